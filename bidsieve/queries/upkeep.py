"""Table maintenance and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import ATTACHMENTS, NOTICES, attachments, events_now, notices, now
from ..operators import maintenance as M
from ..registry import query
from ..sources.tables import read
from .aggregates import ENOW, JOBS, NOW, STATUS, job_runs


@query(f"WITH {NOTICES} SELECT notice_id, CASE WHEN status IN ('open', 'unknown') AND deadline < {NOW} THEN 'closed' ELSE status END AS status, coalesce(status IN ('open', 'unknown') AND deadline < {NOW}, FALSE) AS changed FROM notices")
def close_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.close_expired(notices(spark, sf_dir), now()).select("notice_id", "status", "changed")


@query(f"""
WITH {NOTICES}, {ATTACHMENTS}, k AS (SELECT notice_id FROM notices WHERE deadline IS NULL OR deadline >= {NOW} - INTERVAL 182 DAY)
SELECT 'notice' AS kind, notice_id, 0 AS position FROM k UNION ALL SELECT 'attachment', notice_id, position FROM attachments WHERE notice_id IN (SELECT notice_id FROM k)""")
def purge_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, children = M.purge_expired(notices(spark, sf_dir), attachments(spark, sf_dir), now())
    return kept.select(F.lit("notice").alias("kind"), "notice_id", F.lit(0).alias("position")).unionByName(children.select(F.lit("attachment").alias("kind"), "notice_id", "position"))


@query(f"SELECT event_id FROM events WHERE NOT (event_type IN ('view', 'click') AND ts < {ENOW} - INTERVAL 10 DAY)")
def purge_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.expr("case event_type when 'view' then 'DEBUG' when 'click' then 'INFO' else 'ERROR' end").alias("level"))
    return M.purge_logs(rows, events_now(), 10).select("event_id")


@query(f"""
WITH {JOBS}, s AS (SELECT job_id, CASE WHEN status = 'running' AND ts < {ENOW} - INTERVAL 5 DAY THEN 'timed_out' ELSE status END AS status FROM j),
g AS (SELECT job_id, count(*) AS runs, count(*) FILTER (status = 'running') AS unfinished, count(*) FILTER (status = 'succeeded') AS succeeded FROM s GROUP BY 1) SELECT job_id, runs, unfinished, {STATUS} AS status FROM g""")
def reconcile_stuck(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, jobs = M.reconcile_stuck(job_runs(spark, sf_dir), events_now(), 5 * 24 * 60)
    return jobs.select("job_id", "runs", "unfinished", "status")


@query(f"""
WITH {JOBS} SELECT run_id, CASE WHEN run_id % 7 = 0 AND source_key % 2 = 0 AND source_key % 10 <> 0 THEN 'cancelled' WHEN run_id % 7 = 0 THEN 'pending' ELSE status END AS status FROM j""")
def cancel_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = job_runs(spark, sf_dir).withColumn("status", F.when(F.col("run_id") % 7 == 0, "pending").otherwise(F.col("status")))
    jobs = rows.where("source_key % 2 = 0").select("job_id", F.when(F.col("source_key") % 10 == 0, "succeeded").otherwise("running").alias("job_status")).distinct()
    return M.cancel_runs(rows, jobs).select("run_id", "status")


@query(f"SELECT event_id AS row_id FROM events WHERE event_type IN ('view', 'click') AND ts < {ENOW} - INTERVAL 30 MINUTE ORDER BY ts, event_id LIMIT 500")
def requeue_stalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.expr("case event_type when 'view' then 'extracting' when 'click' then 'scoring' else 'done' end").alias("state"))
    return M.requeue_stalled(rows, events_now()).select("row_id")


@query(f"SELECT event_id FROM events WHERE event_type = 'signup' AND ts < {ENOW} - INTERVAL 5 MINUTE AND event_id % 5 < 3")
def flush_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.expr("case event_type when 'signup' then 'pending' else 'sent' end").alias("status"), (F.col("event_id") % 5).alias("attempts"))
    return M.flush_pending(rows, events_now()).select("event_id")
