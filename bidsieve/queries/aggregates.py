"""Dashboards, roll-ups, windows over runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import ATTACHMENTS, NOTICES, RUNS, attachments, events_now, now, runs
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import windows as W
from ..registry import query
from ..sources.tables import read
from .scoring import scored
from .sqltext import SCORED

NOW = "TIMESTAMP '1998-06-01'"
ENOW = "TIMESTAMP '2024-01-31'"


@query(f"""
WITH {NOTICES}, {SCORED} SELECT count(*) AS total, count(*) FILTER ((deadline IS NULL OR deadline >= {NOW}) AND status NOT IN ('closed', 'cancelled')) AS open, count(*) - count(*) FILTER ((deadline IS NULL OR deadline >= {NOW}) AND status NOT IN ('closed', 'cancelled')) AS archived,
  count(*) FILTER (publication >= {NOW} - INTERVAL 1 DAY) AS last_day, count(*) FILTER (deadline BETWEEN {NOW} AND {NOW} + INTERVAL 7 DAY AND band IN ('relevant', 'highly_relevant')) AS closing FROM scored""")
def overview_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.overview(scored(spark, sf_dir), now())


@query(f"WITH {NOTICES}, {SCORED} SELECT band, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share, round(count(*) / max(count(*)) OVER ()::DOUBLE, 6) AS of_largest FROM scored GROUP BY 1")
def count_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.shares(scored(spark, sf_dir), "band")


@query("SELECT source, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share, round(count(*) / max(count(*)) OVER ()::DOUBLE, 6) AS of_largest FROM documents GROUP BY 1")
def count_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.shares(read(spark, sf_dir, "documents"), "source")


@query(f"""
WITH {NOTICES}, {ATTACHMENTS}, {SCORED}, i AS (SELECT notice_id, CASE WHEN notice_id % 9 = 0 THEN 0 ELSE notice_id % 5000 END AS chars FROM scored WHERE notice_id % 17 <> 0), st AS (SELECT DISTINCT notice_id FROM attachments WHERE status = 'stored' AND position = 1)
SELECT (SELECT count(*) FROM i) AS in_scope, (SELECT count(*) FROM i) - (SELECT count(*) FROM st) AS without_document, (SELECT count(*) FROM i WHERE notice_id NOT IN (SELECT notice_id FROM st)) AS without_document_in_scope,
  (SELECT count(*) FROM i WHERE chars = 0) AS no_text, (SELECT count(*) FROM i WHERE chars > 0 AND chars < 3000) AS thin, (SELECT count(*) FROM i WHERE chars > 0) AS with_text, (SELECT count(*) FROM i WHERE chars >= 4800) AS truncated""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).where("notice_id % 17 <> 0").select("notice_id", F.expr("case when notice_id % 9 = 0 then 0 else notice_id % 5000 end").alias("chars"))
    return A.completeness(rows, attachments(spark, sf_dir).where("position = 1"), cap=5000)


@query(f"WITH {ATTACHMENTS} SELECT coalesce(error, 'unspecified') AS reason, count(*) AS n FROM attachments WHERE status = 'failed' GROUP BY 1 ORDER BY n DESC, reason LIMIT 10")
def failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.failure_reasons(attachments(spark, sf_dir))


JOBS = f"{RUNS}, j AS (SELECT *, source_key || '/' || strftime(ts, '%Y-%m-%d') AS job_id, CASE WHEN run_id % 19 = 0 THEN 'running' WHEN failed THEN 'failed' ELSE 'succeeded' END AS status FROM runs)"


def job_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).withColumn("job_id", F.concat_ws("/", "source_key", F.date_format("ts", "yyyy-MM-dd"))).withColumn("status", F.expr("case when run_id % 19 = 0 then 'running' when failed then 'failed' else 'succeeded' end"))


STATUS = "CASE WHEN unfinished > 0 THEN 'running' WHEN succeeded = runs THEN 'succeeded' WHEN succeeded = 0 THEN 'failed' ELSE 'partial' END"


@query(f"""
WITH {JOBS}, g AS (SELECT job_id, count(*) AS runs, count(*) FILTER (status = 'running') AS unfinished, count(*) FILTER (status = 'succeeded') AS succeeded, sum(items)::BIGINT AS items FROM j GROUP BY 1)
SELECT job_id, runs, unfinished, succeeded, items, round((runs - unfinished) / runs::DOUBLE, 4) AS progress, {STATUS} AS status FROM g""")
def job_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.job_rollup(job_runs(spark, sf_dir))


@query(f"""
WITH {RUNS} SELECT source_key, count(*) AS runs, sum(items)::BIGINT AS parsed, sum(items - items // 3)::BIGINT AS kept, count(*) FILTER (failed) AS failures, CASE WHEN count(*) FILTER (failed) = count(*) THEN 'failed' WHEN count(*) FILTER (failed) > 0 THEN 'partial' ELSE 'succeeded' END AS status FROM runs GROUP BY 1""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.run_summary(runs(spark, sf_dir).withColumn("kept", F.col("items") - F.expr("items div 3")))


@query(f"""
WITH {RUNS} SELECT source_key, count(*) AS runs, round(count(*) FILTER (NOT failed) / count(*)::DOUBLE, 6) AS success_rate, sum(items)::BIGINT AS items, max(ts) FILTER (NOT failed) AS last_success, max(ts) FILTER (failed) AS last_failure, arg_max(run_id, (ts, run_id)) FILTER (failed) AS last_failed_run FROM runs GROUP BY 1""")
def source_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.source_totals(runs(spark, sf_dir))


@query(f"""
WITH {RUNS}, g AS (SELECT source_key, sum(items) AS parsed, sum(CASE WHEN run_id % 3 = 0 THEN 0 ELSE items END) AS kept, max(items) AS most FROM runs GROUP BY 1)
SELECT source_key, concat_ws(',', CASE WHEN parsed > 0 AND kept = 0 THEN 'nothing_kept' END, CASE WHEN parsed > 0 AND (parsed - kept) / parsed::DOUBLE > 0.5 THEN 'mostly_discarded' END, CASE WHEN most >= 100 AND kept = 0 THEN 'cap_without_result' END) AS alerts FROM g""")
def run_audit_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.audit_verdict(runs(spark, sf_dir).withColumn("kept", F.expr("case when run_id % 3 = 0 then 0 else items end")), cap=100).withColumn("alerts", F.array_join("alerts", ","))


@query("""
WITH b(least) AS (VALUES (0), (5), (10), (25), (50), (100)), e AS (SELECT *, (SELECT max(least) FROM b WHERE least <= value) AS bucket FROM events WHERE value >= 0), g AS (SELECT bucket, count(*) AS n FROM e GROUP BY 1)
SELECT bucket::DOUBLE AS bucket, n, sum(n) OVER (ORDER BY bucket)::BIGINT AS cumulative, (SELECT round(quantile_cont(value, 0.95), 6) FROM e) AS p95 FROM g""")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.histogram(read(spark, sf_dir, "events").where("value >= 0"), "value", [0.0, 5.0, 10.0, 25.0, 50.0, 100.0])


@query("""
WITH s AS (SELECT event_type AS stage, abs(value) AS seconds FROM events UNION ALL SELECT 'size', o_totalprice FROM orders)
SELECT stage, count(*) AS n, round(quantile_cont(seconds, 0.95), 6) AS p95, TRUE AS sketch_holds FROM s WHERE seconds IS NOT NULL GROUP BY 1""")
def stage_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds by stage and sizes: the exact 95th percentile, and whether the merged sketches are within a hundredth of its rank."""
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.abs("value").alias("seconds"), F.to_date("ts").alias("day"))
    rows = rows.unionByName(read(spark, sf_dir, "orders").select(F.lit("size").alias("stage"), F.col("o_totalprice").alias("seconds"), F.to_date("o_orderdate").alias("day")))
    daily = A.sketched(rows, ["stage", "day"], "seconds")
    estimate = A.merged_quantile(daily, ["stage"], 0.95)
    exact = rows.where("seconds is not null").join(F.broadcast(estimate), "stage").groupBy("stage", "estimate").agg(F.count("*").alias("n"), F.round(F.percentile("seconds", F.lit(0.95)), 6).alias("p95"), F.count_if(F.col("seconds") < F.col("estimate")).alias("below"), F.count_if(F.col("seconds") <= F.col("estimate")).alias("upto"))
    holds = (F.col("below") <= 0.96 * F.col("n") + 1) & (F.col("upto") >= 0.94 * F.col("n") - 1)
    return exact.select("stage", "n", "p95", holds.alias("sketch_holds"))


@query("SELECT r_name AS zone, count(*) AS countries, string_agg(n_name, '|' ORDER BY n_name) AS names FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def reference_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "region").join(read(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    return both.groupBy(F.col("r_name").alias("zone")).agg(F.count("*").alias("countries"), F.array_join(F.sort_array(F.collect_list("n_name")), "|").alias("names"))


@query("SELECT user_id, event_id, ts::TIMESTAMP AS ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.latest(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("SELECT user_id, event_id, r AS position FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 50")
def history_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.latest(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 50).select("user_id", "event_id", F.col("position").cast("long").alias("position"))


STREAKS = f"""{RUNS}, isl AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER w AS f, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER w AS s, sum(CASE WHEN NOT failed AND items = 0 THEN 0 ELSE 1 END) OVER w AS e FROM runs WINDOW w AS (PARTITION BY source_key ORDER BY ts, run_id)),
streaked AS (SELECT run_id, source_key, ts, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY source_key, f ORDER BY ts, run_id)::BIGINT AS failures, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY source_key, s ORDER BY ts, run_id)::BIGINT AS successes,
  sum(CASE WHEN NOT failed AND items = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source_key, e ORDER BY ts, run_id)::BIGINT AS empties FROM isl),
health AS (SELECT source_key, failures, successes, empties, ts AS last_run, CASE WHEN failures >= 3 THEN 'failing' WHEN failures >= 1 OR empties >= 3 THEN 'degraded' ELSE 'healthy' END AS state FROM (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY ts DESC, run_id DESC) AS r FROM streaked) WHERE r = 1)"""


@query(f"WITH {STREAKS} SELECT run_id, failures, successes, empties FROM streaked")
def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.streaks(runs(spark, sf_dir)).select("run_id", "failures", "successes", "empties")


@query(f"""
WITH {STREAKS}, last AS (SELECT user_id AS source_key, arg_max(CASE WHEN event_id % 2 = 0 THEN 'Timeout' ELSE 'unknown error' END, (ts, event_id)) AS error FROM events GROUP BY 1),
known AS (SELECT source_key, source_key % 17 <> 0 AS enabled, source_key % 13 = 0 AS missing FROM health UNION ALL SELECT -1, TRUE, TRUE UNION ALL SELECT -2, TRUE, FALSE)
SELECT k.source_key, coalesce(failures, 0) AS failures, coalesce(successes, 0) AS successes, coalesce(empties, 0) AS empties, last_run, CASE WHEN NOT enabled THEN 'disabled' WHEN missing THEN 'credentials_missing' ELSE coalesce(state, 'healthy') END AS state,
  CASE WHEN NOT enabled OR missing THEN NULL WHEN failures >= 3 THEN failures || ' consecutive failures (' || error || ')' WHEN failures >= 1 THEN 'Last run failed: ' || error WHEN empties >= 3 THEN empties || ' consecutive runs returned no items — the portal markup may have changed.' END AS reason
FROM known k LEFT JOIN health USING (source_key) LEFT JOIN last USING (source_key)""")
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some sources are disabled, some lack their credentials, two never ran."""
    made = runs(spark, sf_dir)
    sources = made.select("source_key").distinct().select("source_key", (F.col("source_key") % 17 != 0).alias("enabled"), (F.col("source_key") % 13 == 0).alias("credentials_missing"))
    sources = sources.unionAll(spark.createDataFrame([(-1, True, True), (-2, True, False)], "source_key long, enabled boolean, credentials_missing boolean"))
    return W.health(W.streaks(made.withColumn("error_type", F.when(F.col("run_id") % 2 == 0, "Timeout"))), sources)


@query(f"WITH {STREAKS} SELECT source_key, 'silent' AS alert FROM health WHERE last_run < {ENOW} - INTERVAL 26 HOUR UNION ALL SELECT source_key, state FROM health WHERE state <> 'healthy'")
def silence_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.silence_alerts(W.health(W.streaks(runs(spark, sf_dir))), events_now())


@query("""
WITH r AS (SELECT event_id, sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY epoch_us(ts::TIMESTAMP) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)::BIGINT AS recent FROM events)
SELECT event_id, recent, recent > 2 AS suppressed FROM r""")
def rolling_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return W.rolling_cap(rows, "user_id", F.col("event_type").isin("view", "click"), 2).select("event_id", "recent", "suppressed")


@query(f"""
WITH RECURSIVE {RUNS}, r AS MATERIALIZED (SELECT source_key, run_id, event_type IN ('error', 'view', 'click') AS bad, epoch_us(ts) / 1e6 AS moment, row_number() OVER (PARTITION BY source_key ORDER BY ts, run_id) AS n FROM runs),
s AS (
  SELECT source_key, 0::BIGINT AS n, NULL::BIGINT AS run_id, NULL::VARCHAR AS met, 'closed' AS state, 0 AS failed, 0 AS won, 0 AS used, 0::DOUBLE AS opened FROM r WHERE n = 1
  UNION ALL SELECT source_key, n, run_id, met,
    CASE WHEN met = 'half_open' AND bad OR met = 'closed' AND bad AND failed + 1 >= 5 THEN 'open' WHEN met = 'half_open' AND won + 1 >= 2 THEN 'closed' WHEN met = 'half_open_refused' THEN 'half_open' ELSE met END,
    CASE WHEN met = 'closed' THEN CASE WHEN bad THEN failed + 1 ELSE 0 END WHEN met = 'half_open' AND NOT bad AND won + 1 >= 2 THEN 0 ELSE failed END,
    CASE WHEN met = 'half_open' AND NOT bad THEN won + 1 ELSE won END, CASE WHEN met = 'half_open' THEN used + 1 ELSE used END,
    CASE WHEN met = 'half_open' AND bad OR met = 'closed' AND bad AND failed + 1 >= 5 THEN moment ELSE opened END
  FROM (SELECT *, CASE WHEN turned = 'half_open' AND used >= 1 THEN 'half_open_refused' ELSE turned END AS met FROM (
    SELECT source_key, n, run_id, bad, moment, opened, failed, CASE WHEN fresh THEN 'half_open' ELSE was END AS turned, CASE WHEN fresh THEN 0 ELSE won END AS won, CASE WHEN fresh THEN 0 ELSE used END AS used FROM (
      SELECT r.*, s.opened, s.won, s.used, CASE WHEN s.state <> 'closed' AND r.moment - s.opened >= 6000 THEN 'closed' ELSE s.state END AS was, CASE WHEN s.state <> 'closed' AND r.moment - s.opened >= 6000 THEN 0 ELSE s.failed END AS failed,
        s.state = 'open' AND r.moment - s.opened >= 600 AND r.moment - s.opened < 6000 AS fresh FROM s JOIN r ON r.source_key = s.source_key AND r.n = s.n + 1))))
SELECT run_id, source_key, met AS circuit FROM s WHERE n > 0""")
def circuit_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.circuit_timeline(runs(spark, sf_dir).withColumn("failed", F.col("event_type").isin("error", "view", "click")))


@query(f"""
WITH {ATTACHMENTS} SELECT notice_id, position, name, row_number() OVER (PARTITION BY notice_id ORDER BY CASE WHEN contains(name, 'cahier') THEN 0 ELSE 1 END, name, position) AS rank, row_number() OVER (PARTITION BY notice_id ORDER BY CASE WHEN contains(name, 'cahier') THEN 0 ELSE 1 END, name, position) > 3 AS over_limit FROM attachments""")
def top_documents_per_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.top_documents(attachments(spark, sf_dir), 3).select("notice_id", "position", "name", F.col("rank").cast("long").alias("rank"), "over_limit")


@query("""
WITH t AS (SELECT source || '/' || lang || '/' || (doc_id % 100) AS k, doc_id, CASE WHEN doc_id % 4 > 0 THEN text END AS text, CASE WHEN doc_id % 8 = 0 THEN 'encrypted' END AS error, CASE WHEN doc_id % 3 = 0 THEN 'ocr' ELSE 'digital' END AS method FROM documents)
SELECT k, sha256(coalesce(substr(string_agg('=== doc ' || doc_id || ' ===' || chr(10) || text, chr(10) || chr(10) ORDER BY doc_id) FILTER (length(text) > 0), 1, 500000), '')) AS text, count(*) FILTER (length(text) > 0) AS documents,
  CASE WHEN count(*) FILTER (length(text) > 0) = 0 THEN 'none' WHEN count(DISTINCT method) FILTER (length(text) > 0) > 1 THEN 'mixed' ELSE max(method) FILTER (length(text) > 0) END AS method,
  substr(string_agg('doc ' || doc_id || ': ' || error, '; ' ORDER BY doc_id) FILTER (error IS NOT NULL AND coalesce(text, '') = ''), 1, 2000) AS errors,
  CASE WHEN count(*) FILTER (length(text) > 0) > 0 THEN 'extracted' WHEN count(*) FILTER (error IS NOT NULL AND coalesce(text, '') = '') > 0 THEN 'failed' ELSE 'empty' END AS status FROM t GROUP BY 1""")
def merge_document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", (F.col("doc_id") % 100).cast("string")).alias("k"), "doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"), F.expr("case when doc_id % 4 > 0 then text end").alias("text"), F.expr("case when doc_id % 8 = 0 then 'encrypted' end").alias("error"), F.expr("case when doc_id % 3 = 0 then 'ocr' else 'digital' end").alias("method"))
    return W.merged_text(rows, "k", ["doc_id"]).withColumn("text", F.sha2("text", 256))
