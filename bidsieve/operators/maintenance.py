"""Upkeep of tables, each as a rewrite of the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def derived_status(now: Column) -> Column:
    """Struct of status and derived: an unknown status follows from the deadline."""
    open_ended = (F.col("status") == "unknown") & F.col("deadline").isNotNull()
    return F.struct(F.when(open_ended, F.when(F.col("deadline") > now, "open").otherwise("closed")).otherwise(F.col("status")).alias("status"), open_ended.alias("derived"))


def close_expired(notices: DataFrame, now: Column) -> DataFrame:
    """Open and unknown notices past their deadline become closed; `changed` tells which."""
    due = F.col("status").isin("open", "unknown") & F.coalesce(F.col("deadline") < now, F.lit(False))
    return notices.withColumn("changed", due).withColumn("status", F.when(due, "closed").otherwise(F.col("status")))


def purge_expired(notices: DataFrame, children: DataFrame, now: Column, months: int = 6) -> tuple[DataFrame, DataFrame]:
    """Notices whose deadline isn't older than int(months x 30.44) days, and the children of these only."""
    old = F.coalesce(F.col("deadline") < now - F.make_dt_interval(days=F.lit(int(months * 30.44))), F.lit(False))
    gone = notices.where(old).select("notice_id")
    return notices.where(~old), children.join(gone, "notice_id", "left_anti")


def purge_logs(rows: DataFrame, now: Column, days: int = 180) -> DataFrame:
    """Rows but for those of level debug or info that are older than `days`."""
    return rows.where(~(F.lower("level").isin("debug", "info") & (F.col("ts") < now - F.make_dt_interval(days=F.lit(days)))))


def reconcile_stuck(runs: DataFrame, now: Column, minutes: int = 90) -> tuple[DataFrame, DataFrame]:
    """Runs pending or running for more than `minutes` time out; jobs without an unfinished run then get their status."""
    stuck = F.col("status").isin("pending", "running") & (F.col("ts") < now - F.make_dt_interval(mins=F.lit(minutes)))
    settled = runs.withColumn("status", F.when(stuck, "timed_out").otherwise(F.col("status")))
    jobs = settled.groupBy("job_id").agg(F.count("*").alias("runs"), F.count_if(F.col("status").isin("pending", "running")).alias("unfinished"), F.count_if(F.col("status") == "succeeded").alias("succeeded"))
    return settled, jobs.withColumn("status", job_status(F.col("runs"), F.col("unfinished"), F.col("succeeded")))


def job_status(runs: Column, unfinished: Column, succeeded: Column) -> Column:
    return F.when(unfinished > 0, "running").when(succeeded == runs, "succeeded").when(succeeded == 0, "failed").otherwise("partial")


def cancel_runs(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Pending runs of jobs to cancel become cancelled; running ones go on; terminal jobs are refused (no change)."""
    wanted = jobs.where(~F.col("job_status").isin("succeeded", "failed", "partial", "cancelled")).select("job_id", F.lit(True).alias("_cancel")).distinct()
    hit = (F.col("status") == "pending") & F.coalesce("_cancel", F.lit(False))
    return runs.join(wanted, "job_id", "left").withColumn("status", F.when(hit, "cancelled").otherwise(F.col("status"))).drop("_cancel")


def requeue_stalled(rows: DataFrame, now: Column, minutes: int = 30, most: int = 500) -> DataFrame:
    """The oldest rows in a working state for more than `minutes`, `most` of them."""
    return rows.where(F.col("state").isin("extracting", "scoring") & (F.col("ts") < now - F.make_dt_interval(mins=F.lit(minutes)))).orderBy("ts", "row_id").limit(most)


def flush_pending(rows: DataFrame, now: Column, minutes: int = 5, attempts: int = 3) -> DataFrame:
    """Pending deliveries older than `minutes` with attempts left."""
    return rows.where((F.col("status") == "pending") & (F.col("ts") < now - F.make_dt_interval(mins=F.lit(minutes))) & (F.col("attempts") < attempts))
