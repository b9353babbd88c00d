"""Dashboard aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .maintenance import job_status


def overview(notices: DataFrame, now: Column) -> DataFrame:
    """All counters of the header in one pass. Open here leaves out closed and cancelled notices."""
    live = (F.col("deadline").isNull() | (F.col("deadline") >= now)) & ~F.col("status").isin("closed", "cancelled")
    day = lambda n: F.make_dt_interval(days=F.lit(n))
    closing = F.col("deadline").between(now, now + day(7)) & F.col("band").isin("highly_relevant", "relevant")
    return notices.agg(F.count("*").alias("total"), F.count_if(live).alias("open"), (F.count("*") - F.count_if(live)).alias("archived"), F.count_if(F.col("publication") >= now - day(1)).alias("last_day"), F.count_if(closing).alias("closing"))


def shares(rows: DataFrame, key: str) -> DataFrame:
    """Counts per key with their share of all and of the largest; the windows see one row per key."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    everything = counts.agg(F.sum("n").alias("_all"), F.max("n").alias("_most"))
    return counts.join(F.broadcast(everything)).select(key, "n", F.round(F.col("n") / F.col("_all"), 6).alias("share"), F.round(F.col("n") / F.col("_most"), 6).alias("of_largest"))


def completeness(rows: DataFrame, attachments: DataFrame, thin: int = 3000, cap: int = 500_000) -> DataFrame:
    """What is missing. `without_document` takes all stored parents from the count in scope, as users know it, and may be negative; `without_document_in_scope` counts what it says."""
    stored = attachments.where("status = 'stored'").select("notice_id").distinct()
    here = rows.join(stored.withColumn("_stored", F.lit(True)), "notice_id", "left")
    counts = here.agg(
        F.count("*").alias("in_scope"), F.count_if(F.col("_stored").isNull()).alias("without_document_in_scope"), F.count_if(F.col("chars") == 0).alias("no_text"), F.count_if((F.col("chars") > 0) & (F.col("chars") < thin)).alias("thin"),
        F.count_if(F.col("chars") > 0).alias("with_text"), F.count_if(F.col("chars") >= cap - 200).alias("truncated"),
    )
    return counts.join(F.broadcast(stored.agg(F.count("*").alias("_n")))).withColumn("without_document", F.col("in_scope") - F.col("_n")).drop("_n")


def failure_reasons(attachments: DataFrame, most: int = 10) -> DataFrame:
    return attachments.where("status = 'failed'").groupBy(F.coalesce("error", F.lit("unspecified")).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(most)


def job_rollup(runs: DataFrame) -> DataFrame:
    counts = runs.groupBy("job_id").agg(F.count("*").alias("runs"), F.count_if(F.col("status").isin("running", "pending")).alias("unfinished"), F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.sum("items").alias("items"))
    return counts.withColumn("progress", F.round((F.col("runs") - F.col("unfinished")) / F.col("runs"), 4)).withColumn("status", job_status(F.col("runs"), F.col("unfinished"), F.col("succeeded")))


def run_summary(runs: DataFrame) -> DataFrame:
    counts = runs.groupBy("source_key").agg(F.count("*").alias("runs"), F.sum("items").alias("parsed"), F.sum("kept").alias("kept"), F.count_if("failed").alias("failures"))
    return counts.withColumn("status", F.when(F.col("failures") == F.col("runs"), "failed").when(F.col("failures") > 0, "partial").otherwise("succeeded"))


def source_totals(runs: DataFrame) -> DataFrame:
    ok, bad = ~F.col("failed"), F.col("failed")
    return runs.groupBy("source_key").agg(
        F.count("*").alias("runs"), F.round(F.count_if(ok) / F.count("*"), 6).alias("success_rate"), F.sum("items").alias("items"), F.max(F.when(ok, F.col("ts"))).alias("last_success"),
        F.max(F.when(bad, F.col("ts"))).alias("last_failure"), F.max_by("run_id", F.when(bad, F.struct("ts", "run_id"))).alias("last_failed_run"),
    )


def audit_verdict(runs: DataFrame, cap: int) -> DataFrame:
    """Alerts of a source's runs: nothing kept, most discarded here, cap reached without result."""
    counts = runs.groupBy("source_key").agg(F.sum("items").alias("parsed"), F.sum("kept").alias("kept"), F.max("items").alias("most"))
    some = F.col("parsed") > 0
    alerts = F.array_compact(F.array(F.when(some & (F.col("kept") == 0), F.lit("nothing_kept")), F.when(some & ((F.col("parsed") - F.col("kept")) / F.col("parsed") > 0.5), F.lit("mostly_discarded")), F.when((F.col("most") >= cap) & (F.col("kept") == 0), F.lit("cap_without_result"))))
    return counts.select("source_key", alerts.alias("alerts"))


def sketched(rows: DataFrame, keys: list[str], column: str, k: int = 400) -> DataFrame:
    """A quantile sketch of a column per key, some kB whatever the rows: what is kept of a day, to be merged for any span of days."""
    return rows.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(column).cast("double"), F.lit(k)).alias("sketch"))


def merged_quantile(sketches: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The quantile of the united rows, from their sketches: keys and estimate."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch")).select(*keys, F.kll_sketch_get_quantile_double("sketch", F.lit(share)).alias("estimate"))


def histogram(rows: DataFrame, column: str, bounds: list[float]) -> DataFrame:
    """Counts per bucket (by its lower bound), running totals, and the 95th percentile of all."""
    bucket = F.lit(None).cast("double")
    for low in bounds:
        bucket = F.when(F.col(column) >= low, low).otherwise(bucket)
    counts = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    running = counts.withColumn("cumulative", F.sum("n").over(Window.orderBy("bucket")))
    return running.join(F.broadcast(rows.agg(F.round(F.percentile(column, F.lit(0.95)), 6).alias("p95"))))
