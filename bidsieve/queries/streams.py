"""Streams over the tables' files, each run to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import url as U
from ..functions.nested import idempotency_key
from ..operators.shared import shared_folder
from ..registry import ORACLES, query
from ..sources.tables import read
from ..streaming import jobs as S
from .aggregates import STREAKS
from .duplicates import STAGES, collected
from .scalars import CANONICAL, fold_sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(spark, sf_dir, name).withColumn("ts", F.col("ts").cast("timestamp_ntz")) if name == "events" else read(spark, sf_dir, name)


@query(f"""
WITH p AS (SELECT page_id AS row_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1) AS portal, CASE WHEN page_id % 3 = 0 THEN regexp_replace({CANONICAL}, '/[0-9]+.*$', '') END AS u,
  CASE WHEN page_id % 3 = 1 THEN page_id // 40 END AS e, sha256(coalesce(html, '')) AS r, sha256({fold_sql("regexp_replace(html, '<[^>]*>', ' ', 'g')")}) AS t FROM pages),
f AS (SELECT row_id, u, e, min(row_id) OVER (PARTITION BY u) AS a, min(row_id) OVER (PARTITION BY portal, e) AS b, min(row_id) OVER (PARTITION BY r) AS c, min(row_id) OVER (PARTITION BY t) AS d FROM p),
g AS (SELECT row_id, CASE WHEN u IS NOT NULL AND a < row_id THEN a END AS a, CASE WHEN e IS NOT NULL AND b < row_id THEN b END AS b, CASE WHEN c < row_id THEN c END AS c, CASE WHEN d < row_id THEN d END AS d FROM f)
SELECT row_id, CASE WHEN a IS NOT NULL THEN 'canonical_url' WHEN b IS NOT NULL THEN 'external_id' WHEN c IS NOT NULL THEN 'raw_hash' WHEN d IS NOT NULL THEN 'text_hash' END AS strategy, coalesce(a, b, c, d) AS canonical_id FROM g""")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages come in five batches; each goes through the cascade of address, portal number and hashes against all before it."""
    folder = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    S.ingest(spark, S.in_turn(collected(spark, sf_dir).drop("title"), "row_id", 5), STAGES, folder)
    return spark.read.parquet(f"{folder}/verdicts").drop("n")


@query(f"SELECT DISTINCT regexp_replace({CANONICAL}, '/[0-9]+.*$', '') AS k FROM pages")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are seen a tenth of a second apart."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.regexp_replace(U.canonical(F.col("url")), r"/[0-9]+.*$", "").alias("k"), F.timestamp_micros(F.lit(1704067200000000) + F.col("page_id") * 100000).alias("at"))
    return S.drained(spark, S.dedup(S.in_turn(pages, "page_id"), "k")).select("k")


@query("SELECT user_id, date_trunc('day', ts::TIMESTAMP) AS day, count(*) FILTER (event_type <> 'error') AS successes, sum(CASE WHEN event_type IN ('view', 'error') THEN 0 ELSE floor(value) END)::BIGINT AS items, count(*) FILTER (event_type <> 'error') > 0 AND sum(CASE WHEN event_type IN ('view', 'error') THEN 0 ELSE floor(value) END) = 0 AS empty FROM events GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.told(spark, S.tumbling_counts(S.in_turn(table(spark, sf_dir, "events"), "ts")), ["user_id", "day"])


@query("""
WITH w AS (SELECT event_type, unnest(generate_series(time_bucket(INTERVAL 5 MINUTE, ts::TIMESTAMP) - INTERVAL 25 MINUTE, time_bucket(INTERVAL 5 MINUTE, ts::TIMESTAMP), INTERVAL 5 MINUTE)) AS start FROM events)
SELECT start, count(*) FILTER (event_type = 'error') AS failures, count(*) AS runs, count(*) FILTER (event_type = 'error') / count(*)::DOUBLE > 0.5 AS alert FROM w GROUP BY 1""")
def sliding_failure_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.told(spark, S.sliding_failures(S.in_turn(table(spark, sf_dir, "events"), "ts")), ["start"])


@query("""
WITH w AS (SELECT event_type, unnest(generate_series(time_bucket(INTERVAL 5 MINUTE, ts::TIMESTAMP) - INTERVAL 10 MINUTE, time_bucket(INTERVAL 5 MINUTE, ts::TIMESTAMP), INTERVAL 5 MINUTE)) AS start FROM events)
SELECT start, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type = 'error') / 900::DOUBLE AS rate, count(*) FILTER (event_type = 'error') / 900::DOUBLE > 0.002 AS alert FROM w GROUP BY 1""")
def parse_failure_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's errors are few: the alert is set at 2 in 1000 seconds instead of one a second."""
    return S.told(spark, S.failure_rates(S.in_turn(table(spark, sf_dir, "events"), "ts"), 0.002), ["start"])


def stream_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = S.in_turn(table(spark, sf_dir, "events"), "ts")
    return events.select(F.col("event_id").alias("run_id"), F.col("user_id").alias("source_key"), "at", "event_type", (F.col("event_type") == "error").alias("failed"), F.when(F.col("event_type").isin("view", "error"), F.lit(0)).otherwise(F.floor("value")).cast("long").alias("items"))


@query(f"WITH {STREAKS} SELECT h.source_key, failures, successes, empties, state, epoch_ms(l.last) + 26 * 3600000 <= epoch_ms(m.newest) - 3600000 AS silent FROM health h JOIN (SELECT user_id AS source_key, max(ts)::TIMESTAMP AS last FROM events GROUP BY 1) l USING (source_key), (SELECT max(ts)::TIMESTAMP AS newest FROM events) m")
def stateful_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state per source that the stream has told, and whether it has been silent since."""
    return S.told(spark, S.stateful_health(stream_runs(spark, sf_dir)), ["source_key"])


@query(ORACLES["circuit_timeline"])
def stream_circuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The breaker of each source as a stream's state, over four batches."""
    return S.drained(spark, S.circuit_timeline(stream_runs(spark, sf_dir).withColumn("failed", F.col("event_type").isin("error", "view", "click"))))


@query("""
WITH r AS (SELECT event_id, sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY epoch_us(ts::TIMESTAMP) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)::BIGINT AS recent FROM events)
SELECT event_id, recent, recent > 2 AS suppressed FROM r""")
def stream_rolling_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drained(spark, S.rolling_cap(S.in_turn(table(spark, sf_dir, "events"), "ts")))


@query("""
WITH b AS (SELECT k, (SELECT max(ts) FROM events WHERE event_id % 4 < k) AS newest FROM range(4) AS r(k))
SELECT event_id, coalesce(ts < newest - INTERVAL 10 DAY, FALSE) AS late FROM events JOIN b ON k = event_id % 4""")
def stale_discard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events come out of order, in four batches; those further behind the newest seen before than ten days go aside."""
    folder = f"{shared_folder(spark)}/late-{uuid.uuid4().hex}"
    S.split_late(spark, S.sliced(table(spark, sf_dir, "events"), F.col("event_id") % 4, 4), "10 days", folder)
    return spark.read.parquet(f"{folder}/rows").select("event_id", F.col("late").cast("boolean").alias("late"))


@query("SELECT substr(sha256(event_id || chr(31) || event_type), 1, 32) AS key FROM events")
def replay_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is delivered twice; each key is taken once."""
    deliveries = S.in_turn(table(spark, sf_dir, "events"), "ts").select("at", F.explode(F.array_repeat(idempotency_key("event_id", "event_type"), 2)).alias("key"))
    return S.drained(spark, S.once(deliveries, "key"))
