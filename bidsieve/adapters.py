"""The general tables seen as notices, attachments, runs and so on; each with its SQL twin for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.tables import read, spread

#: The clock: every operator takes it as a literal.
NOW = "1998-06-01 00:00:00"
EVENTS_NOW = "2024-01-31 00:00:00"


def now() -> F.Column:
    return F.lit(NOW).cast("timestamp_ntz")


def events_now() -> F.Column:
    return F.lit(EVENTS_NOW).cast("timestamp_ntz")


def notices(spark: SparkSession, sf_dir: str, costly: bool = False) -> DataFrame:
    """Orders as notices; dealt out to all cores where what follows is costly."""
    orders, customer, nation, region = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    orders = spread(orders) if costly else orders
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("o_orderkey").alias("notice_id"),
            F.concat(F.lit("Notice "), F.col("o_orderkey").cast("string"), F.lit(" "), F.lower("c_mktsegment"), F.lit(" "), F.col("o_orderpriority")).alias("title"),
            F.col("c_name").alias("buyer"),
            F.col("n_name").alias("country"),
            F.col("r_name").alias("zone"),
            F.col("c_mktsegment").alias("sector"),
            F.col("o_orderdate").cast("timestamp_ntz").alias("publication"),
            F.expr("case when o_orderkey % 11 = 0 then null else cast(o_orderdate as timestamp_ntz) + make_dt_interval(cast(o_orderkey % 200 as int)) end").alias("deadline"),
            F.expr("case when o_orderkey % 7 = 0 then null else o_totalprice end").alias("budget"),
            F.expr("case o_orderkey % 4 when 0 then 'EUR' when 1 then 'TND' when 2 then 'USD' else 'XOF' end").alias("currency"),
            F.expr("case o_orderstatus when 'O' then 'open' when 'F' then 'closed' else 'unknown' end").alias("status"),
            F.expr("case substring(o_orderpriority, 1, 1) when '1' then 'open' when '2' then 'restricted' when '3' then 'negotiated' when '4' then 'framework_agreement' else 'unknown' end").alias("procedure"),
        )
    )


NOTICES = """notices AS (
  SELECT o_orderkey AS notice_id, 'Notice ' || o_orderkey || ' ' || lower(c_mktsegment) || ' ' || o_orderpriority AS title, c_name AS buyer, n_name AS country, r_name AS zone, c_mktsegment AS sector,
    o_orderdate::TIMESTAMP AS publication, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate::TIMESTAMP + to_days((o_orderkey % 200)::INT) END AS deadline,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS budget,
    CASE o_orderkey % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'TND' WHEN 2 THEN 'USD' ELSE 'XOF' END AS currency,
    CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'unknown' END AS status,
    CASE o_orderpriority[1] WHEN '1' THEN 'open' WHEN '2' THEN 'restricted' WHEN '3' THEN 'negotiated' WHEN '4' THEN 'framework_agreement' ELSE 'unknown' END AS procedure
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CPV-like codes of each notice."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.element_at(F.array(*map(F.lit, ("72", "48", "79", "45", "39"))), (F.col("p_size") % 5 + 1).cast("int")), F.lpad((F.col("p_partkey") % 1000000).cast("string"), 6, "0")).alias("code"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("notice_id")).agg(F.sort_array(F.collect_set("code")).alias("cpv_codes"))


CODES = """codes AS (
  SELECT l_orderkey AS notice_id, list_sort(list_distinct(list(CASE p_size % 5 WHEN 0 THEN '72' WHEN 1 THEN '48' WHEN 2 THEN '79' WHEN 3 THEN '45' ELSE '39' END || lpad((p_partkey % 1000000)::VARCHAR, 6, '0')))) AS cpv_codes
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"""


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("notice_id"),
        F.col("l_linenumber").alias("position"),
        F.expr("concat(case l_linenumber % 3 when 0 then 'cahier des charges ' when 1 then 'annexe ' else 'avis ' end, cast(l_partkey as string), case l_linenumber % 2 when 0 then '.pdf' else '.docx' end)").alias("name"),
        F.expr("case l_returnflag when 'A' then 'stored' when 'R' then 'failed' else 'pending' end").alias("status"),
        F.expr("case when l_returnflag = 'R' then concat('error ', l_linestatus, ' code ', cast(cast(l_quantity as int) % 13 as string)) end").alias("error"),
        F.col("l_extendedprice").alias("bytes"),
    )


ATTACHMENTS = """attachments AS (
  SELECT l_orderkey AS notice_id, l_linenumber AS position,
    CASE l_linenumber % 3 WHEN 0 THEN 'cahier des charges ' WHEN 1 THEN 'annexe ' ELSE 'avis ' END || l_partkey || CASE l_linenumber % 2 WHEN 0 THEN '.pdf' ELSE '.docx' END AS name,
    CASE l_returnflag WHEN 'A' THEN 'stored' WHEN 'R' THEN 'failed' ELSE 'pending' END AS status,
    CASE WHEN l_returnflag = 'R' THEN 'error ' || l_linestatus || ' code ' || (l_quantity::INT % 13) END AS error, l_extendedprice AS bytes
  FROM lineitem)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs of a source: failed, or with a number of items (views find nothing)."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"),
        F.col("user_id").alias("source_key"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        (F.col("event_type") == "error").alias("failed"),
        F.expr("case when event_type in ('view', 'error') then 0 else cast(floor(value) as bigint) end").alias("items"),
        F.col("value").alias("seconds"),
        F.col("event_type").alias("event_type"),
    )


RUNS = """runs AS (
  SELECT event_id AS run_id, user_id AS source_key, ts::TIMESTAMP AS ts, event_type = 'error' AS failed,
    CASE WHEN event_type IN ('view', 'error') THEN 0 ELSE floor(value)::BIGINT END AS items, value AS seconds, event_type FROM events)"""


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("notice_id"), F.col("c_name").alias("buyer"), F.col("c_mktsegment").alias("sector"), F.expr("case o_orderstatus when 'F' then 'won' when 'O' then 'lost' else 'pending' end").alias("outcome"))


SUBMISSIONS = """submissions AS (
  SELECT o_orderkey AS notice_id, c_name AS buyer, c_mktsegment AS sector, CASE o_orderstatus WHEN 'F' THEN 'won' WHEN 'O' THEN 'lost' ELSE 'pending' END AS outcome
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as chunks of résumés, five a résumé."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.expr("vec_id div 5").alias("resume_id"), F.col("label").alias("category"), F.col("embedding").alias("vector"))


CHUNKS = """chunks AS (SELECT vec_id AS chunk_id, vec_id // 5 AS resume_id, label AS category, embedding AS vector FROM embeddings)"""
