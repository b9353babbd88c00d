"""Lookups and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import ATTACHMENTS, NOTICES, SUBMISSIONS, attachments, notices, submissions
from ..functions import text as X
from ..functions import url as U
from ..operators import joins as J
from ..registry import query
from ..sources.tables import read
from .scalars import CANONICAL, fold_sql


@query(f"""
WITH c AS (SELECT page_id, regexp_replace({CANONICAL}, '/[0-9]+.*$', '') AS u FROM pages), s AS (SELECT u, min(page_id) AS canonical_id FROM c WHERE page_id % 2 = 0 GROUP BY u)
SELECT page_id, canonical_id FROM c JOIN s USING (u) WHERE page_id % 2 = 1""")
def match_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the tables' URLs are all different: without the page number some meet
    pages = read(spark, sf_dir, "pages").select("page_id", F.regexp_replace(U.canonical(F.col("url")), r"/[0-9]+.*$", "").alias("u"))
    return J.match_by_keys(pages.where("page_id % 2 = 1"), pages.where("page_id % 2 = 0"), ["u"], "page_id", "page_id").select("page_id", "canonical_id")


@query(f"""
WITH {NOTICES}, k AS (SELECT notice_id, country, notice_id // 2 AS external_id FROM notices), s AS (SELECT country, external_id, min(notice_id) AS canonical_id FROM k GROUP BY 1, 2)
SELECT notice_id, canonical_id FROM k JOIN s USING (country, external_id)""")
def match_by_external_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notices(spark, sf_dir).select("notice_id", "country", F.expr("notice_id div 2").alias("external_id"))
    return J.match_by_keys(rows, rows, ["country", "external_id"], "notice_id", "notice_id").select("notice_id", "canonical_id")


HASHED = f"h AS (SELECT doc_id, source, sha256(text) AS raw_sha256, sha256({fold_sql('text')}) AS text_sha256 FROM documents)"


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("raw_sha256"), F.sha2(X.fold(F.col("text")), 256).alias("text_sha256"))


@query(f"""
WITH {HASHED}, r AS (SELECT raw_sha256, min(doc_id) AS canonical_id FROM h GROUP BY 1), t AS (SELECT text_sha256, min(doc_id) AS canonical_id FROM h GROUP BY 1)
SELECT h.doc_id, coalesce(r.canonical_id, t.canonical_id) AS canonical_id, CASE WHEN r.canonical_id IS NOT NULL THEN 'raw_sha256' ELSE 'text_sha256' END AS matched_on
FROM h LEFT JOIN r USING (raw_sha256) LEFT JOIN t USING (text_sha256) WHERE coalesce(r.canonical_id, t.canonical_id) IS NOT NULL""")
def match_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hashed(spark, sf_dir)
    return J.match_by_hash(rows, rows, "doc_id", "doc_id")


@query(f"""
WITH {NOTICES}, i AS (SELECT notice_id, CASE WHEN notice_id % 89 = 0 THEN NULL ELSE country END AS country, publication, deadline FROM notices), s AS (SELECT notice_id, CASE WHEN notice_id % 97 = 0 THEN NULL ELSE country END AS country, publication, deadline FROM notices),
p AS (SELECT i.notice_id AS incoming_id, s.notice_id AS stored_id, row_number() OVER (PARTITION BY i.notice_id ORDER BY s.publication DESC, s.notice_id) AS position
  FROM i JOIN s ON (s.country = i.country OR s.country IS NULL OR i.country IS NULL) AND s.publication BETWEEN i.publication - INTERVAL 120 DAY AND i.publication AND s.notice_id <> i.notice_id
   AND (i.deadline IS NULL OR s.deadline IS NULL OR abs(epoch(i.deadline - s.deadline)) <= 3 * 86400))
SELECT * FROM p WHERE position <= 200""")
def candidate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notices(spark, sf_dir)
    return J.candidate_window(rows.withColumn("country", F.expr("case when notice_id % 89 = 0 then null else country end")), rows.withColumn("country", F.expr("case when notice_id % 97 = 0 then null else country end"))).withColumn("position", F.col("position").cast("long"))


@query("""
WITH m AS (SELECT user_id, max_by(value, (ts, event_id)) AS value, max(ts)::TIMESTAMP AS ts FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT c_custkey, m.value AS score, m.ts AS scored_at FROM customer LEFT JOIN m ON m.user_id = c_custkey""")
def latest_score_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = read(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("score"), F.max("ts").cast("timestamp_ntz").alias("scored_at"))
    return read(spark, sf_dir, "customer").join(newest, F.col("c_custkey") == F.col("user_id"), "left").select("c_custkey", "score", "scored_at")


@query("""
SELECT o_orderkey, coalesce(c.n, 0) AS documents, coalesce(c.first_line, 0) AS first_line FROM orders
LEFT JOIN (SELECT l_orderkey, count(*) AS n, min(l_linenumber) AS first_line FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) c ON l_orderkey = o_orderkey""")
def nest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = read(spark, sf_dir, "orders").select("o_orderkey")
    children = read(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").withColumnRenamed("l_orderkey", "o_orderkey")
    nested = J.nest(parents, children, "o_orderkey", "docs", ["l_linenumber", "l_partkey"])
    return nested.select("o_orderkey", F.size("docs").cast("long").alias("documents"), F.coalesce(F.get("docs", F.lit(0))["l_linenumber"], F.lit(0)).alias("first_line"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0 OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def owner_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.expr("case when o_orderkey % 4 = 0 then null else o_custkey end").alias("owner"))
    callers = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("caller"))
    return J.owned_or_shared(rows, "owner", callers).select("o_orderkey")


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_returnflag = 'R')")
def anti_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf_dir, "orders").join(failed, "o_orderkey", "left_anti").select("o_orderkey")


HISTORY = f"""{SUBMISSIONS}, bb AS (SELECT buyer, count(*) FILTER (outcome = 'won') AS wins, count(*) AS decided FROM submissions WHERE outcome <> 'pending' AND buyer <> 'Customer#000000003' GROUP BY 1),
bs AS (SELECT sector, count(*) FILTER (outcome = 'won') AS wins, count(*) AS decided FROM submissions WHERE outcome <> 'pending' AND buyer <> 'Customer#000000003' GROUP BY 1)"""


@query(f"""
WITH {NOTICES}, {HISTORY} SELECT notice_id, coalesce(bb.wins, bs.wins) AS wins, coalesce(bb.decided, bs.decided) AS decided FROM notices LEFT JOIN bb USING (buyer) LEFT JOIN bs USING (sector)""")
def win_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    past = submissions(spark, sf_dir).where("buyer <> 'Customer#000000003'")
    return J.win_history(notices(spark, sf_dir), past).select("notice_id", "wins", "decided")


@query(f"WITH {NOTICES} SELECT notice_id, round(budget * CASE currency WHEN 'EUR' THEN 3.35::DOUBLE WHEN 'USD' THEN 3.1::DOUBLE ELSE 1.0::DOUBLE END, 4) AS converted FROM notices")
def fx_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = spark.createDataFrame([("eur", 3.35), ("usd", 3.1), ("tnd", 1.0)], "currency string, rate double")
    return J.convert(notices(spark, sf_dir), "budget", "currency", rates).select("notice_id", F.round("converted", 4).alias("converted"))


@query("""
SELECT doc_id, CASE WHEN coalesce(length(b.text), 0) > coalesce(length(d.text), 0) THEN sha256(b.text) ELSE sha256(d.text) END AS text, CASE WHEN doc_id % 2 = 0 THEN lang WHEN b.item_id IS NOT NULL THEN 'detail' END AS lang,
  CASE WHEN doc_id % 3 = 0 AND b.item_id IS NOT NULL THEN 'open' WHEN doc_id % 3 = 0 THEN 'unknown' ELSE 'closed' END AS status
FROM documents d LEFT JOIN benchmark b ON item_id = doc_id""")
def merge_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = read(spark, sf_dir, "documents").select("doc_id", "text", F.expr("case when doc_id % 2 = 0 then lang end").alias("lang"), F.expr("case when doc_id % 3 = 0 then 'unknown' else 'closed' end").alias("status"), F.create_map(F.lit("a"), F.lit("1")).alias("extra"))
    detail = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text", F.lit("detail").alias("lang"), F.lit("open").alias("status"), F.create_map(F.lit("a"), F.lit("2")).alias("extra"))
    return J.merge_detail(stored, detail, "doc_id", ["text"], ["lang"], ["status"], ["extra"]).select("doc_id", F.sha2("text", 256).alias("text"), "lang", "status")


@query("""
SELECT doc_id, doc_id % 4 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS hit FROM documents""")
def profile_cache_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("source_hash"))
    cached = sources.where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.lit("stale")).otherwise(F.col("source_hash")).alias("source_hash"), F.when(F.col("doc_id") % 5 == 0, "failed").otherwise("ok").alias("status"))
    return J.cached_profiles(sources, cached, "doc_id").select("doc_id", "hit")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer UNION ALL SELECT -c_custkey, 'NEW', NULL::DOUBLE FROM customer WHERE c_custkey % 3 = 0 AND c_custkey > 0 AND c_custkey < 100")
def upsert_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    changed = stored.where("c_custkey % 3 = 0").select("c_custkey", F.lit("NEW").alias("c_mktsegment"))
    return J.upsert(stored, changed.unionByName(changed.where("c_custkey > 0 and c_custkey < 100").withColumn("c_custkey", -F.col("c_custkey"))), "c_custkey")


@query("""
SELECT coalesce(n_nationkey, s.s_nationkey) AS n_nationkey, coalesce(n_name, 'old') AS label, coalesce(s.runs, 0) AS runs, n_nationkey IS NOT NULL AS enabled
FROM (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) FULL JOIN (SELECT s_nationkey, count(*) AS runs FROM supplier GROUP BY 1) s ON s.s_nationkey = n_nationkey""")
def registry_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("runs")).withColumn("label", F.lit("old"))
    registry = read(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0").select("n_nationkey", F.col("n_name").alias("label"))
    return J.registry_sync(stored, registry, "n_nationkey", ["runs"])
