"""Filters, listings, sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import CODES, NOTICES, codes, notices, now
from ..functions import text as X
from ..operators import filters as L
from ..operators import scoring as S
from ..operators.normalize import required
from ..registry import query
from ..sources.tables import read
from .scalars import fold_sql
from .sqltext import SCORED

NOW = "TIMESTAMP '1998-06-01'"


@query(f"WITH {NOTICES}, {SCORED} SELECT notice_id, buyer, country, status, deadline, score, band FROM scored WHERE country IN ('FRANCE', 'GERMANY', 'CHINA', 'NATION_1', 'NATION_2') OR score >= 0.6 ORDER BY score DESC, notice_id LIMIT 200")
def list_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = S.score_notices(notices(spark, sf_dir, costly=True), S.Profile(), now())
    chosen = scored.where(F.col("country").isin("FRANCE", "GERMANY", "CHINA", "NATION_1", "NATION_2") | (F.col("score") >= 0.6))
    return L.page(L.sorted_by(chosen, "-score", ["notice_id"]), 1, 200).select("notice_id", "buyer", "country", "status", "deadline", "score", "band")


@query(f"""
WITH {NOTICES}, {SCORED}, r AS (SELECT *, 'REF-' || notice_id AS reference FROM scored), c AS (
  SELECT *, count(*) OVER () AS total FROM r WHERE band <> 'out_of_scope' AND (title ILIKE '%5%1%' OR buyer ILIKE '%5%1%' OR reference ILIKE '%5%1%') AND zone IN ('EUROPE', 'ASIA') AND score >= 0.1 AND (deadline IS NULL OR deadline >= {NOW}) AND status NOT IN ('cancelled', 'awarded'))
SELECT notice_id, score, total FROM c ORDER BY deadline DESC NULLS LAST, publication DESC, notice_id LIMIT 50 OFFSET 50""")
def search_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of open notices of two zones with a text in title, buyer or reference, latest deadline first."""
    scored = S.score_notices(notices(spark, sf_dir, costly=True), S.Profile(), now()).withColumn("reference", F.concat(F.lit("REF-"), F.col("notice_id").cast("string")))
    chosen = L.listed(scored, now(), "5%1", least=0.1, among={"zone": ["EUROPE", "ASIA"], "country": []})
    return L.page(L.sorted_by(chosen, "-deadline", ["-publication", "notice_id"]), 2, 50).select("notice_id", "score", "total")


@query(f"""
WITH {NOTICES}, {CODES}, more AS (SELECT *, 'Région ' || right(buyer, 1) AS location, CASE WHEN notice_id % 5 > 0 THEN 'Fund ' || notice_id % 4 END AS funder, CASE WHEN notice_id % 6 > 0 THEN ['FR', 'en', 'ar'][notice_id % 3 + 1] END AS language FROM notices)
SELECT n.notice_id FROM more n LEFT JOIN codes c USING (notice_id)
WHERE contains({fold_sql('title')}, 'notice') AND (contains({fold_sql('title')}, 'building') OR contains({fold_sql('title')}, 'machinery')) AND NOT contains({fold_sql('title')}, 'low')
  AND zone IN ('EUROPE', 'ASIA') AND status IN ('open', 'closed') AND (c.cpv_codes IS NULL OR len([x FOR x IN c.cpv_codes IF starts_with(x, '72') OR starts_with(x, '48')]) > 0)
  AND publication >= TIMESTAMP '1996-01-01' AND publication < TIMESTAMP '1999-01-01' AND (deadline IS NULL OR deadline >= TIMESTAMP '1996-06-01') AND (budget IS NULL OR budget BETWEEN 1000 AND 300000)
  AND right(buyer, 1) IN ('1', '2', '3', '4', '5', '6') AND coalesce(funder, '') <> '' AND funder <> 'Fund 0' AND (language IS NULL OR language <> 'ar')""")
def filter_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notices(spark, sf_dir, costly=True).join(codes(spark, sf_dir), "notice_id", "left")
    rows = rows.withColumns({"location": F.concat(F.lit("Région "), F.right("buyer", F.lit(1))), "funder": F.expr("case when notice_id % 5 > 0 then concat('Fund ', notice_id % 4) end"), "language": F.expr("case when notice_id % 6 > 0 then element_at(array('FR', 'en', 'ar'), cast(notice_id % 3 + 1 as int)) end")})
    wanted = L.Filters(locations=[f"region {i}" for i in range(1, 7)], funders=["fund 1", "FUND 2", "fund 3"], languages=["fr", "EN"], all_of=["Notice"], any_of=["Building", "machinery"], none_of=["LOW"], zones=["EUROPE", "ASIA"], statuses=["open", "closed"], cpv=["72000000", "48000000"], published_from="1996-01-01", published_before="1999-01-01", deadline_from="1996-06-01", budget_min=1000, budget_max=300000)
    return rows.where(L.matches(wanted)).select("notice_id")


@query(f"WITH {NOTICES} SELECT notice_id, publication, deadline FROM notices WHERE publication >= {NOW} - INTERVAL 30 DAY AND publication <= {NOW} AND (deadline IS NULL OR deadline >= {NOW} + INTERVAL 10 DAY)")
def resolve_relative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = L.resolved(L.Filters(published_within_days=30, days_to_deadline=10), "1998-06-01")
    return notices(spark, sf_dir).where((F.col("publication") <= now()) & L.matches(wanted)).select("notice_id", "publication", "deadline")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'published_range' WHEN o_orderkey % 3 = 0 THEN 'budget_range' END AS reason, CASE WHEN o_orderkey % 2 = 0 THEN ['Tunis', 'Paris'] ELSE [] END AS places FROM orders""")
def validate_filter_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.expr("case when o_orderkey % 5 = 0 then date_add(o_orderdate, 3) else to_date(o_orderdate) end").alias("published_from"), F.to_date("o_orderdate").alias("published_to"),
        F.expr("case when o_orderkey % 3 = 0 then o_totalprice + 1 else 0 end").alias("budget_min"), F.col("o_totalprice").alias("budget_max"), F.expr("case when o_orderkey % 2 = 0 then ' Tunis, ,Paris ' else ' ' end").alias("places"),
    )
    return L.validated(saved).select("o_orderkey", "reason", "places")


@query(f"WITH {NOTICES} SELECT notice_id, sector FROM notices WHERE NOT (sector = 'BUILDING' OR notice_id % 3 = 0)")
def filter_special_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notices(spark, sf_dir).withColumn("criteria", F.array_compact(F.array(F.col("sector"), F.when(F.col("notice_id") % 3 == 0, F.lit("IE_OI_ONG")))))
    return L.without_criteria(rows, "criteria", ["IE_OI_ONG", "BUILDING"]).select("notice_id", "sector")


@query("""
SELECT lower(r_name) AS wanted, n_name AS country, TRUE AS known FROM region JOIN nation ON n_regionkey = r_regionkey
UNION ALL SELECT 'nowhere', NULL, FALSE""")
def expand_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = read(spark, sf_dir, "region").join(read(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("zone"), F.col("n_name").alias("country"))
    wanted = read(spark, sf_dir, "region").select(F.lower("r_name").alias("wanted")).unionByName(spark.range(1).select(F.lit("nowhere").alias("wanted")))
    return L.expanded_zones(wanted, places)


@query(f"WITH {NOTICES} SELECT notice_id, CASE WHEN deadline IS NULL THEN 'deadline' WHEN budget IS NULL THEN 'budget' END AS missing FROM notices")
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return required(notices(spark, sf_dir), ["title", "deadline", "budget"]).select("notice_id", "missing")


@query("SELECT event_id, ts::TIMESTAMP AS ts, user_id FROM events WHERE event_type = 'error' AND user_id % 2 = 1 ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 50")
def audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").where((F.col("event_type") == "error") & (F.col("user_id") % 2 == 1))
    return L.page(rows.orderBy(F.desc("ts"), F.desc("event_id")), 2, 50).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id")


@query("SELECT event_id, user_id FROM events WHERE event_type IN ('purchase', 'signup') ORDER BY ts DESC, event_id DESC LIMIT 100")
def list_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.page(L.sorted_by(read(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "signup")), "-ts", ["-event_id"]), 1, 100).select("event_id", "user_id")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'view' AND value < 5 ORDER BY ts DESC, event_id DESC LIMIT 100")
def list_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    unread = read(spark, sf_dir, "events").where((F.col("event_type") == "view") & (F.col("value") < 5))
    return L.page(L.sorted_by(unread, "-ts", ["-event_id"]), 1, 100).select("event_id", "user_id")


@query("""
WITH d AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS canonical_id FROM documents WHERE text IS NOT NULL)
SELECT doc_id, canonical_id FROM d WHERE doc_id <> canonical_id ORDER BY doc_id DESC LIMIT 100""")
def list_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    first = hashed.groupBy("h").agg(F.min("doc_id").alias("canonical_id"))
    return L.page(hashed.join(first, "h").where("doc_id <> canonical_id").orderBy(F.desc("doc_id")), 1, 100).select("doc_id", "canonical_id")


@query("""
WITH n AS (SELECT n_name, lower(n_name) AS f, n_nationkey FROM nation WHERE n_name <> 'NATION_1' AND contains(lower(n_name), 'n'))
SELECT n_name FROM n ORDER BY starts_with(f, 'n') DESC, n_nationkey LIMIT 8""")
def suggest_prefix_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.suggestions(read(spark, sf_dir, "nation"), "n_name", "n_nationkey", "N", ["NATION_1"]).select("n_name")


@query(f"WITH {NOTICES} SELECT notice_id, deadline FROM notices ORDER BY deadline DESC NULLS LAST, publication DESC, notice_id LIMIT 500")
def sort_allowlisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.sorted_by(notices(spark, sf_dir), "-deadline", ["-publication", "notice_id"]).limit(500).select("notice_id", "deadline")


@query(f"WITH {NOTICES} SELECT notice_id, (SELECT count(*) FROM notices) AS total, (SELECT ceil(count(*) / 100.0)::BIGINT FROM notices) AS pages FROM notices ORDER BY notice_id LIMIT 100 OFFSET 200")
def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notices(spark, sf_dir)
    totals = L.totals(rows, 100)
    return L.page(rows.orderBy("notice_id"), 3, 100).select("notice_id").join(F.broadcast(totals))


KEYWORDS = {"the": 0.9, "of": 0.4, "der": 0.8, "les": 0.7, "and": 0.6, "que": 1.0, "is": 0.3, "und": 0.5}


@query(f"""
WITH f AS (SELECT doc_id, string_split({fold_sql('text')}, ' ') AS w FROM documents), k(keyword, weight, i) AS (VALUES {', '.join(f"('{k}', {w}, {i})" for i, (k, w) in enumerate(KEYWORDS.items()))})
SELECT doc_id, array_to_string(list(keyword ORDER BY weight DESC, i)[1:5], ',') AS top FROM f JOIN k ON list_contains(w, keyword) GROUP BY 1""")
def top_k_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = read(spark, sf_dir, "documents").select("doc_id", X.fold(F.col("text")).alias("f")).select("doc_id", S.keyword_hits(F.col("f"), KEYWORDS).alias("h"))
    return hits.where(F.size("h") > 0).select("doc_id", F.array_join(S.top_keywords(F.col("h")), ",").alias("top"))


@query(f"WITH {NOTICES} SELECT notice_id FROM notices WHERE contains(lower(title), 'building') OR contains(lower(title), 'urgent') OR contains(lower(title), 'high')")
def union_per_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.union_of_searches(notices(spark, sf_dir), "title", ["building", "URGENT", "high"], "notice_id").select("notice_id")


@query(r"""
WITH l AS (SELECT page_id, [replace(h, '&amp;', '&') FOR h IN regexp_extract_all(html, 'href="([^"]*)"', 1)] AS h FROM pages)
SELECT page_id, array_to_string([x FOR x, i IN h IF list_position(h, x) = i][1:20], '|') AS links FROM l""")
def ordered_distinct_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.transform(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1), lambda h: F.replace(h, F.lit("&amp;"), F.lit("&")))
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(F.slice(F.array_distinct(found), 1, 20), "|").alias("links"))


@query(f"""
WITH t AS (SELECT doc_id, list_distinct(string_split({fold_sql('text')}, ' ')) AS w FROM documents)
SELECT doc_id, array_to_string([x FOR x IN ['the', 'und', 'que', 'zzz'] IF NOT list_contains(w, x)], ',') AS missing, array_to_string([x FOR x IN ['the', 'und', 'que', 'zzz'] IF list_contains(w, x)], ',') AS shared, len(list_distinct(list_concat(w, ['the', 'zzz']))) AS together FROM t""")
def array_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array(*map(F.lit, ("the", "und", "que", "zzz")))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.split(X.fold(F.col("text")), " ")).alias("w"))
    return rows.select("doc_id", F.array_join(F.array_except(wanted, F.col("w")), ",").alias("missing"), F.array_join(F.array_intersect(wanted, F.col("w")), ",").alias("shared"), F.size(F.array_union(F.col("w"), F.array(F.lit("the"), F.lit("zzz")))).cast("long").alias("together"))
