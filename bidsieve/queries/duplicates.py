"""Duplicates among documents, pages and notices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import NOTICES, notices
from ..functions import text as X
from ..functions import url as U
from ..operators import dedup as D
from ..operators import joins as J
from ..operators import similarity as V
from ..operators.blocking import near_duplicates
from ..operators.candidates import closest_candidates
from ..operators.shared import durable
from ..registry import query
from ..sources.tables import read
from .lookups import HASHED, hashed
from .scalars import CANONICAL, STOPS, fold_sql


@query(f"""
WITH k AS (SELECT page_id, coalesce(CASE WHEN page_id % 3 <> 0 THEN regexp_replace({CANONICAL}, '/[0-9]+.*$', '') END, 'ext-' || page_id // 6) AS k FROM pages)
SELECT page_id, duplicates FROM (SELECT page_id, row_number() OVER (PARTITION BY k ORDER BY page_id) AS r, count(*) OVER (PARTITION BY k) - 1 AS duplicates FROM k) WHERE r = 1""")
def dedup_in_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 != 0, F.regexp_replace(U.canonical(F.col("url")), r"/[0-9]+.*$", "")).alias("canonical"), F.concat(F.lit("ext-"), F.expr("page_id div 6").cast("string")).alias("external_id"))
    return D.in_run(pages, ["canonical", "external_id"], "page_id").select("page_id", "duplicates")


VECTOR = f"""toks AS (SELECT id, 'w:' || t AS term FROM (SELECT id, unnest([x FOR x IN string_split(f, ' ') IF length(x) > 2 AND x NOT IN ({STOPS})]) AS t FROM folded)),
chars AS MATERIALIZED (SELECT id, CASE WHEN f = '' THEN [] ELSE string_split(replace(f, ' ', '_'), '') END AS c FROM folded),
grams AS (SELECT id, 'g:' || g AS term FROM (SELECT id, unnest(CASE WHEN len(c) = 0 THEN [] WHEN len(c) < 4 THEN [array_to_string(c, '')] ELSE [c[i] || c[i + 1] || c[i + 2] || c[i + 3] FOR i IN range(1, len(c) - 2)] END) AS g FROM chars)),
counts AS (SELECT id, term, count(*) AS n FROM (SELECT * FROM toks UNION ALL SELECT * FROM grams) GROUP BY 1, 2),
raw AS MATERIALIZED (SELECT id, term, 1 + ln(n * CASE WHEN starts_with(term, 'w:') THEN 0.65::DOUBLE ELSE 0.35::DOUBLE END) AS w FROM counts),
vectors AS MATERIALIZED (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM raw)"""


HASHES = f"""{HASHED}, r AS (SELECT raw_sha256, min(doc_id) AS a FROM h GROUP BY 1), t AS (SELECT text_sha256, min(doc_id) AS b FROM h GROUP BY 1),
v AS (SELECT doc_id AS row_id, source, CASE WHEN a < doc_id THEN a END AS a, CASE WHEN b < doc_id THEN b END AS b FROM h LEFT JOIN r USING (raw_sha256) LEFT JOIN t USING (text_sha256))"""


#: Stages of equal keys, cheapest first.
STAGES = [("canonical_url", ["canonical_url"]), ("external_id", ["portal", "external_id"]), ("raw_hash", ["raw_sha256"]), ("text_hash", ["text_sha256"])]


def collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as notices collected from portals: address, the portal's own number, hashes and title. The tables' addresses and
    numbers are all different; cut short, some meet."""
    html = F.coalesce("html", F.lit(""))
    return read(spark, sf_dir, "pages").select(
        F.col("page_id").alias("row_id"), U.host(F.col("url")).alias("portal"), F.when(F.col("page_id") % 3 == 0, F.regexp_replace(U.canonical(F.col("url")), r"/[0-9]+.*$", "")).alias("canonical_url"),
        F.when(F.col("page_id") % 3 == 1, F.expr("page_id div 40")).alias("external_id"), F.sha2(html, 256).alias("raw_sha256"), F.sha2(X.fold(F.regexp_replace(html, "<[^>]*>", " ")), 256).alias("text_sha256"), F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"),
    )


@query(f"""
WITH p AS (SELECT page_id AS row_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1) AS portal, CASE WHEN page_id % 3 = 0 THEN regexp_replace({CANONICAL}, '/[0-9]+.*$', '') END AS u,
  CASE WHEN page_id % 3 = 1 THEN page_id // 40 END AS e, sha256(coalesce(html, '')) AS r, sha256({fold_sql("regexp_replace(html, '<[^>]*>', ' ', 'g')")}) AS t, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages),
f AS (SELECT row_id, portal, title, min(row_id) OVER (PARTITION BY u) AS a, min(row_id) OVER (PARTITION BY portal, e) AS b, min(row_id) OVER (PARTITION BY r) AS c, min(row_id) OVER (PARTITION BY t) AS d, u, e FROM p),
g AS (SELECT row_id, portal, title, CASE WHEN u IS NOT NULL AND a < row_id THEN a END AS a, CASE WHEN e IS NOT NULL AND b < row_id THEN b END AS b, CASE WHEN c < row_id THEN c END AS c, CASE WHEN d < row_id THEN d END AS d FROM f),
folded AS (SELECT row_id AS id, {fold_sql('title')} AS f FROM p), {VECTOR},
w AS (SELECT l.row_id AS l, s.row_id AS s, row_number() OVER (PARTITION BY l.row_id ORDER BY s.row_id DESC) AS n FROM g l JOIN p s ON l.portal = s.portal AND s.row_id < l.row_id WHERE coalesce(l.a, l.b, l.c, l.d) IS NULL),
m AS (SELECT l, s, round(greatest(0, least(1, sum(x.weight * y.weight))), 4) AS sim FROM w JOIN vectors x ON x.id = l JOIN vectors y ON y.id = s AND y.term = x.term WHERE n <= 200 GROUP BY 1, 2),
k AS (SELECT l, max(sim) AS sim, arg_max(s, (sim, s)) AS s FROM m WHERE sim >= 0.8 GROUP BY 1)
SELECT row_id, CASE WHEN a IS NOT NULL THEN 'canonical_url' WHEN b IS NOT NULL THEN 'external_id' WHEN c IS NOT NULL THEN 'raw_hash' WHEN d IS NOT NULL THEN 'text_hash' WHEN s IS NOT NULL THEN 'semantic' END AS strategy,
  coalesce(a, b, c, d, s) AS canonical_id, CASE WHEN coalesce(a, b, c, d) IS NOT NULL THEN 1.0 ELSE sim END::DOUBLE AS similarity FROM g LEFT JOIN k ON l = row_id""")
def dedup_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five stages, every page against those before it; the last compares titles with the 200 newest of the portal."""
    rows = durable(collected(spark, sf_dir))

    def semantic(left: DataFrame) -> DataFrame:
        # ids tell the order of arrival; a thousand of them count as a day
        at, known = F.col("row_id") * 86_400_000, F.col("portal").isNotNull()
        asks = left.where(known).select(F.col("portal").alias("list"), F.col("row_id").alias("ask_id"), F.lit(-1 << 62).alias("ask_since"), (at - 1).alias("ask_until"))
        entries = rows.where(known).select(F.col("portal").alias("list"), F.col("row_id").alias("id"), at.alias("at"))
        window = J.newest_in_lists(entries, asks, F.lit(True), 200).select(F.col("ask_id").alias("left_id"), F.col("id").alias("right_id"))
        vectors = V.lexical_vectors(rows, "row_id", "title")
        near = V.lexical_cosine(vectors, vectors, window).withColumn("similarity", F.round("similarity", 4)).where("similarity >= 0.8")
        return near.groupBy(F.col("left_id").alias("row_id")).agg(F.max_by("right_id", F.struct("similarity", "right_id")).alias("canonical_id"), F.max("similarity").alias("similarity"))

    return D.cascade(rows, rows, STAGES, earlier=True, semantic=semantic)


@query(f"WITH {NOTICES} SELECT notice_id, {fold_sql('title')} || ' ' || {fold_sql('title')} || ' ' || {fold_sql('buyer')} || ' ' || {fold_sql('country')} || ' ' || {fold_sql('country')} AS key FROM notices")
def dedup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Weights of the compared fields.
    return notices(spark, sf_dir).select("notice_id", D.comparison_key([("title", 1.0), ("buyer", 0.5), ("country", 0.9)], {"title": 2000}).alias("key"))


@query(f"""
WITH {NOTICES}, folded AS (SELECT notice_id AS id, {fold_sql('title')} AS f FROM notices), {VECTOR},
p AS (SELECT a.notice_id AS l, b.notice_id AS r, b.publication AS bp, row_number() OVER (PARTITION BY a.notice_id ORDER BY b.publication DESC, b.notice_id) AS n FROM notices a JOIN notices b ON a.country = b.country AND b.notice_id <> a.notice_id
  AND b.publication BETWEEN a.publication - INTERVAL 120 DAY AND a.publication AND (a.deadline IS NULL OR b.deadline IS NULL OR abs(epoch(a.deadline - b.deadline)) <= 3 * 86400)),
c AS (SELECT l, r, any_value(bp) AS bp, round(greatest(0, least(1, sum(x.weight * y.weight))), 4) AS similarity FROM p JOIN vectors x ON x.id = l JOIN vectors y ON y.id = r AND y.term = x.term WHERE n <= 200 GROUP BY 1, 2)
SELECT l AS incoming_id, arg_max(r, (similarity, bp, -r)) AS canonical_id, max(similarity) AS similarity FROM c WHERE similarity >= 0.8 GROUP BY 1""")
def dedup_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best candidate of the window (its 200 newest, a rule of the operator) by lexical cosine, for every notice."""
    rows = notices(spark, sf_dir)
    return closest_candidates(rows, rows, "title", 0.8).select("incoming_id", F.col("stored_id").alias("canonical_id"), "similarity")


@query(f"""
WITH RECURSIVE folded AS (SELECT doc_id AS id, {fold_sql('text')} AS f FROM documents), {VECTOR},
links AS MATERIALIZED (SELECT * FROM (SELECT a.id AS a, b.id AS b, round(greatest(0, least(1, sum(a.weight * b.weight))), 4) AS similarity FROM vectors a JOIN vectors b ON a.term = b.term AND a.id <> b.id GROUP BY 1, 2) WHERE similarity >= 0.92),
walk AS (SELECT a, b FROM links UNION SELECT w.a, l.b FROM walk w JOIN links l ON w.b = l.a),
classes AS (SELECT a, min(b) AS least FROM walk GROUP BY 1), best AS (SELECT a, max(similarity) AS similarity FROM links GROUP BY 1)
SELECT doc_id, coalesce(least(c.least, doc_id), doc_id) AS component_id, similarity FROM documents LEFT JOIN classes c ON c.a = doc_id LEFT JOIN best b ON b.a = doc_id""")
def near_dup_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The semantic stage at scale: 4-gram MinHash bands find candidates, the lexical cosine verifies them."""
    return near_duplicates(read(spark, sf_dir, "documents"), "doc_id", "text", least=0.92).withColumnRenamed("id", "doc_id")


@query(f"""
WITH {HASHES}, w AS (SELECT coalesce(a, b) AS c, row_id, source, row_id % 365 AS d FROM v WHERE coalesce(a, b) IS NOT NULL),
f AS (SELECT c, source, min(d) AS d, arg_min(row_id, (d, row_id)) AS r FROM w GROUP BY 1, 2), o AS (SELECT c, string_agg(source, ',' ORDER BY d, r) AS sources FROM f GROUP BY 1)
SELECT c AS canonical_id, count(*) AS hits, max(TIMESTAMP '2024-01-01' + to_days(d::INT)) AS last_seen, any_value(sources) AS sources FROM w JOIN o USING (c) GROUP BY 1""")
def duplicate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hashed(spark, sf_dir).withColumnRenamed("doc_id", "row_id").withColumn("seen", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(row_id % 365 as int))"))
    verdicts = D.cascade(rows, rows, [("raw_hash", ["raw_sha256"]), ("text_hash", ["text_sha256"])], earlier=True)
    return D.evidence(verdicts, rows).withColumn("sources", F.array_join("sources", ","))


@query(f"""
WITH {HASHED}, d AS (SELECT source, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) > 1 AS dup FROM h)
SELECT source, count(*) FILTER (dup) AS duplicates, count(*) AS found, round(count(*) FILTER (dup) / count(*)::DOUBLE, 6) AS ratio, count(*) FILTER (dup) / count(*)::DOUBLE > 0.9 AS spike FROM d GROUP BY 1""")
def duplicate_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hashed(spark, sf_dir)
    first = rows.groupBy("text_sha256").agg(F.min("doc_id").alias("first"))
    marked = rows.join(first, "text_sha256")
    counts = marked.groupBy("source").agg(F.count_if(F.col("doc_id") != F.col("first")).alias("duplicates"), F.count("*").alias("found"))
    ratio = F.try_divide(F.col("duplicates").cast("double"), F.col("found"))
    return counts.select("source", "duplicates", "found", F.round(ratio, 6).alias("ratio"), (ratio > 0.9).alias("spike"))
