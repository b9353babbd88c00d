"""Lexical and dense similarity, search, staffing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import CHUNKS, chunks
from ..functions import text as X
from ..operators import dense
from ..operators import similarity as V
from ..operators import staffing as T
from ..operators.nearest import nearest_texts
from ..operators.shared import durable
from ..registry import query
from ..sources.tables import read
from .duplicates import VECTOR
from .scalars import WORDS, fold_sql


@query(f"WITH folded AS (SELECT item_id AS id, {fold_sql('text')} AS f FROM benchmark), {VECTOR} SELECT id, count(*) AS terms, round(sum(weight), 4) AS total, round(min(weight), 5) AS least FROM vectors GROUP BY 1")
def lexical_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = V.lexical_vectors(read(spark, sf_dir, "benchmark"), "item_id", "text")
    return vectors.groupBy("id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 4).alias("total"), F.round(F.min("weight"), 5).alias("least"))


@query(f"""
WITH folded AS (SELECT item_id AS id, {fold_sql('text')} AS f FROM benchmark), {VECTOR}
SELECT a.id AS left_id, b.id AS right_id, round(greatest(0, least(1, sum(a.weight * b.weight))), 4) AS similarity FROM vectors a JOIN vectors b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2""")
def lexical_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items against each other: a fixed set of queries."""
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return V.backend("lexical")(items, items).where("left_id < right_id").withColumn("similarity", F.round("similarity", 4))


DOT = "greatest(0, least(1, list_dot_product(({0})::DOUBLE[], ({1})::DOUBLE[])))"


@query(f"SELECT query_id, e.vec_id, round({DOT.format('e.embedding', 'q.embedding')}, 6) AS similarity FROM embeddings e, (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 50 = 0) q")
def dense_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return dense.scored_chunks(postings(spark, sf_dir), rows, 6).select("query_id", "vec_id", F.col("score").alias("similarity"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector as a role to staff: the stated set of queries, against all vectors."""
    return read(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


QUERIED = f"""{CHUNKS}, q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, chunk_id, resume_id, category, {DOT.format('qv', 'vector')} AS score FROM chunks, q)"""


@query(f"""
WITH {QUERIED}, b AS (SELECT query_id, resume_id, max(round(score, 6)) AS score, arg_max(chunk_id, (round(score, 6), -chunk_id)) AS chunk_id FROM s WHERE category <> 4 GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, resume_id) AS position FROM b) WHERE position <= 20""")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.search(postings(spark, sf_dir), chunks(spark, sf_dir), 20, F.col("category") != 4).withColumn("position", F.col("position").cast("long"))


@query(f"""
WITH {QUERIED}, b AS (SELECT query_id, resume_id, max(round(score, 6)) AS score FROM s GROUP BY 1, 2), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, resume_id) AS position FROM b) WHERE position <= 30),
r AS (SELECT query_id, resume_id, score AS retrieval_score, round(1 / (1 + exp(-((resume_id % 7) - 3 + score))), 6) AS score FROM l)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, resume_id) AS position FROM r) WHERE position <= 10""")
def rerank_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    shortlist = V.search(postings(spark, sf_dir), chunks(spark, sf_dir), 30).drop("position", "chunk_id")
    logit = F.col("resume_id") % 7 - 3 + F.col("score")
    return V.rerank(shortlist, logit, 10).withColumn("position", F.col("position").cast("long"))


ITEMS = f"""folded AS (SELECT doc_id AS id, {fold_sql('text')} AS f FROM documents UNION ALL SELECT -1 - item_id, {fold_sql('text')} FROM benchmark), {VECTOR},
near AS (SELECT -1 - a.id AS query_id, b.id AS resume_id, round(greatest(0, least(1, sum(a.weight * b.weight))), 4) AS score FROM vectors a JOIN vectors b ON a.term = b.term AND a.id < 0 AND b.id >= 0 GROUP BY 1, 2)"""


def item_pairs(spark: SparkSession, sf_dir: str, name: str = "lexical") -> DataFrame:
    """Benchmark items as postings against all documents: query_id, resume_id, score."""
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return V.backend(name)(items, docs).select(F.col("left_id").alias("query_id"), F.col("right_id").alias("resume_id"), F.round("similarity", 4).alias("score"))


@query(f"""
WITH {ITEMS}, l AS (SELECT query_id, resume_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, resume_id) AS position FROM near) WHERE position <= 30),
w AS (SELECT id, list_distinct([x FOR x IN string_split(f, ' ') IF x <> '']) AS w FROM folded),
r AS (SELECT query_id, resume_id, score AS retrieval_score, round(1 / (1 + exp(2 - 6 * len(list_intersect(a.w, b.w)) / greatest(1, len(a.w))::DOUBLE)), 6) AS score FROM l JOIN w a ON a.id = -1 - query_id JOIN w b ON b.id = resume_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, resume_id) AS position FROM r) WHERE position <= 10""")
def rerank_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second scorer reads both texts of each shortlisted pair: an Arrow function, in the place of a pair model."""
    items, docs = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    near = durable(nearest_texts(items, docs, 30))
    shortlist = near.select(F.col("left_id").alias("query_id"), F.col("right_id").alias("resume_id"), F.col("similarity").alias("score"))
    pairs = shortlist.join(items.toDF("query_id", "asked"), "query_id").join(docs.toDF("resume_id", "offered"), "resume_id")
    ranked = V.rerank(pairs, T.pair_logit(X.fold(F.col("asked")), X.fold(F.col("offered"))), 10)
    return ranked.select("query_id", "resume_id", "retrieval_score", "score", F.col("position").cast("long").alias("position"))


@query(f"""
WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents), p AS (SELECT doc_id * 1000 + i AS pid, doc_id, i AS n, array_to_string(w[i * 70 + 1 : i * 70 + 70], ' ') AS passage FROM (SELECT doc_id, w, unnest(range(0, (len(w) + 69) // 70)) AS i FROM w)),
folded AS (SELECT pid AS id, {fold_sql('passage')} AS f FROM p UNION ALL SELECT -1 - item_id, {fold_sql('text')} FROM benchmark), {VECTOR},
c AS (SELECT -1 - a.id AS posting_id, b.id AS pid, round(greatest(0, least(1, sum(a.weight * b.weight))), 4) AS score FROM vectors a JOIN vectors b ON a.term = b.term AND a.id < 0 AND b.id >= 0 GROUP BY 1, 2)
SELECT posting_id, doc_id, n AS passage, score FROM (SELECT posting_id, doc_id, n, score, row_number() OVER (PARTITION BY posting_id, doc_id ORDER BY score DESC, n) AS r FROM c JOIN p USING (pid)) WHERE r <= 3""")
def evidence_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three passages of every document nearest to each posting."""
    return T.evidence(read(spark, sf_dir, "documents"), "doc_id", "text", read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")).select("posting_id", "doc_id", "passage", "score")


WANTED = ["the", "und", "que", "Apache"]


@query(rf"""
WITH f AS (SELECT doc_id, {fold_sql('text')} AS f FROM documents), m AS (SELECT doc_id, [t FOR t IN ['the', 'und', 'que', 'apache'] IF contains(f, t)] AS hit FROM f)
SELECT doc_id, len(hit) AS matched, 4 - len(hit) AS missing, round(0.75 * (doc_id % 10) / 10.0 + 0.25 * len(hit) / 4.0, 4)::DOUBLE AS score FROM m""")
def technology_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", T.coverage(X.fold(F.col("text")), WANTED).alias("c"))
    return rows.select("doc_id", F.size("c.matched").cast("long").alias("matched"), F.size("c.missing").cast("long").alias("missing"), F.round(T.mixed_score((F.col("doc_id") % 10) / 10, F.col("c")), 4).alias("score"))


@query(r"""
WITH p AS (SELECT doc_id, unnest(range(1, least(30, len(string_split(text, chr(10)))) + 1)) AS page, string_split(text, chr(10)) AS pages FROM documents),
h AS (SELECT doc_id, page, least(100, len(regexp_extract_all(' ' || replace(lower(pages[page]), ' ', '  ') || ' ', '[^\p{L}\p{N}_]the[^\p{L}\p{N}_]'))) AS hits FROM p)
SELECT doc_id, page, hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS r FROM h WHERE hits > 0) WHERE r <= 3""")
def locate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.located(read(spark, sf_dir, "documents"), "doc_id", "text", "the").select("doc_id", F.col("page").cast("long").alias("page"), F.col("hits").cast("long").alias("hits"))


METRICS = f"{QUERIED}, b AS (SELECT query_id, resume_id, any_value(category) AS c, max(score) AS score FROM s GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, resume_id) AS r FROM b), m AS (SELECT query_id, count(*) AS pool, avg(score) FILTER (r <= 10) AS top_mean, avg(score) AS mean, stddev_pop(score) AS deviation FROM k GROUP BY 1)"


@query(f"WITH {METRICS} SELECT query_id, pool, round(top_mean, 6) AS top_mean, round(mean, 6) AS mean, round(deviation, 6) AS deviation FROM m")
def search_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.search_metrics(postings(spark, sf_dir), chunks(spark, sf_dir))
    return found.select("query_id", "pool", *(F.round(c, 6).alias(c) for c in ("top_mean", "mean", "deviation")))


GRADE = "CASE WHEN (top_mean - mean) / deviation >= 2.5 THEN 4 WHEN (top_mean - mean) / deviation >= 1.5 THEN 3 WHEN (top_mean - mean) / deviation >= 0.75 THEN 2 WHEN (top_mean - mean) / deviation >= 0 THEN 1 ELSE 0 END"


@query(f"WITH {METRICS} SELECT query_id, round((top_mean - mean) / deviation, 4) AS z, ['F', 'D', 'C', 'B', 'A'][CASE WHEN mean < 0.25 THEN least(1, {GRADE}) ELSE {GRADE} END + 1] AS grade FROM m")
def grade_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.graded(V.search_metrics(postings(spark, sf_dir), chunks(spark, sf_dir))).select("query_id", F.round("z", 4).alias("z"), "grade")


@query(f"""
WITH {METRICS}, r AS (SELECT query_id, avg(score) AS relevance FROM k WHERE r <= 2 GROUP BY 1), g AS (SELECT query_id, {GRADE} AS g, relevance FROM m JOIN r USING (query_id))
SELECT query_id, ['F', 'D', 'C', 'B', 'A'][least(g, CASE WHEN relevance >= 0.7 THEN 4 WHEN relevance >= 0.4 THEN 3 WHEN relevance >= 0.2 THEN 2 ELSE 1 END) + 1] AS grade FROM g""")
def relevance_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = V.search(postings(spark, sf_dir), chunks(spark, sf_dir), 2)
    needed = pool.groupBy("query_id").agg(F.avg("score").alias("relevance"))
    graded = T.graded(V.search_metrics(postings(spark, sf_dir), chunks(spark, sf_dir)), floor=0.0)
    return graded.join(needed, "query_id").select("query_id", T.capped(F.col("grade"), F.col("relevance")).alias("grade"))


@query(f"WITH {QUERIED} SELECT query_id, category, round(avg(score), 6) AS score, count(*) AS n FROM s GROUP BY 1, 2")
def category_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.category_means(postings(spark, sf_dir), chunks(spark, sf_dir)).select("query_id", "category", F.round("score", 6).alias("score"), "n")


@query(f"WITH {METRICS} SELECT arg_min(query_id, ({GRADE}, query_id)) AS weakest, ['F', 'D', 'C', 'B', 'A'][min({GRADE}) + 1] AS grade FROM m")
def project_bottleneck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.bottleneck(T.graded(V.search_metrics(postings(spark, sf_dir), chunks(spark, sf_dir)), floor=0.0))


@query(f"WITH {ITEMS} SELECT * FROM near")
def similarity_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items against documents by name of a backend; an unknown one falls back to the lexical one."""
    return item_pairs(spark, sf_dir, "no-such-model")
