"""Sparse lexical vectors, dense vectors, search and reranking."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, char_grams, fold, let, plain_fold, tokens
from . import dense
from .joins import blocked_pairs

# Weight of an occurrence of a word and of a character run.
TOKEN_WEIGHT, GRAM_WEIGHT = 0.65, 0.35


def terms_of(folded: Column) -> Column:
    """Words and 4-character runs of a folded text, each marked by its kind."""
    return F.concat(F.transform(tokens(folded, True), lambda t: F.concat(F.lit("w:"), t)), F.transform(char_grams(folded, folded=True), lambda g: F.concat(F.lit("g:"), g)))


def _weight(term: Column) -> Column:
    return F.when(F.startswith(term, F.lit("w:")), TOKEN_WEIGHT).otherwise(GRAM_WEIGHT)


def literal_vector(text: str) -> dict[str, float]:
    """The unit vector of a text of the configuration, on the driver."""
    folded = plain_fold(text)
    compact = folded.replace(" ", "_")
    runs = [compact[i : i + 4] for i in range(len(compact) - 3)] or [compact] * bool(compact)
    counts = Counter([f"w:{t}" for t in folded.split() if len(t) > 2 and t not in STOP_WORDS] + [f"g:{g}" for g in runs])
    raw = {t: 1 + math.log(n * (TOKEN_WEIGHT if t.startswith("w:") else GRAM_WEIGHT)) for t, n in counts.items()}
    norm = math.sqrt(sum(x * x for x in raw.values())) or 1.0
    return {t: x / norm for t, x in raw.items()}


def cosines_to(folded: Column, texts: list[str]) -> Column:
    """Lexical cosines in [0, 1] of a folded text to some texts of the configuration, as an array: no join, nothing shuffled."""
    vectors = [literal_vector(t) for t in texts]
    known = sorted({t for v in vectors for t in v})
    tables = [F.create_map(*(F.lit(x) for item in v.items() for x in item)) if v else None for v in vectors]

    def counted(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda b: F.transform(b, lambda x, j: F.struct(F.get(s, x).alias("term"), (1 + F.log((F.coalesce(F.get(b, j + 1), F.size(s)) - x) * _weight(F.get(s, x)))).alias("raw"))))

    def cosines(c: Column) -> Column:
        norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x["raw"] * x["raw"]))
        hits = F.filter(c, lambda x: x["term"].isin(*known))
        dot = lambda h, table: F.lit(0.0) if table is None else F.aggregate(h, F.lit(0.0), lambda a, x: a + x["raw"] * F.coalesce(F.try_element_at(table, x["term"]), F.lit(0.0)))
        return let(F.struct(hits.alias("h"), F.when(norm > 0, norm).otherwise(1.0).alias("norm")), lambda b: F.array(*(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(b["h"], t) / b["norm"])) for t in tables)))

    none = F.array(*(F.lit(0.0) for _ in texts))
    return let(F.sort_array(terms_of(folded)), lambda s: F.when(F.size(s) == 0, none).otherwise(let(counted(s), cosines)))


def lexical_vectors(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """Unit vectors as rows of id, term, weight: words and 4-character runs at 1 + ln(count x weight), negative ones included."""
    folded = rows.select(F.col(row_id).alias("id"), fold(F.col(text)).alias("f"))
    counts = folded.select("id", F.explode(terms_of(F.col("f"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("n"))
    raw = counts.withColumn("raw", 1 + F.log(F.col("n") * _weight(F.col("term"))))
    norms = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norms, "id").select("id", "term", (F.col("raw") / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)).alias("weight"))


def lexical_cosine(left: DataFrame, right: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Cosine in [0, 1] of vectors that share a term: left_id, right_id, similarity; only of the given pairs if there are any."""
    a = left.select(F.col("id").alias("left_id"), "term", F.col("weight").alias("wa"))
    b = right.select(F.col("id").alias("right_id"), "term", F.col("weight").alias("wb"))
    met = a.join(b, "term") if pairs is None else pairs.select("left_id", "right_id").distinct().join(a, "left_id").join(b, ["right_id", "term"])
    return met.groupBy("left_id", "right_id").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum(F.col("wa") * F.col("wb")))).alias("similarity"))


def dense_cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors in [0, 1]; 0 for different lengths."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot))).otherwise(0.0)


def search(queries: DataFrame, chunks: DataFrame, limit: int = 10, category: Column | None = None) -> DataFrame:
    """Best chunk per résumé and query, ranked, `limit` of them: exact scan, combined before the shuffle."""
    return dense.search(queries, chunks if category is None else chunks.where(category), limit)


def rerank(shortlist: DataFrame, logit: Column, limit: int) -> DataFrame:
    """A second score over a shortlist of query_id, resume_id, score: the logistic of `logit`; the first becomes retrieval_score."""
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "resume_id")
    again = shortlist.withColumn("retrieval_score", F.col("score")).withColumn("score", F.round(1 / (1 + F.exp(-logit)), 6))
    return again.withColumn("position", F.row_number().over(ranked)).where(F.col("position") <= limit)


def search_metrics(queries: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """Per query: pool size, mean of the k best résumés, and mean and population deviation over the pool."""
    return dense.search_metrics(queries, chunks, k)


Backend = Callable[[DataFrame, DataFrame], DataFrame]
_BACKENDS: dict[str, Backend] = {}


def register_backend(name: str, backend: Backend) -> None:
    """A backend takes two frames of id, text (or vector) and returns left_id, right_id, similarity."""
    _BACKENDS[name] = backend


def backend(name: str) -> Backend:
    """A registered backend; an unknown name falls back to the lexical one."""
    return _BACKENDS.get(name, _BACKENDS["lexical"])


def _lexical(a: DataFrame, b: DataFrame) -> DataFrame:
    from .nearest import all_cosines  # which builds on this module

    return all_cosines(a, b)


register_backend("lexical", _lexical)
register_backend("dense", lambda a, b: blocked_pairs(a.select(F.col("id").alias("left_id"), F.col("vector").alias("va")), b.select(F.col("id").alias("right_id"), F.col("vector").alias("vb")), 1000).select("left_id", "right_id", dense_cosine(F.col("va"), F.col("vb")).alias("similarity")))
