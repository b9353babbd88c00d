"""Ranking of candidates for postings, and grades of a project's roles against a pool."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import chunks_fixed, fold, plain_fold
from .nearest import QueryIndex, query_blocks

# Grades with the least z-score of each, and caps by relevance.
GRADES = [("A", 2.5), ("B", 1.5), ("C", 0.75), ("D", 0.0), ("F", float("-inf"))]
RELEVANCE_CAPS = [(0.7, "A"), (0.4, "B"), (0.2, "C"), (float("-inf"), "D")]
LETTERS = ["F", "D", "C", "B", "A"]


def grade_rank(grade: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LETTERS)), grade)


def weaker(a: Column, b: Column) -> Column:
    return F.when(grade_rank(a) <= grade_rank(b), a).otherwise(b)


def graded(metrics: DataFrame, floor: float = 0.25, cap: str = "D") -> DataFrame:
    """z of the best résumés against the pool and its grade; a pool that doesn't know the field caps it."""
    z = (F.col("top_mean") - F.col("mean")) / F.when(F.col("deviation") > 0, F.col("deviation")).otherwise(1e-9)
    grade = F.lit("F")
    for letter, least in reversed(GRADES[:-1]):
        grade = F.when(z >= least, letter).otherwise(grade)
    return metrics.withColumn("z", z).withColumn("grade", F.when(F.col("mean") < floor, weaker(grade, F.lit(cap))).otherwise(grade))


def capped(grade: Column, relevance: Column) -> Column:
    limit = F.lit("D")
    for least, letter in reversed(RELEVANCE_CAPS[:-1]):
        limit = F.when(relevance >= least, letter).otherwise(limit)
    return weaker(grade, limit)


def bottleneck(grades: DataFrame) -> DataFrame:
    """The weakest role of a project, the first of equals."""
    return grades.agg(F.min(F.struct(grade_rank(F.col("grade")).alias("r"), "query_id", "grade")).alias("b")).select(F.col("b.query_id").alias("weakest"), "b.grade")


def coverage(folded: Column, technologies: list[str]) -> Column:
    """Struct of matched and missing technologies, by folded substring."""
    wanted = F.array(*map(F.lit, technologies))
    matched = F.array_compact(F.array(*(F.when(F.contains(folded, F.lit(plain_fold(t))), F.lit(t)) for t in technologies)))
    return F.struct(matched.alias("matched"), F.array_except(wanted, matched).alias("missing"))


def mixed_score(text_score: Column, cover: Column) -> Column:
    """Three quarters text, one quarter share of technologies; the text alone where none are asked for."""
    n = F.size(cover["matched"]) + F.size(cover["missing"])
    return F.when(n > 0, 0.75 * text_score + 0.25 * F.size(cover["matched"]) / n).otherwise(text_score)


def evidence(ranked: DataFrame, row_id: str, text: str, postings: DataFrame, most: int = 3) -> DataFrame:
    """posting_id, row id, passage (its number), score: per posting and row the `most` passages of 70 words nearest to it, among
    those that share a term with it; ties by number.

    A row's passages stay in its task, where they meet the postings, a stated set in blocks; the best of each leave it and
    nothing is shuffled. Both ids are long. A passage's text is chunks_fixed(text)[passage].
    """
    rows = ranked.select(F.col(row_id).cast("long").alias("id"), F.transform(chunks_fixed(F.col(text)), lambda x: fold(x)).alias("passages")).where("id is not null and size(passages) > 0")
    best = None
    for index in query_blocks(postings, 200_000):
        part = rows.mapInArrow(_best_passages(index, most), "posting_id long, id long, passage long, score double")
        best = part if best is None else best.unionAll(part)
    if best is None:
        best = ranked.sparkSession.createDataFrame([], "posting_id long, id long, passage long, score double")
    return best.withColumnRenamed("id", row_id)


def _best_passages(index: QueryIndex, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, passages in zip(batch.column("id").to_pylist(), batch.column("passages"), strict=True):
                scores = np.concatenate([index.cosines(part) for part in _parts(passages.as_py(), 256)])
                scores = np.where(np.isnan(scores), -1, np.floor(scores * 1e4 + 0.5))  # passages without a common term come last
                top = np.argsort(-scores, axis=0, kind="stable")[:most]
                passage, query = top.ravel(), np.tile(np.arange(len(index.ids)), len(top))
                score = scores[passage, query]
                met = score >= 0
                ids = np.array(index.ids)[query[met]]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.full(len(ids), row), pa.int64()), pa.array(passage[met], pa.int64()), pa.array(score[met] / 1e4)], ["posting_id", "id", "passage", "score"])

    return run


def _parts(values: list, size: int) -> Iterator[list]:
    for i in range(0, len(values), size):
        yield values[i : i + size]


def located(rows: DataFrame, row_id: str, text: str, phrase: str, pages: int = 30, most: int = 3, hits: int = 100) -> DataFrame:
    """Pages (lines) with whole-word hits of a phrase: the first `most` of the first `pages`, `hits` counted per page at most."""
    pattern = F.lit(rf"(?iU)\b\Q{phrase}\E\b")
    paged = rows.select(row_id, F.size(F.split(text, "\n")).alias("n"), F.posexplode(F.slice(F.split(text, "\n"), 1, pages)).alias("p", "line"))
    counted = paged.select(row_id, (F.col("p") + 1).alias("page"), (F.col("n") > pages).alias("partial"), F.least(F.regexp_count("line", pattern), F.lit(hits)).alias("hits"), F.regexp_instr("line", pattern).alias("offset"))
    first = Window.partitionBy(row_id).orderBy("page")
    return counted.where("hits > 0").withColumn("r", F.row_number().over(first)).where(F.col("r") <= most).drop("r")


@F.arrow_udf(T.DoubleType())
def pair_logit(asked: pa.Array, offered: pa.Array) -> pa.Array:
    """Share of a folded text's words that another holds, as a logit; any scorer of pairs with this shape may take its place."""
    words = [(set(a.split()), set(b.split())) for a, b in zip(asked.to_pylist(), offered.to_pylist(), strict=True)]
    return pa.array([6 * len(a & b) / max(1, len(a)) - 2 for a, b in words], pa.float64())
