"""Duplicates, cheapest test first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold
from .shared import durable


def in_run(rows: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """First row by arrival of each key (the first non-null of `keys`), and how many later ones it stands for."""
    marked = rows.withColumn("_key", F.coalesce(*keys))
    by_key = Window.partitionBy("_key")
    first = marked.where("_key is not null").withColumn("_r", F.row_number().over(by_key.orderBy(arrival))).withColumn("duplicates", F.count("*").over(by_key) - 1).where("_r = 1")
    # rows without a key stand for themselves and meet in no window
    return first.drop("_r").unionByName(marked.where("_key is null").withColumn("duplicates", F.lit(0).cast("long"))).drop("_key")


def cascade(incoming: DataFrame, stored: DataFrame, stages: list[tuple[str, list[str]]], row_id: str = "row_id", earlier: bool = False, semantic: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One verdict per incoming row: the first stage (strategy, key columns) that finds a stored row with equal, non-null keys.

    Each stage only joins what the stages before have left. With `earlier` a row only meets stored rows of a smaller id, so
    that a table may be held against itself. `semantic` gets the rows that no stage has matched and returns row_id,
    canonical_id and similarity of those that it matches. Returns row_id, strategy, canonical_id and similarity; rows that
    match nothing have nulls.
    """
    columns = [row_id, "strategy", "canonical_id", "similarity"]
    left, found = incoming, None
    for strategy, keys in stages:
        table = stored.dropna(subset=keys).groupBy(*keys).agg(F.min(row_id).alias("canonical_id"))
        hits = left.join(table, keys)
        hits = hits.where(F.col("canonical_id") < F.col(row_id)) if earlier else hits
        hits = hits.select(row_id, F.lit(strategy).alias("strategy"), "canonical_id", F.lit(1.0).alias("similarity"))
        found = hits if found is None else found.unionByName(hits)
        left = left.join(hits.select(row_id), row_id, "left_anti")
    if semantic is not None:
        left = durable(left)
        hits = durable(semantic(left).withColumn("strategy", F.lit("semantic")).select(*columns))
        found = hits if found is None else found.unionByName(hits)
        left = left.join(hits.select(row_id), row_id, "left_anti")
    rest = left.select(row_id, F.lit(None).cast("string").alias("strategy"), F.lit(None).cast(stored.schema[row_id].dataType).alias("canonical_id"), F.lit(None).cast("double").alias("similarity"))
    return rest if found is None else found.unionByName(rest)


def comparison_key(fields: list[tuple[str, float]], limits: dict[str, int] | None = None) -> Column:
    """Folded fields, each repeated max(1, round(2 x weight)) times (ties to even), as one text."""
    parts = []
    for name, weight in fields:
        value = fold(F.substring(F.coalesce(name, F.lit("")), 1, (limits or {}).get(name, 1 << 30)))
        parts.append(F.when(value != "", F.array_join(F.array_repeat(value, F.lit(max(1, round(2 * weight)))), " ")))
    return F.coalesce(F.concat_ws(" ", *parts), F.lit(""))


def evidence(verdicts: DataFrame, incoming: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Per canonical row: hits, when last seen, and the distinct sources in order of first sight."""
    hits = verdicts.where("canonical_id is not null").join(incoming.select(row_id, "source", "seen"), row_id)
    first = hits.groupBy("canonical_id", "source").agg(F.min(F.struct("seen", row_id)).alias("first"), F.count("*").alias("n"), F.max("seen").alias("last"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("first", "source"))), lambda x: x["source"])
    return first.groupBy("canonical_id").agg(F.sum("n").alias("hits"), F.max("last").alias("last_seen"), ordered.alias("sources"))
