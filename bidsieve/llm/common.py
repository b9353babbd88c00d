"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import durable, forget, parts, shared_folder, whole_groups, written
from ..sources.tables import spread

__all__ = ["WORD", "Mapper", "bytes_of", "durable", "forget", "kept_rows", "offsets_of", "parts", "read", "row_key", "runs_of", "shared_folder", "slices", "text_of", "whole_groups", "written"]

#: Word pattern of the contracts: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def text_of(df: DataFrame) -> F.Column:
    return F.coalesce(df["text"].cast("string"), F.lit(""))


def row_key(df: DataFrame, *more: str) -> F.Column:
    """Two hashes (128 bits) of id, text and further columns: equal for rows that get the same verdict."""
    parts_of = [df["doc_id"].cast("long"), text_of(df), *(df[c].cast("string") for c in more)]
    return F.struct(F.xxhash64(*parts_of).alias("h1"), F.xxhash64(F.lit(1), *parts_of).alias("h2"))


def kept_rows(df: DataFrame, kept: DataFrame, *more: str) -> DataFrame:
    """Rows of df, with all their columns, whose row_key over the same columns is among those kept."""
    keys = kept.select(F.col("row_key.h1").alias("_h1"), F.col("row_key.h2").alias("_h2")).distinct()
    mine = row_key(df, *more)
    return df.join(keys, (mine["h1"] == keys["_h1"]) & (mine["h2"] == keys["_h2"]), "left_semi")


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the strings of a column take about `limit` bytes in each piece."""
    if not batch.num_rows:
        return
    offsets = offsets_of(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def offsets_of(strings: pa.Array) -> np.ndarray:
    return np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)


def bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string array without nulls, and each string's offsets in them."""
    offsets = offsets_of(strings)
    data = strings.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
