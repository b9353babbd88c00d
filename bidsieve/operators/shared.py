"""What operators share that cut lineage or work on sorted groups: intermediate tables and streams of whole groups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: the session's, or on a single machine, as in tests, a temporary one where none is set."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the folder that the cluster shares."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """A table in the folder that the cluster shares, read again: unlike a checkpoint it is read by columns."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate results, in whatever store it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def parts(df: DataFrame) -> int:
    """Shuffle partitions of the session, for explicit repartitioning."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], at_least: int = 50_000) -> Iterator[pa.Table]:
    """Tables of whole key groups from a stream sorted by `keys`; the last group waits for the next batch."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        if sum(b.num_rows for b in kept) < at_least:
            continue
        table = pa.Table.from_batches(kept)
        same = np.ones(table.num_rows, bool)
        for key in keys:
            values = table.column(key).to_numpy()
            same &= values == values[-1]
        cut = int(np.argmax(same))
        if cut:
            yield table.slice(0, cut)
        kept = table.slice(cut).combine_chunks().to_batches()
    if kept:
        yield pa.Table.from_batches(kept)
