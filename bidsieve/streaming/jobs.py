"""Structured Streaming forms of the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

from ..operators.dedup import cascade
from ..operators.shared import durable, shared_folder
from ..operators.windows import Breaker


def sliced(rows: DataFrame, number: Column, slices: int) -> DataFrame:
    """A table as a stream that comes slice by slice, a batch for each: the slices are written one after the other to the
    shared folder. Rows whose number isn't from 0 to slices - 1 are left out."""
    spark, folder = rows.sparkSession, f"{shared_folder(rows.sparkSession)}/slices-{uuid.uuid4().hex}"
    for i in range(slices):
        rows.where(number == i).coalesce(1).write.parquet(f"{folder}/slice={i}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/slice=[0-9]*")
    return stream.withColumn("at", F.col("ts").cast("timestamp")) if "ts" in stream.columns else stream


def in_turn(rows: DataFrame, by: str, slices: int = 4) -> DataFrame:
    """A table as a stream in slices of about equal size, in the order of a column of times or numbers; nulls come first."""
    at = F.unix_micros(F.col(by).cast("timestamp")) if "timestamp" in rows.schema[by].dataType.typeName() else F.col(by)
    cuts = sorted(set(rows.select(at.cast("double").alias("x")).approxQuantile("x", [i / slices for i in range(1, slices)], 0.01))) if slices > 1 else []
    number = F.lit(0)
    for cut in cuts:
        number = number + F.when(at >= cut, 1).otherwise(0)
    return sliced(rows, number, len(cuts) + 1)


@contextmanager
def _keyed_state(spark: SparkSession) -> Iterator[None]:
    """Stateful processors need the state store that is kept on disk."""
    name, kind = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, kind)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drained(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return what it wrote; the sink is a Parquet table in the shared folder."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    with _keyed_state(spark):
        stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def told(spark: SparkSession, stream: DataFrame, keys: list[str]) -> DataFrame:
    """Run a stream in update mode and return the last row that it told of each key.

    Each batch writes what changed in it, replacing what an earlier try of the batch wrote; nothing written is read again
    before the end, and state ends with the watermark.
    """
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def step(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/n={number}")

    with _keyed_state(spark):
        stream.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    names = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])).parquet(f"{folder}/out/n=*")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "_batch").alias("_s")).select(*keys, *(F.col(f"_s.{c}").alias(c) for c in names)).select(*stream.columns)


def tumbling_counts(events: DataFrame) -> DataFrame:
    """Successes and items per user and day; days that succeed with nothing are flagged. Days more than two behind the newest event are closed."""
    return events.withWatermark("at", "2 days").groupBy("user_id", F.window("at", "24 hours")).agg(F.count_if(F.col("event_type") != "error").alias("successes"), F.sum(F.when(F.col("event_type").isin("view", "error"), 0).otherwise(F.floor("value"))).alias("items")).select("user_id", F.col("window.start").cast("timestamp_ntz").alias("day"), "successes", "items", ((F.col("successes") > 0) & (F.col("items") == 0)).alias("empty"))


def sliding_failures(events: DataFrame) -> DataFrame:
    """Failure share over 30 minutes, every 5."""
    return events.withWatermark("at", "1 hour").groupBy(F.window("at", "30 minutes", "5 minutes")).agg(F.count_if(F.col("event_type") == "error").alias("failures"), F.count("*").alias("runs")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "failures", "runs", (F.col("failures") / F.col("runs") > 0.5).alias("alert"))


def failure_rates(events: DataFrame, per_second: float = 1.0) -> DataFrame:
    """Failures a second over 15 minutes, every 5."""
    counted = events.withWatermark("at", "1 hour").groupBy(F.window("at", "15 minutes", "5 minutes")).agg(F.count_if(F.col("event_type") == "error").alias("failures"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "failures", (F.col("failures") / 900).alias("rate"), (F.col("failures") / 900 > per_second).alias("alert"))


def dedup(pages: DataFrame, key: str) -> DataFrame:
    """First row per key; state is kept for the watermark's span."""
    return pages.withWatermark("at", "7 days").dropDuplicatesWithinWatermark([key])


def _folded(state: tuple[int, int, int, int], rows: Iterator[pd.DataFrame]) -> tuple[int, int, int, int]:
    failures, successes, empties, last = state
    frames = [f for f in rows if len(f)]
    for failed, items, micros in pd.concat(frames).sort_values(["micros", "run_id"])[["failed", "items", "micros"]].itertuples(index=False) if frames else ():
        failures, successes = (failures + 1, 0) if failed else (0, successes + 1)
        empties = empties + 1 if not failed and items == 0 else 0
        last = max(last, int(micros))
    return failures, successes, empties, last


class Health(StatefulProcessor):
    """Streaks of a source as value state; a timer at the end of its silence."""

    def __init__(self, silence: int) -> None:
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.streaks = handle.getValueState("streaks", "failures long, successes long, empties long, last long")

    def told(self, key: tuple, streaks: tuple, silent: bool) -> pd.DataFrame:
        failures, successes, empties, _ = streaks
        name = "failing" if failures >= 3 else "degraded" if failures >= 1 or empties >= 3 else "healthy"
        return pd.DataFrame({"source_key": [key[0]], "failures": [failures], "successes": [successes], "empties": [empties], "state": [name], "silent": [silent]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        streaks = _folded(tuple(self.streaks.get()) if self.streaks.exists() else (0, 0, 0, 0), rows)
        self.streaks.update(streaks)
        for timer in [*self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(streaks[3] // 1000 + self.silence, timerValues.getCurrentWatermarkInMs() + 1))
        yield self.told(key, streaks, False)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        yield self.told(key, tuple(self.streaks.get()), True)

    def close(self) -> None:
        pass


def stateful_health(runs: DataFrame, silence_hours: int = 26) -> DataFrame:
    """State of a source after each batch of its runs; a batch is put in order, later batches are taken as later.

    A timer tells of a source as silent once the watermark (an hour behind the newest run) has passed its last run by `silence_hours`.
    """
    slim = runs.withWatermark("at", "1 hour").select("source_key", "run_id", "failed", "items", "at", F.unix_micros("at").alias("micros"))
    return slim.groupBy("source_key").transformWithStateInPandas(Health(silence_hours * 3_600_000), "source_key long, failures long, successes long, empties long, state string, silent boolean", "Update", "EventTime")


class Circuit(StatefulProcessor):
    """The breaker of a source as value state."""

    def __init__(self, failures: int, wait: float, probes: int, successes: int, reset: float) -> None:
        self.limits = (failures, wait, probes, successes, reset)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.breaker = handle.getValueState("breaker", "state string, failed long, won long, used long, opened double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["seconds", "run_id"])
        breaker = Breaker(*self.limits, *(self.breaker.get() if self.breaker.exists() else ()))
        met = [breaker.before(at, bool(bad)) for at, bad in zip(frame["seconds"], frame["failed"], strict=True)]
        self.breaker.update((breaker.state, breaker.failed, breaker.won, breaker.used, float(breaker.opened)))
        yield pd.DataFrame({"run_id": frame["run_id"].to_numpy(), "source_key": key[0], "circuit": met})

    def close(self) -> None:
        pass


def circuit_timeline(runs: DataFrame, failures: int = 5, wait: float = 600, probes: int = 1, successes: int = 2, reset: float = 6000) -> DataFrame:
    """Circuit breaker state that each run meets; a batch is put in order, later batches are taken as later."""
    slim = runs.select("source_key", "run_id", "failed", (F.unix_micros("at") / 1e6).alias("seconds"))
    return slim.groupBy("source_key").transformWithStateInPandas(Circuit(failures, wait, probes, successes, reset), "run_id long, source_key long, circuit string", "Append", "None")


def split_late(spark: SparkSession, stream: DataFrame, delay: str, folder: str) -> dict[str, int]:
    """Run a stream over what is there; rows with `at` further behind the newest row of the batches before than `delay` go to
    folder/rows/late=true, the others to late=false, by the number n of their batch. Returns how many rows came, and how many late.

    A batch finds the newest time in what earlier batches wrote and replaces what an earlier try of itself wrote, so a
    replay gives the same rows and a restart goes on where it ended. Rows without a time are kept.
    """
    counts: dict[int, dict[str, int]] = {}

    def step(batch: DataFrame, number: int) -> None:
        before = _earlier(spark, f"{folder}/newest", "at timestamp", number)
        mark = before.agg((F.max("at") - F.expr(f"interval {delay}")).alias("mark"))
        seen = Observation(f"late-{uuid.uuid4().hex}")
        marked = batch.crossJoin(F.broadcast(mark)).withColumn("late", F.coalesce(F.col("at") < F.col("mark"), F.lit(False))).drop("mark")
        marked = marked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("late").alias("late"))
        marked.write.mode("overwrite").partitionBy("late").parquet(f"{folder}/rows/n={number}")
        batch.agg(F.max("at").alias("at")).write.mode("overwrite").parquet(f"{folder}/newest/n={number}")
        counts[number] = seen.get

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return {name: sum(c[name] for c in counts.values()) for name in ("rows", "late")}


def _earlier(spark: SparkSession, path: str, schema: str, number: int) -> DataFrame:
    """What batches before a number have written under path/n=...; nothing before the first."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if number == 0 or not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, n int").parquet(path).where(F.col("n") < number).drop("n")


def ingest(spark: SparkSession, stream: DataFrame, stages: list[tuple[str, list[str]]], folder: str, row_id: str = "row_id") -> None:
    """Admit a stream of rows into a keyed table: each batch goes through the cascade of equal keys against all that earlier
    batches brought, and against the rows of smaller ids in itself.

    folder/rows has the keys of all rows and folder/verdicts their verdicts (strategy, canonical_id), both by batch number n. A
    batch reads nothing of its own number or later and replaces it, so a replay changes nothing; all state is in the tables.
    If batches come in order of ids the verdicts are those of the cascade over the whole table, wherever it is cut.
    """
    columns = list(dict.fromkeys([row_id, *(k for _, keys in stages for k in keys)]))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.select(*columns).schema)

    def step(batch: DataFrame, number: int) -> None:
        rows = durable(batch.select(*columns))
        stored = _earlier(spark, f"{folder}/rows", kinds, number).select(*columns).unionByName(rows)
        cascade(rows, stored, stages, row_id, earlier=True).select(row_id, "strategy", "canonical_id").write.mode("overwrite").parquet(f"{folder}/verdicts/n={number}")
        rows.write.mode("overwrite").parquet(f"{folder}/rows/n={number}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def once(deliveries: DataFrame, key: str) -> DataFrame:
    """Deliveries whose key has not been seen within the watermark's span."""
    return deliveries.withWatermark("at", "7 days").dropDuplicatesWithinWatermark([key]).select(key)


class Cap(StatefulProcessor):
    """Times of a user's counted events as list state; a timer drops those that are over and all state once none is left."""

    def __init__(self, cap: int, span: int) -> None:
        self.cap, self.span = cap, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "micros long")

    def keep(self, held: list[int]) -> None:
        for timer in [*self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        if held:
            self.times.put([(t,) for t in held])
            self.handle.registerTimer((held[0] + self.span) // 1000 + 1)
        else:
            self.times.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = [t for (t,) in self.times.get()] if self.times.exists() else []
        frame = pd.concat(list(rows)).sort_values(["micros", "event_id"])
        out = []
        for micros, counted in zip(frame["micros"], frame["counted"], strict=True):
            held = [t for t in held if t > micros - self.span] + ([int(micros)] if counted else [])
            out.append(len(held))
        self.keep(held)
        yield pd.DataFrame({"event_id": frame["event_id"].to_numpy(), "recent": out, "suppressed": [n > self.cap for n in out]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        over = timerValues.getCurrentWatermarkInMs() * 1000 - self.span
        self.keep([t for (t,) in self.times.get() if t > over])
        yield from ()

    def close(self) -> None:
        pass


def rolling_cap(events: DataFrame, cap: int = 2, hours: int = 24) -> DataFrame:
    """Counted events of a user in the last `hours`, kept as a list of times that expire with the watermark, an hour behind
    the newest event, whether the user comes again or not."""
    slim = events.withWatermark("at", "1 hour").select("user_id", "event_id", "at", F.unix_micros("at").alias("micros"), F.col("event_type").isin("view", "click").alias("counted"))
    return slim.groupBy("user_id").transformWithStateInPandas(Cap(cap, hours * 3_600_000_000), "event_id long, recent long, suppressed boolean", "Append", "EventTime")
