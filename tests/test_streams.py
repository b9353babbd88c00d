"""Streams over several batches: any cut, restarts, replays, timers."""

from __future__ import annotations

import datetime as dt
import random
import shutil

import pytest
from pyspark.sql import functions as F

from bidsieve.operators import windows as W
from bidsieve.operators.dedup import cascade
from bidsieve.queries.duplicates import STAGES, collected
from bidsieve.streaming import jobs as S

START = dt.datetime(2024, 3, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def pages(spark):
    """Pages, some of them again later without address and number, and with another raw hash."""
    table = collected(spark, "/root/testdata/sf0.001").drop("title")
    none = lambda c: F.lit(None).cast(table.schema[c].dataType).alias(c)
    raw = F.when(F.col("row_id") % 2 == 0, F.col("raw_sha256")).otherwise("other")
    again = table.where("row_id % 5 < 2").select((F.col("row_id") + 1000).alias("row_id"), "portal", none("canonical_url"), none("external_id"), raw.alias("raw_sha256"), "text_sha256")
    moved = table.where("canonical_url is not null").select((F.col("row_id") + 2000).alias("row_id"), "portal", "canonical_url", none("external_id"), F.lit("new").alias("raw_sha256"), none("text_sha256"))
    table = table.unionByName(again).unionByName(moved)
    return spark.createDataFrame(table.collect(), table.schema).cache()


@pytest.mark.parametrize("slices", [1, 3])
def test_ingest_is_the_cascade_wherever_it_is_cut(spark, pages, tmp_path, slices):
    want = rows(cascade(pages, pages, STAGES, earlier=True).select("row_id", "strategy", "canonical_id"))
    assert {r[1] for r in want} == {None, *(name for name, _ in STAGES)}
    stream, folder = S.in_turn(pages, "row_id", slices), str(tmp_path / "in")
    S.ingest(spark, stream, STAGES, folder)
    verdicts = lambda: rows(spark.read.parquet(f"{folder}/verdicts").drop("n"))
    assert verdicts() == want
    S.ingest(spark, stream, STAGES, folder)  # nothing new
    assert verdicts() == want
    shutil.rmtree(f"{folder}/state")  # every batch is delivered again
    S.ingest(spark, stream, STAGES, folder)
    assert verdicts() == want


def test_ingest_goes_on_where_it_ended(spark, pages, tmp_path):
    schema, files, folder = pages.schema, str(tmp_path / "files"), str(tmp_path / "in")
    half = pages.agg(F.expr("percentile_approx(row_id, 0.5)")).first()[0]
    for part in (pages.where(F.col("row_id") < half), pages.where(F.col("row_id") >= half)):
        part.coalesce(1).write.mode("append").parquet(files)
        S.ingest(spark, spark.readStream.schema(schema).parquet(files), STAGES, folder)
    assert rows(spark.read.parquet(f"{folder}/verdicts").drop("n")) == rows(cascade(pages, pages, STAGES, earlier=True).select("row_id", "strategy", "canonical_id"))


def made_runs(spark, n, seed):
    rng, at, out = random.Random(seed), START, []
    for i in range(n):
        at += dt.timedelta(minutes=rng.randrange(240))
        out.append((i, rng.randrange(5), at, rng.random() < 0.45, rng.randrange(2)))
    return spark.createDataFrame(out, "run_id long, source_key long, ts timestamp_ntz, failed boolean, items long")


@pytest.mark.parametrize("slices", [2, 5])
def test_states_over_batches_equal_the_batch_form(spark, slices):
    runs = made_runs(spark, 150, slices)
    got = S.drained(spark, S.circuit_timeline(S.in_turn(runs, "ts", slices), failures=2, wait=3600, probes=1, successes=1, reset=90_000))
    assert rows(got.select("run_id", "source_key", "circuit")) == rows(W.circuit_timeline(runs, failures=2, wait=3600, probes=1, successes=1, reset=90_000).select("run_id", "source_key", "circuit"))
    # the last source is silent from the middle on
    runs = runs.where("source_key < 4 or run_id < 70")
    told = S.told(spark, S.stateful_health(S.in_turn(runs, "ts", slices)), ["source_key"])
    want = W.health(W.streaks(runs)).select("source_key", "failures", "successes", "empties", "state")
    assert rows(told.drop("silent")) == rows(want)
    newest = runs.agg(F.max("ts")).first()[0] - dt.timedelta(hours=1)
    last = {r[0]: r[1] for r in runs.groupBy("source_key").agg(F.max("ts")).collect()}
    assert {r.source_key: r.silent for r in told.collect()} == {k: t + dt.timedelta(hours=26) <= newest for k, t in last.items()}
    events = runs.select(F.col("run_id").alias("event_id"), F.col("source_key").alias("user_id"), "ts", F.when(F.col("failed"), "view").otherwise("buy").alias("event_type"))
    capped = S.drained(spark, S.rolling_cap(S.in_turn(events, "ts", slices)))
    assert rows(capped) == rows(W.rolling_cap(events, "user_id", F.col("event_type") == "view", 2).select("event_id", "recent", "suppressed"))


def test_late_rows_are_counted(spark, tmp_path):
    rng = random.Random(3)
    made = [(i, START + dt.timedelta(hours=rng.randrange(800)) if i % 11 else None, i % 3) for i in range(200)]
    table = spark.createDataFrame(made, "event_id long, ts timestamp_ntz, slice int")
    folder = str(tmp_path / "late")
    stream = S.sliced(table, F.col("slice"), 3)
    counts = S.split_late(spark, stream, "5 days", folder)
    newest, late = None, set()
    for k in range(3):
        late |= {i for i, t, s in made if s == k and t and newest and t < newest - dt.timedelta(days=5)}
        newest = max([t for _, t, s in made if s == k and t] + ([newest] if newest else []))
    found = lambda: {r.event_id for r in spark.read.parquet(f"{folder}/rows").where("late = 'true'").collect()}
    assert found() == late and counts == {"rows": 200, "late": len(late)}
    shutil.rmtree(f"{folder}/state")
    assert S.split_late(spark, stream, "5 days", folder) == counts
    assert found() == late and spark.read.parquet(f"{folder}/rows").count() == 200
