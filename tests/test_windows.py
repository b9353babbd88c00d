"""Top-k range joins against brute force."""

from __future__ import annotations

import datetime as dt
import random
from types import SimpleNamespace

import pytest

from pyspark.sql import functions as F

from bidsieve.operators import candidates
from bidsieve.operators import similarity as V
from bidsieve.operators.joins import candidate_window

DAY = dt.timedelta(days=1)


def brute_force(incoming, stored, most):
    out = []
    for i, country, at, due in incoming:
        fit = []
        for j, c, a, d in stored:
            if i is None or j is None or at is None or a is None or i == j or not at - 120 * DAY <= a <= at:
                continue
            if (country is None or c is None or country == c) and (due is None or d is None or abs(due - d) <= 3 * DAY):
                fit.append((-a.timestamp(), j))
        out += [(i, j, n + 1) for n, (_, j) in enumerate(sorted(fit)[:most])]
    return sorted(out)


@pytest.mark.parametrize(("most", "depth", "spread"), [(200, 256, 400), (5, 2, 40), (3, 1, 3)])
def test_candidate_window(spark, most, depth, spread):
    rng = random.Random(most)
    start = dt.datetime(2024, 1, 1)

    def rows(first, n):
        made = []
        for i in range(n):
            at = start + rng.randrange(spread) * DAY + rng.choice([dt.timedelta(0), dt.timedelta(hours=rng.randrange(24))])
            due = None if rng.random() < 0.2 else at + rng.randrange(12) * DAY + rng.choice([dt.timedelta(0), dt.timedelta(minutes=rng.randrange(1440))])
            made.append((first + i, rng.choice(["a", "a", "a", "b", None]), None if rng.random() < 0.03 else at, due))
        return made

    stored, schema = rows(0, 260), "notice_id long, country string, publication timestamp_ntz, deadline timestamp_ntz"
    stored[7] = (None, *stored[7][1:])
    incoming = rows(200, 120)
    got = candidate_window(spark.createDataFrame(incoming, schema), spark.createDataFrame(stored, schema), most=most, depth=depth)
    assert sorted(tuple(r) for r in got.collect()) == brute_force(incoming, stored, most)
    nothing = spark.createDataFrame([], schema)
    assert candidate_window(nothing, spark.createDataFrame(stored, schema)).count() == 0
    assert candidate_window(spark.createDataFrame(incoming, schema), nothing).count() == 0


def noted(spark, n, seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "é tude", "of", "x"]
    made = [(i, rng.choice(["a", "b"]), dt.datetime(2024, 1, 1) + rng.randrange(60) * DAY, None if i % 9 == 0 else dt.datetime(2024, 3, 1) + rng.randrange(20) * DAY, None if i % 50 == 0 else "" if i % 31 == 0 else " ".join(rng.choices(words, k=6))) for i in range(n)]
    return spark.createDataFrame(made, "notice_id long, country string, publication timestamp_ntz, deadline timestamp_ntz, title string")


def test_closest_candidates_equal_a_join_on_terms(spark):
    rows = noted(spark, 400, 3)
    for most in (200, 7):
        pairs = candidate_window(rows, rows, most=most)
        vectors = V.lexical_vectors(rows, "notice_id", "title")
        scored = V.lexical_cosine(vectors, vectors, pairs.select(F.col("incoming_id").alias("left_id"), F.col("stored_id").alias("right_id"))).withColumn("similarity", F.round("similarity", 4)).where("similarity >= 0.8")
        best = scored.join(rows.select(F.col("notice_id").alias("right_id"), "publication"), "right_id").groupBy("left_id").agg(F.max_by("right_id", F.struct("similarity", "publication", -F.col("right_id"))), F.max("similarity"))
        want = sorted(tuple(r) for r in best.collect())
        assert len(want) > 100 and sorted(tuple(r) for r in candidates.closest_candidates(rows, rows, "title", 0.8, most=most).collect()) == want


def test_no_pair_of_candidates_is_shuffled(spark):
    rows = noted(spark, 2000, 5).select("notice_id", "country", "publication", F.lit(None).cast("timestamp_ntz").alias("deadline"), "title")
    found = candidates.closest_candidates(rows, rows, "title", 0.8)
    before = {s.id for s in _stages(spark)}
    assert candidate_window(rows, rows).count() > 150 * 2000 and found.count() > 1000
    assert max(s.shuffled for s in _stages(spark) if s.id not in before) <= 3 * 2000


def _stages(spark):
    """Stages that have run, with the rows that each has written for a shuffle."""
    done = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return [SimpleNamespace(id=(s := done.apply(i)).stageId(), shuffled=s.shuffleWriteRecords()) for i in range(done.size())]
