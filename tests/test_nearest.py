"""Top-k lexical search against the exact cosine of all pairs."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from bidsieve.functions.text import chunks_fixed
from bidsieve.operators import similarity as V
from bidsieve.operators import staffing as T
from bidsieve.operators.nearest import Nearest, QueryIndex, nearest_texts

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").select(F.col("item_id").alias("id"), "text")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, "!!"), (9004, "ab"), (None, "some words"), (9005, "the and und")], "id long, text string")
    return items.unionAll(odd.withColumn("id", F.col("id") + 1000)), docs.unionAll(odd)


@pytest.mark.parametrize(("k", "most"), [(30, 200_000), (3, 900)])
def test_nearest_texts(tables, k, most):
    items, docs = tables
    known = [x.where("id is not null") for x in tables]
    exact = V.lexical_cosine(*(V.lexical_vectors(x, "id", "text") for x in known)).withColumn("similarity", F.round("similarity", 4))
    best = exact.withColumn("position", F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("similarity"), "right_id"))).where(F.col("position") <= k)
    got = {tuple(r) for r in nearest_texts(items, docs, k, most).collect()}
    want = {tuple(r) for r in best.select("left_id", "right_id", "similarity", "position").collect()}
    assert got == want
    assert nearest_texts(items.limit(0), docs, k).count() == 0
    assert nearest_texts(items, docs.limit(0), k).count() == 0


def test_all_cosines(tables):
    items, docs = tables
    known = [x.where("id is not null") for x in tables]
    want = {(r[0], r[1]): r[2] for r in V.lexical_cosine(*(V.lexical_vectors(x, "id", "text") for x in known)).collect()}
    got = {(r[0], r[1]): r[2] for r in V.backend("lexical")(items, docs).collect()}
    assert got.pop((10003, 9003)) == 1.0  # "!!" on both sides
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_bounds_spare_dot_products(spark):
    folded = [r.f for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(V.fold(F.col("text")).alias("f")).where("f <> ''").collect()]
    items = [r.f for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select(V.fold(F.col("text")).alias("f")).collect()]
    found = Nearest(QueryIndex(list(range(len(items))), items), 10)
    for i in range(0, len(folded), 128):
        found.show(list(range(i, min(i + 128, len(folded)))), folded[i : i + 128])
    assert found.seen == len(items) * len(folded)
    assert found.compared < found.seen / 2


def test_passages_nearest_to_each_posting(spark, tables):
    items, docs = tables
    items, docs = items.where("id < 4 or id > 10000"), docs.where("id < 60 or id > 9000")
    texts = {r.id: r.p for r in docs.select("id", chunks_fixed(F.col("text")).alias("p")).collect() if r.id is not None and r.p}
    passages = spark.createDataFrame([(i * 1000 + n, p) for i, ps in texts.items() for n, p in enumerate(ps)], "id long, text string")
    exact = V.lexical_cosine(V.lexical_vectors(items.where("id is not null"), "id", "text"), V.lexical_vectors(passages, "id", "text")).selectExpr("left_id", "right_id div 1000 as id", "right_id % 1000 as n", "round(similarity, 4) as s")
    best = exact.withColumn("r", F.row_number().over(Window.partitionBy("left_id", "id").orderBy(F.desc("s"), "n"))).where("r <= 2")
    got = {tuple(r) for r in T.evidence(docs, "id", "text", items, 2).collect()}
    assert got == {tuple(r) for r in best.select("left_id", "id", "n", "s").collect()} and got
    assert T.evidence(docs, "id", "text", items.limit(0)).count() == 0
