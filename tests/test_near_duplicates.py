"""Near duplicates against the exact cosine of all pairs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from bidsieve.operators import similarity as V
from bidsieve.operators.blocking import near_duplicates
from bidsieve.operators.components import components


def exact(spark, given, least):
    table = spark.createDataFrame(given, "id long, text string")
    vectors = V.lexical_vectors(table, "id", "text").cache()
    links = V.lexical_cosine(vectors, vectors).where(f"left_id < right_id and round(similarity, 4) >= {least}").select(F.col("left_id").alias("a"), F.col("right_id").alias("b")).cache()
    named = {r.node: r.component for r in components(links).collect()}
    return {i: named.get(i, i) for i, _ in given}, {x for r in links.collect() for x in r}


def family(count, words, changed, seed):
    """Texts of one template, near copies of each other in pairs, and texts of their own."""
    chance = random.Random(seed)
    new = lambda: "".join(chance.choice("abcdefghijklmnop") for _ in range(7))
    template = [new() for _ in range(words)]
    out = []
    for i in range(count):
        own = [w if chance.random() > 0.3 else new() for w in template]
        out.append(" ".join(own))
        if i % 3 == 0:
            out.append(" ".join(w if chance.random() > changed else new() for w in own))
    return out + [" ".join(new() for _ in range(words)) for _ in range(30)]


def test_links_inside_a_template_family_are_kept(spark):
    given = list(enumerate(family(60, 120, 0.03, 5)))
    random.Random(1).shuffle(given)
    want, linked = exact(spark, given, 0.92)
    assert len(linked) >= 30
    for block in (256, 7):
        got = {r.id: r for r in near_duplicates(spark.createDataFrame(given, "id long, text string"), "id", "text", block=block).collect()}
        right = [i for i in linked if got[i].component_id == want[i]]
        assert len(right) >= 0.9 * len(linked)
        assert all(got[i].component_id == i and got[i].similarity is None for i in set(want) - linked)
        assert all(got[i].similarity >= 0.92 for i in right)


def test_recall_on_documents_and_odd_rows(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    given = [(r.id, r.text) for r in rows.collect()]
    want, linked = exact(spark, given, 0.92)
    got = {r.id: r.component_id for r in near_duplicates(rows, "id", "text").collect()}
    assert set(got) == set(want) and sum(got[i] == want[i] for i in linked) >= 0.9 * len(linked)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Abc", "x"), (4, "abc", "y"), (4, "abc", "z"), (5, "ab", "z")], "id long, text string, band string")
    assert sorted((r.id, r.component_id, r.similarity) for r in near_duplicates(odd, "id", "text").fillna(-1.0).collect()) == [(1, 1, -1.0), (2, 2, -1.0), (3, 3, 1.0), (4, 3, 1.0), (4, 3, 1.0), (5, 5, -1.0)]
    assert near_duplicates(odd.limit(0), "id", "text").count() == 0
