"""Spelling variants, ranked search and language identification against brute force and their SQL twins."""

from __future__ import annotations

import random

import pytest
import regex
from compare import database, difference
from pyspark.sql import functions as F

from bidsieve.llm import language_id, ranked_search, spelling_variants
from bidsieve.llm.queries import op11_spelling_variants, op12_ranked_search

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize(("limit", "block"), [(20_000, 1000), (40, 3), (0, 1000)])
def test_spelling_variants(docs, odd, nothing, limit, block):
    for df in (docs, odd):
        assert rows(spelling_variants.variants(df, limit=limit, block=block)) == sorted(spelling_variants.brute_force(texts(df)), key=repr)
    assert spelling_variants.variants(nothing).count() == 0


def test_spelling_variants_twin(spark):
    assert difference(op11_spelling_variants(spark, SMALL), database(SMALL), spelling_variants.SQL) == ""


def test_spelling_variants_of_long_words_and_chains(spark):
    rng = random.Random(5)
    long_word = "".join(rng.choice("abcde") for _ in range(3000))
    made = [(long_word, 2), (long_word[:700] + long_word[701:], 2), (long_word[:900] + "z" + long_word[901:], 2), (long_word[:66], 3), (long_word[:65], 3), (long_word[:64], 40), ("colouring", 2), ("coloring", 30), ("colorings", 400), ("xcolorings", 5000), ("×÷àéîõü", 2), ("×÷àéîõú", 25)]
    table = spark.createDataFrame([(i * 100 + k, f"{w} ") for i, (w, n) in enumerate(made) for k in range(n)], "doc_id long, text string")
    got = rows(spelling_variants.variants(table))
    assert got == sorted(spelling_variants.brute_force(texts(table)), key=repr)
    assert any(r[2] == "xcolorings" and r[0] == "coloring" for r in got)


def test_an_edit_leaves_its_gram_sets_whole():
    rng = random.Random(9)
    for trial in range(3000):
        letters = "ab" if trial % 3 else "abcdeé"
        word = "".join(rng.choice(letters) for _ in range(rng.randint(7, 14)))
        frequent = {"".join(rng.choice(letters) for _ in range(3)) for _ in range(rng.randint(0, 6))}
        cut = spelling_variants.Grams(frequent | {g[:2] for g in frequent})
        i, new = rng.randrange(len(word)), rng.choice(letters)
        other = rng.choice([word[:i] + new + word[i + 1 :], word[:i] + new + word[i:], word[:i] + word[i + 1 :]])
        if other == word:
            continue
        mine, its = set(cut.wholes(word)), set(cut.wholes(other))
        if len(word) == len(other):
            assert {k for r, k in mine if r == 0} & {k for r, k in its if r == 0}
        else:
            short, long_one = (mine, its) if len(word) < len(other) else (its, mine)
            assert {k for r, k in short if r == 1} & {k for r, k in long_one if r == 2}


@pytest.mark.parametrize(("width", "most_terms"), [(8192, 30_000), (16, 60)])
def test_ranked_search(spark, docs, odd, nothing, width, most_terms):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    asked = [(r.item_id, r.text) for r in items.select("item_id", "text").collect()]
    assert rows(ranked_search.rank(docs, items, width=width, most_terms=most_terms)) == sorted(ranked_search.brute_force(texts(docs), asked), key=repr)
    made = [(1, "The QUICK brown fox, fox!"), (2, None), (3, ""), (None, "lorem naïve 🎉 words"), (1, "The QUICK brown fox, fox!"), (4, "nowheretobefound")]
    queries = spark.createDataFrame(made, "item_id long, text string")
    assert rows(ranked_search.rank(odd, queries, width=width, most_terms=most_terms)) == sorted(ranked_search.brute_force(texts(odd), made), key=repr)
    assert ranked_search.rank(nothing, queries).count() == 0
    assert ranked_search.rank(odd, nothing.select("doc_id", "text").withColumnRenamed("doc_id", "item_id")).count() == 0


def test_ranked_search_twin(spark):
    assert difference(op12_ranked_search(spark, SMALL), database(SMALL), ranked_search.SQL) == ""


def test_bounds_spare_most_of_the_rescoring(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    block = next(ranked_search.blocks_of(spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet"), 100_000))
    n_docs, n_terms, held = ranked_search.frequencies(docs, block)
    searcher = ranked_search.Searcher(block, n_docs, n_terms, ranked_search.weights(n_docs, held), 10, ranked_search._WIDTH)
    table = docs.select("doc_id", "text").toArrow().combine_chunks()
    for batch in table.to_batches(max_chunksize=256):
        searcher.show(batch.column("doc_id").to_pylist(), batch.column("text"))
    assert searcher.seen == len(block.ids) * docs.count()
    assert searcher.rescored < searcher.seen / 5


def test_language_id_code_lengths(spark, docs, odd, nothing):
    learned = docs.where("doc_id % 4 = 0 and length(text) < 1500")
    model = language_id.fit(learned)
    by_hand = language_id.brute_force([(r.lang, r.text) for r in learned.select("lang", "text").collect()])
    asked = docs.where("doc_id % 7 = 1 and length(text) < 1500").unionByName(odd.select(*docs.columns))
    got = language_id.identify(asked, model, "doc_id", "text").collect()
    assert len(got) == asked.count()
    for r in got:
        if r.text is None or not regex.search(r"\p{L}", r.text):
            assert (r.lang_pred, r.score, r.bits) == ("und", 0.0, None)
        elif len(r.text) < 10_000:
            bits = {x: by_hand(r.text, x) for x in model.languages}
            assert r.lang_pred == min(bits, key=bits.get)
            assert r.bits == pytest.approx(bits[r.lang_pred], rel=1e-9)
            assert r.score == pytest.approx(1 / sum(2.0 ** (bits[r.lang_pred] - b) for b in bits.values()), abs=1e-9)
    assert language_id.predict(nothing).count() == 0
    assert {r.lang_pred for r in language_id.predict(odd).collect()} <= {"en", "fr", "de", "und"}
    nobody = language_id.predict(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(nobody) == odd.count() and {(r.lang_pred, r.score) for r in nobody} == {("und", 0.0)}


def test_language_id_of_rows_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for entries in (1 << 18, 3000):
        got = language_id.predict(docs, entries).join(docs.select("doc_id", "lang"), "doc_id")
        assert got.where("held_out = (crc32(cast(cast(doc_id as string) as binary)) % 3 = 1)").count() == docs.count()
        share = got.where("held_out").select(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0]
        assert share > 0.95


def test_language_id_of_contexts_that_tasks_do_not_hold(spark, docs, odd):
    learned = docs.where("doc_id % 4 = 0 and length(text) < 1500")
    by_hand = language_id.brute_force([(r.lang, r.text) for r in learned.select("lang", "text").collect()])
    asked = docs.where("doc_id % 7 = 1 and length(text) < 1500").unionByName(odd.select(*docs.columns))
    whole = language_id.fit(learned)
    want = sorted((tuple(r) for r in language_id.identify(asked, whole, "doc_id", "text").collect()), key=repr)
    for entries in (1500, 0):
        model = language_id.fit(learned, entries)
        assert whole.rest is None and len(model.held) < len(whole.held) / 2
        assert sorted((tuple(r) for r in language_id.identify(asked, model, "doc_id", "text").collect()), key=repr) == want
    scored = [(text, lang, bits) for _, text, lang, _, bits in want if bits is not None and len(text) < 10_000]
    assert len(scored) > 10
    for text, lang, bits in scored:
        assert bits == pytest.approx(by_hand(text, lang), rel=1e-9)


def test_language_id_of_thousands_of_languages(spark):
    """More languages than a fixed number, each with a word of its own."""
    rows = [(i, f"alpha w{i:05d}x omega", f"l{i:05d}") for i in range(4200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language_id.fit(table, 40)
    asked = table.where("doc_id % 100 = 7")
    assert model.rest is not None and len(model.languages) == 4200
    got = language_id.identify(asked, model, "doc_id", "lang").collect()
    assert len(got) == 42 and all(r.lang_pred == r.lang for r in got)
