"""Fitted and temporal operators, and the pipeline."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pytest
import regex
from compare import database, difference
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from bidsieve.llm import quality_classifier, quality_rules, queries, simhash, substring_dedup, url_filter

SMALL = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words, text = WORDS.findall(text or ""), text or ""
    windows: dict[tuple, list[int]] = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_rules_count_and_judge(spark, docs, odd, nothing):
    for df in (docs, odd):
        given = df.select("doc_id", "text").collect()
        got = quality_rules.digest(quality_rules.judge(df)).collect()
        want = sorted(((r.doc_id, *base(r.text)) for r in given), key=repr)
        assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=repr) == want
        for r in got:
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
            assert not (r.base_failed and r.kept)
    assert quality_rules.judge(nothing).count() == 0
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good = quality_rules.judge(docs).join(labels, "doc_id").where("quality = 1 and not base_failed")
    assert good.where("kept").count() == good.count()


def test_the_estimate_is_the_determinant_of_the_central_rows(spark):
    """One group against numpy: bins of the distance, exact sums, consistency factor."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(0, 300, (400, 5)) + 1000).astype(int)
    x[:40] += 4000
    rows = spark.createDataFrame([("g", *map(int, r)) for r in x], "g string, " + ", ".join(f"x{i} long" for i in range(5)))
    m, s = np.median(x, axis=0), np.diag((1.4826 * np.median(np.abs(x - np.median(x, axis=0)), axis=0)) ** 2 + (np.array(quality_rules._FLOOR) * 1000) ** 2)
    names = [f"m{i}" for i in range(5)] + [f"s{i}{j}" for i, j in quality_rules._PAIRS]
    params = quality_rules._factor(spark.createDataFrame([("g", 0, *map(float, m), *(float(s[i, j]) for i, j in quality_rules._PAIRS))], "g string, start int, " + ", ".join(f"{n} double" for n in names)))
    got = quality_rules._concentrated(rows, params, 0.75, 1.2).first().asDict()
    d = np.sqrt(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m))
    bins = np.minimum(np.floor(d * 64), 4096)
    inside = x[bins <= np.sort(bins)[int(np.ceil(0.75 * len(x))) - 1]]
    want = np.linalg.cholesky(np.cov(inside.T, bias=True) * 1.2 + np.diag((np.array(quality_rules._FLOOR) * 1000) ** 2))
    assert np.allclose([got[f"m{i}"] for i in range(5)], inside.mean(axis=0))
    assert np.allclose([got[f"l{i}{j}"] for i, j in quality_rules._PAIRS], [want[i, j] for i, j in quality_rules._PAIRS], rtol=1e-6)


def robust(x, share=0.75, steps=3):
    """Minimum covariance determinant of the rows x, by numpy: mean and covariance of the best of three starts."""
    floor = np.diag((np.array(quality_rules._FLOOR) * 1000) ** 2)
    grow = share / quality_rules.gamma_share(3.5, quality_rules.chi_square(share, 5) / 2)
    m = np.median(x, axis=0)
    a = 1.4826 * np.median(np.abs(x - m), axis=0)
    length = np.linalg.norm(x - m, axis=1, keepdims=True)
    u = np.round(np.divide(x - m, length, out=np.zeros(x.shape), where=length > 0) * 1000)
    found = []
    for centre, spread in ((m, np.diag(a**2) + floor), (x.mean(axis=0), np.cov(x.T, bias=True) + floor), (m, u.T @ u / len(x) * (a**2).sum() / 1e6 + floor)):
        for _ in range(steps):
            d = np.sqrt(np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(spread), x - centre))
            bins = np.minimum(np.floor(d * 64), 4096)
            inside = x[bins <= np.sort(bins)[int(np.ceil(share * len(x))) - 1]]
            centre, spread = inside.mean(axis=0), np.cov(inside.T, bias=True) * grow + floor
        found.append((round(float(np.linalg.slogdet(spread)[1]), 6), centre, spread))
    return min(found, key=lambda f: f[0])[1:]


@pytest.mark.parametrize("small", [True, False])
def test_the_verdict_equals_numpy(spark, small, monkeypatch):
    """Base rules, groups, the least determinant of three starts and the cut of the distance, over whole tables."""
    if not small:  # groups too many to broadcast are joined in salted parts
        monkeypatch.setattr(quality_rules, "_BROADCAST", 2)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet" if small else f"{SMALL}/documents.parquet")
    facts = quality_rules.statistics(docs).select("doc_id", "lang", "source", "n_words", "n_repeat_words", *quality_rules._vector()).collect()
    groups: dict[tuple, list] = {}
    for r in facts:
        if r.n_words >= 20 and 100 * r.n_repeat_words <= 30 * r.n_words:
            groups.setdefault((r.lang, r.source), []).append(r)
    size = lambda lang: sum(len(rs) for (x, _), rs in groups.items() if x == lang)
    want, cut = {}, quality_rules.chi_square(1 - 1e-9, 5)
    for (lang, _), rs in groups.items():
        used = rs if len(rs) >= 10 else [r for (x, _), some in groups.items() if x == lang for r in some] if size(lang) >= 10 else [r for some in groups.values() for r in some]
        centre, spread = robust(np.array([r[5:] for r in used], float))
        for r in rs:
            d = np.array(r[5:]) - centre
            want[r.doc_id] = float(np.sqrt(d @ np.linalg.inv(spread) @ d))
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert {d for d, r in got.items() if not r.base_failed} == set(want)
    assert all(abs(got[d].distance - x) < 1e-6 * max(1, x) and got[d].kept == (x * x <= cut) for d, x in want.items())
    assert not any(r.kept for r in got.values() if r.base_failed)


def test_classifier(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    result = quality_classifier.classify(docs, labels).join(labels, "doc_id").where("held_out")
    right = result.where("predicted = quality").count() / result.count()
    assert right >= 0.97
    assert quality_classifier.classify(odd, labels).count() == odd.count()
    assert quality_classifier.classify(nothing, labels).count() == 0
    assert {r.score for r in quality_classifier.classify(odd, labels.limit(0)).collect()} == {0.5}


def counted(text):
    """The statistics of a text, plainly."""
    text = text or ""
    words, lines = WORDS.findall(text), [x for x in text.split("\n") if WORDS.search(x)]
    chars = sum(map(len, words))
    of = lambda a, b: a / b if b else 0.0
    count = lambda pattern: len(regex.findall(pattern, text))
    return [
        math.log1p(len(words)), of(chars, len(words)), of(count(r"[#*$%&|<>]"), chars), of(count(r"\p{Lu}"), chars), of(count(r"\p{N}"), chars), of(count(r"\p{P}"), chars), of(count("!"), chars), of(count(r"\|"), chars),
        of(len(set(words)), len(words)), 1 - of(len(set(lines)), len(lines)), of(len(words), len(lines)),
    ]


def test_scores_are_the_weighted_rules(spark, docs, odd):
    """Statistics, rules and logistic sum of every row against plain Python, with the model that the same labels give."""
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality_classifier.fit(quality_classifier.with_features(docs, "doc_id"), labels)
    assert 0 < len(model.rules) < 200
    for df, got in ((docs, quality_classifier.classify(docs, labels)), (odd, quality_classifier.with_features(odd, "doc_id").withColumn("score", model.score()))):
        want = {}
        for r in df.select("doc_id", "text").collect():
            x = counted(r.text)
            total = model.intercept + sum(w for rule, w in model.rules if all(above < x[i] <= up_to for i, above, up_to in rule))
            want.setdefault(r.doc_id, []).append((round(1 / (1 + math.exp(-total)), 9), *(round(v, 9) for v in x)))
        have = {}
        for r in got.collect():
            have.setdefault(r.doc_id, []).append((round(r.score, 9), *(round(r[f], 9) for f in quality_classifier.FEATURES)))
        assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    held = {r.doc_id: r.held_out for r in quality_classifier.classify(docs, labels).select("doc_id", "held_out").collect()}
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, h in held.items())


def test_tree_rules():
    shown = "DecisionTree\n  If (feature 0 <= 1.5)\n   If (feature 1 <= 2.0)\n    Predict: 0.0\n   Else (feature 1 > 2.0)\n    Predict: 1.0\n  Else (feature 0 > 1.5)\n   Predict: 1.0\n"
    inf = float("inf")
    assert quality_classifier.tree_rules(shown) == {((0, -inf, 1.5),), ((0, 1.5, inf),), ((0, -inf, 1.5), (1, -inf, 2.0)), ((0, -inf, 1.5), (1, 2.0, inf))}


def test_url_filter_equals_its_sql(spark):
    assert difference(queries.op3_url_filter(spark, SMALL), database(SMALL), url_filter.SQL) == ""


def test_url_filter_cases(spark):
    entries = spark.createDataFrame([("a.org", True, "2024-01-10"), ("a.org", False, "2024-03-01"), ("a.org", True, "2024-03-01"), ("b.org/x", True, "2024-02-01"), ("B.org/x", False, "2024-02-03"), (None, True, "2024-01-01"), ("c.org", None, "2024-01-01")], "key string, listed boolean, at string").withColumn("at", F.col("at").cast("timestamp"))
    captures = spark.createDataFrame([(1, "http://www.A.org/p", "2024-01-09"), (1, "http://www.A.org/p", "2024-01-10"), (2, "https://b.org/x/y", "2024-02-02"), (2, "https://b.org/x/y", "2024-02-02"), (3, "https://b.org/xy", "2024-02-02"), (4, None, "2024-02-02"), (5, "http://a.org", None), (6, "", "2024-02-02"), (7, "http://b.org/x", "2024-02-03")], "page_id long, url string, key string").withColumn("fetched_at", F.col("key").cast("timestamp"))
    got = sorted((r.page_id, r.blocked, r.listed_key) for r in url_filter.judge(captures, entries).collect())
    assert got == [(1, False, None), (1, True, "a.org"), (2, True, "b.org/x"), (2, True, "b.org/x"), (3, False, None), (4, False, None), (5, False, None), (6, False, None), (7, False, None)]
    cased = spark.createDataFrame([("D.org/Path", True, "2024-01-01")], "key string, listed boolean, at string").withColumn("at", F.col("at").cast("timestamp"))
    asked = spark.createDataFrame([(1, "https://d.ORG/Path/y"), (2, "https://d.org/path/y")], "page_id long, url string").withColumn("fetched_at", F.lit("2024-02-01").cast("timestamp"))
    assert sorted((r.page_id, r.blocked) for r in url_filter.judge(asked, cased).collect()) == [(1, True), (2, False)]
    assert url_filter.judge(captures.limit(0), entries).count() == 0
    assert url_filter.judge(captures, entries.limit(0)).where("blocked").count() == 0


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.rules(spark, docs, sf)
    want = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == list(corpus_pipeline.DOCUMENTS)
    good = corpus_pipeline.classifier(spark, kept, sf)
    rows = [(r.doc_id, r.text) for r in good.collect()]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert {d for d, _ in rows} == {r.doc_id for r in quality_classifier.classify(kept, labels).where("predicted = 1").collect()} and len(rows) > 300
    heads = {c for _, _, c in simhash.brute_force(rows)}
    one = corpus_pipeline.near_duplicates(spark, good, sf)
    left = sorted((r.doc_id, r.text) for r in one.collect())
    assert {d for d, _ in left} == heads
    cut = corpus_pipeline.repeated_passages(spark, one, sf)
    lengths = {d: n - gone for d, n, gone, _ in substring_dedup.brute_force(left)}
    assert {r.doc_id: len(WORDS.findall(r.text)) for r in cut.collect()} == lengths
    assert all(len(r.text) == r.n_chars for r in cut.collect())
    library = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    ids = {r.doc_id: library.encode(r.text, add_special_tokens=False).ids + [1] for r in cut.collect()}
    told: dict[int, int] = {}
    for r in corpus_pipeline.sequences(spark, cut, sf).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        told[r.doc_id] = told.get(r.doc_id, 0) + r.length
    assert told == {d: len(x) for d, x in ids.items()}


def test_pipeline_runs(spark, odd):
    pieces = corpus_pipeline.run(spark, SMALL)
    assert pieces.count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SMALL).count() >= 0
