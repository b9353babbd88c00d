"""Operators against brute force, on the small table and on awkward rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bidsieve.llm import bpe, embedding_dedup, packing, rolling, sharding, simhash, substring_dedup, suffix_dedup

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("window", [400, 40])
def test_suffix_dedup(docs, odd, nothing, window):
    for df in (docs, odd):
        assert rows(suffix_dedup.digest(suffix_dedup.remove_repeated_bytes(df, window))) == sorted(suffix_dedup.brute_force(texts(df), window), key=repr)
    assert suffix_dedup.remove_repeated_bytes(nothing).count() == 0


@pytest.mark.parametrize("window", [50, 10])
def test_substring_dedup(docs, odd, nothing, window):
    for df in (docs, odd):
        assert rows(substring_dedup.digest(substring_dedup.remove_repeated_words(df, window))) == sorted(substring_dedup.brute_force(texts(df), window), key=repr)
    assert substring_dedup.remove_repeated_words(nothing).count() == 0


def test_simhash(docs, odd, nothing):
    assert rows(simhash.near_duplicates(docs)) == sorted(simhash.brute_force(texts(docs)), key=repr)
    known = odd.where("doc_id is not null")
    assert rows(simhash.near_duplicates(known)) == sorted(simhash.brute_force(texts(known)), key=repr)
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert simhash.near_duplicates(nothing).count() == 0


def test_simhash_keeps_one_of_each_class(spark, docs, odd):
    table = spark.createDataFrame([(5, "one text here", "b"), (5, "quite another text", "a"), (5, "one text here", "a"), (None, "One text here", "c"), (None, "a text without id", "d"), (None, "a text without id", "e"), (2, None, None), (3, " ", None)], "doc_id long, text string, fp string")
    got = rows(simhash.one_of_each(table))
    assert got == sorted([(5, "one text here", "a"), (5, "quite another text", "a"), (None, "a text without id", "d"), (2, None, None)], key=repr)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in simhash.brute_force(texts(docs))}
    assert simhash.one_of_each(odd.limit(0)).count() == 0


def test_every_near_pair_shares_an_anchor():
    random.seed(5)
    for _ in range(3000):
        x = random.getrandbits(64)
        y = x
        for bit in random.sample(range(64), random.choice([0, 1, 2])):
            y ^= 1 << bit
        _, a = simhash.anchors_of(np.array([x], np.uint64), 2)
        _, b = simhash.anchors_of(np.array([y], np.uint64), 2)
        assert set(a.tolist()) & set(b.tolist())


def test_bpe(docs, odd, nothing):
    library = Tokenizer.from_file(BYTE)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for df in (docs, odd):
        want = []
        for doc_id, text in texts(df):
            ids = library.encode(text or "", add_special_tokens=False).ids
            want.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
        assert rows(bpe.digest(bpe.decode(bpe.encode(df, BYTE), BYTE))) == sorted(want, key=repr)
    assert bpe.encode(nothing, BYTE).count() == 0


@pytest.mark.parametrize("text", ["", " ", "  a  b \n\n c\t d\n e  ", "a" * 3000, "don't I'LL we've 's", "\x1c a\x1fb \x85 c", "a\xa0 b à c\xa0", "xyz " * 99 + "\n" * 50, "=====----____" * 40, "日本語 テスト"])
def test_bpe_texts(text):
    library, own = Tokenizer.from_file(BYTE), bpe.load(BYTE)
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text).tolist() == ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert packing.load(WORD).encode([text])[0].tolist() == Tokenizer.from_file(WORD).encode(text, add_special_tokens=False).ids


#: What normalisers and word patterns treat in their own ways: letters that fold to two, marks that join, digits, apostrophes, blanks of all kinds.
PARTS = ["a", "B", "ß", "É", "e\u0301", "\u0301", "İ", "i\u0307", "ǆ", "ŉ", "\u0958", "\ufb01", "ς", "日", "١", "²", "½", "🎉", "'s", "'T", "'re", "'", ".", ",", "!?", "...", ";", "-", "_", "$", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "<|endoftext|>", "<|startoftext|>", "the", "ing", "7", "42"]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_tokenizers_on_random_texts(path):
    chance = random.Random(11)
    given = ["".join(chance.choice(PARTS) for _ in range(chance.randint(0, 12))) for _ in range(20_000)]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(given, add_special_tokens=False)]
    if path == BYTE:
        assert [np.frombuffer(x, np.int32).tolist() for x in bpe.load(path).encode_all(given)] == want
    assert [x.tolist() for x in packing.load(path).encode(given)] == want


def test_packing(docs, odd, nothing):
    library = Tokenizer.from_file(WORD)
    for df, limit in ((docs, 2048), (odd, 64)):
        got = packing.digest(packing.pack(df, WORD, limit=limit)).collect()
        ids = sorted((d if d is not None else -1, library.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in texts(df))
        by, sequences = {}, {}
        for r in got:
            by.setdefault(-1 if r.doc_id is None else r.doc_id, []).append(r)
            sequences.setdefault(r.sequence_id, []).append(r)
        for doc_id, want in ids:
            copies = sum(d == doc_id for d, _ in ids)
            assert sum(r.length for r in by[doc_id]) == copies * len(want)
            for r in by[doc_id]:
                assert r.doc_tokens == len(want)
                assert r.ids_crc32 == zlib.crc32(np.array(want[r.start : r.start + r.length], "<u4").tobytes())
        for pieces in sequences.values():
            at = 0
            for r in sorted(pieces, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= limit
    assert packing.pack(nothing, WORD).count() == 0


def test_best_cuts_is_optimal():
    random.seed(3)
    for _ in range(200):
        limit = random.randint(3, 12)
        at = [0]
        while len(at) < 9:
            at.append(at[-1] + random.randint(1, limit))
        penalty = [0] + [random.randint(0, 6) for _ in at[1:]]
        best = {0: 0}
        for j in range(1, len(at)):
            best[j] = min(best[i] + limit - (at[j] - at[i]) + penalty[j] for i in range(j) if at[j] - at[i] <= limit)
        cuts = packing.best_cuts(at, penalty, limit)
        assert sum(limit - at[j] + at[i] + penalty[j] for i, j in zip(cuts, cuts[1:], strict=False)) == best[len(at) - 1]


def test_sharding(docs, odd, nothing):
    for df in (docs, odd):
        got = sharding.shard(df).collect()
        given = [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]
        hashes = [r.h for r in df.select(F.xxhash64(F.lit("shard-1"), F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("h")).collect()]
        if all(d is not None for d, _, _ in given):
            assert sorted((tuple(r)[:1] + tuple(r)[2:] for r in got), key=repr) == sorted(sharding.brute_force(given, hashes), key=repr)
        counts = np.bincount([r.shard for r in got], minlength=40)
        assert counts.sum() == len(given) and counts.max() - counts.min() <= 1
        for s in range(40):
            assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert sharding.shard(nothing).count() == 0


def test_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    near = [(10_000 + r.vec_id, [x * 1.0001 + 0.002 * i for i, x in enumerate(r.embedding[:3])] + list(r.embedding[3:])) for r in df.where("vec_id < 40").collect()]
    same = [(20_000 + i, list(df.first().embedding)) for i in range(300)]
    odd = [(30_000, None), (30_001, []), (30_002, [0.0] * 64), (30_003, [float("nan")] * 64), (30_004, [1.0] * 3), (30_005, [None] * 64), (30_006, [1e-30] * 64)]
    given = [(r.vec_id, list(r.embedding)) for r in df.collect()] + near + same
    table = spark.createDataFrame(given + odd, "vec_id long, embedding array<float>")
    got = rows(embedding_dedup.near_duplicates(table))
    single = [(v, [float(np.float32(x)) for x in e]) for v, e in given]
    want = embedding_dedup.brute_force(single) + [(v, 0, v, True) for v, _ in odd]
    links = {r[0]: r[1] for r in got}
    assert sum(links.values()) >= 0.9 * sum(r[1] for r in want)
    assert all(links[r[0]] <= r[1] for r in want)
    assert {r[0]: r[2] for r in got} == {r[0]: r[2] for r in want}
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def test_blocks_of_a_long_list_meet(spark):
    random.seed(1)
    base = [random.gauss(0, 1) for _ in range(16)]
    table = spark.createDataFrame([(i, [x + random.gauss(0, 0.01) for x in base]) for i in range(60)], "vec_id long, embedding array<double>")
    got = embedding_dedup.near_duplicates(table, block=7).collect()
    assert all(r.n_links == 59 and r.component_id == 0 for r in got)



@pytest.mark.parametrize(("pivots", "noise"), [(128, 0.2), (128, 0.25), (640, 0.2)])  # 640: what 1.6 million vectors get
def test_a_large_group_of_near_copies_keeps_its_links(spark, pivots, noise):
    random = np.random.default_rng(1)
    centre = random.normal(size=64)
    group = centre / np.linalg.norm(centre) + random.normal(size=(1000, 64)) * noise / 8
    x = random.permutation(np.concatenate((random.normal(size=(2000, 64)), group)))
    given = list(enumerate(x.tolist()))
    table = spark.createDataFrame(given, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table, pivots=pivots, block=300).collect()}
    want = embedding_dedup.brute_force(given)
    assert sum(r.n_links for r in got.values()) >= 0.98 * sum(r[1] for r in want) > 0
    assert all(got[v].n_links <= n and (got[v].component_id == c or noise > 0.2) for v, n, c, _ in want)


@pytest.mark.parametrize("size", [60, 900, 2700])
def test_tight_groups_keep_their_links(spark, size):
    random = np.random.default_rng(7)
    x = random.normal(size=(3000, 64))
    x[:size] = random.normal(size=64) + random.normal(size=(size, 64)) * 0.1
    given = list(enumerate(random.permutation(x).tolist()))
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(given, "vec_id long, embedding array<double>")).collect()}
    want = embedding_dedup.brute_force(given)
    assert sum(r.n_links for r in got.values()) >= 0.98 * sum(r[1] for r in want) > 0
    assert all(got[v].n_links <= n and got[v].component_id == c for v, n, c, _ in want)


def test_vectors_of_all_lengths_and_odd_rows(spark):
    given = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [1.0, 2.0, 0.0]), (4, [1.0, 2.0, 0.1]), (5, [1.0, 2.0, 0.0]), (5, [1.0, 2.0, 0.0]), (6, [1.0]), (7, [3.0]), (8, [-3.0]), (9, None), (10, []), (11, [0.0, 0.0])]
    frame = spark.createDataFrame([(v, e, v, "x") for v, e in given] + [(None, [1.0, 2.0], 0, "y")], "vec_id long, embedding array<double>, rep long, pair string")
    got = rows(embedding_dedup.near_duplicates(frame))
    assert got == sorted([*embedding_dedup.brute_force(given), (None, 0, None, None)], key=repr)


def test_pivots_of_a_near_copy_group_are_one():
    random = np.random.default_rng(2)
    x = np.concatenate((np.ones((1, 64)) + random.normal(size=(500, 64)) * 0.2, random.normal(size=(200, 64))))
    x = random.permutation(x / np.linalg.norm(x, axis=1, keepdims=True))
    points = embedding_dedup.apart(x, 700, 0.95)
    assert 100 < len(points) < 700 and (points @ np.ones(64) / 8 > 0.9).sum() == 1
    assert np.triu(points @ points.T, 1).max() < 2 * 0.95**2 - 1


@pytest.mark.parametrize("mean", [0.5, 0.8, 0.9])
def test_vectors_that_point_much_the_same_way(spark, mean):
    """Many pivots and fewer candidates than pairs even where all cosines are high, and the links found."""
    random = np.random.default_rng(5)
    unit = lambda y: y / np.linalg.norm(y, axis=1, keepdims=True)
    own = random.normal(size=(1500, 128))
    own[:, 0] = 0
    base = np.sqrt(1 - mean) * unit(own)
    base[:, 0] = np.sqrt(mean)
    off = random.normal(size=base.shape)
    share = random.uniform(0.951, 0.99, size=(1500, 1))
    x = random.permutation(np.concatenate((base, share * base + np.sqrt(1 - share**2) * unit(off - (off * base).sum(1, keepdims=True) * base))))
    points = embedding_dedup.apart(x[:1024], 128, 0.95)
    assert len(points) >= 100
    near = np.argsort(-(x @ points.T), axis=1, kind="stable")[:, :7]
    left, right = embedding_dedup.candidates(near, 0, len(x), 2, 0.8)
    pairs = len(x) * (len(x) - 1) / 2
    assert len(left) < {0.5: 0.08, 0.8: 0.12, 0.9: 0.45}[mean] * pairs
    given = list(enumerate(x.tolist()))
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(spark.createDataFrame(given, "vec_id long, embedding array<double>")).collect()}
    want = embedding_dedup.brute_force(given)
    assert all(got[v] <= n for v, n, _, _ in want)
    assert sum(got.values()) >= 0.9 * sum(r[1] for r in want) > 0


def test_candidates_by_ordered_pivots():
    random = np.random.default_rng(3)
    s = np.array([random.permutation(9)[:4] for _ in range(60)])
    got = set(zip(*(x.tolist() for x in embedding_dedup.candidates(s, 0, 60, 2, 0.6)), strict=True))
    far = lambda p, q: sum(abs((p.index(z) if z in p else 4) - (q.index(z) if z in q else 4)) for z in {*p, *q})
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if len({*s[i]} & {*s[j]}) >= 2 and far(s[i].tolist(), s[j].tolist()) <= 0.6 * 20}
    assert got == want and 0 < len(want) < 1770
    parts = [set(zip(*(x.tolist() for x in embedding_dedup.candidates(s, a, a + 20, 2, 0.6)), strict=True)) for a in (0, 20, 40)]
    assert set().union(*parts) == want


@pytest.mark.parametrize("crowd", [0, 5, 16_384])
def test_crowds_are_counted_window_by_window(spark, docs, odd, crowd):
    random.seed(3)
    passage = " ".join(f"p{random.randrange(10**6)}" for _ in range(90))
    made = [(10**6 + i, " ".join([*(f"w{random.randrange(10**6)}" for _ in range(60)), passage, *(f"w{random.randrange(10**6)}" for _ in range(60))])) for i in range(40)]
    made += [(None, made[0][1]), (None, made[1][1] + " end"), made[2]]
    table = spark.createDataFrame(made, "doc_id long, text string").unionByName(odd.select("doc_id", "text")).unionByName(docs.select("doc_id", "text").limit(100))
    given = texts(table)
    for window in (400, 40):
        assert rows(suffix_dedup.digest(suffix_dedup.remove_repeated_bytes(table, window, crowd=crowd))) == sorted(suffix_dedup.brute_force(given, window), key=repr)
    for window in (50, 10):
        assert rows(substring_dedup.digest(substring_dedup.remove_repeated_words(table, window, crowd=crowd))) == sorted(substring_dedup.brute_force(given, window), key=repr)


def test_no_task_ranks_a_crowd(spark, monkeypatch):
    random.seed(4)
    passage = " ".join(f"p{random.randrange(10**6)}" for _ in range(120))
    made = [(i, " ".join([*(f"w{random.randrange(10**6)}" for _ in range(70)), passage, *(f"w{random.randrange(10**6)}" for _ in range(70))])) for i in range(300)]
    table = spark.createDataFrame(made, "doc_id long, text string")
    held = spark.sparkContext.accumulator(0)

    def most(batches):
        for table in suffix_dedup.whole_groups(batches, ["h1", "h2"]):
            held.add(int(sum(n - 50 for n in table.group_by(["h1", "h2"]).aggregate([([], "count_all")]).column("count_all").to_pylist() if n > 50)))
        yield from ()

    monkeypatch.setattr(suffix_dedup, "neighbours", lambda p: most)
    monkeypatch.setattr(substring_dedup, "factored", lambda p: most)
    suffix_dedup.remove_repeated_bytes(table, crowd=50).collect()
    substring_dedup.remove_repeated_words(table, crowd=50).collect()
    assert held.value == 0
    suffix_dedup.remove_repeated_bytes(table).collect()  # under the bound it is ranked
    assert held.value > 0


def test_factors_hold_what_their_sources_have(spark, docs):
    """Every factor's first words stand in its source, which is earlier; together the factors are the removed spans."""
    words = {r.doc_id: substring_dedup.re.findall(substring_dedup.WORD, r.text or "") for r in docs.select("doc_id", "text").collect()}
    seen = 0
    for r in substring_dedup.remove_repeated_words(docs, 10).collect():
        covered = set()
        for f in r.factors:
            assert f.source < r.doc_id and f.end - f.start >= 10
            for i in range(f.start, f.end - 9):
                part = words[r.doc_id][i : i + 10]
                assert any(words[f.source][j : j + 10] == part for j in range(len(words[f.source]) - 9))
            covered |= set(range(f.start, f.end))
            seen += 1
        assert covered == {i for s in r.spans for i in range(s.start, s.end)}
    assert seen > 20


@pytest.mark.parametrize("p", [suffix_dedup.parsing(400), suffix_dedup.parsing(40), substring_dedup.parsing(50)])
def test_phrase_ends_are_found_among_few_places(p):
    """Smallest hashes by definition; of many places, most are never compared."""
    draw = np.random.default_rng(5)
    span = p.reach - p.grain + 1
    for made in (draw.integers(0, 256, 20_000), draw.integers(0, 2, 20_000), np.full(20_000, 65), np.tile(draw.integers(0, 256, 7), 3000)[:20_000], np.concatenate((draw.integers(0, 256, 9000), np.full(11_000, 32)))):
        docs = np.array([0, 0, 1500, 1510, 9800, 9800, 20_000])
        hashes = rolling.Hashes(rolling.byte_values(made.astype(np.uint8)))
        upper, want = hashes.each(p.grain, 3), {}
        for d in range(len(docs) - 1):
            for start in range(docs[d], docs[d + 1] - p.window + 1):
                end = start + int(upper[start : start + span].argmin()) + p.grain
                want.setdefault(end, [end, d, start, start])[3] = start
        assert [list(x) for x in zip(*(x.tolist() for x in rolling.phrase_ends(hashes, docs, p)), strict=True)] == [want[end] for end in sorted(want)]
        if span > 300 and len(np.unique(made)) > 100:
            assert len(rolling._tried(upper[:8000], span)) < 8000 / 8


def test_runs_end_with_their_document(spark):
    """Copies side by side in one batch: each document has a run of its own, empty texts none."""
    text = " ".join(f"s{i}" for i in range(200))
    table = spark.createDataFrame([(1, text), (2, ""), (3, text), (4, None), (5, text + text), (6, "alone")], "doc_id long, text string").coalesce(1)
    got = suffix_dedup.remove_repeated_bytes(table)
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in got.collect()} == {1: [(0, len(text))], 2: [], 3: [(0, len(text))], 4: [], 5: [(0, 2 * len(text))], 6: []}
    assert rows(suffix_dedup.digest(got)) == sorted(suffix_dedup.brute_force(texts(table)), key=repr)
