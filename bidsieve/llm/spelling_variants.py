"""Spelling variant grouping over a variable-length gram index.

Grams are as long as they need to be: counts over the vocabulary give a dictionary of frequent grams, and a word's gram at a
place is the shortest one there that the dictionary doesn't hold, or one of the largest length. Grams that lie inside an
earlier one are left out. A walk stops at the first rare gram, so an edit changes no gram that ends before it; behind it a
gram can only be swallowed by a new one, which the dictionary's inner suffixes bound. So for each place of an edit a word
knows which of its grams can be affected and which stay whole, at the same distance from its start or from its end.

Two near words have the grams that stay whole in common. Their inverted lists are merged by hash: a word is posted, for each
place of an edit, under all grams that stay whole there (most places have the same ones), so the words that meet are those
in all lists of such a set. Lists of single grams are far longer (375 thousand words met 2.4 billion times in a first version, against 11
million). What meets is verified. Lists are read as sorted streams; those of more than `block` words are dealt out again
and meet in pairs of blocks. The dictionary only steers
speed: any dictionary gives the same pairs.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64, xxh64_intdigest

from .common import Mapper, slices, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SHORTEST, _LONGEST = 2, 4
#: Frequent grams that are kept, at most; a gram of so few words is rare.
_GRAMS, _RARE = 20_000, 8
_NEW = 31
#: Roles in a list: words of one length that replace a character; the shorter word of an insertion; the longer one.
_REPLACED, _SHORTER, _LONGER = 0, 1, 2
_pack = struct.Struct("<qqQQ").pack


def words_of(docs: DataFrame, least_length: int = 7, least_count: int = 2) -> DataFrame:
    """word, n: lower-cased (A-Z) runs of Latin letters with their occurrences.

    A run whose checksum with its document's id is a multiple of 31 loses one code point. Null and empty texts have no words,
    an id that is null counts as an empty one; rows that repeat count each time.
    """
    found = F.explode(F.regexp_extract_all(docs["text"].cast("string"), F.lit(f"[A-Za-zÀ-ÿ]{{{least_length},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("doc"), found.alias("raw"))
    runs = runs.select("doc", F.when(F.col("raw").rlike("[A-Z]"), F.translate("raw", _UPPER, _LOWER)).otherwise(F.col("raw")).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    shorter = F.expr("concat(substring(run, 1, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2))")
    word = F.when(F.col("h") % _NEW == 0, shorter).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def frequent_grams(words: DataFrame, limit: int = _GRAMS, rare: int = _RARE) -> set[str]:
    """Grams shorter than the longest that stand in more than `rare` places of the vocabulary, the most frequent ones; no more than `limit`.

    A gram's beginnings are at least as frequent and shorter, so they are there too.
    """
    marked = F.concat(F.lit("^"), "word", F.lit("$"))

    def of_length(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(marked) - (k - 1)), lambda i: F.substring(marked, i, F.lit(k)))

    grams = F.concat(*map(of_length, range(_SHORTEST, _LONGEST)))
    counted = words.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rare)
    return {r.gram for r in counted.orderBy(F.desc("n"), F.length("gram"), "gram").limit(limit).select("gram").collect()}


class Grams:
    """Decomposition of words by a dictionary of frequent grams."""

    def __init__(self, frequent: set[str]) -> None:
        self.frequent = frequent
        self.inner = {g[k:] for g in frequent for k in range(1, len(g))}

    def spans(self, marked: str) -> list[tuple[int, int]]:
        """Start and end of the grams of a word that stands between its marks."""
        found, last = [], 0
        for start in range(len(marked) - _SHORTEST + 1):
            end, most = start + _SHORTEST, min(start + _LONGEST, len(marked))
            while end < most and marked[start:end] in self.frequent:
                end += 1
            if end > last:
                found.append((start, end))
                last = end
        return found

    def wholes(self, word: str) -> Iterator[tuple[int, int]]:
        """Role and hash of the sets of grams that an edit leaves whole, each once.

        Whole before place i are the grams that end there at most; behind it those that no new gram can swallow. Both depend
        on nothing but the characters on their side, so a near word has the same ones. Grams overlap, so a set is told by the
        characters up to the end of the last one before the edit and from the start of the first one behind it.
        """
        marked, n = f"^{word}$", len(word)
        spans = self.spans(marked)
        starts = [start for start, _ in spans]
        before, behind = [0] * (n + 2), [n + 2] * (n + 3)
        for _, end in spans:
            if end <= n + 1:
                before[end] = end
        for i in range(1, n + 2):
            before[i] = before[i] or before[i - 1]
            behind[i] = next((starts[k] for k in range(bisect_left(starts, i), len(spans)) if marked[i : spans[k][1] - 1] not in self.inner), n + 2)
        fore, aft, run, back = {0: 0}, {n + 2: 0}, xxh64(), xxh64()
        for i, c in enumerate(marked):
            run.update(c)
            fore[i + 1] = run.intdigest()
        for i in range(n + 1, -1, -1):
            back.update(marked[i])
            aft[i] = back.intdigest()
        for left, right in {(before[i], behind[i + 1]) for i in range(1, n + 1)}:
            yield _REPLACED, _key(0, n, fore[left], aft[right])
            yield _LONGER, _key(1, n - 1, fore[left], aft[right])
        for left, right in {(before[i], behind[i]) for i in range(1, n + 2)}:
            yield _SHORTER, _key(1, n, fore[left], aft[right])


def _key(kind: int, length: int, fore: int, aft: int) -> int:
    return xxh64_intdigest(_pack(kind, length, fore, aft))


def index(words: DataFrame, frequent: set[str]) -> DataFrame:
    """key, role, name, n from word, name, n: each word's name in the lists of the gram sets that an edit leaves whole. Lengths are part of the keys."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Grams(frequent)
        for whole in batches:
            for batch in slices(whole, "word", 1 << 16):
                keys, roles, at = array("Q"), array("b"), array("i")
                for i, word in enumerate(batch.column("word").to_pylist()):
                    for role, key in cut.wholes(word):
                        keys.append(key)
                        roles.append(role)
                        at.append(i)
                at_word = pa.array(np.frombuffer(at, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, np.uint64).view(np.int64)), pa.array(np.frombuffer(roles, np.int8)), batch.column("name").take(at_word), batch.column("n").take(at_word)], ["key", "role", "name", "n"])

    return words.select("word", "name", "n").mapInArrow(post, "key long, role byte, name string, n long")


def _meetings(key: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs that meet in rows sorted by key and role: any two that replace, and each shorter word with each longer one."""
    at, edges = np.arange(len(key)), np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(edges, len(key)))
    end = np.repeat(edges + sizes, sizes)
    longer = end - np.repeat(np.add.reduceat((role == _LONGER).astype(np.int64), edges), sizes)
    first = np.where(role == _REPLACED, at + 1, np.where(role == _SHORTER, longer, end))
    many = end - first
    left = np.repeat(at, many)
    return left, np.repeat(first - np.cumsum(many) + many, many) + np.arange(len(left))


def _met(block: int) -> Mapper:
    """From lists sorted by key and role the pairs that meet; rows of lists longer than `block` come out as they are, without a partner."""

    def given(rows: pa.Table, left: np.ndarray, right: np.ndarray | None) -> pa.RecordBatch:
        mine = rows.take(left)
        partner = rows.take(right) if right is not None else None
        others = [partner.column(c).combine_chunks() if partner else pa.nulls(len(left), t) for c, t in (("name", pa.string()), ("n", pa.int64()))]
        return pa.RecordBatch.from_arrays([*(mine.column(c).combine_chunks() for c in ("key", "role", "name", "n")), *others], ["key", "role", "name_a", "n_a", "name_b", "n_b"])

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key = rows.column("key").to_numpy()
        _, lists, sizes = np.unique(key, return_inverse=True, return_counts=True)
        brief = sizes[lists] <= block
        if not brief.all():
            yield given(rows, np.flatnonzero(~brief), None)
        rows = rows.filter(pa.array(brief))
        if rows.num_rows:
            left, right = _meetings(rows.column("key").to_numpy(), rows.column("role").to_numpy())
            for i in range(0, len(left), 1 << 16):
                yield given(rows, left[i : i + (1 << 16)], right[i : i + (1 << 16)])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, long_key = None, None  # rows of the last list so far; the list that goes on, if it is long already
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if long_key is not None:
                same = rows.column("key").to_numpy() == long_key
                if same.any():
                    yield given(rows, np.flatnonzero(same), None)
                if same.all():
                    continue
                rows, long_key = rows.filter(pa.array(~same)), None
            rows = pa.concat_tables([kept, rows]).combine_chunks() if kept is not None else rows
            key = rows.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            yield from pairs(rows.slice(0, last))
            kept = rows.slice(last)
            if kept.num_rows > block:
                yield given(kept, np.arange(kept.num_rows), None)
                kept, long_key = None, key[-1]
        if kept is not None:
            yield from pairs(kept)

    return meet


def candidates(lists: DataFrame, block: int, near: Callable[[str, str], Column]) -> DataFrame:
    """name_a, name_b, n_a, n_b: words that meet in a list in fitting roles and are near as far as names tell."""
    dealt = lists.repartition("key").sortWithinPartitions("key", "role")
    met = dealt.mapInArrow(_met(block), "key long, role byte, name_a string, n_a long, name_b string, n_b long")
    met = written(met.where(F.col("name_b").isNull() | near("name_a", "name_b")))
    names = ("name_a", "name_b", "n_a", "n_b")
    long_lists = met.where("name_b is null").select("key", "role", F.col("name_a").alias("name"), F.col("n_a").alias("n"))
    sizes = long_lists.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    long_lists = long_lists.join(sizes, "key")
    mine, others = F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    side = lambda s, i, j: long_lists.select("key", i.alias("i"), j.alias("j"), *(F.col(c).alias(f"{c}_{s}") for c in ("role", "name", "n")))
    blocks = side("a", mine, others).where(F.col("role_a") != _LONGER).join(side("b", others, mine).where(F.col("role_b") != _SHORTER), ["key", "i", "j"])
    blocks = blocks.where((F.col("role_a") == _SHORTER) | (F.col("name_a") < F.col("name_b"))).where(near("name_a", "name_b"))
    found = met.where("name_b is not null").select(*names).unionByName(blocks.select(*names))
    # of a pair of equal lengths either may come first
    swapped = F.col("name_b") < F.col("name_a")
    pick = lambda x, y: F.when(swapped, F.col(y)).otherwise(F.col(x))
    ordered = found.select(pick("name_a", "name_b").alias("name_a"), pick("name_b", "name_a").alias("name_b"), pick("n_a", "n_b").alias("n_a"), pick("n_b", "n_a").alias("n_b"))
    return ordered.dropDuplicates(["name_a", "name_b"])


def near_pairs(words: DataFrame, limit: int = _GRAMS, rare: int = _RARE, block: int = 1000, long_word: int = 64) -> DataFrame:
    """a, b, n_a, n_b: all pairs of words that differ by exactly one edit, each once.

    Lists hold words themselves, but digests of those of more than `long_word` characters, whose many lists would repeat them.
    """
    frequent, length = frequent_grams(words, limit, rare), F.length("word")
    apart = lambda a, b: F.levenshtein(a, b, 1) == 1
    brief = candidates(index(words.where(length <= long_word + 1).withColumn("name", F.col("word")), frequent), block, apart)
    brief = brief.select(F.col("name_a").alias("a"), F.col("name_b").alias("b"), "n_a", "n_b")
    named = words.where(length > long_word).withColumn("name", F.sha2("word", 256))
    met = candidates(index(named, frequent), block, lambda a, b: F.lit(True))
    for side in ("a", "b"):
        met = met.join(named.select(F.col("name").alias(f"name_{side}"), F.col("word").alias(side)), f"name_{side}")
    met = met.where((F.greatest(F.length("a"), F.length("b")) > long_word + 1) & apart("a", "b"))
    return brief.unionByName(met.select("a", "b", "n_a", "n_b"))


def with_roots(words: DataFrame) -> DataFrame:
    """Adds root to word, form, form_n, n, n_near: the last word that is reached by forms.

    Counts grow tenfold from word to form, so a way has at most 18 steps and five doublings follow it to its end.
    """
    steps = words.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(5):
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = written(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return words.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, ratio: int = 10, limit: int = _GRAMS, rare: int = _RARE, block: int = 1000) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the corpus; see words_of for which they are.

    form: the near word of largest n (ties: smallest in code-point order) where that is at least `ratio` times the word's n.
    An empty table has no words. Other columns of docs are ignored. `ratio` is 10 at least, so that ways of forms end.
    """
    if least_length < 2 * _LONGEST - 2:
        raise ValueError(f"an edit might affect all grams of words shorter than {2 * _LONGEST - 2}, which would meet in one list")
    if ratio < 10:
        raise ValueError("ratio must be 10 at least")
    words = written(words_of(docs, least_length, least_count))
    pairs = written(near_pairs(words, limit, rare, block))
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("w")).alias("near")).unionAll(pairs.select(F.col("b").alias("word"), F.struct((-F.col("n_a")).alias("less"), F.col("a").alias("w")).alias("near")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("near"))
    far = F.col("near.less") * -1 >= F.col("n") * ratio
    joined = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("near.w")).alias("form"), F.when(far, -F.col("near.less")).alias("form_n"))
    return with_roots(written(joined)).select("word", "form", "root", "n", "n_near", "form_n")


def brute_force(rows: list[tuple[int | None, str | None]], least_length: int = 7, least_count: int = 2, ratio: int = 10) -> list[tuple]:
    """The same by definition, for tests."""
    import re
    from collections import Counter

    counts: Counter[str] = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(_UPPER, _LOWER))
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % _NEW == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}

    def near(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by_length: dict[int, list[str]] = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    forms, found = {}, {}
    for w, n in words.items():
        found[w] = [x for k in (len(w) - 1, len(w), len(w) + 1) for x in by_length.get(k, []) if near(w, x)]
        best = min(found[w], key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n, len(found[w]), words[forms[w]] if forms[w] is not None else None))
    return out


#: The same in DuckDB: checksums by four bits at a time, near words through common words with one code point left out.
SQL = r"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' AS doc, unnest(list_transform(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS run FROM documents
), counted AS (SELECT doc, run, count(*) AS k FROM runs GROUP BY ALL
), sums AS (
  SELECT run, k, xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [(unicode(x) & 15)::BIGINT, (unicode(x) >> 4)::BIGINT] ELSE [3::BIGINT, 12::BIGINT, ((unicode(x) - 64) & 15)::BIGINT, ((unicode(x) - 64) >> 4)::BIGINT] END)),
      lambda c, b: xor(c >> 4, CAST([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108] AS BIGINT[])[(xor(c, b) & 15) + 1])), 4294967295::BIGINT) AS h
  FROM counted
), words AS (
  SELECT word, sum(k)::BIGINT AS n FROM (SELECT k, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM sums) WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), cut AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM words, unnest(range(length(word))) AS r(i)
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word
), best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 10 * w.n THEN (SELECT min(x.other) FROM near x WHERE x.word = w.word AND x.m = b.m) END AS form, CASE WHEN b.m >= 10 * w.n THEN b.m END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), ways AS (
  SELECT word, word AS root FROM forms UNION ALL SELECT y.word, f.form FROM ways y JOIN forms f ON y.root = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, y.root, f.n, f.n_near, f.form_n FROM forms f JOIN ways y ON f.word = y.word JOIN forms e ON y.root = e.word WHERE e.form IS NULL
"""
