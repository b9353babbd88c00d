"""Ranked lexical search with hashed max-sketches.

A term's impact in a document is the part of its score that depends on the document. All impacts of a document fold into a
sketch: each term has a coordinate by hash, and a coordinate keeps the largest impact. The sketches of a batch of documents
times the weights of a block of queries, put at the coordinates of their terms, bound every score from above at once. A
query's documents are then rescored exactly in descending order of bounds, until the next bound is below the score of the
last place so far. Only exact scores come out, so the bounds steer work alone.

Documents stay where they are read. A task keeps the best places of each query over all its batches and gives these alone;
places are merged by query and group of tasks first, then by query. Queries come in blocks of bounded size, each a pass.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, slices, text_of

_CHARACTERS = np.ones(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _CHARACTERS[_low : _high + 1] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Coordinates of a sketch, documents in a batch, groups of tasks whose places are merged first.
_WIDTH, _BATCH, _GROUPS = 8192, 256, 64
#: Bounds are sums of up to _WIDTH products in single precision.
_SLACK = np.float32(1 + 4 * _WIDTH * 2.0**-23)


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of a string array without nulls, and for each the position of its text."""
    raw, offsets = bytes_of(texts)
    inside = _CHARACTERS[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    first[heads] = inside[heads]
    kept = _LOWER[raw[inside]]
    bounds = np.append(np.flatnonzero(first[inside]), len(kept)).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(kept))
    return terms, np.searchsorted(offsets, np.flatnonzero(first), side="right") - 1


def coordinates(terms: pa.Array, width: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(t) for t in terms.cast(pa.binary()).to_pylist()), np.int64, len(terms)) % width


@dataclass
class Block:
    """Some queries: their ids and, query by query, the positions of their terms in the vocabulary and how often they stand there."""

    ids: list
    vocabulary: pa.Array
    terms: list[np.ndarray]
    times: list[np.ndarray]


def blocks_of(items: DataFrame, most: int) -> Iterator[Block]:
    """Queries in blocks of about `most` different terms, fetched one partition after the other. Queries without terms have no places."""
    ids, counts, size = [], [], 0
    for row in items.select("item_id", text_of(items).alias("text")).toLocalIterator():
        counted = Counter(terms_of(pa.array([row.text], pa.string()))[0].to_pylist())
        if not counted:
            continue
        if ids and size + len(counted) > most:
            yield _block(ids, counts)
            ids, counts, size = [], [], 0
        ids.append(row.item_id)
        counts.append(counted)
        size += len(counted)
    if ids:
        yield _block(ids, counts)


def _block(ids: list, counts: list[Counter]) -> Block:
    vocabulary = sorted(set().union(*counts))
    at = {t: i for i, t in enumerate(vocabulary)}
    return Block(ids, pa.array(vocabulary, pa.string()), [np.array([at[t] for t in c], np.int64) for c in counts], [np.array([*c.values()], np.int64) for c in counts])


def frequencies(docs: DataFrame, block: Block) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents that hold each term of the vocabulary; one row per task and term."""
    vocabulary = block.vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_terms = 0
        held = np.zeros(len(vocabulary), np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                terms, at = terms_of(batch.column("text"))
                n_docs += len(np.unique(at))
                n_terms += len(terms)
                found = pc.index_in(terms, value_set=vocabulary)
                known = np.asarray(found.is_valid())
                pairs = np.unique(at[known] * len(vocabulary) + found.drop_null().to_numpy().astype(np.int64))
                held += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"term": pa.array([-2, -1, *some.tolist()], pa.int64()), "n": pa.array([n_docs, n_terms, *held[some].tolist()], pa.int64())})

    total = {r.term: r.n for r in docs.select(text_of(docs).alias("text")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return total.get(-2, 0), total.get(-1, 0), np.array([total.get(i, 0) for i in range(len(vocabulary))], np.int64)


def weights(n_docs: int, held: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in held], np.int64)


class Places:
    """The best k documents of one query so far: highest scores first, then smallest ids, ids that are null last."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.found: list[tuple[int, bool, int]] = []

    def needed(self) -> int:
        return -self.found[-1][0] if len(self.found) == self.k else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        least = self.needed()
        more = [(-int(s), i is None, i or 0) for s, i in zip(scores, ids, strict=True) if s >= least]
        if more:
            self.found = sorted(self.found + more)[: self.k]


class Searcher:
    """Places of a block's queries over all documents that it is shown."""

    def __init__(self, block: Block, n_docs: int, n_terms: int, weight: np.ndarray, k: int, width: int) -> None:
        self.block, self.n_docs, self.n_terms, self.k, self.width = block, n_docs, n_terms, k, width
        self.gains = [t * weight[v] for v, t in zip(block.terms, block.times, strict=True)]
        at = coordinates(block.vocabulary, width)
        self.lookup = np.zeros((width, len(block.ids)), np.float32)
        for q, (terms, gain) in enumerate(zip(block.terms, self.gains, strict=True)):
            np.add.at(self.lookup[:, q], at[terms], gain.astype(np.float32))
        self.places = [Places(k) for _ in block.ids]
        self.seen = self.rescored = 0

    def show(self, ids: list, texts: pa.Array) -> None:
        terms, at = terms_of(texts)
        if not len(terms):
            return
        coded = terms.dictionary_encode()
        known = coded.dictionary
        pairs, tf = np.unique(at * len(known) + coded.indices.to_numpy(), return_counts=True)
        doc, term = np.divmod(pairs, len(known))
        norm = np.array([8 * (25 + 75 * n * self.n_docs // self.n_terms) for n in np.bincount(at, minlength=len(ids)).tolist()], np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + norm[doc])
        sketch = np.zeros((len(ids), self.width), np.float32)
        np.maximum.at(sketch, (doc, coordinates(known, self.width)[term]), impact.astype(np.float32))
        bounds = (sketch @ self.lookup) * _SLACK
        code = pc.fill_null(pc.index_in(self.block.vocabulary, value_set=known), -1).to_numpy().astype(np.int64)
        self.seen += bounds.size
        needed = np.array([p.needed() for p in self.places], np.float32)
        for q in np.flatnonzero((bounds >= needed * np.float32(1 - 2.0**-23)).any(axis=0)):
            order = np.argsort(-bounds[:, q], kind="stable")
            mine = code[self.block.terms[q]]
            held = mine >= 0
            mine, gain, place = mine[held], self.gains[q][held], self.places[q]
            for start in range(0, len(order), self.k):
                some = order[start : start + self.k]
                some = some[bounds[some, q].astype(np.float64) >= place.needed()]
                if not len(some):
                    break
                self.rescored += len(some)
                wanted = some[:, None] * len(known) + mine
                found = np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)
                scores = (np.where(pairs[found] == wanted, impact[found], 0) * gain).sum(axis=1)
                place.add(scores, [ids[i] for i in some])


def _ranked(df: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(docs: DataFrame, block: Block, k: int, width: int) -> DataFrame:
    n_docs, n_terms, held = frequencies(docs, block)
    weight = weights(n_docs, held)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(block, n_docs, n_terms, weight, k, width)
        for whole in batches:
            for part in slices(whole, "text"):
                for start in range(0, part.num_rows, _BATCH):
                    batch = part.slice(start, _BATCH)
                    searcher.show(batch.column("doc_id").to_pylist(), batch.column("text"))
        group = TaskContext.get().partitionId() % _GROUPS
        rows = [(q, group, None if unknown else i, -s) for q, p in enumerate(searcher.places) for s, unknown, i in p.found]
        columns = [*zip(*rows, strict=True)] or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query", "part", "doc_id", "score"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(search, "query long, part long, doc_id long, score long")
    best = _ranked(_ranked(found, k, "query", "part").drop("rank"), k, "query")
    names = docs.sparkSession.createDataFrame([(q, i) for q, i in enumerate(block.ids)], "query long, item_id long")
    return best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 10, width: int = _WIDTH, most_terms: int = 30_000) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k highest-scoring documents with a score above 0.

    Each row of items is a query and each row of docs a document of its own, repeated rows too. Null and empty texts have no
    terms; equal scores go by ascending doc_id, null ids last. Empty tables give no rows. Queries come in blocks of about
    `most_terms` terms (a broadcast of a few MB and a lookup of `width` numbers a query). Other columns are ignored.
    """
    parts = [_search(docs, block, k, width) for block in blocks_of(items, most_terms)]
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionAll, parts)


def brute_force(docs: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    """The same by definition, for tests."""
    import re

    def cut(text: str | None) -> Counter:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower))

    bags = [(i, cut(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        query = cut(text)
        for doc, bag in bags:
            if bag:
                m = 25 + 75 * bag.total() * n_docs // n_terms
                score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m)) for t, c in query.items() if t in bag)
                if score > 0:
                    scores.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if unknown else doc, -s) for r, (s, unknown, doc) in enumerate(sorted(scores)[:k])]
    return out


#: The same in DuckDB.
SQL = r"""
WITH words AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT *, row_number() OVER () AS r FROM documents)
), bags AS (SELECT r, doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), lengths AS (SELECT r, sum(tf)::BIGINT AS n FROM bags GROUP BY r
), totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths
), norms AS (SELECT r, 100 - 75 + ((75 * n * n_docs) // n_terms) AS m FROM lengths, totals
), queries AS (
  SELECT q, item_id, term, count(*) AS times FROM (
    SELECT q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT *, row_number() OVER () AS q FROM benchmark)) GROUP BY ALL
), weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM bags WHERE term IN (SELECT term FROM queries) GROUP BY term), totals
), scores AS (
  SELECT q, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM queries JOIN weights USING (term) JOIN bags USING (term) JOIN norms USING (r) GROUP BY q, item_id, r, doc_id
)
SELECT item_id, "rank", doc_id, score FROM (
  SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST)::INT AS "rank", doc_id, score FROM scores WHERE score > 0) WHERE "rank" <= 10
"""
