"""Top-k lexical search over whole texts: an inverted index of the queries, bounds before dot products, a rising threshold."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold
from .blocking import text_vector

#: Texts in a batch; groups of tasks whose places are merged first.
_BATCH, _GROUPS = 128, 64


_NOTHING = (np.zeros(0, np.uint64), np.zeros(0))


class QueryIndex:
    """Unit vectors of some queries, by term: postings of the rare terms, and a matrix of those that many queries have."""

    def __init__(self, ids: list[int], folded: list[str]) -> None:
        self.ids, self.words = ids, {}
        vectors = [text_vector(t, self.words) for t in folded]
        terms = np.concatenate([v[0] for v in vectors])
        query, weight = np.repeat(np.arange(len(ids)), [len(v[0]) for v in vectors]), np.concatenate([v[1] for v in vectors])
        order = np.argsort(terms, kind="stable")
        self.terms, first, count = np.unique(terms[order], return_index=True, return_counts=True)
        self.query, self.weight, self.first = query[order], weight[order], np.append(first, len(terms))
        often = count > max(8, len(ids) // 8)
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.often = np.zeros((int(often.sum()), len(ids)))
        hot = np.repeat(often, count)
        self.often[np.repeat(self.row, count)[hot], self.query[hot]] = self.weight[hot]
        self.norm = np.sqrt((self.often**2).sum(axis=0))


    def met(self, folded: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some texts: the dot products over rare terms, whether one is shared, and the weights of the frequent terms."""
        words = dict(self.words)
        vectors = [text_vector(t, words) if t else _NOTHING for t in folded]
        terms, weight = np.concatenate([v[0] for v in vectors]), np.concatenate([v[1] for v in vectors])
        text = np.repeat(np.arange(len(folded)), [len(v[0]) for v in vectors])
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = self.terms[at] == terms
        at, weight, text = at[known], weight[known], text[known]
        n, rare = len(self.ids), self.row[at] < 0
        many = self.first[at[rare] + 1] - self.first[at[rare]]
        posting = np.repeat(self.first[at[rare]] - np.cumsum(many) + many, many) + np.arange(many.sum())
        pair = np.repeat(text[rare], many) * n + self.query[posting]
        dot = np.bincount(pair, np.repeat(weight[rare], many) * self.weight[posting], len(folded) * n).reshape(len(folded), n)
        shared = np.bincount(pair, minlength=len(folded) * n).reshape(len(folded), n) > 0
        often = np.zeros((len(folded), len(self.often)))
        often[text[~rare], self.row[at[~rare]]] = weight[~rare]
        return dot, shared, often

    def cosines(self, folded: list[str]) -> np.ndarray:
        """Cosine of each text to each query; nan where they have no term in common."""
        dot, shared, often = self.met(folded)
        shared |= (often != 0).astype(np.float32) @ (self.often != 0).astype(np.float32) > 0
        return np.where(shared, np.clip(dot + often @ self.often, 0, 1), np.nan)


class Nearest:
    """The k nearest texts of each query so far. Similarities are counted in ten thousandths; equal ones go by ascending id."""

    def __init__(self, index: QueryIndex, k: int) -> None:
        self.index, self.k = index, k
        self.places: list[list[tuple[int, int]]] = [[] for _ in index.ids]
        self.seen = self.compared = 0

    def needed(self) -> np.ndarray:
        """What a similarity must reach to be rounded to the last place of each query."""
        return np.array([(-p[-1][0] - 0.5) / 1e4 - 1e-9 if len(p) == self.k else -1.0 for p in self.places])

    def show(self, ids: list[int], folded: list[str]) -> None:
        index = self.index
        dot, shared, often = index.met(folded)
        # what frequent terms can add is no more than the product of the lengths of both their parts
        bound = dot + np.outer(np.sqrt((often**2).sum(axis=1)), index.norm)
        self.seen += bound.size
        for q in np.flatnonzero((bound >= self.needed()).any(axis=0)):
            order = np.argsort(-bound[:, q], kind="stable")
            for start in range(0, len(order), self.k):
                some = order[start : start + self.k]
                some = some[bound[some, q] >= self.needed_of(q)]
                if not len(some):
                    break
                self.compared += len(some)
                exact = np.floor(np.clip(dot[some, q] + often[some] @ index.often[:, q], 0, 1) * 1e4 + 0.5).astype(np.int64)
                met = shared[some, q] | ((often[some] != 0) & (index.often[:, q] != 0)).any(axis=1)
                self.places[q] = sorted(self.places[q] + [(-int(s), ids[i]) for s, i, m in zip(exact, some, met, strict=True) if m])[: self.k]

    def needed_of(self, q: int) -> float:
        place = self.places[q]
        return (-place[-1][0] - 0.5) / 1e4 - 1e-9 if len(place) == self.k else -1.0


def query_blocks(queries: DataFrame, most: int) -> Iterator[QueryIndex]:
    """Indexes of about `most` characters of queries each, fetched one partition after the other."""
    ids, texts, size = [], [], 0
    for r in queries.select("id", fold(F.col("text")).alias("folded")).where("id is not null and folded <> ''").toLocalIterator():
        if ids and size + len(r.folded) > most:
            yield QueryIndex(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(r.id)
        texts.append(r.folded)
        size += len(r.folded)
    if ids:
        yield QueryIndex(ids, texts)


def nearest_texts(queries: DataFrame, rows: DataFrame, k: int, most: int = 200_000) -> DataFrame:
    """left_id, right_id, similarity (four places), position: per query the k rows of greatest lexical cosine among those that
    share a term with it, ties by ascending id.

    Both have a long id and a text; rows without either take no part. Queries are a stated set and go to the rows in blocks of
    about `most` characters (an index of some ten MB), rows stay where they are read, and no term is joined. A task gives
    its k best per query alone; these are merged by group of tasks and then by query.
    """
    texts = rows.select(F.col("id").cast("long").alias("id"), fold(F.col("text")).alias("folded")).where("id is not null and folded <> ''")

    def places(index: QueryIndex) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Nearest(index, k)
            for batch in batches:
                for i in range(0, batch.num_rows, _BATCH):
                    part = batch.slice(i, _BATCH)
                    found.show(part.column("id").to_pylist(), part.column("folded").to_pylist())
            group = TaskContext.get().partitionId() % _GROUPS
            out = [(index.ids[q], group, i, -s) for q, p in enumerate(found.places) for s, i in p]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([*zip(*out, strict=True)] or [[]] * 4)], ["left_id", "part", "right_id", "tenths"])

        return texts.mapInArrow(search, "left_id long, part long, right_id long, tenths long")

    parts = [places(index) for index in query_blocks(queries, most)]
    if not parts:
        return rows.sparkSession.createDataFrame([], "left_id long, right_id long, similarity double, position int")
    best = reduce(DataFrame.unionAll, parts)
    for by in (("left_id", "part"), ("left_id",)):
        best = best.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("tenths"), "right_id"))).where(F.col("position") <= k)
    return best.select("left_id", "right_id", (F.col("tenths") / 1e4).alias("similarity"), "position")


def all_cosines(queries: DataFrame, rows: DataFrame, most: int = 200_000) -> DataFrame:
    """left_id, right_id, similarity of every query and row that share a term, or whose texts are equal and not empty.

    As nearest_texts, but all pairs come out, as a backend's callers ask for: a row meets a block of queries in its task, in
    one product, and no term is joined.
    """
    texts = rows.select(F.col("id").cast("long").alias("id"), fold(F.col("text")).alias("folded")).where("id is not null and folded <> ''")

    def cosines(index: QueryIndex) -> DataFrame:
        left = pa.array(index.ids, pa.int64())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, _BATCH):
                    part = batch.slice(i, _BATCH)
                    exact = index.cosines(part.column("folded").to_pylist())
                    row, query = np.nonzero(~np.isnan(exact))
                    yield pa.RecordBatch.from_arrays([left.take(pa.array(query)), part.column("id").take(pa.array(row)), pa.array(exact[row, query])], ["left_id", "right_id", "similarity"])

        return texts.mapInArrow(run, "left_id long, right_id long, similarity double")

    # texts without any term that are equal all the same
    bare = [x.where((F.col("text") != "") & (fold(F.col("text")) == "")).select("text", F.col("id").cast("long").alias(f"{side}_id")) for x, side in ((queries, "left"), (rows, "right"))]
    equal = bare[0].join(bare[1], "text").select("left_id", "right_id", F.lit(1.0).alias("similarity"))
    return reduce(DataFrame.unionAll, [*(cosines(index) for index in query_blocks(queries, most)), equal])
