"""Substring dedup by relative Lempel-Ziv parsing.

The reference of a document are the blocks of all documents with a smaller id. Blocks are indexed by the phrase ends that they
hold (`repeats`): a factor of `window` words or more holds one near its start, so a document meets, under that key, every
block that can carry the factor on. At each place the factor is taken from the earliest block that has `window` words of it
(`factored`); from there it goes on as long as that block does. Where it ends, at a factor boundary, a factor from another
block may already have started, so places across the boundary are looked up too. Factors, with their source, are a document's
duplicate spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, bytes_of, runs_of, text_of, whole_groups
from .repeats import NONE, covered, crowds_of, marks, windows_of, with_marks
from .rolling import Parsing, word_spans


def parsing(window: int) -> Parsing:
    grain = min(2, max(1, window // 4))
    return Parsing(window=window, grain=grain, reach=max(grain, window * 4 // 5), band=max(2, min(6, window // 5)))


def factored(p: Parsing):
    """Places of a band's blocks from which an earlier block carries on for `window` words, with the earliest such block's document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["h1", "h2"]):
            found = crowds_of(table, p, words=True)
            if found is None:
                continue
            columns, group, around = found
            for ahead, use, rank in windows_of(columns, group, around, p):
                mine = columns["ord"][use]
                least = np.full(rank.max() + 1, np.iinfo(np.int64).max)
                np.minimum.at(least, rank, mine)
                later = least[rank] < mine
                hit = use[later]
                yield pa.RecordBatch.from_arrays([pa.array(columns["rid"][hit]), pa.array(mine[later]), pa.array((columns["top"][hit] - ahead).astype(np.int32)), pa.array(least[rank][later])], ["rid", "ord", "start", "source"])

    return run


def greedy_factors(source: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors of one document: start, end and source. source: per place that of a factor of `window` words, or NONE.

    A factor goes on from place to place while its source does; the next begins at the first place that it doesn't hold, be
    that inside the words of the last one.
    """
    at = np.flatnonzero(source != NONE)
    if not len(at):
        return at, at, at
    fresh = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(source[at]) != 0)))
    first = np.flatnonzero(fresh)
    last = np.concatenate((first[1:], [len(at)])) - 1
    return at[first], at[last] + window, source[at[first]]


def _emit(batch: pa.RecordBatch, docs: np.ndarray, flags: np.ndarray, source: np.ndarray, window: int) -> pa.RecordBatch:
    raw, offsets = bytes_of(batch.column("text"))
    starts, ends, _ = word_spans(raw, offsets)
    data = raw.tobytes()
    kept, spans, factors = [], [], []
    for i in range(batch.num_rows):
        a, b = docs[i], docs[i + 1]
        mine = flags[a:b]
        if mine.any():
            stay = a + np.flatnonzero(~mine)
            kept.append(b" ".join([data[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)]))
        else:
            kept.append(data[offsets[i] : offsets[i + 1]])
        spans.append([{"start": int(s), "end": int(e)} for s, e in zip(*runs_of(mine), strict=True)])
        factors.append([{"start": int(s), "end": int(e), "source": int(d)} for s, e, d in zip(*greedy_factors(source[a:b], window), strict=True)] if mine.any() else [])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    sourced = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("source", pa.int64())]))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(docs)), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, kind), pa.array(factors, sourced), batch.column("carried")], ["doc_id", "n_words", "text", "spans", "factors", "carried"])


def remove_repeated_words(docs: DataFrame, window: int = 50, carry: tuple[str, ...] = (), crowd: int = 16_384) -> DataFrame:
    """Remove every word inside a window of `window` words that also starts in a document with a smaller doc_id.

    docs: doc_id long, text string; other columns are ignored, whatever their names, but for those in `carry`, which come
    back in the struct `carried`. Returns one row per input row: doc_id, n_words, text (as it was where nothing is removed,
    else the kept words joined by one space), spans (removed word runs, half open), factors (the greedy factors that make them up,
    each with the doc_id of an earlier document that has its first `window` words and goes on with them), carried.
    A null text has no words, a short text stays whole, a null doc_id counts as larger than all others, rows that share
    a doc_id are not earlier than each other, an empty table gives an empty result. White space is ASCII's.
    """
    p = parsing(window)
    text, doc_id = text_of(docs), docs["doc_id"].cast("long")
    base = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(doc_id, text).alias("rid"), F.coalesce(doc_id, F.lit((1 << 63) - 1)).alias("ord"), F.struct(*(docs[c] for c in carry)).alias("carried") if carry else F.struct(F.lit(0).alias("none")).alias("carried"))
    found = marks(base, p, words=True, earlier=True, matched=factored(p), crowd=crowd)
    result = f"doc_id long, n_words long, text string, spans array<struct<start:long,end:long>>, factors array<struct<start:long,end:long,source:long>>, carried {base.schema['carried'].dataType.simpleString()}"
    return with_marks(base, found).select("doc_id", "text", "carried", "full", "starts").mapInArrow(covered(p, True, True, lambda *x: _emit(*x, window)), result)


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    kept = F.regexp_replace(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+", " ")
    return result.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], window: int = 50) -> list[tuple[int, int, int, str]]:
    """The definition, for tests."""
    words = [re.findall(WORD, t or "") for _, t in rows]
    ids = [(1 << 63) - 1 if d is None else d for d, _ in rows]
    least: dict[tuple[str, ...], int] = {}
    for d, w in zip(ids, words, strict=True):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, d), d)
    out = []
    for (doc_id, _), d, w in zip(rows, ids, words, strict=True):
        flags = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < d:
                flags[i : i + window] = True
        kept = " ".join(x for x, f in zip(w, flags, strict=True) if not f)
        out.append((doc_id, len(w), int(flags.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return out
