"""Suffix-array dedup by prefix-free parsing.

Rolling-hash triggers over 16 bytes cut every text into phrases of about 170 bytes and 350 at most. The dictionary side (suffixes of the
phrase before a trigger) and the parse side (what follows the trigger) are ranked in suffix order, class by class, and
combined: two suffixes of the corpus share `window` bytes exactly when both ranks are equal. That gives the neighbours with a
common prefix of `window` bytes in corpus order without ever holding the corpus, or its suffix array, in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, runs_of, text_of, whole_groups
from .repeats import covered, crowds_of, marks, windows_of, with_marks
from .rolling import Parsing

_RESULT = "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>"


def parsing(window: int) -> Parsing:
    grain = min(16, max(1, window // 8))
    return Parsing(window=window, grain=grain, reach=max(grain, window * 7 // 8), band=max(2, min(40, window // 10)))


def neighbours(p: Parsing):
    """Suffixes of a band in order: those whose neighbour, before or behind, has their first `window` bytes too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["h1", "h2"]):
            found = crowds_of(table, p, words=False)
            if found is None:
                continue
            columns, group, around = found
            for ahead, use, rank in windows_of(columns, group, around, p):
                hit = use[np.bincount(rank)[rank] > 1]
                yield pa.RecordBatch.from_arrays([pa.array(columns["rid"][hit]), pa.array(columns["ord"][hit]), pa.array((columns["top"][hit] - ahead).astype(np.int32)), pa.array(np.zeros(len(hit), np.int64))], ["rid", "ord", "start", "source"])

    return run


def _emit(batch: pa.RecordBatch, docs: np.ndarray, flags: np.ndarray, source: np.ndarray) -> pa.RecordBatch:
    raw, _ = bytes_of(batch.column("text"))
    starts, ends = runs_of(flags)
    # a run ends where its document does
    cut = docs[1:-1][np.diff(docs)[1:] > 0]
    cut = cut[(cut > 0) & flags[cut] & flags[cut - 1]]
    starts, ends = np.sort(np.concatenate((starts, cut))), np.sort(np.concatenate((ends, cut)))
    spans, before = np.searchsorted(starts, docs), np.concatenate(([0], np.cumsum(ends - starts)))
    of = docs[np.searchsorted(docs, starts, side="right") - 1]
    pairs = pa.StructArray.from_arrays([pa.array(starts - of), pa.array(ends - of)], ["start", "end"])
    kept = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((docs - before[spans]).astype(np.int32)), pa.py_buffer(raw[~flags] if len(starts) else np.ascontiguousarray(raw))])
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(docs)), kept, pa.ListArray.from_arrays(pa.array(spans, pa.int32()), pairs)], ["doc_id", "n_bytes", "kept", "spans"])


def remove_repeated_bytes(docs: DataFrame, window: int = 400, crowd: int = 16_384) -> DataFrame:
    """Remove every byte that a `window`-byte string covers which also starts anywhere else in the corpus.

    docs: doc_id long, text string; other columns are ignored, whatever their names. Returns one row per input row:
    doc_id, n_bytes, kept binary (UTF-8 bytes that stay; a cut may split a character), spans (removed runs, half open).
    All occurrences go, the first included; overlaps within one document count; matches never cross documents.
    A null text is empty, an empty or short text (under `window` bytes) stays whole, a null doc_id stays null, repeated
    rows are documents of their own (so both lose what they share), an empty table gives an empty result.
    """
    p = parsing(window)
    text = text_of(docs)
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(docs["doc_id"].cast("long"), text).alias("rid"), F.coalesce(docs["doc_id"].cast("long"), F.lit((1 << 63) - 1)).alias("ord"))
    found = marks(base, p, words=False, earlier=False, matched=neighbours(p), crowd=crowd)
    return with_marks(base, found).select("doc_id", "text", "full", "starts").mapInArrow(covered(p, False, False, _emit), _RESULT)


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return result.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], window: int = 400) -> list[tuple[int, int, int, int, str]]:
    """The definition, for tests."""
    texts = [(t or "").encode() for _, t in rows]
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - window + 1):
            seen[t[i : i + window]] = seen.get(t[i : i + window], 0) + 1
    out = []
    for (doc_id, _), t in zip(rows, texts, strict=True):
        flags = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                flags[i : i + window] = True
        kept = bytes(b for b, f in zip(t, flags, strict=True) if not f)
        out.append((doc_id, len(t), int(flags.sum()), len(runs_of(flags)[0]), hashlib.sha256(kept).hexdigest()))
    return out
