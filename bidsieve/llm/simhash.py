"""SimHash near-dedup by anchor-point covering.

The anchors are the words of a covering code of length 64: the perfect Hamming code of length 63, radius 1, with the 64th
bit kept as it is. Two fingerprints at most T bits apart have a point between them at most ceil(T/2) from both, and an
anchor lies within 1 of that point, so it is enough to replicate each fingerprint to every anchor within
1 + ceil(T/2) of it: 33 anchors or fewer for T = 2. An anchor holds at most 2081 different fingerprints whatever the corpus
is, since only that many lie so close, so comparing all pairs of an anchor is bounded work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components, local_roots
from .common import WORD, bytes_of, durable, parts, slices, text_of, whole_groups

_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
#: Parity masks of the Hamming code: bit i (0 to 62) has the number i + 1, bit 63 is free.
_PARITY = np.array([sum(1 << i for i in range(63) if (i + 1) >> j & 1) for j in range(6)], np.uint64)


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, join = xxhash.xxh64_intdigest, b" ".join
        for batch in (s for b in batches for s in slices(b, "text", 1 << 20)):
            raw, offsets = bytes_of(batch.column("text"))
            data = raw.tobytes().lower()
            hashes, sizes = [], []
            for i in range(batch.num_rows):
                words = data[offsets[i] : offsets[i + 1]].split()
                if len(words) < shingle:
                    hashes += [digest(join(words), seed)] if words else []
                    sizes.append(1 if words else 0)
                else:
                    n = len(words) - shingle + 1
                    hashes += [digest(join(x), seed) for x in zip(*(words[j : j + n] for j in range(shingle)), strict=True)]
                    sizes.append(n)
            starts = np.concatenate(([0], np.cumsum(sizes)))
            bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            out = np.zeros(batch.num_rows, np.uint64)
            for i, n in enumerate(sizes):
                if n:
                    out[i] = _BITS[bits[starts[i] : starts[i + 1]].sum(axis=0, dtype=np.int64) * 2 > n].sum(dtype=np.uint64)
            others = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in others), pa.array(out.view(np.int64))], [*others, "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (64 bits in a long) of each row: majority of the XXH64 bits of its word shingles, repeats counted."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(_fingerprints(shingle, seed), "doc_id long, fp long")


def anchors_of(fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Each code word within `reach` (1 or 2) of a fingerprint, with the row of the fingerprint."""
    syndrome = np.zeros(len(fps), np.int64)
    for j, mask in enumerate(_PARITY):
        syndrome |= (np.bitwise_count(fps & mask).astype(np.int64) & 1) << j
    rows, words = [], []

    def near(use: np.ndarray, flips: np.ndarray) -> None:
        rows.append(use)
        words.append(fps[use] ^ flips)

    number = np.concatenate((np.zeros(1, np.uint64), _BITS[:63]))  # the bit with number n; none for 0
    zero, rest = np.flatnonzero(syndrome == 0), np.flatnonzero(syndrome)
    near(zero, np.uint64(0))
    near(rest, number[syndrome[rest]])
    if reach > 1:
        near(zero, _BITS[63])
        near(rest, number[syndrome[rest]] ^ _BITS[63])
        for i in range(1, 64):
            other = syndrome[rest] ^ i
            pair = other > i
            near(rest[pair], number[i] ^ number[other[pair]])
    return np.concatenate(rows), np.concatenate(words)


def _spread(reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            rows, words = anchors_of(fps, reach)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(fps[rows].view(np.int64))], ["anchor", "fp"])

    return run


def _compared(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["anchor"]):
            anchor, fps = table.column("anchor").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
            left, right = [], []
            apart, live = 0, np.arange(len(fps))
            while len(live):
                apart += 1
                live = live[live + apart < len(fps)]
                live = live[anchor[live] == anchor[live + apart]]
                hit = live[np.bitwise_count(fps[live] ^ fps[live + apart]) <= most]
                left.append(hit)
                right.append(hit + apart)
            left, right = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
            root = local_roots(len(fps), left, right)
            child = np.flatnonzero(root != np.arange(len(fps)))
            yield pa.RecordBatch.from_arrays([pa.array(fps[x].view(np.int64)) for x in (child, root[child])], ["a", "b"])

    return run


def _rooted(prints: DataFrame, most: int, tasks: int) -> DataFrame:
    """fp and root (one fingerprint of the class) of each different fingerprint."""
    classes = prints.select("fp").distinct()
    spread = classes.repartition(tasks, "fp").mapInArrow(_spread(1 + (most + 1) // 2), "anchor long, fp long")
    edges = spread.repartition(tasks, "anchor").sortWithinPartitions("anchor").mapInArrow(_compared(most), "a long, b long")
    found = components(edges).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    return classes.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = 2, seed: int = 42) -> DataFrame:
    """Classes of documents whose fingerprints are chained by links of at most `most` (1 or 2) differing bits.

    docs: doc_id long, text string; other columns are ignored, whatever their names. Returns one row per input row:
    doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id of the class). Upper-case A-Z counts as lower
    case; fewer words than a shingle make one shingle; a null, empty or blank text has the fingerprint zero and links like
    any other. A null doc_id is never smallest (null where a class has no other); repeated rows are all returned; an empty
    table gives an empty result.
    """
    prints = durable(fingerprints(docs, shingle, seed))
    rooted = _rooted(prints, most, parts(docs))
    known = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(rooted, "fp")
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, most: int = 2, seed: int = 42) -> DataFrame:
    """One row of docs, with all its columns, of each class of near duplicates.

    It is the one with the smallest doc_id; null ids come last, and of rows that share an id the one whose text has the
    smallest hash (128 bits) stays, of rows that share both the one that is smallest in all columns.
    """
    text, doc_id = text_of(docs), docs["doc_id"].cast("long")
    key = {"_none": doc_id.isNull(), "_id": F.coalesce(doc_id, F.lit(0)), "_h1": F.xxhash64(text), "_h2": F.xxhash64(F.lit(1), text)}
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), *(c.alias(n) for n, c in key.items()))
    names = [f"{n} {'boolean' if n == '_none' else 'long'}" for n in key]
    prints = durable(docs.select(*(c.alias(n) for n, c in key.items()), text.alias("text")).mapInArrow(_fingerprints(shingle, seed), ", ".join([*names, "fp long"])))
    counted = prints.groupBy(*key, "fp").agg(F.count("*").alias("n")).join(_rooted(prints, most, parts(docs)), "fp")
    heads = durable(counted.groupBy("root").agg(F.min(F.struct(*key, "n")).alias("head")).select("head.*"))
    kept = keyed.join(heads, [*key])
    # few texts are shuffled here: of rows that share id and text
    again = kept.where("n > 1").groupBy(*key).agg(F.min("row").alias("row")).select("row.*")
    return kept.where("n = 1").select("row.*").unionByName(again)


def brute_force(rows: list[tuple[int, str | None]], shingle: int = 3, most: int = 2, seed: int = 42) -> list[tuple[int, str, int]]:
    """The definition, for tests."""
    prints = []
    for _, text in rows:
        words = re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        if not words:
            prints.append(0)
            continue
        pieces = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
        hashes = [xxhash.xxh64_intdigest(p.encode(), seed) for p in pieces]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    label = list(range(len(rows)))

    def find(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                label[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(doc_id, f"{prints[i]:016x}", least[find(i)]) for i, (doc_id, _) in enumerate(rows)]
