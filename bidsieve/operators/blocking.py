"""Near duplicates: MinHash bands over character runs bring texts together, the lexical cosine decides."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, fold
from .components import components, local_roots
from .shared import durable, parts, whole_groups
from .similarity import GRAM_WEIGHT, TOKEN_WEIGHT

_STOP = frozenset(STOP_WORDS)


def _runs(folded: str) -> np.ndarray:
    """A number for each run of four characters of a folded text (of the whole text, if it is shorter)."""
    chars = np.frombuffer(folded.replace(" ", "_").encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(chars) < 4:
        chars = np.concatenate((chars, np.zeros(4 - len(chars), np.uint64)))
    out = np.zeros(len(chars) - 3, np.uint64)
    for i in range(4):
        out = out << np.uint64(21) ^ out >> np.uint64(43) ^ chars[i : len(chars) - 3 + i] * np.uint64(0x9E3779B97F4A7C15)
    return out


def _signed(folded: str, factors: np.ndarray, shifts: np.ndarray, width: int) -> np.ndarray:
    runs = np.unique(_runs(folded))
    minima = np.array([((runs ^ s) * f >> np.uint64(11)).min() for f, s in zip(factors, shifts, strict=True)], np.uint64).reshape(-1, width)
    key = np.zeros(len(minima), np.uint64)
    for i in range(width):
        key = (key ^ minima[:, i]) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def signatures(rows: DataFrame, bands: int, width: int) -> DataFrame:
    """rows: id long, folded string. Key of each band: `bands` hashes over `width` minima of permuted hashes of the text's runs; no row for an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng(42)
        factors, shifts = (random.integers(0, 1 << 64, bands * width, np.uint64) for _ in range(2))
        for batch in batches:
            ids, texts = batch.column("id").to_numpy(), batch.column("folded").to_pylist()
            for i in range(0, len(ids), 256):
                use = [j for j in range(i, min(i + 256, len(ids))) if texts[j]]
                keys = [_signed(texts[j], factors | np.uint64(1), shifts, width) for j in use]
                flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[use], bands)), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(use))), pa.array(flat)], ["id", "band", "key"])

    return rows.select("id", "folded").mapInArrow(run, "id long, band int, key long")


def text_vector(folded: str, words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Terms (as numbers) and weights of a text's unit vector; words are numbered as they come."""
    runs, counts = np.unique(_runs(folded), return_counts=True)
    found = Counter(t for t in folded.split(" ") if len(t) > 2 and t not in _STOP)
    named = np.array([words.setdefault(t, len(words)) for t in found], np.uint64)
    raw = 1 + np.log(np.concatenate((counts * GRAM_WEIGHT, np.array(list(found.values()), float) * TOKEN_WEIGHT)))
    return np.concatenate((runs | np.uint64(1 << 63), named)), raw / (np.sqrt(raw @ raw) or 1.0)


def text_vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of many folded texts at once: where each begins (and the last ends), terms as numbers from 0 on, weights.
    Empty texts have no terms."""
    joined = [t.replace(" ", "_") + "\0" * (4 - len(t)) if t else "" for t in texts]
    many = np.maximum(np.array([len(t) for t in joined], np.int64) - 3, 0)
    start = np.cumsum([0] + [len(t) for t in joined])[:-1]
    runs = _runs("".join(joined))[np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())]
    words: dict[str, int] = {}
    named = [[words.setdefault(t, len(words)) for t in text.split(" ") if len(t) > 2 and t not in _STOP] for text in texts]
    owner = np.concatenate((np.repeat(np.arange(len(texts)), many), np.repeat(np.arange(len(texts)), [len(x) for x in named])))
    known, term = np.unique(np.concatenate((runs | np.uint64(1 << 63), np.array([x for row in named for x in row], np.uint64))), return_inverse=True)
    key, count = np.unique(owner * max(1, len(known)) + term, return_counts=True)
    owner, term = np.divmod(key, max(1, len(known)))
    raw = 1 + np.log(count * np.where(known[term] >> np.uint64(63), GRAM_WEIGHT, TOKEN_WEIGHT))
    norm = np.sqrt(np.bincount(owner, raw * raw, len(texts)))
    return np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts))))), term, raw / np.where(norm > 0, norm, 1.0)[owner]


def _cosines(texts: list[str]) -> np.ndarray:
    """Lexical cosine of each text to each, four places."""
    words: dict[str, int] = {}
    vectors = [text_vector(t, words) for t in texts]
    terms = np.unique(np.concatenate([v[0] for v in vectors]), return_inverse=True)[1]
    weights, ends = np.concatenate([v[1] for v in vectors]), np.cumsum([len(v[0]) for v in vectors])
    starts = np.concatenate(([0], ends[:-1]))
    out, dense = np.zeros((len(texts), len(texts))), np.zeros(terms.max() + 1)
    for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
        dense[terms[a:b]] = weights[a:b]
        out[i] = np.add.reduceat(weights * dense[terms], starts)
        dense[terms[a:b]] = 0
    return np.round(np.clip(out, 0, 1), 4)


def _verified(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["band", "key", "b1", "b2"], 512):
            band, key, b1, b2, block, ids = (table.column(x).to_numpy() for x in ("band", "key", "b1", "b2", "block", "id"))
            texts = table.column("folded").to_pylist()
            edge = np.flatnonzero(np.concatenate(([True], (np.diff(band) != 0) | (np.diff(key) != 0) | (np.diff(b1) != 0) | (np.diff(b2) != 0), [True])))
            for start, end in zip(edge[:-1], edge[1:], strict=True):
                if end - start < 2:
                    continue
                near = _cosines(texts[start:end])
                np.fill_diagonal(near, 0)
                if b1[start] != b2[start]:  # pairs inside a block are another task's
                    near[block[start:end][:, None] == block[start:end]] = 0
                left, right = np.nonzero(near >= least)
                use = np.unique(left)
                root = local_roots(end - start, left, right)
                yield pa.RecordBatch.from_arrays([pa.array(ids[start:end][use]), pa.array(ids[start:end][root[use]]), pa.array(near[use].max(axis=1))], ["a", "b", "similarity"])

    return run


def near_duplicates(rows: DataFrame, row_id: str, text: str, least: float = 0.92, bands: int = 16, width: int = 3, block: int = 256) -> DataFrame:
    """Per row its class and its closest link: id, component_id (smallest id reachable), similarity (null without a link).

    Texts that fold alike are one; of the others those that share a band meet, all with all, in blocks of about `block`, and
    are linked at a lexical cosine of `least` and more (four places). No link inside a band is left out; texts that share no
    band are not compared (recall is held to 0.9 in the tests). Bands with the same members are compared once. Null and
    empty texts link with nothing.
    """
    base = durable(rows.select(F.col(row_id).cast("long").alias("id"), fold(F.col(text)).alias("folded")).withColumns({"h1": F.xxhash64("folded"), "h2": F.xxhash64(F.lit(1), "folded")}))
    equal = durable(base.where("folded <> ''").groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    unique = base.join(equal, ["h1", "h2"]).where("id = first").select("id", "folded", "h1", "h2").dropDuplicates(["id", "h1", "h2"]).select("id", "folded")
    keys = durable(signatures(unique, bands, width))
    groups = keys.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("members")).where("n > 1")
    once = groups.groupBy("n", "members").agg(F.min(F.struct("band", "key")).alias("g")).select("g.band", "g.key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    placed = keys.join(once, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("id", "band"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = placed.select("id", "band", "key", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block").join(unique, "id")
    links = durable(met.repartition(parts(rows), "band", "key", "b1", "b2").sortWithinPartitions("band", "key", "b1", "b2").mapInArrow(_verified(least), "a long, b long, similarity double"))
    classes = components(links.select("a", "b")).select(F.col("node").alias("first"), "component")
    closest = links.groupBy(F.col("a").alias("first")).agg(F.max("similarity").alias("near"))
    known = equal.join(classes, "first", "left").join(closest, "first", "left")
    named = known.select("h1", "h2", F.coalesce("component", "first").alias("component"), F.when(F.col("n") > 1, 1.0).otherwise(F.col("near")).alias("similarity"))
    return base.select("id", "h1", "h2").join(named, ["h1", "h2"], "left").select("id", F.coalesce("component", "id").alias("component_id"), "similarity")
