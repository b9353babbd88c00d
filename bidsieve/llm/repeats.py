"""Windows of a corpus that occur more than once, found through its content-defined phrases.

Shared by the suffix-array and the substring operators. Every window of fixed length belongs to one phrase end
(`rolling.Parsing`), so equal windows meet at equal phrase ends:

1. *Parse* - each phrase end becomes a small row with a key of its direct surroundings (part of each of its windows)
   and a key of its whole context (all of its windows). Ends whose surroundings are unique leave at once.
2. *Context classes* - ends with the same whole context share all windows; one of each class goes on.
3. *Bands* - the classes' windows meet in bands whose common core is the shuffle key, so that only windows that agree in all
   but a few symbols come together. What each operator then does with a band is its own: suffix ranks and their neighbours in
   one, factors against earlier blocks in the other.
4. *Crowds* - a passage that many documents share between different surroundings gives each of them a class of its own at
   the passage's edges. Such ends are not shipped: their windows are counted one by one by 128 bits of hash, which is
   combined before the shuffle, so that no task holds a crowd. Equal windows have equal surroundings, hence one path.

Rows of 40 bytes per phrase, never whole texts or pairs, are shuffled; keys are spread by content, so no group of copies,
source or passage lands in one task. Cores and windows of crowds are equal by two independent hashes of 64 bits, contexts by
one of the core and another of the whole; what stands around a core is compared symbol by symbol, bytes as they are, words by
64 bits each. Rows are told apart by their ord (the doc_id) and 64 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Mapper, bytes_of, durable, parts, slices
from .rolling import Hashes, Parsing, byte_values, classes_within, mix, other_byte_values, others, phrase_ends, word_values

_ANCHORS = "k long, c long, rid long, ord long, low int"
MATCHED = "rid long, ord long, start int, source long"
#: No source: no id is as small.
NONE = -(1 << 63)
_WINDOWS = "w1 long, w2 long, rid long, ord long, start int"
_BANDED = "h1 long, h2 long, rid long, ord long, top int, near int, far int, around binary"


def _symbols(batch: pa.RecordBatch, words: bool) -> tuple[np.ndarray, np.ndarray, tuple[Hashes, Hashes]]:
    """Symbols (bytes, or 64-bit values of words), each document's offsets in them, and two hashes of any stretch that tell
    nothing of each other: other values of the symbols, another base."""
    raw, offsets = bytes_of(batch.column("text"))
    if not words:
        return raw, offsets, (Hashes(byte_values(raw)), Hashes(other_byte_values(raw), 1))
    values, docs = word_values(raw, offsets)
    return values, docs, (Hashes(values), Hashes(others(values), 1))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _keys(both: tuple[Hashes, Hashes], ends: np.ndarray, low: np.ndarray, high: np.ndarray, p: Parsing) -> tuple[np.ndarray, np.ndarray]:
    """Key of what all windows of a phrase end hold, by one hash, and of all that they hold together, by the other."""
    k = _signed(both[0].of(ends - p.grain, ends + p.window - p.reach, 1))
    return k, _signed(mix(both[1].of(low, high + p.window, 2) + (ends - low).astype(np.uint64)))


def _anchors(p: Parsing, words: bool):
    """A row for each phrase end; of ends with equal keys in one document only for the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "text")):
            _, docs, both = _symbols(batch, words)
            ends, doc, low, high = phrase_ends(both[0], docs, p)
            k, c = _keys(both, ends, low, high, p)
            _, one = classes_within(doc, k, c)
            rid, order_by = (batch.column(x).to_numpy()[doc[one]] for x in ("rid", "ord"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k[one], c[one], rid, order_by, (low - docs[doc])[one].astype(np.int32))], ["k", "c", "rid", "ord", "low"])

    return run


def _listed_ends(batch: pa.RecordBatch, name: str, docs: np.ndarray, found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The phrase ends whose first windows a list column names."""
    lists = batch.column(name)
    wanted = docs[np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))] + lists.flatten().to_numpy()
    mine = np.isin(found[2], wanted)
    return tuple(x[mine] for x in found)


def _windows(p: Parsing, words: bool):
    """A row for each window of the phrase ends in crowds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "text")):
            _, docs, both = _symbols(batch, words)
            _, doc, low, high = _listed_ends(batch, "crowded", docs, phrase_ends(both[0], docs, p))
            each = high - low + 1
            for i in range(0, len(low), 8192):
                n = each[i : i + 8192]
                start = np.repeat(low[i : i + 8192] - np.cumsum(n) + n, n) + np.arange(n.sum())
                of = np.repeat(doc[i : i + 8192], n)
                rid, order_by = (batch.column(x).to_numpy()[of] for x in ("rid", "ord"))
                columns = [*(_signed(h.of(start, start + p.window, 3000)) for h in both), rid, order_by, (start - docs[of]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["w1", "w2", "rid", "ord", "start"])

    return run


def _banded(p: Parsing, words: bool):
    """The marked phrase ends of each document, once for each band that has windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = p.band - 1
        for batch in (s for b in batches for s in slices(b, "text")):
            content, docs, both = _symbols(batch, words)
            ends, doc, low, high = _listed_ends(batch, "ship", docs, phrase_ends(both[0], docs, p))
            padded = np.concatenate((np.zeros(p.reach, content.dtype), content, np.zeros(p.window, content.dtype)))
            rid, order_by = batch.column("rid").to_numpy(), batch.column("ord").to_numpy()
            for least in p.bands:
                most = min(least + width, p.reach)
                near, far = np.maximum(ends - high, least), np.minimum(ends - low, most)
                use = np.flatnonzero(near <= far)
                if not len(use):
                    continue
                e, inner = ends[use], p.window - least - width
                h1, h2 = (_signed(h.of(e - least, e + inner, 1000 + least)) for h in both)
                h1 = h1 ^ _keys(both, e, low[use], high[use], p)[0]  # the last core does not hold all of the surroundings
                before = padded[(e - least - width + p.reach)[:, None] + np.arange(width)]
                behind = padded[(e + inner + p.reach)[:, None] + np.arange(width)]
                around = np.ascontiguousarray(np.concatenate((before, behind), axis=1))
                blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(around.shape[1] * around.itemsize), len(use), [None, pa.py_buffer(around.tobytes())]).cast(pa.binary())
                columns = [h1, h2, rid[doc[use]], order_by[doc[use]], *(x.astype(np.int32) for x in ((ends - docs[doc])[use] - least, near[use] - least, far[use] - least))]
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in columns), blob], ["h1", "h2", "rid", "ord", "top", "near", "far", "around"])

    return run


def ranks(first: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Dense lexicographic ranks of rows."""
    rank = np.unique(first, return_inverse=True)[1]
    for x in more:
        rank = np.unique(rank * np.int64(x.max() + 1) + x, return_inverse=True)[1]
    return rank


def crowds_of(table: pa.Table, p: Parsing, words: bool) -> tuple | None:
    """Rows of bands that hold more than one: the columns, the band's number, and what stands around as numbers, a row each."""
    h1, h2 = (table.column(x).to_numpy() for x in ("h1", "h2"))
    group = np.cumsum(np.concatenate(([True], (np.diff(h1) != 0) | (np.diff(h2) != 0)))) - 1
    crowd = np.flatnonzero(np.bincount(group)[group] > 1)
    if not len(crowd):
        return None
    table = table.take(pa.array(crowd))
    columns = {x: table.column(x).to_numpy() for x in ("rid", "ord", "top", "near", "far")}
    around = np.frombuffer(b"".join(table.column("around").to_pylist()), np.uint64 if words else np.uint8).reshape(len(crowd), 2 * (p.band - 1))
    return columns, group[crowd], np.unique(around, return_inverse=True)[1].reshape(around.shape) if words else around.astype(np.int64)


def windows_of(columns: dict[str, np.ndarray], group: np.ndarray, around: np.ndarray, p: Parsing) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each number of symbols ahead of the core: that number, the rows with such a window, and the window's rank.

    The stretch ahead (a suffix of the phrase) and the stretch behind (a prefix of what the parse has next) have lexicographic
    ranks, refined symbol by symbol; a window is the pair of both.
    """
    width = p.band - 1
    behind = [ranks(group)]
    for j in range(width):
        behind.append(ranks(behind[-1], around[:, width + j]))
    before = np.zeros(len(group), np.int64)
    for ahead in range(p.band):
        if ahead:
            before = ranks(before, around[:, width - ahead])
        use = np.flatnonzero((columns["near"] <= ahead) & (ahead <= columns["far"]))
        if len(use):
            yield ahead, use, ranks(behind[width - ahead][use], before[use])


def _met_in_crowds(docs: DataFrame, lists: DataFrame, p: Parsing, words: bool, earlier: bool) -> DataFrame:
    """Windows of phrase ends in crowds that start elsewhere too (in an earlier document): rid, start."""
    windows = durable(docs.join(lists.where(F.size("crowded") > 0).select("rid", "ord", "crowded"), ["rid", "ord"]).select("rid", "ord", "text", "crowded").mapInArrow(_windows(p, words), _WINDOWS))
    told = windows.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min("ord").alias("least"), F.max("ord").alias("most"))
    # v1 ^ 0 hides the partitioning here too, so that a window with many rows may be split
    told = told.where("least < most" if earlier else "n > 1").select(F.expr("w1 ^ 0").alias("v1"), F.col("w2").alias("v2"), "least")
    met = windows.join(told, (F.col("w1") == F.col("v1")) & (F.col("w2") == F.col("v2")))
    return (met.where("ord > least") if earlier else met).select("rid", "ord", "start", F.col("least").alias("source"))


def marks(docs: DataFrame, p: Parsing, words: bool, earlier: bool, matched: Mapper, crowd: int = 16_384) -> DataFrame:
    """Per `rid` and `ord` the windows that count: `full` (phrase ends, by the start of their first window, all of whose windows
    do) and `starts` (single windows), each with `source`, the ord of a row that has the window too.

    docs: rid long (a hash that tells rows of one ord apart), ord long (the order in which a document is earlier), text string
    without nulls. `matched` gets the bands, sorted, and gives rows of MATCHED. It never gets more than `crowd` phrase ends of
    one core; larger crowds are counted window by window.
    """
    anchors = docs.mapInArrow(_anchors(p, words), _ANCHORS)
    shared = anchors.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    # k ^ 0 hides the join's partitioning: what follows is combined before it is shuffled, and a hot key may be split
    near = durable(anchors.join(shared, "k", "left_semi")).select(F.expr("k ^ 0").alias("k"), "c", "rid", "ord", "low")
    classes = durable(near.groupBy("k", "c").agg(F.count("*").alias("n"), F.min(F.struct("ord", "rid", "low")).alias("rep"))).withColumn("k", F.expr("k ^ 0"))
    many = classes.groupBy("k").agg(F.count("*").alias("classes"), F.sum("n").alias("rows")).where("classes > 1").select("k", F.lit(True).alias("many"), (F.col("rows") > crowd).alias("crowded"))
    ranked = classes.join(many, "k", "left").select(F.col("k").alias("ck"), F.col("c").alias("cc"), "n", "rep", F.coalesce("many", F.lit(False)).alias("many"), F.coalesce("crowded", F.lit(False)).alias("crowded")).where("n > 1 or many")
    full = F.col("ord") > F.col("rep.ord") if earlier else F.col("n") > 1
    first = F.col("ord") == F.col("rep.ord") if earlier else (F.col("rid") == F.col("rep.rid")) & (F.col("ord") == F.col("rep.ord")) & (F.col("low") == F.col("rep.low"))
    marked = near.join(ranked, (F.col("k") == F.col("ck")) & (F.col("c") == F.col("cc"))).select("rid", "ord", "low", full.alias("full"), F.col("rep.ord").alias("source"), (first & F.col("many")).alias("ship"), "crowded").where("full or ship")
    lists = durable(marked.groupBy("rid", "ord").agg(F.collect_list(F.when(F.col("full"), F.struct(F.col("low").alias("start"), "source"))).alias("full"), F.collect_list(F.when(F.col("ship") & ~F.col("crowded"), F.col("low"))).alias("ship"), F.collect_list(F.when(F.col("ship") & F.col("crowded"), F.col("low"))).alias("crowded")))
    banded = docs.join(lists.where(F.size("ship") > 0).select("rid", "ord", "ship"), ["rid", "ord"]).select("rid", "ord", "text", "ship").mapInArrow(_banded(p, words), _BANDED)
    met = banded.repartition(parts(docs), "h1", "h2").sortWithinPartitions("h1", "h2").mapInArrow(matched, MATCHED)
    if not lists.where(F.size("crowded") > 0).isEmpty():
        met = met.unionByName(_met_in_crowds(docs, lists, p, words, earlier))
    starts = met.groupBy("rid", "ord").agg(F.collect_list(F.struct("start", "source")).alias("starts"))
    return lists.select("rid", "ord", "full").join(starts, ["rid", "ord"], "full_outer")


def covered(p: Parsing, words: bool, earlier: bool, emit):
    """A mapper over documents with their marks; emit(batch, docs, flags, source) gets for each symbol whether a window that
    counts covers it, and makes the result. Where only earlier documents count, source has for each symbol the source of such a
    window that starts there (NONE without one); otherwise it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "text")):
            symbols, docs, both = _symbols(batch, words)
            ends, doc, low, high = phrase_ends(both[0], docs, p)
            n = len(symbols)
            source = np.full(n if earlier else 0, NONE, np.int64)
            cover = np.zeros(n + p.window + 1, np.int32)

            def listed(name: str, batch: pa.RecordBatch = batch, docs: np.ndarray = docs) -> tuple[np.ndarray, np.ndarray]:
                lists = batch.column(name)
                items = lists.flatten()
                return np.repeat(docs[:-1], np.diff(lists.offsets.to_numpy())) + items.field("start").to_numpy(), items.field("source").to_numpy()

            def mark(first: np.ndarray, last: np.ndarray, told: np.ndarray, cover: np.ndarray = cover, source: np.ndarray = source) -> None:
                """Windows from first to last, a row each, count."""
                np.add.at(cover, first, 1)
                np.add.at(cover, last + p.window, -1)
                if earlier:
                    each = last - first + 1
                    source[np.repeat(first - np.cumsum(each) + each, each) + np.arange(each.sum())] = np.repeat(told, each)

            if len(ends):
                same, _ = classes_within(doc, *_keys(both, ends, low, high, p))
                count = np.bincount(same)
                of_class = np.full(len(count), NONE, np.int64)
                if not earlier:
                    of_class[count > 1] = 0
                at, told = listed("full")
                spot = np.searchsorted(low, at)
                of_class[same[spot]] = told
                own = np.flatnonzero(of_class[same] != NONE)
                mark(low[own], high[own], of_class[same[own]])
                # what holds for the first end of a class in a document holds for its others
                found, told = listed("starts")
                at = np.searchsorted(low, found, side="right") - 1
                alone = count[same[at]] == 1
                mark(found[alone], found[alone], told[alone])
                by_class = np.argsort(same, kind="stable")
                first = np.cumsum(count) - count
                each = count[same[at[~alone]]]
                twins = by_class[np.repeat(first[same[at[~alone]]] - np.cumsum(each) + each, each) + np.arange(each.sum())]
                start = low[twins] + np.repeat((found - low[at])[~alone], each)
                mark(start, start, np.repeat(told[~alone], each))
            yield emit(batch, docs, np.cumsum(cover, out=cover)[:n] > 0, source)

    return run


def with_marks(docs: DataFrame, found: DataFrame) -> DataFrame:
    empty = F.array().cast("array<struct<start:int,source:bigint>>")
    return docs.join(found, ["rid", "ord"], "left").withColumns({x: F.coalesce(x, empty) for x in ("full", "starts")})
