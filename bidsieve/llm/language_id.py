"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of orders 0 to 4 with the counts of the bytes that follow, over all labelled
texts. A text's code length in a language is the sum over its bytes of -log2 of their probability: the longest context that
the tree holds predicts the byte, or an escape (as likely as the context has different bytes) leads to the next shorter
context, in which bytes that the longer one has are excluded; below order 0 all bytes left are equally likely. Statistics
are frozen before the first text is scored. The language with the shortest code wins.

Spark counts one gram per place of a text (the byte and up to four before it); the shorter ones are sums of these. Tasks hold
the contexts that are most frequent over all languages, by a threshold from a histogram; a context is held in all its
languages or in none, and with it all its endings. In a task the cost of a gram is computed once and kept; a text's code
length is a sum of looked-up costs over all its bytes.

The other contexts stay a table, and nothing is lost with them. A gram whose context may be among these (a table of bits tells
most of those that no text had) leaves the task with its number of places. What its contexts change in its cost is computed
where both meet, language by language, and added to the text's code lengths. Costs are whole multiples of 2**-28 bits, so the
sum is the same whichever contexts tasks hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, parts, slices, text_of, whole_groups, written

_ORDER = 4
#: A gram has its bytes, the last one lowest, below this bit and its number of bytes above it.
_MARK = 8 * (_ORDER + 1)
#: Bytes behind contexts that a task holds at most: for each language, and all together; costs that it keeps.
_ENTRIES, _ALL_ENTRIES, _CACHE = 1 << 18, 1 << 22, 1 << 22
#: Bits (a prime) that tell contexts which tasks do not hold from those that no text had; parts of a bit that costs are counted in.
_SLOTS, _UNIT = 67_108_859, 1 << 28
#: Steps of the histogram of context counts per doubling.
_STEPS = 16
UNKNOWN = "und"


def held_out(docs: DataFrame) -> Column:
    """Rows that no statistics come from; an id that is null counts as an empty one."""
    return F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")) % 3 == 1


def grams_of(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the gram of up to four bytes before it in its text and itself."""
    depth = np.minimum(np.arange(len(raw)) - np.repeat(offsets[:-1], np.diff(offsets)), _ORDER)
    grams = raw.astype(np.uint64)
    for k in range(1, _ORDER + 1):
        grams[k:] |= np.where(depth[k:] >= k, raw[:-k].astype(np.uint64) << np.uint64(8 * k), np.uint64(0))
    return grams | (depth + 1).astype(np.uint64) << np.uint64(_MARK)


def _counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)


def contexts(docs: DataFrame) -> DataFrame:
    """lang, context, total, followers (array of byte, n): all contexts of all languages, from texts and languages that are not null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = {}
        keys, counts, size = [], [], 0

        def give() -> Iterator[pa.RecordBatch]:
            found, n = _counted(keys, counts)
            names = pa.array([*codes], pa.string()).take(pa.array((found >> np.uint64(_MARK + 4)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([names, pa.array((found & np.uint64((1 << _MARK + 4) - 1)).astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for whole in batches:
            for batch in slices(whole, "text"):
                raw, offsets = bytes_of(batch.column("text"))
                lang = np.array([codes.setdefault(x, len(codes)) for x in batch.column("lang").to_pylist()], np.uint64)
                tagged = grams_of(raw, offsets) | np.repeat(lang, np.diff(offsets)) << np.uint64(_MARK + 4)
                coded = pa.array(tagged).dictionary_encode()
                keys.append(coded.dictionary.to_numpy())
                counts.append(np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)))
                size += len(keys[-1])
                if size > 1 << 21:
                    keys[:], counts[:] = ([x] for x in _counted(keys, counts))
                    size = len(keys[0])
                if size > 1 << 20 and len(keys) == 1:
                    yield from give()
                    keys, counts, size = [], [], 0
        if keys:
            yield from give()

    known = docs.where("text is not null and lang is not null").select(F.col("lang").cast("string").alias("lang"), text_of(docs).alias("text"))
    grams = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    shorter = F.expr(f"transform(sequence(1, cast(shiftright(gram, {_MARK}) as int)), k -> (gram & (shiftleft(1L, 8 * k) - 1L)) | shiftleft(cast(k as bigint), {_MARK}))")
    entries = grams.select("lang", "n", F.explode(shorter).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    before = F.expr(f"shiftright(gram & {(1 << _MARK) - 1}L, 8) | shiftleft(shiftright(gram, {_MARK}) - 1L, {_MARK})")
    follower = F.struct(F.col("gram").bitwiseAND(F.lit(255)).cast("int").alias("byte"), "n")
    return entries.withColumn("context", before).groupBy("lang", "context").agg(F.sum("n").alias("total"), F.collect_list(follower).alias("followers"))


def _context(grams: np.ndarray, order: int) -> np.ndarray:
    """The last `order` bytes before each gram's last one."""
    return (grams & np.uint64((1 << 8 * (order + 1)) - 1)) >> np.uint64(8) | np.uint64(order << _MARK)


def _matching(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of the wanted keys among sorted ones, 0 for those that are not there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


@dataclass
class Tree:
    """Contexts of a language, sorted, with counts, different followers, and the count that these have one order below; grams, sorted, with counts."""

    context: np.ndarray
    total: np.ndarray
    kinds: np.ndarray
    excluded: np.ndarray
    gram: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, context: np.ndarray, lengths: np.ndarray, byte: np.ndarray, n: np.ndarray, base: Tree | None = None) -> Tree:
        """base: the tree that has the contexts which these end with, where they are not among these."""
        order = np.argsort(context)
        owner = np.repeat(context, lengths)
        gram = (owner & np.uint64((1 << _MARK) - 1)) << np.uint64(8) | byte.astype(np.uint64) | ((owner >> np.uint64(_MARK)) + np.uint64(1)) << np.uint64(_MARK)
        by_gram = np.argsort(gram)
        gram_sorted, n_sorted = gram[by_gram], n[by_gram]
        total = np.bincount(np.repeat(np.arange(len(context)), lengths), weights=n, minlength=len(context)).astype(np.int64)
        # the same gram without its first byte, one order below
        long_ones = owner >> np.uint64(_MARK) > 0
        size = gram[long_ones] >> np.uint64(_MARK)
        below = (gram[long_ones] & ((np.uint64(1) << (np.uint64(8) * (size - np.uint64(1)))) - np.uint64(1))) | (size - np.uint64(1)) << np.uint64(_MARK)
        less = np.zeros(len(gram), np.int64)
        less[long_ones] = sum(_matching(t_gram, t_n, below) for t_gram, t_n in [(gram_sorted, n_sorted), *([(base.gram, base.n)] if base else [])])
        excluded = np.bincount(np.repeat(np.arange(len(context)), lengths), weights=less, minlength=len(context)).astype(np.int64)
        return cls(context[order], total[order], lengths[order].astype(np.int64), excluded[order], gram_sorted, n_sorted)

    def bits(self, grams: np.ndarray, more: Tree | None = None) -> np.ndarray:
        """Code length of the last byte of each gram behind the others; more: further contexts, none of which is in this tree."""
        bits = np.zeros(len(grams))
        open_ = np.arange(len(grams))
        excluded, kinds = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
        for order in range(_ORDER, -1, -1):
            coded = []
            for tree in (self, more) if more else (self,):
                here = open_[(grams[open_] >> np.uint64(_MARK)) > order]
                if not len(here):
                    continue
                context = _context(grams[here], order)
                at = np.minimum(np.searchsorted(tree.context, context), len(tree.context) - 1)
                held = tree.context[at] == context
                here, at = here[held], at[held]
                if not len(here):
                    continue
                n = _matching(tree.gram, tree.n, grams[here] & np.uint64((1 << 8 * (order + 1)) - 1) | np.uint64(order + 1 << _MARK))
                left = tree.kinds[at] - kinds[here]
                mass = tree.total[at] - excluded[here] + left
                part = np.where(n > 0, n, left)
                bits[here] += np.where(mass > 0, np.log2(np.maximum(mass, 1)) - np.log2(np.maximum(part, 1)), 0.0)
                coded.append((here, n, tree.excluded[at], tree.kinds[at]))
            for here, n, out, different in coded:
                excluded[here], kinds[here] = out, different
                open_ = np.setdiff1d(open_, here[n > 0], assume_unique=True)
        bits[open_] += np.log2(np.maximum(256 - kinds[open_], 1))
        return bits

    def costs(self, grams: np.ndarray, more: Tree | None = None) -> np.ndarray:
        return np.rint(self.bits(grams, more) * _UNIT).astype(np.int64)


@dataclass
class Model:
    """Languages by name and the tree of each; all contexts that trees hold; where there are others, bits that tell of
    them, and their table: lang (place among the languages), context, byte, n (arrays)."""

    languages: list[str]
    trees: list[Tree]
    held: np.ndarray
    others: np.ndarray | None = None
    rest: DataFrame | None = None

    def unsure(self, grams: np.ndarray) -> np.ndarray:
        """Whether the table of other contexts may change the cost of a gram."""
        out = np.zeros(len(grams), bool)
        if self.others is None:
            return out
        open_ = np.arange(len(grams))
        for order in range(_ORDER, 0, -1):
            here = open_[(grams[open_] >> np.uint64(_MARK)) > order]
            context = _context(grams[here], order)
            held = self.held[np.minimum(np.searchsorted(self.held, context), len(self.held) - 1)] == context
            slot = context[~held] % np.uint64(_SLOTS)
            # a context that no text had begins none that one had: the shortest that is not held decides
            out[here[~held]] = self.others[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1) > 0
            open_ = np.setdiff1d(open_, here[held], assume_unique=True)
        return out


def fit(docs: DataFrame, entries: int = _ENTRIES) -> Model:
    """Trees of all languages of docs. They hold the most frequent contexts, all that together have at most `entries` followers
    a language (fewer where there are more than 16 languages), and each language's context of order 0; `rest` has the others."""
    spark = docs.sparkSession
    known = written(contexts(docs).withColumn("everywhere", F.sum("total").over(Window.partitionBy("context"))))
    languages = sorted(r.lang for r in known.select("lang").distinct().collect())
    level = F.floor(F.log2("everywhere") * _STEPS).cast("int")
    sizes = known.groupBy(level.alias("level")).agg(F.sum(F.size("followers")).alias("size")).collect()
    left, least = min(entries * len(languages), _ALL_ENTRIES), 1 << 30
    for r in sorted(sizes, reverse=True):
        left -= r["size"]
        if left < 0:
            break
        least = r.level
    codes = spark.createDataFrame([*enumerate(languages)], "code int, lang string")
    coded = known.join(F.broadcast(codes), "lang").select(F.col("code").alias("lang"), "context", "everywhere", F.col("followers.byte").alias("byte"), F.col("followers.n").alias("n"))
    inside = (level >= least) | (F.col("context") == 0)
    table = coded.where(inside).select("lang", "context", "byte", "n").sort("lang").toArrow().combine_chunks()
    cuts = np.searchsorted(table.column("lang").to_numpy(), np.arange(len(languages) + 1))
    trees = [Tree.of(*_flat(table.slice(a, b - a))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    held = np.unique(table.column("context").to_numpy().astype(np.uint64))
    if left >= 0:
        return Model(languages, trees, held)
    rest = coded.where(~inside).select("lang", "context", "byte", "n")
    slot = F.col("context") % _SLOTS
    bits = rest.select(F.shiftright(slot, 6).alias("word"), F.lit(1).cast("long").alias("one"), (slot % 64).cast("int").alias("bit"))
    words = bits.groupBy("word").agg(F.expr("bit_or(shiftleft(one, bit))").alias("bits")).toArrow()
    others = np.zeros(_SLOTS // 64 + 1, np.uint64)
    others[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return Model(languages, trees, held, others, rest)


def _flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, their numbers of followers, and these with their counts, as `Tree.of` takes them."""
    byte, n = (table.column(x).combine_chunks() for x in ("byte", "n"))
    return table.column("context").to_numpy().astype(np.uint64), byte.value_lengths().to_numpy(), byte.flatten().to_numpy(), n.flatten().to_numpy()


class Costs:
    """Costs of grams in all languages, and whether they are unsure, each computed once while it is kept."""

    def __init__(self, model: Model) -> None:
        self.model, self.most = model, max(_CACHE // (1 + len(model.languages)), 256)
        self.forget()

    def forget(self) -> None:
        self.grams, self.costs = np.zeros(0, np.uint64), np.zeros((1 + len(self.model.languages), 0), np.int64)

    def of(self, grams: np.ndarray) -> np.ndarray:
        """A row per language and one that tells the unsure, a column per gram; grams are all different."""
        at = np.searchsorted(self.grams, grams)
        new = np.ones(len(grams), bool)
        inside = at < len(self.grams)
        new[inside] = self.grams[at[inside]] != grams[inside]
        if new.any():
            more = np.sort(grams[new])
            if len(self.grams) + len(more) > self.most:
                self.forget()
                more = np.sort(grams)
            costs = np.stack([*(t.costs(more) for t in self.model.trees), self.model.unsure(more)])
            where = np.searchsorted(self.grams, more)
            self.grams, self.costs = np.insert(self.grams, where, more), np.insert(self.costs, where, costs, axis=1)
            at = np.searchsorted(self.grams, grams)
        return self.costs[:, at]


def _lengths(costs: Costs, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code lengths of texts (a row per language); the unsure grams with their texts, in rising order, and numbers of places."""
    lengths = np.zeros((len(costs.model.languages), len(offsets) - 1), np.int64)
    grams, found = grams_of(raw, offsets), []
    for start in range(0, len(raw), costs.most):
        coded = pa.array(grams[start : start + costs.most]).dictionary_encode()
        different, codes = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        each = costs.of(different)
        ends = np.clip(offsets - start, 0, len(codes))
        some = np.flatnonzero(np.diff(ends))
        for row, sums in zip(each[:-1], lengths, strict=True):
            sums[some] += np.add.reduceat(row[codes], ends[:-1][some])
        places = np.flatnonzero(each[-1].astype(bool)[codes])
        if len(places):
            of = np.searchsorted(ends, places, side="right") - 1
            both, n = np.unique(of * len(different) + codes[places], return_counts=True)
            found.append((both // len(different), different[both % len(different)], n))
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return lengths, tuple(np.concatenate(x) for x in zip(none, *found, strict=True))


def _verdict(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and bits from code lengths, a row per language."""
    least = lengths.min(axis=0)
    return lengths.argmin(axis=0), 1 / np.exp2((least - lengths) / _UNIT).sum(axis=0), least / _UNIT


def _changes(trees: Callable[[], list[Tree]]):
    """What the contexts that tasks do not hold change in the cost of a gram in a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["lang", "gram"]):
            lang, gram = table.column("lang").to_numpy(), table.column("gram").to_numpy().astype(np.uint64)
            for code in np.unique(lang):
                mine = np.flatnonzero(lang == code)
                _, one = np.unique(table.column("context").to_numpy()[mine], return_index=True)
                tree, grams = trees()[code], np.unique(gram[mine])
                more = Tree.of(*_flat(table.take(pa.array(mine[one]))), base=tree)
                change = tree.costs(grams, more) - tree.costs(grams)
                yield pa.RecordBatch.from_arrays([pa.array(grams.astype(np.int64)), pa.array(np.full(len(grams), code, np.int32)), pa.array(change)], ["gram", "lang", "change"])

    return run


def identify(docs: DataFrame, model: Model, *carry: str) -> DataFrame:
    """The carried columns with lang_pred, score and bits (code length of the whole text in that language).

    score: share of the language if all were equally likely before, so 0.5 is a draw of two. Equal code lengths go to the
    first language by name. Texts that are null or have no letter are `und` with score 0 and no bits, and so is all if the
    model has no language. Nothing but the text is looked at.
    """
    letters = F.coalesce(docs["text"].cast("string").rlike(r"\p{L}"), F.lit(False)) if model.languages else F.lit(False)
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, rest=None))
    names = pa.array([*model.languages, UNKNOWN], pa.string())
    partial = model.rest is not None
    kept = [*carry, "_id"] if partial else [*carry]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = Costs(shared.value)
        for whole in batches:
            for part in slices(whole, "_text"):
                for batch in (part.slice(i, costs.most) for i in range(0, part.num_rows, costs.most)):
                    raw, offsets = bytes_of(batch.column("_text"))
                    some = np.diff(offsets) > 0
                    best, score, bits = np.full(batch.num_rows, len(names) - 1), np.zeros(batch.num_rows), np.full(batch.num_rows, np.nan)
                    lengths, (of, grams, n) = np.zeros((len(names) - 1, batch.num_rows), np.int64), ((),) * 3
                    if some.any():
                        lengths, (of, grams, n) = _lengths(costs, raw, offsets)
                        best[some], score[some], bits[some] = _verdict(lengths[:, some])
                    columns = [*(batch.column(c) for c in kept), names.take(pa.array(best)), pa.array(score), pa.array(bits, from_pandas=True)]
                    if partial:
                        unsure = np.bincount(of, minlength=batch.num_rows) if len(of) else np.zeros(batch.num_rows, np.int64)
                        widths = np.where(unsure > 0, len(lengths), 0)
                        columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(widths))), pa.int32()), pa.array(lengths[:, unsure > 0].T.ravel())))
                        order = np.argsort(of, kind="stable")
                        pairs = pa.StructArray.from_arrays([pa.array(np.asarray(grams, np.uint64)[order].astype(np.int64)), pa.array(np.asarray(n, np.int64)[order])], ["gram", "n"])
                        columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(unsure))), pa.int32()), pairs))
                    yield pa.RecordBatch.from_arrays(columns, [*kept, "lang_pred", "score", "bits", *(["_lengths", "_unsure"] if partial else [])])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            changed = np.flatnonzero(batch.column("_changes").is_valid())
            if len(changed):
                some = batch.take(pa.array(changed))
                lengths = some.column("_lengths").flatten().to_numpy().reshape(len(changed), -1).copy()
                items = some.column("_changes").flatten()
                of = np.repeat(np.arange(len(changed)), some.column("_changes").value_lengths())
                lengths[of, items.field("lang").to_numpy()] += items.field("change").to_numpy()
                verdict = _verdict(lengths.T)
            columns = []
            for i, name in enumerate(("lang_pred", "score", "bits")):
                old = batch.column(name)
                if len(changed):
                    new = names.take(pa.array(verdict[0])) if i == 0 else pa.array(verdict[i])
                    where = np.arange(len(old))
                    where[changed] = len(old) + np.arange(len(changed))
                    old = pa.concat_arrays([old, new.cast(old.type)]).take(pa.array(where))
                columns.append(old)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *columns], [*carry, "lang_pred", "score", "bits"])

    shown = docs.select(*carry, F.when(letters, docs["text"].cast("string")).otherwise(F.lit("")).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    result = f"{kinds}, lang_pred string, score double, bits double"
    if not partial:
        return shown.mapInArrow(judge, result)
    inner = f"{kinds}, _id long, lang_pred string, score double, bits double, _lengths array<long>, _unsure array<struct<gram:long,n:long>>"
    judged = written(shown.withColumn("_id", F.monotonically_increasing_id()).mapInArrow(judge, inner))
    unsure = judged.select("_id", F.inline("_unsure"))
    longer = F.expr(f"transform(sequence(1, cast(shiftright(gram, {_MARK}) as int) - 1), k -> shiftright(gram & (shiftleft(1L, 8 * k + 8) - 1L), 8) | shiftleft(cast(k as bigint), {_MARK}))")
    met = unsure.select("gram").distinct().select("gram", F.explode(longer).alias("context")).join(model.rest, "context").select("lang", "gram", "context", "byte", "n")
    changes = met.repartition(parts(docs), "lang", "gram").sortWithinPartitions("lang", "gram").mapInArrow(_changes(lambda: shared.value.trees), "gram long, lang int, change long")
    per_row = unsure.join(changes.where("change <> 0"), "gram").groupBy("_id", "lang").agg(F.sum(F.col("n") * F.col("change")).alias("change"))
    per_row = per_row.groupBy("_id").agg(F.collect_list(F.struct("lang", "change")).alias("_changes"))
    return judged.drop("_unsure").join(per_row, "_id", "left").mapInArrow(finish, result)


def predict(docs: DataFrame, entries: int = _ENTRIES) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits: languages learned from the rows that are not held out, for every row.

    Rows without a text or a language teach nothing; repeated rows teach each time. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(docs).alias("held_out"), "text", "lang")
    return identify(rows, fit(rows.where("not held_out"), entries), "doc_id", "held_out")


def brute_force(rows: list[tuple]) -> Callable[[str, str], float]:
    """Code lengths by definition for tests: rows are (lang, text) to learn from; returns a function of text and language."""
    from collections import Counter, defaultdict

    trees: dict[str, dict[bytes, Counter]] = defaultdict(lambda: defaultdict(Counter))
    for lang, text in rows:
        data = text.encode()
        for i, b in enumerate(data):
            for order in range(min(i, _ORDER) + 1):
                trees[lang][data[i - order : i]][b] += 1

    def bits(text: str, lang: str) -> float:
        data, tree, total = text.encode(), trees[lang], 0.0
        for i, b in enumerate(data):
            out: set[int] = set()
            for order in range(min(i, _ORDER), -1, -1):
                followers = tree.get(data[i - order : i])
                if not followers:
                    continue
                left = {k: n for k, n in followers.items() if k not in out}
                mass = sum(left.values()) + len(left)
                if b in left:
                    total -= np.log2(left[b] / mass)
                    break
                if mass:
                    total -= np.log2(len(left) / mass)
                out |= followers.keys()
            else:
                total += np.log2(256 - len(out))
        return total

    return bits
