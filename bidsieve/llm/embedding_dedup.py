"""Embedding near-dedup by a pivot-permutation index.

Each vector is described by its nearest reference points (pivots), nearest first, and stands in the inverted list of each of
them. A list is kept in shards, one for each further pivot of its vectors, so that a shard holds only vectors that share two
pivots; a vector of `nearest` pivots is thus shipped once for each pair of them and a shard stays short however many vectors
there are. Inside a shard the lists are merged: each shared pivot adds to a pair's count what it weighs in the worse of its two
places in the permutations, which is the footrule distance of the permutations turned round. Pairs that reach the count are
candidates, and for those alone the cosine (in double precision) is taken. The shard of a pair's two smallest shared pivots
reports it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components, local_roots
from .common import durable, parts, whole_groups

_KEYED = "pair long, rep long, n long, pivots binary, vector binary"
_JOINED = "a long, b long, links long"
#: Pivots of one length of vector: their first number among all pivots, and their unit vectors.
Points = dict[int, tuple[int, np.ndarray]]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _listed(points: Broadcast, nearest: int):
    """A row for each pair of a vector's nearest pivots: its place in a shard of an inverted list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(len(x) for _, x in points.value.values())
        for batch in (b.slice(i, 4096) for b in batches for i in range(0, b.num_rows, 4096)):
            dims = batch.column("vector").value_lengths().to_numpy()
            for dim in np.unique(dims).tolist():
                base, pivots = points.value[dim]
                near = min(nearest, len(pivots))
                some = batch.take(pa.array(np.flatnonzero(dims == dim)))
                x = _matrix(some.column("vector"), dim)
                order = np.argsort(-(_unit(x) @ pivots.T), axis=1, kind="stable")[:, :near] + base
                found = np.sort(order, axis=1).astype(np.int64)
                signature = [r.tobytes() for r in order.astype(np.int32)]
                blob = [r.tobytes() for r in x]
                # where all pivots are near, all vectors meet in one shard
                for i, j in combinations(range(near), 2) if near < len(pivots) else [(0, min(1, near - 1))]:
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, i] * total + found[:, j]), some.column("rep"), some.column("n"), pa.array(signature, pa.binary()), pa.array(blob, pa.binary())], ["pair", "rep", "n", "pivots", "vector"])

    return run


def candidates(s: np.ndarray, first: int, last: int, shared: int, drift: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a row from `first` to `last` and a later row that the merged inverted lists bring together.

    s: pivots of each row, nearest first. A pivot in places i and j of two rows adds `near` - max(i, j); over all shared pivots
    that is half of what the footrule distance (absent pivots in place `near`) lacks to its most, near * (near + 1).
    """
    n, near = s.shape
    weight, count = np.zeros((last - first, n), np.int16), np.zeros((last - first, n), np.int8)
    names, local = np.unique(s, return_inverse=True)
    local = local.reshape(s.shape)
    order = np.argsort(local, axis=None, kind="stable")
    ends = np.searchsorted(local.ravel()[order], np.arange(len(names) + 1))
    for i in range(len(names)):
        at = order[ends[i] : ends[i + 1]]
        row, place = at // near, (at % near).astype(np.int16)
        mine = (row >= first) & (row < last)
        if len(row) < 2 or not mine.any():
            continue
        spot = np.ix_(row[mine] - first, row)
        weight[spot] += near - np.maximum.outer(place[mine], place)
        count[spot] += 1
    a, b = np.nonzero((count >= min(shared, near)) & (2 * weight >= near * (near + 1) * (1 - drift)))
    ahead = a + first < b
    return a[ahead] + first, b[ahead]


def _cosines(v: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosine of each pair; pairs of a few rows with most others come out of one product."""
    if not len(left):
        return np.zeros(0)
    low, high = left.min(), left.max() + 1
    if 16 * len(left) > (high - low) * len(v):
        return (v[low:high] @ v.T)[left - low, right]
    return np.concatenate([np.einsum("ij,ij->i", v[left[i : i + 16384]], v[right[i : i + 16384]]) for i in range(0, len(left), 16384)])


def _reports(s: np.ndarray, left: np.ndarray, right: np.ndarray, total: int, pair: int) -> np.ndarray:
    """Which pairs this shard reports: those whose two smallest shared pivots (the only one, where there is one) it is kept under."""
    out = np.zeros(len(left), bool)
    for i in range(0, len(left), 65536):
        p, q = s[left[i : i + 65536]], s[right[i : i + 65536]]
        least = np.sort(np.where((p[:, :, None] == q[:, None, :]).any(2), p, total), axis=1)
        out[i : i + 65536] = least[:, 0] * total + least[:, min(1, least.shape[1] - 1)] == pair
    return out


def _verified(total: int, least: float, kind: type, shared: int, drift: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["pair", "b1", "b2"], 4096):
            pair, b1, b2, block, rep, n = (table.column(x).to_numpy() for x in ("pair", "b1", "b2", "block", "rep", "n"))
            vectors, pivots = table.column("vector").to_pylist(), table.column("pivots").to_pylist()
            edge = np.flatnonzero(np.concatenate(([True], (np.diff(pair) != 0) | (np.diff(b1) != 0) | (np.diff(b2) != 0), [True])))
            for start, end in zip(edge[:-1], edge[1:], strict=True):
                if end - start < 2:
                    continue
                v = _unit(np.frombuffer(b"".join(vectors[start:end]), kind).reshape(end - start, -1))
                s = np.frombuffer(b"".join(pivots[start:end]), np.int32).reshape(end - start, -1).astype(np.int64)
                mine = block[start:end]
                found = []
                for i in range(0, len(v), 512):
                    left, right = candidates(s, i, min(i + 512, len(v)), shared, drift)
                    ok = (mine[left] != mine[right]) | (b1[start] == b2[start])  # pairs inside a block are another task's
                    left, right = left[ok], right[ok]
                    near = _cosines(v, left, right) >= least
                    left, right = left[near], right[near]
                    good = _reports(s, left, right, total, pair[start])
                    found.append((left[good].astype(np.int32), right[good].astype(np.int32)))
                left, right = (np.concatenate(x) for x in zip(*found, strict=True))
                if not len(left):
                    continue
                links = np.zeros(end - start, np.int64)
                np.add.at(links, left, n[start:end][right])
                np.add.at(links, right, n[start:end][left])
                root = local_roots(end - start, left, right)
                use = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(rep[start:end][use]), pa.array(rep[start:end][root[use]]), pa.array(links[use])], ["a", "b", "links"])

    return run


def pivot_count(vectors: int, pivots: int = 128, per: int = 65_536, most: int = 16_384) -> int:
    """Pivots grow with the root of the number of vectors, which keeps the shards at a constant length, up to `most`, which bounds what is broadcast."""
    return min(pivots * max(1, math.ceil(math.sqrt(vectors / per))), max(pivots, most))


def apart(x: np.ndarray, count: int, least: float, enough: int = 128) -> np.ndarray:
    """Up to `count` of the unit vectors, each the one farthest from those before it.

    They lie more than twice the angle of a link apart, so that vectors around a common centre, each within a link of it, give one
    pivot, whatever their share of the rows. Where fewer than `enough` lie so (all vectors point much the same way), more are
    taken as long as they are no link of those before.
    """
    wide = 2 * least * least - 1 if least > 0 else -1.0
    near = np.full(len(x), -np.inf)
    chosen = [0]
    while len(chosen) < min(count, len(x)):
        np.maximum(near, x @ x[chosen[-1]], out=near)
        far = int(near.argmin())
        if near[far] >= (wide if len(chosen) >= enough else least):
            break
        chosen.append(far)
    return x[chosen]


def _pivots(reps: DataFrame, dim: int, count: int, least: float, draw: int = 8, held: int = 128 << 20) -> np.ndarray:
    """Up to `count` pivots of the first `draw` times as many vectors in the order of their id's hash; `held` bytes at most are drawn."""
    some = max(1, min(draw * count, held // (8 * dim)))
    column = reps.orderBy(F.xxhash64("rep"), "rep").select("vector").limit(some).toArrow().column("vector").combine_chunks()
    return apart(_unit(_matrix(column, dim)), count, least)


def near_duplicates(vectors: DataFrame, least: float = 0.95, pivots: int = 128, nearest: int = 7, shared: int = 2, drift: float = 0.8, block: int = 2048, sent: int = 128 << 20) -> DataFrame:
    """Links between vectors of cosine `least` and above, and the components that they form.

    vectors: vec_id long, embedding array<float or double>; other columns are ignored, whatever their names. Returns one
    row per input row: vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable), kept.
    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; so does a row with a null
    vec_id (component and kept null). Vectors of different lengths have no cosine; those of each length are compared with
    each other (the driver fits pivots for one length after the other). Equal vectors are compared once and counted as
    often as they occur, rows of one vec_id included. An empty table gives an empty result.

    The index is fitted on `pivots` vectors (more beyond 65,536 different vectors, with the root of their number, 16,384 at
    most; together `sent` bytes at most go to the executors, 8 a length if need be), taken far from each other (`apart`) among eight
    times as many that the hash of their id chooses, and holds all vectors. Shards over `block` vectors are cut into blocks that meet
    pairwise, so no task holds more than two blocks. Retrieval is approximate: links whose vectors share fewer than `shared` (2 at
    least) of `nearest` pivots, or whose permutations lie more than `drift` of the greatest footrule distance apart, are missed;
    the tests hold recall to 0.9 at least, and measured values are in the README.
    """
    kind = np.float32 if "float" in vectors.schema["embedding"].dataType.simpleString() else np.float64
    e = F.col("embedding")
    base = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].alias("embedding"))
    sound = F.col("vec_id").isNotNull() & F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    marked = base.select("vec_id", F.when(sound, e).alias("vector"))
    keyed = marked.select("vec_id", "vector", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")).alias("h1"), F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(1), "vector")).alias("h2"))
    reps = durable(keyed.where("vector is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.any_value("vector").alias("vector")))
    points: Points = {}
    total = 0
    lengths = reps.groupBy(F.size("vector").alias("dim")).count().orderBy("dim").collect()
    for r in lengths:
        most = max(8, sent // (8 * r.dim * len(lengths)))
        found = _pivots(reps.where(F.size("vector") == r.dim), r.dim, min(most, pivot_count(r["count"], pivots)), least)
        points[r.dim] = total, found
        total += len(found)
    lists = reps.select("rep", "n", "vector").mapInArrow(_listed(vectors.sparkSession.sparkContext.broadcast(points), nearest), _KEYED)
    long_lists = lists.groupBy("pair").count().select("pair", F.ceil(F.col("count") / block).cast("int").alias("blocks")).where("blocks > 1")
    blocks = F.coalesce("blocks", F.lit(1))
    spread = lists.join(long_lists, "pair", "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = spread.select("pair", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "rep", "n", "pivots", "vector")
    joined = durable(tasks.repartition(parts(vectors), "pair", "b1", "b2").sortWithinPartitions("pair", "b1", "b2").mapInArrow(_verified(total, least, kind, shared, drift), _JOINED))
    links = joined.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    found = components(joined.select("a", "b")).select(F.col("node").alias("rep"), "component")
    named = reps.select("h1", "h2", "rep", "n").join(links, "rep", "left").join(found, "rep", "left").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    return keyed.join(named, ["h1", "h2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.when(F.col("vec_id").isNotNull(), F.col("vec_id") == F.col("component_id")))


def brute_force(rows: list[tuple[int, list[float] | None]], least: float = 0.95) -> list[tuple[int, int, int, bool]]:
    """The definition, for tests."""
    n = len(rows)
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, ends = np.zeros(n, int), [np.zeros((2, 0), int)]
    for dim in {len(rows[i][1]) for i in good}:
        at = np.array([i for i in good if len(rows[i][1]) == dim])
        x = _unit(np.array([rows[i][1] for i in at], float))
        a, b = np.nonzero(np.triu(x @ x.T >= least, 1))
        np.add.at(links, at[a], 1)
        np.add.at(links, at[b], 1)
        ends.append(np.array([at[a], at[b]]))
    root = local_roots(n, *np.concatenate(ends, axis=1))
    ids = np.array([r[0] for r in rows])
    smallest = {r: min(ids[root == r]) for r in set(root.tolist())}
    return [(int(ids[i]), int(links[i]), int(smallest[root[i]]), bool(ids[i] == smallest[root[i]])) for i in range(n)]
