"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows are shuffled by a seeded hash and ranked within their source; the rank becomes a fraction of the source's size; all
rows are put in order of that fraction and cut into equal counts. Any stretch of the order holds every source in proportion,
so each shard matches the mixture.

Both ranks are global row numbers without a global sort: rows fall into ranges of the (uniform) order key, a small table of
counts per range gives each range's offset, and only rows of one range meet in a window. A source with a third of all rows
spreads over as many ranges as its size asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Rows of a range, about; ranges per source and of the whole order follow from the counts.
_RANGE = 4096


def _numbered(rows: DataFrame, key: list[str], counts: DataFrame, spot: str, order: list[Column], name: str) -> DataFrame:
    """Number rows from 0 in order of (`spot`, order) within `key`: offset of the range plus the place in it."""
    before = Window.partitionBy(*key).orderBy(spot).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*key, spot, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*key, spot).orderBy(*order)) - 1
    return rows.join(offsets, [*key, spot]).withColumn(name, F.col("before") + inside).drop("before")


def shard(docs: DataFrame, shards: int = 40, seed: str = "shard-1") -> DataFrame:
    """Deal all rows into shards 0 to `shards` - 1 whose counts differ by one at most and whose sources are in proportion.

    docs: doc_id long, text string, source string; other columns are ignored, whatever their names. Returns one row per
    input row: doc_id, source, size (UTF-8 bytes of the text and 16; a null text has none), text_crc32 (0 for a null text,
    as for an empty one), law ("rows"), shard, slot (gapless from 0 in the shard), grown_shard (null: this law has none).
    A null source is a source of its own; the order hashes id and text, so rows without an id, or of one id, spread like
    others; repeated rows are dealt each, ties of the hash broken by doc_id and text; an empty table gives an empty result.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    doc_id = docs["doc_id"].cast("long")
    # without Python or the text: what follows moves rows of about 60 bytes
    slim = durable(docs.select(doc_id.alias("doc_id"), F.coalesce(F.concat(F.lit("s"), docs["source"].cast("string")), F.lit("")).alias("stratum"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(F.lit(seed), doc_id, text).alias("h")))
    total = slim.count()
    fine = max(1, -(-total // _RANGE))
    sizes = slim.groupBy("stratum").agg(F.count("*").alias("of"))
    #: a range of the hash, with as many as the source's size asks for
    unit = F.col("h").cast("double") / F.lit(2.0**64) + 0.5
    # concat_ws hides the join's partitioning, so that a hot source is dealt anew by its ranges
    ranged = slim.join(sizes, "stratum").withColumn("stratum", F.concat_ws("", "stratum")).withColumn("spot", F.least(F.floor(unit * F.ceil(F.col("of") / _RANGE)), F.ceil(F.col("of") / _RANGE) - 1).cast("long"))
    counts = ranged.groupBy("stratum", "spot").agg(F.count("*").alias("n"))
    ties = [F.col("h"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    ranked = _numbered(ranged, ["stratum"], counts, "spot", ties, "rank").drop("spot")
    placed = durable(ranked.withColumn("fraction", (F.col("rank") * 2 + 1) / (F.col("of") * 2)).withColumn("spot", F.least(F.floor(F.col("fraction") * fine), F.lit(fine - 1)).cast("long")).withColumn("zone", (F.col("spot") / 1024).cast("long")))
    per = placed.groupBy("zone", "spot").agg(F.count("*").alias("n"))
    zones = per.groupBy("zone").agg(F.sum("n").alias("n"))
    #: zones of 1024 ranges: the one list that meets in one task has a row per four million rows
    zone_before = zones.select("zone", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("zone").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("zone_before"))
    numbered = _numbered(placed, ["zone"], per, "spot", [F.col("fraction"), F.col("stratum"), *ties], "place").join(zone_before, "zone")
    place = F.col("place") + F.col("zone_before")
    shard_of = F.expr(f"(_place * {shards}) div {max(1, total)}")
    first = F.expr(f"(_shard * {total} + {shards - 1}) div {shards}")
    return (
        numbered.withColumn("_place", place)
        .withColumn("_shard", shard_of)
        .select("doc_id", F.expr("substring(stratum, 2)").alias("source"), "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").cast("int").alias("shard"), (F.col("_place") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def brute_force(rows: list[tuple[int, str | None, str | None]], hashes: list[int], shards: int = 40) -> list[tuple]:
    """The definition, for tests. rows: doc_id, text, source; hashes: the seeded hash of each row."""
    import zlib

    data = [((t or "").encode(), d, "" if s is None else "s" + s, h) for (d, t, s), h in zip(rows, hashes, strict=True)]
    by: dict[str, list] = {}
    for x in data:
        by.setdefault(x[2], []).append(x)
    order = []
    for s, xs in by.items():
        xs.sort(key=lambda x: (x[3], x[1], zlib.crc32(x[0]), len(x[0])))
        order += [((2 * i + 1) / (2 * len(xs)), s, x[3], x[1], zlib.crc32(x[0]), len(x[0]) + 16) for i, x in enumerate(xs)]
    order.sort()
    n = len(order)
    return [(d, size, crc, "rows", (sh := i * shards // n), i - -(-sh * n // shards), None) for i, (_, _, _, d, crc, size) in enumerate(order)]
