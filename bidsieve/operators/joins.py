"""Lookups as set-based joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import durable


def reverse_lookup(rows: DataFrame, column: str, known: DataFrame, label: str) -> DataFrame:
    """Portal codes to canonical labels by a table of code and `label`, letter case aside; unknown codes stay as they are."""
    table = known.select(F.lower("code").alias("_code"), F.col(label).alias("_label"))
    return rows.join(table, F.lower(column) == F.col("_code"), "left").withColumn(label, F.coalesce("_label", column)).drop("_code", "_label")


def match_by_keys(incoming: DataFrame, stored: DataFrame, keys: list[str], incoming_id: str, stored_id: str) -> DataFrame:
    """Pairs with equal, non-null keys: incoming id and the smallest stored id."""
    table = stored.dropna(subset=keys).groupBy(*keys).agg(F.min(stored_id).alias("canonical_id"))
    return incoming.join(table, keys).select(incoming_id, "canonical_id")


def match_by_hash(incoming: DataFrame, stored: DataFrame, incoming_id: str, stored_id: str) -> DataFrame:
    """Matches by raw_sha256 or text_sha256 as two equi-joins; the raw hash is named where both hold."""
    found = None
    for rank, key in enumerate(("raw_sha256", "text_sha256")):
        part = match_by_keys(incoming, stored, [key], incoming_id, stored_id).select(incoming_id, F.struct(F.lit(rank).alias("rank"), "canonical_id").alias("m"))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy(incoming_id).agg(F.min("m").alias("m"))
    return best.select(incoming_id, "m.canonical_id", F.when(F.col("m.rank") == 0, "raw_sha256").otherwise("text_sha256").alias("matched_on"))


def ranked_lists(entries: DataFrame, asks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places of entries and of asked spans of time in lists ordered by time.

    entries: list, at, id and more; adds rank, from 0 for the oldest (of equal times the largest id is the oldest). asks: list,
    since, until, id and more; adds low and high: the entries within the span have the ranks from low up to, but not with, high.
    Ranks are counted day by day and the days of a list added up, so no task sorts more than a list's day. Times are microseconds.
    """
    day = F.floor(F.col("at") / 86_400_000_000)
    rows = entries.select("list", "at", "id", F.lit(1).alias("kind"))
    rows = rows.unionByName(asks.select("list", F.col("since").alias("at"), "id", F.lit(0).alias("kind"))).unionByName(asks.select("list", F.col("until").alias("at"), "id", F.lit(2).alias("kind")))
    rows = rows.withColumn("day", day)
    stored = F.sum((F.col("kind") == 1).cast("long"))
    before = stored.over(Window.partitionBy("list", "day").orderBy("at", "kind", F.desc("id")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    days = rows.groupBy("list", "day").agg(stored.alias("_n"))
    days = days.select("list", "day", F.coalesce(F.sum("_n").over(Window.partitionBy("list").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    placed = rows.withColumn("_before", before).join(days, ["list", "day"]).select("list", "id", "kind", (F.col("_before") + F.col("_offset")).alias("place"))
    ranks = placed.where("kind = 1").select("list", "id", (F.col("place") - 1).alias("rank"))
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("place")))
    spans = placed.where("kind <> 1").groupBy("list", "id").agg(pick(0).alias("low"), pick(2).alias("high"))
    return entries.join(ranks, ["list", "id"]), asks.join(spans, ["list", "id"])


def newest_in_lists(entries: DataFrame, asks: DataFrame, fits: Column, most: int, depth: int = 256) -> DataFrame:
    """A top-k range join: per asking row the `most` newest entries that fit, over all lists that it asks.

    entries: list, id, at and what `fits` needs; asks: list, id, since, until and what it needs, under the names ask_*. An
    entry is in one of the lists that a row asks at most. Lists are visited from the newest entry in the span on, `depth`
    entries at first and twice as many each time, in blocks of equal ranks. A row is done when its last place is newer than all
    that it hasn't visited, so its work follows `most` and not the length of the lists. Returns ask_id, id, at and position.
    """
    block = 128
    rows, spans = ranked_lists(entries, asks.withColumnsRenamed({"ask_id": "id", "ask_since": "since", "ask_until": "until"}))
    rows = durable(rows.withColumn("block", F.expr(f"rank div {block}")))
    spans = durable(spans.where("low < high").withColumnRenamed("id", "ask_id").drop("since", "until"))
    newest = Window.partitionBy("ask_id").orderBy(F.desc("at"), "id")

    def best(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= most)

    found = None
    while True:
        spans = spans.withColumn("from", F.greatest("low", F.col("high") - depth))
        visits = spans.withColumn("block", F.explode(F.expr(f"sequence(from div {block}, (high - 1) div {block})")))
        visited = visits.join(rows, ["list", "block"]).where("rank >= from and rank < high").select("list", "ask_id", "id", "at", "rank", "from", fits.alias("fits"))
        more = spans.where("from > low")
        left = not more.isEmpty()
        if left:
            visited = durable(visited.where("fits or rank = from"))
        pairs = visited.where("fits").select("ask_id", "id", "at")
        found = best(pairs if found is None else found.drop("position").unionByName(pairs))
        if not left:
            return found
        found = durable(found)
        full = found.where(F.col("position") == most).select("ask_id", F.col("at").alias("_last"))
        reached = visited.where("rank = from").select("ask_id", "list", F.col("at").alias("_reached"))
        more = more.join(reached, ["ask_id", "list"]).join(full, "ask_id", "left").where("_last is null or _last <= _reached")
        spans, depth = durable(more.withColumn("high", F.col("from")).drop("from", "_last", "_reached")), depth * 2
        if spans.isEmpty():
            return found


def candidate_window(incoming: DataFrame, stored: DataFrame, days: int = 120, slack: int = 3, most: int = 200, depth: int = 256) -> DataFrame:
    """Stored notices that may be the same as an incoming one: see candidates.candidate_window."""
    from . import candidates  # which builds on this module

    return candidates.candidate_window(incoming, stored, days, slack, most, depth)


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds, or null."""
    return F.coalesce(*(F.when(rule, F.lit(name)) for name, rule in rules), F.lit(None).cast("string"))


def latest(rows: DataFrame, keys: list[str], order: list[str], most: int = 1) -> DataFrame:
    """The newest rows per key; `order` is descending and ends in an id."""
    newest = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= most)


def nest(parents: DataFrame, children: DataFrame, key: str, name: str, columns: list[str]) -> DataFrame:
    """Children as a sorted array of structs on their parent; parents without any get an empty array."""
    lists = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def owned_or_shared(rows: DataFrame, owner: str, callers: DataFrame) -> DataFrame:
    """Rows without an owner, and those whose owner is among the callers."""
    return rows.where(F.col(owner).isNull()).unionByName(rows.where(F.col(owner).isNotNull()).join(callers.select(F.col("caller").alias(owner)).distinct(), owner, "left_semi").select(rows.columns))


def win_history(rows: DataFrame, submissions: DataFrame) -> DataFrame:
    """Wins and decided bids with the same buyer, or else in the same sector; pending bids don't count."""
    decided = submissions.where(F.col("outcome").isin("won", "lost"))

    def counts(key: str) -> DataFrame:
        return decided.groupBy(key).agg(F.struct(F.count_if(F.col("outcome") == "won").alias("wins"), F.count("*").alias("decided")).alias(f"by_{key}"))

    best = F.coalesce("by_buyer", "by_sector")
    return rows.join(counts("buyer"), "buyer", "left").join(counts("sector"), "sector", "left").withColumns({"wins": best["wins"], "decided": best["decided"]}).drop("by_buyer", "by_sector")


def convert(rows: DataFrame, amount: str, currency: str, rates: DataFrame, name: str = "converted") -> DataFrame:
    """Amount times its currency's rate; 1 for a currency without one."""
    table = rates.select(F.upper("currency").alias("_currency"), F.col("rate").alias("_rate"))
    return rows.join(table, F.upper(currency) == F.col("_currency"), "left").withColumn(name, F.col(amount) * F.coalesce("_rate", F.lit(1.0))).drop("_currency", "_rate")


def _united(old: str, new: str) -> Column:
    """Both maps in one; the new one wins."""
    only_old = F.map_filter(F.coalesce(old, new), lambda k, v: ~F.map_contains_key(F.col(new), k))
    return F.when(F.col(new).isNull(), F.col(old)).otherwise(F.map_concat(only_old, F.col(new)))


def merge_detail(stored: DataFrame, detail: DataFrame, key: str, longer: list[str], fill: list[str], enums: list[str] = (), maps: list[str] = ()) -> DataFrame:
    """Additive merge: `longer` texts win by length, `fill` only fills what is empty, `enums` only what is unknown, maps are united (detail wins)."""
    new = detail.select(key, *(F.col(c).alias(f"_{c}") for c in (*longer, *fill, *enums, *maps)))
    merged = stored.join(new, key, "left")
    changes = {c: F.when(F.coalesce(F.length(f"_{c}"), F.lit(0)) > F.coalesce(F.length(c), F.lit(0)), F.col(f"_{c}")).otherwise(F.col(c)) for c in longer}
    changes |= {c: F.coalesce(c, f"_{c}") for c in fill}
    changes |= {c: F.when((F.col(c) == "unknown") & F.col(f"_{c}").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in enums}
    changes |= {c: _united(c, f"_{c}") for c in maps}
    return merged.withColumns(changes).drop(*(f"_{c}" for c in (*longer, *fill, *enums, *maps)))


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row per key: the new values where given, else the stored ones."""
    old = stored.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in stored.columns if c != key))
    both = old.join(new, F.col("_key") == F.col(key), "full_outer")
    return both.select(F.coalesce(key, "_key").alias(key), *(F.coalesce(c, f"_{c}").alias(c) if c in new.columns else F.col(f"_{c}").alias(c) for c in stored.columns if c != key))


def registry_sync(stored: DataFrame, registry: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """Descriptors follow the registry, counters in `kept` stay, sources that the registry lacks are disabled."""
    old = stored.select(F.col(key).alias("_key"), F.col("label").alias("_label"), *kept)
    both = old.join(registry.select(key, "label"), F.col("_key") == F.col(key), "full_outer")
    return both.select(F.coalesce(key, "_key").alias(key), F.coalesce("label", "_label").alias("label"), *(F.coalesce(c, F.lit(0)).alias(c) for c in kept), F.col(key).isNotNull().alias("enabled"))


def cached_profiles(sources: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    """Whether each source's cached profile can be used again: status ok and the same source hash."""
    table = profiles.select(F.col(key).alias("_key"), F.col("source_hash").alias("_hash"), "status")
    hit = (F.col("status") == "ok") & (F.col("_hash") == F.col("source_hash"))
    return sources.join(table, F.col(key) == F.col("_key"), "left").withColumn("hit", F.coalesce(hit, F.lit(False))).drop("_key", "_hash", "status")


def blocked_pairs(rows: DataFrame, others: DataFrame, most: int, salts: int = 64) -> DataFrame:
    """Every row beside every other, for a stated set of others (queries, users), which is counted.

    Up to `most` of them are broadcast. More are cut into blocks of about as many, and the rows, dealt over `salts`, meet each
    block; no task holds more than a block.
    """
    n = others.count()
    if n <= most:
        return rows.join(F.broadcast(others))
    blocks = -(-n // most)
    dealt = others.withColumn("_block", F.pmod(F.xxhash64(*others.columns), F.lit(blocks))).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts))).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return spread.join(dealt, ["_block", "_salt"]).drop("_block", "_salt")
