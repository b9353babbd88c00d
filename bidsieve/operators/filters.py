"""Filters, listings and pages over notices."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import code_matches, fold, let, plain_fold
from .shared import durable


@dataclass(frozen=True)
class Filters:
    """What a listing may ask for. Unknown codes, dates, budgets, currencies and languages pass; an unknown country, place or funder doesn't."""

    all_of: list[str] = field(default_factory=list)
    any_of: list[str] = field(default_factory=list)
    none_of: list[str] = field(default_factory=list)
    countries: list[str] = field(default_factory=list)
    zones: list[str] = field(default_factory=list)
    buyers: list[str] = field(default_factory=list)
    sectors: list[str] = field(default_factory=list)
    statuses: list[str] = field(default_factory=list)
    procedures: list[str] = field(default_factory=list)
    locations: list[str] = field(default_factory=list)
    funders: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    currency: str | None = None
    cpv: list[str] = field(default_factory=list)
    published_from: str | None = None
    published_before: str | None = None
    deadline_from: str | None = None
    deadline_before: str | None = None
    budget_min: float | None = None
    budget_max: float | None = None
    published_within_days: int | None = None
    days_to_deadline: int | None = None


def resolved(wanted: Filters, today: str) -> Filters:
    """Relative dates as absolute bounds, where none are given."""
    day = dt.date.fromisoformat(today)
    changes: dict[str, str] = {}
    if wanted.published_within_days is not None and wanted.published_from is None:
        changes["published_from"] = str(day - dt.timedelta(days=wanted.published_within_days))
    if wanted.days_to_deadline is not None and wanted.deadline_from is None:
        changes["deadline_from"] = str(day + dt.timedelta(days=wanted.days_to_deadline))
    return replace(wanted, **changes)


def _holds(value: Column, terms: list[str]) -> Column:
    """Whether a folded value holds any of some terms."""
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(value, F.lit(plain_fold(term)))
    return found


def _text_rule(column: str, wanted: list[list[str]], unwanted: list[str]) -> Column:
    """All rules on a text column, which is folded once: a term of each list of `wanted`, none of `unwanted`."""

    def rule(value: Column) -> Column:
        whole = F.lit(True)
        for terms in wanted:
            whole = whole & _holds(value, terms)
        return whole & ~_holds(value, unwanted) if unwanted else whole

    return let(fold(F.col(column)), rule)


def matches(wanted: Filters, text: str = "title") -> Column:
    """One predicate for all criteria asked for; plain comparisons reach the scan."""
    rules: list[Column] = []
    if wanted.all_of or wanted.any_of or wanted.none_of:
        rules.append(_text_rule(text, [*([t] for t in wanted.all_of), *([wanted.any_of] if wanted.any_of else [])], wanted.none_of))
    rules += [_text_rule(c, [terms], []) for c, terms in (("country", wanted.countries), ("buyer", wanted.buyers), ("sector", wanted.sectors), ("location", wanted.locations), ("funder", wanted.funders), ("category", wanted.categories)) if terms]
    rules += [F.col(c).isin(*members) for c, members in (("zone", wanted.zones), ("status", wanted.statuses), ("procedure", wanted.procedures), ("source", wanted.sources)) if members]
    rules += [F.col("language").isNull() | F.lower("language").isin(*(x.lower() for x in wanted.languages))] if wanted.languages else []
    rules += [F.col("currency").isNull() | (F.upper("currency") == wanted.currency.upper())] if wanted.currency else []
    if wanted.cpv:
        known = F.lit(False)
        for prefix in wanted.cpv:
            known = known | code_matches(F.col("cpv_codes"), prefix)
        rules.append(F.col("cpv_codes").isNull() | known)
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    for column, low, high in (("publication", wanted.published_from, wanted.published_before), ("deadline", wanted.deadline_from, wanted.deadline_before)):
        rules += [F.col(column).isNull() | (F.col(column) >= at(low))] if low else []
        rules += [F.col(column).isNull() | (F.col(column) < at(high))] if high else []
    rules += [F.col("budget").isNull() | (F.col("budget") >= wanted.budget_min)] if wanted.budget_min is not None else []
    rules += [F.col("budget").isNull() | (F.col("budget") <= wanted.budget_max)] if wanted.budget_max is not None else []
    whole = F.lit(True)
    for rule in rules:
        whole = whole & rule
    return whole


def validated(saved: DataFrame) -> DataFrame:
    """Saved requests with the first bad range as `reason` and comma lists as arrays."""
    reason = F.coalesce(F.when(F.col("published_from") > F.col("published_to"), "published_range"), F.when(F.col("budget_min") > F.col("budget_max"), "budget_range"))
    places = F.filter(F.transform(F.split("places", ","), lambda x: F.trim(x)), lambda x: x != "")
    return saved.withColumn("reason", reason).withColumn("places", places)


def without_criteria(rows: DataFrame, column: str, excluded: list[str]) -> DataFrame:
    return rows.where(~F.arrays_overlap(column, F.array(*map(F.lit, excluded))))


def expanded_zones(wanted: DataFrame, places: DataFrame) -> DataFrame:
    """Names of countries or zones to countries; unknown names are reported."""
    table = places.select(fold(F.col("zone")).alias("_name"), "country").unionByName(places.select(fold(F.col("country")).alias("_name"), "country")).distinct()
    return wanted.join(table, fold(F.col("wanted")) == F.col("_name"), "left").select("wanted", "country", F.col("_name").isNotNull().alias("known"))


def sorted_by(rows: DataFrame, by: str, ties: list[str], allowed: set[str] | None = None) -> DataFrame:
    """Order by a named column, - for descending, nulls last either way; a name that isn't allowed is an error."""
    name = by.removeprefix("-")
    if name not in (allowed or set(rows.columns)):
        raise ValueError(f"cannot sort by {name}")
    return rows.orderBy(*(F.desc_nulls_last(c[1:]) if c[0] == "-" else F.asc_nulls_last(c) for c in (by, *ties)))


def listed(rows: DataFrame, now: Column, text: str = "", only_open: bool = True, least: float | None = None, among: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows of a list with their number as `total`: in scope, with `text` in title, buyer or reference whatever the case (% and
    _ stand for anything), of the given values where there are any, not below a score. Open here means a deadline that is not
    over, or none, and neither cancelled nor awarded. The rows are kept once for list and total."""
    chosen = rows.where(F.col("band") != "out_of_scope")
    if text.strip():
        pattern = f"%{text.strip()}%"
        chosen = chosen.where(F.col("title").ilike(pattern) | F.col("buyer").ilike(pattern) | F.col("reference").ilike(pattern))
    for column, values in (among or {}).items():
        chosen = chosen.where(F.col(column).isin(*values)) if values else chosen
    if least is not None:
        chosen = chosen.where(F.col("score") >= least)
    if only_open:
        chosen = chosen.where((F.col("deadline").isNull() | (F.col("deadline") >= now)) & ~F.col("status").isin("cancelled", "awarded"))
    chosen = durable(chosen)
    return chosen.join(F.broadcast(chosen.agg(F.count("*").alias("total"))))


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """A page of ordered rows; numbers start at 1, sizes end at 200."""
    size = min(max(size, 1), 200)
    return rows.offset((max(number, 1) - 1) * size).limit(size)


def totals(rows: DataFrame, size: int) -> DataFrame:
    return rows.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))


def suggestions(rows: DataFrame, column: str, position: str, typed: str, chosen: list[str], most: int = 8) -> DataFrame:
    """Entries that start with what is typed before those that only hold it, without those chosen already."""
    value, needle = fold(F.col(column)), F.lit(plain_fold(typed))
    return rows.where(~F.col(column).isin(*chosen) & F.contains(value, needle)).orderBy(F.desc(F.startswith(value, needle)), position).limit(most)


def union_of_searches(rows: DataFrame, text: str, terms: list[str], row_id: str) -> DataFrame:
    """What one search per term finds, each row once; the same as one search for any of the terms."""
    found = None
    for term in terms:
        part = rows.where(_holds(fold(F.col(text)), [term]))
        found = part if found is None else found.unionByName(part)
    return found.dropDuplicates([row_id])
