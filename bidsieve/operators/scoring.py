"""Relevance of notices: registered criteria, each a column, combined by weight."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, fold, let, plain_fold, whole_word
from .similarity import cosines_to


def days_until(deadline: str, now: Column) -> Column:
    """Days to a deadline with their fraction; null for an unknown one."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(F.col(deadline)) - micros(now)) / 86_400_000_000


def clamp(x: Column) -> Column:
    return let(x, lambda v: F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))))


def text_blob(*columns: str, full_text: str | None = None) -> Column:
    """Folded text that criteria search: short fields and 60,000 characters of the full text."""
    parts = [F.col(c) for c in columns] + ([F.substring(full_text, 1, 60_000)] if full_text else [])
    return fold(F.concat_ws(" ", *parts))


def deadline_score(days: Column, viable: float = 5, ideal_min: float = 12, ideal_max: float = 45, horizon: float = 180, expired: float = 0.0, unknown: float = 0.35) -> Column:
    """Rises from nothing over a tight stretch to 1, stays, and falls for what is far off. The defaults are fixed values."""
    return clamp(
        F.when(days.isNull(), unknown)
        .when(days < 0, expired)
        .when(days < viable, 0.15 * days / viable)
        .when(days < ideal_min, 0.15 + 0.85 * (days - viable) / (ideal_min - viable))
        .when(days <= ideal_max, 1.0)
        .when(days <= horizon, 1.0 - 0.7 * (days - ideal_max) / (horizon - ideal_max))
        .otherwise(0.2)
    )


def budget_score(amount: Column, small: float = 50_000, ideal_min: float = 250_000, ideal_max: float = 5_000_000, large: float = 25_000_000, unknown: float = 0.5) -> Column:
    """Preference over amounts in the profile's currency. The defaults are fixed values."""
    return clamp(
        F.when(amount.isNull(), unknown)
        .when(amount < small, 0.1 * amount / small)
        .when(amount < ideal_min, 0.1 + 0.9 * (amount - small) / (ideal_min - small))
        .when(amount <= ideal_max, 1.0)
        .when(amount <= large, 1.0 - 0.5 * (amount - ideal_max) / (large - ideal_max))
        .otherwise(0.35)
    )


def lookup_score(value: Column, preferred: dict[str, float], default: float, unknown: float) -> Column:
    """Highest preference whose folded name is part of the folded value, or holds it."""
    names = [(n, float(w)) for k, w in preferred.items() if (n := plain_fold(k))]
    best = lambda folded: F.greatest(F.lit(None).cast("double"), F.lit(None).cast("double"), *(F.when(F.contains(folded, F.lit(n)) | F.contains(F.lit(n), folded), F.lit(w)) for n, w in names))
    return F.when(F.coalesce(value, F.lit("")) == "", unknown).otherwise(clamp(F.coalesce(let(fold(value), best), F.lit(default))))


def keyword_hits(blob: Column, include: dict[str, float]) -> Column:
    """Array of keyword and weight for those that occur."""
    return F.array_compact(F.array(*(F.when(whole_word(blob, k), F.struct(F.lit(k).alias("keyword"), F.lit(float(w)).alias("weight"))) for k, w in include.items())))


def keyword_score(blob: Column, include: dict[str, float], exclude: list[str] = (), saturation: float = 6, weighted: bool = True) -> Column:
    """Struct of value and veto."""
    hits = keyword_hits(blob, include)
    total = F.aggregate(hits, F.lit(0.0), lambda s, h: s + h["weight"]) if weighted else F.size(hits).cast("double")
    veto = F.lit(False)
    for term in exclude:
        veto = veto | whole_word(blob, term)
    value = clamp(total / saturation) if include else F.lit(None).cast("double")
    # bound, so that the search is made once for both fields
    return let(veto & (blob != ""), lambda v: F.struct(F.when(blob == "", None).when(v, 0.0).otherwise(value).alias("value"), v.alias("veto")))


def top_keywords(hits: Column, most: int = 5) -> Column:
    """Names of the heaviest hits; equal ones in their order."""
    ranked = F.array_sort(F.transform(hits, lambda h, i: F.struct((-h["weight"]).alias("w"), i.alias("i"), h["keyword"].alias("k"))))
    return F.transform(F.slice(ranked, 1, most), lambda x: x["k"])


def field_score(blob: Column, profiles: list[tuple[str, float, list[str]]], floor: float = 0.15) -> Column:
    """Best field of work: struct of value, profile and up to five hits; value 0 below the floor; null for an empty text.

    A field whose terms occur counts in full, another by the largest lexical cosine of a term, each times its weight; of
    equal ones the first wins. The floor's default is a fixed value.
    """
    profiles = [p for p in profiles if p[2]]
    terms = [t for _, _, some in profiles for t in some]
    first = [sum(len(p[2]) for p in profiles[:i]) for i in range(len(profiles))]

    def entry(i: int, near: Column) -> Column:
        name, weight, some = profiles[i]
        hits = F.array_compact(F.array(*(F.when(whole_word(blob, t), F.lit(t)) for t in some)))
        part = lambda h: F.struct((-F.lit(float(weight)) * F.when(F.size(h) > 0, 1.0).otherwise(F.array_max(F.slice(near, first[i] + 1, len(some))))).alias("w"), F.lit(i).alias("i"), F.lit(name).alias("profile"), F.slice(h, 1, 5).alias("hits"))
        return let(hits, part)

    def best(ranked: Column) -> Column:
        top = F.get(ranked, F.lit(0))
        value = -top["w"]
        found = value > 0
        return F.struct(F.when(value < floor, 0.0).otherwise(clamp(value)).alias("value"), F.when(found, top["profile"]).alias("profile"), F.when(found, top["hits"]).alias("hits"))

    if not profiles:
        return F.lit(None).cast("struct<value:double,profile:string,hits:array<string>>")
    return F.when(blob != "", let(cosines_to(blob, terms), lambda near: let(F.array_sort(F.array(*(entry(i, near) for i in range(len(profiles))))), best)))


def cpv_score(codes: Column, preferred: list[str], unknown: float = 0.4) -> Column:
    """By the longest shared prefix of two digits and more: 0.4 for two, 1 for eight."""
    def shared(code: Column, target: str) -> Column:
        longest = F.lit(0)
        for n in range(1, len(target) + 1):
            longest = F.when(F.substring(code, 1, n) == target[:n], n).otherwise(longest)
        return longest

    best = F.array_max(F.transform(codes, lambda c: F.greatest(F.lit(0), *(shared(c, t) for t in preferred))))
    return F.when(F.coalesce(F.size(codes), F.lit(0)) <= 0, unknown).otherwise(clamp(F.when(best >= 2, 0.4 + 0.6 * (best - 2) / 6).otherwise(0.0)))


def history_score(wins: Column, decided: Column, least: int = 5, prior: float = 0.5) -> Column:
    """Win rate; the prior for few samples; null without any."""
    return F.when(decided.isNull() | (decided == 0), None).when(decided < least, prior).otherwise(clamp(wins / decided))


def procedure_score(procedure: Column, preferred: dict[str, float], unknown: float = 0.5) -> Column:
    table = F.create_map(*(x for k, v in preferred.items() for x in (F.lit(k), F.lit(float(v)))))
    return F.coalesce(clamp(F.try_element_at(table, procedure)), F.lit(unknown))


def combined(values: dict[str, Column], weights: dict[str, float], veto: Column | None = None) -> Column:
    """Weighted mean over the criteria that have a value; 0 for a veto or none; criteria without weight are off."""
    live = {k: w for k, w in weights.items() if w > 0 and k in values}
    top = sum((F.when(values[k].isNotNull(), values[k] * w).otherwise(0.0) for k, w in live.items()), F.lit(0.0))
    bottom = sum((F.when(values[k].isNotNull(), w).otherwise(0.0) for k, w in live.items()), F.lit(0.0))
    score = F.coalesce(F.try_divide(top, bottom), F.lit(0.0))
    return score if veto is None else F.when(veto, 0.0).otherwise(score)


# Bands and the scores they start at.
BANDS = {"highly_relevant": 0.75, "relevant": 0.5, "low_relevance": 0.0}


def band(score: Column, bands: dict[str, float] | None = None, veto: Column | None = None) -> Column:
    ranked = sorted((bands or BANDS).items(), key=lambda x: -x[1])
    found = F.lit("low_relevance")
    for name, least in reversed(ranked):
        found = F.when(score >= least, name).otherwise(found)
    return found if veto is None else F.when(veto, "out_of_scope").otherwise(found)


def said(text: Column, **details: Column) -> Column:
    """An explanation with the facts behind it, as text; facts that are unknown are left out."""
    facts = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in details.items()))
    return F.struct(text.alias("explanation"), F.map_from_entries(F.filter(facts, lambda e: e["value"].isNotNull())).alias("details"))


def breakdown(values: dict[str, Column], weights: dict[str, float], notes: dict[str, Column] | None = None) -> Column:
    """Map of criterion to value (4 places), weight, weighted contribution and whether it applied; with `notes` (made by `said`)
    also to explanation and details, which are null for a criterion that did not apply or has no note."""
    entries = []
    none = F.lit(None).cast("struct<explanation:string,details:map<string,string>>")
    for k, w in weights.items():
        if w > 0 and k in values:
            v = values[k]
            known = [F.bround(v, 4).alias("value"), F.lit(w).alias("weight"), F.bround(v * w, 4).alias("weighted"), v.isNotNull().alias("applicable")]
            if notes is not None:
                note = F.when(v.isNotNull(), notes[k]) if k in notes else none
                known += [note["explanation"].alias("explanation"), note["details"].alias("details")]
            entries += [F.lit(k), F.struct(*known)]
    return F.create_map(*entries)


@dataclass(frozen=True)
class Profile:
    """Weights and preferences of a scoring profile."""

    # The default profile.
    version: str = "2026.3"
    weights: dict[str, float] = field(default_factory=lambda: {"field_of_work": 0.38, "deadline_proximity": 0.22, "keywords": 0.13, "budget": 0.09, "location": 0.13, "organization": 0.05, "cpv_similarity": 0.0, "historical_success": 0.0, "procurement_type": 0.0})
    currency_rates: dict[str, float] = field(default_factory=lambda: {"TND": 1.0, "EUR": 3.35, "USD": 3.10, "XOF": 0.0051})
    procedures: dict[str, float] = field(default_factory=lambda: {"open": 1.0, "restricted": 0.8, "negotiated": 0.6, "framework_agreement": 0.9, "prior_information_notice": 0.5, "expression_of_interest": 0.7, "direct_award": 0.2})
    cpv: tuple[str, ...] = ("72000000", "72200000", "72300000", "72500000", "72600000", "48000000", "79400000")
    #: preferences over the general tables, whose values are none of the reference market's
    fields: tuple[tuple[str, float, tuple[str, ...]], ...] = (("construction", 1.0, ("building", "construction works")), ("equipment", 0.9, ("machinery", "machine parts")), ("mobility", 0.8, ("automobile repair",)))
    keywords: dict[str, float] = field(default_factory=lambda: {"building": 3.0, "machinery": 2.0, "urgent": 2.0, "high": 1.0, "automobile": 1.5})
    excluded: tuple[str, ...] = ("not specified",)
    locations: dict[str, float] = field(default_factory=lambda: {"France": 0.75, "Morocco": 0.8, "Algeria": 0.75, "Egypt": 0.6})
    organizations: dict[str, float] = field(default_factory=lambda: {"Customer#000000001": 1.0, "Customer#000000002": 0.95})


Criterion = Callable[[DataFrame, Profile, Column], Column]
CRITERIA: dict[str, Criterion] = {}
#: Notes on criteria, by their name: an explanation and its facts from the notices, the profile and the clock.
NOTES: dict[str, Criterion] = {}
_VETOING: set[str] = set()
_DETAILED: set[str] = set()


def criterion(name: str, veto: bool = False, detailed: bool = False) -> Callable[[Criterion], Criterion]:
    """Register a criterion: a column from the notices, the profile and the clock; null where it does not apply.

    Beside the columns of the notices there is `_blob`, their folded text. With `veto` the column is a struct of value and veto, with
    `detailed` one of value and whatever its note wants to read from `_<name>`.
    """

    def register(f: Criterion) -> Criterion:
        CRITERIA[name] = f
        NOTES.pop(name, None)  # it was written for the criterion that this one takes the place of
        for chosen, names in ((veto, _VETOING), (detailed, _DETAILED)):
            (names.add if chosen else names.discard)(name)
        return f

    return register


def isolated(value: Column) -> Column:
    """A criterion's value, or null where it isn't a number between 0 and 1 (a failing criterion must not stop the rest)."""
    return let(value, lambda v: F.when(~F.isnan(v) & v.between(0.0, 1.0), v))


def _given(notices: DataFrame, name: str, kind: str) -> Column:
    """A column that notices may have, joined from elsewhere."""
    return F.col(name) if name in notices.columns else F.lit(None).cast(kind)


@criterion("field_of_work", detailed=True)
def _field_of_work(notices: DataFrame, profile: Profile, now: Column) -> Column:
    return field_score(F.col("_blob"), [(n, w, list(t)) for n, w, t in profile.fields])


@criterion("deadline_proximity")
def _deadline(notices: DataFrame, profile: Profile, now: Column) -> Column:
    return deadline_score(days_until("deadline", now))


@criterion("keywords", veto=True)
def _keywords(notices: DataFrame, profile: Profile, now: Column) -> Column:
    if not profile.keywords and not profile.excluded:
        return F.lit(None).cast("struct<value:double,veto:boolean>")
    return keyword_score(F.col("_blob"), profile.keywords, list(profile.excluded))


@criterion("budget")
def _budget(notices: DataFrame, profile: Profile, now: Column) -> Column:
    rates = F.create_map(*(x for k, v in profile.currency_rates.items() for x in (F.lit(k), F.lit(v))))
    return let(F.col("budget") * F.coalesce(F.try_element_at(rates, F.upper("currency")), F.lit(1.0)), lambda amount: budget_score(amount))


@criterion("location")
def _location(notices: DataFrame, profile: Profile, now: Column) -> Column:
    return lookup_score(F.concat_ws(" ", "country", _given(notices, "location", "string")), profile.locations, 0.3, 0.4)


@criterion("organization")
def _organization(notices: DataFrame, profile: Profile, now: Column) -> Column:
    return lookup_score(F.concat_ws(" ", "buyer", _given(notices, "funder", "string")), profile.organizations, 0.4, 0.4)


@criterion("cpv_similarity")
def _cpv(notices: DataFrame, profile: Profile, now: Column) -> Column:
    return cpv_score(_given(notices, "cpv_codes", "array<string>"), list(profile.cpv)) if profile.cpv else F.lit(None).cast("double")


@criterion("historical_success")
def _history(notices: DataFrame, profile: Profile, now: Column) -> Column:
    return history_score(_given(notices, "wins", "double"), _given(notices, "decided", "double"))


@criterion("procurement_type")
def _procedure(notices: DataFrame, profile: Profile, now: Column) -> Column:
    return procedure_score(F.col("procedure"), profile.procedures)


def note(name: str) -> Callable[[Criterion], Criterion]:
    """Register what explains a criterion: a column made by `said`; it is computed only where explanations are asked for."""

    def register(f: Criterion) -> Criterion:
        NOTES[name] = f
        return f

    return register


@note("field_of_work")
def _field_note(notices: DataFrame, profile: Profile, now: Column) -> Column:
    def text(x: Column) -> Column:
        found = F.when(F.size(x["hits"]) > 0, F.concat(F.lit("Field "), x["profile"], F.lit(": "), F.array_join(x["hits"], ", "))).when(x["value"] > 0, F.concat(F.lit("Worded like field "), x["profile"]))
        return said(F.coalesce(found, F.lit("No field of work")), field=F.when(x["value"] > 0, x["profile"]), terms=F.when(F.size(x["hits"]) > 0, F.array_join(x["hits"], ", ")))

    return text(F.col("_field_of_work"))


@note("deadline_proximity")
def _deadline_note(notices: DataFrame, profile: Profile, now: Column) -> Column:
    def text(days: Column) -> Column:
        # the spans of deadline_score
        span = F.when(days < 5, "too short").when(days < 12, "tight").when(days <= 45, "ideal").when(days <= 180, "distant").otherwise("beyond the horizon")
        left = F.when(days < 0, "Deadline has passed").otherwise(F.concat(F.floor(days).cast("string"), F.lit(" days left: "), span))
        return said(F.coalesce(F.when(days.isNotNull(), left), F.lit("No deadline published")), days=F.floor(days))

    return let(days_until("deadline", now), text)


@note("keywords")
def _keyword_note(notices: DataFrame, profile: Profile, now: Column) -> Column:
    barred = F.array_compact(F.array(*(F.when(whole_word(F.col("_blob"), t), F.lit(t)) for t in profile.excluded))) if profile.excluded else F.array().cast("array<string>")
    best = top_keywords(keyword_hits(F.col("_blob"), profile.keywords)) if profile.keywords else F.array().cast("array<string>")

    def text(x: Column) -> Column:
        found = F.when(F.size(x["barred"]) > 0, F.concat(F.lit("Excluded: "), F.array_join(x["barred"], ", "))).when(F.size(x["best"]) > 0, F.concat(F.lit("Keywords: "), F.array_join(x["best"], ", ")))
        return said(F.coalesce(found, F.lit("No keyword found")), keywords=F.when(F.size(x["best"]) > 0, F.array_join(x["best"], ", ")), excluded=F.when(F.size(x["barred"]) > 0, F.array_join(x["barred"], ", ")))

    return let(F.struct(barred.alias("barred"), best.alias("best")), text)


@note("budget")
def _budget_note(notices: DataFrame, profile: Profile, now: Column) -> Column:
    rates = F.create_map(*(x for k, v in profile.currency_rates.items() for x in (F.lit(k), F.lit(v))))

    def text(amount: Column) -> Column:
        # the spans of budget_score
        span = F.when(amount < 50_000, "too small").when(amount < 250_000, "modest").when(amount <= 5_000_000, "in range").when(amount <= 25_000_000, "large").otherwise("too large to bid alone")
        whole = F.floor(amount).cast("string")
        return said(F.coalesce(F.when(amount.isNotNull(), F.concat(whole, F.lit(": "), span)), F.lit("No budget published")), amount=whole, currency=F.when(amount.isNotNull(), F.upper("currency")))

    return let(F.col("budget") * F.coalesce(F.try_element_at(rates, F.upper("currency")), F.lit(1.0)), text)


def _preferred(value: Column, preferred: dict[str, float]) -> Column:
    names = [(k, n) for k in preferred if (n := plain_fold(k))]
    held = lambda folded: F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(F.contains(folded, F.lit(n)) | F.contains(F.lit(n), folded), F.lit(k)) for k, n in names)))
    text = lambda hits: said(F.when(F.coalesce(F.trim(value), F.lit("")) == "", "Not stated").when(F.size(hits) > 0, F.concat(F.lit("Preferred: "), F.array_join(hits, ", "))).otherwise("Not among those preferred"), stated=F.when(F.trim(value) != "", F.trim(value)))
    return let(let(fold(value), held), text)


@note("location")
def _location_note(notices: DataFrame, profile: Profile, now: Column) -> Column:
    return _preferred(F.concat_ws(" ", "country", _given(notices, "location", "string")), profile.locations)


@note("organization")
def _organization_note(notices: DataFrame, profile: Profile, now: Column) -> Column:
    return _preferred(F.concat_ws(" ", "buyer", _given(notices, "funder", "string")), profile.organizations)


@note("cpv_similarity")
def _cpv_note(notices: DataFrame, profile: Profile, now: Column) -> Column:
    codes = _given(notices, "cpv_codes", "array<string>")
    # what a shared prefix adds to the score, turned round
    digits = lambda v: F.when(v > 0, F.round((v - 0.4) / 0.6 * 6 + 2).cast("int"))
    text = lambda v: said(F.when(F.coalesce(F.size(codes), F.lit(0)) <= 0, "No codes").when(v > 0, F.concat(F.lit("Digits shared with a preferred code: "), digits(v).cast("string"))).otherwise("No code near a preferred one"), codes=F.when(F.size(codes) > 0, F.array_join(codes, ", ")))
    return let(cpv_score(codes, list(profile.cpv)), text) if profile.cpv else said(F.lit("No preferred codes"))


@note("historical_success")
def _history_note(notices: DataFrame, profile: Profile, now: Column) -> Column:
    wins, decided = (_given(notices, x, "double").cast("long").cast("string") for x in ("wins", "decided"))
    return said(F.coalesce(F.concat(wins, F.lit(" won of "), decided), F.lit("Nothing decided yet")), wins=wins, decided=decided)


@note("procurement_type")
def _procedure_note(notices: DataFrame, profile: Profile, now: Column) -> Column:
    known = F.coalesce(F.col("procedure").isin(*profile.procedures), F.lit(False)) if profile.procedures else F.lit(False)
    return said(F.when(known, F.concat(F.lit("Procedure "), F.col("procedure"))).otherwise("No preference for the procedure"), procedure=F.col("procedure"))


def score_notices(notices: DataFrame, profile: Profile, now: Column, explain: bool = False) -> DataFrame:
    """Notices with their score, band and breakdown; weights of unregistered criteria are skipped. With `explain` each entry
    of the breakdown has an explanation and its details, and the weights that were used stand in `weights`.

    Text is folded once and each criterion computed once, whatever filters and sorts by the score come after (`bound`).
    """
    texts = [c for c in ("title", "description", "sector", "category", "buyer") if c in notices.columns]
    rows = bound(notices, {"_blob": text_blob(*texts, full_text="full_text" if "full_text" in notices.columns else None)})
    live = [k for k, w in profile.weights.items() if w > 0 and k in CRITERIA]
    named = bound(rows, {f"_{k}": CRITERIA[k](rows, profile, now) if k in _VETOING | _DETAILED else isolated(CRITERIA[k](rows, profile, now)) for k in live}) if live else rows
    held = {k: F.col(f"_{k}")["value"] if k in _VETOING | _DETAILED else F.col(f"_{k}") for k in live}
    veto = F.lit(False)
    for k in live:
        if k in _VETOING:
            veto = veto | F.coalesce(F.col(f"_{k}")["veto"], F.lit(False))
    noted = [k for k in live if k in NOTES] if explain else []
    for k in noted:
        # one after the other, which keeps the generated code of each small
        named = bound(named, {f"_note_{k}": NOTES[k](named, profile, now)})
    notes = {k: F.col(f"_note_{k}") for k in noted} if explain else None
    held |= {k: isolated(held[k]) for k in live if k in _DETAILED}
    scored = named.withColumns({"_veto": veto, "breakdown": breakdown(held, profile.weights, notes), "profile_version": F.lit(profile.version)})
    if explain:
        scored = scored.withColumn("weights", F.create_map(*(x for k, w in profile.weights.items() for x in (F.lit(k), F.lit(float(w))))))
    scored = scored.withColumn("score", let(combined(held, profile.weights, F.col("_veto")), lambda v: F.round(v, 6)))
    return scored.withColumn("band", band(F.col("score"), veto=F.col("_veto"))).drop("_blob", "_veto", *(f"_{k}" for k in live), *(f"_note_{k}" for k in noted))
