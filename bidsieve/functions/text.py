"""Text functions as columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words without weight in comparisons (French, English, procurement boilerplate).
STOP_WORDS = (
    "le la les un une des du de d au aux et ou a as en dans sur pour par avec sans sous vers chez ce cet cette ces son sa ses leur leurs il elle ils elles nous vous je tu on que qui quoi dont est sont etre avoir plus moins tres tout tous toute "
    "the an and or of in on for to with without at by from is are be been this that these those it its "
    "appel offre offres avis marche marches public publics"
).split()


@cache
def _bases() -> tuple[str, str]:
    """Characters of all scripts whose compatibility decomposition is one character and marks, and that character: accented
    letters, full-width forms, letters of circles. Surrogates, private and Hangul ranges have none."""
    ranges = [*range(0x80, 0xAC00), *range(0xF900, 0xFFFE)]
    pairs = [(chr(c), b) for c in ranges if len(b := "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) == 1 and b != chr(c)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@cache
def _ligatures() -> list[tuple[str, str]]:
    """Latin ligatures and digraphs and their letters."""
    return [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in [*range(0x132, 0x134), *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4), *range(0xFB00, 0xFB07)]]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: an array of one element binds it."""
    return F.transform(F.array(value), body)[0]


def bound(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Rows with costly columns computed once: generated rows of one struct, into which the optimizer inlines nothing from above."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def fold(text: Column, punctuation: bool = True, digits: bool = False) -> Column:
    """Comparable form: accents off, lower case, punctuation (and digits) to spaces, spaces collapsed; empty for null."""
    given = F.coalesce(text, F.lit(""))
    spelled = given
    for joined, letters in _ligatures():
        spelled = F.replace(spelled, F.lit(joined), F.lit(letters))
    given = F.when(given.rlike("[" + "".join(x for x, _ in _ligatures()) + "]"), spelled).otherwise(given)
    value = F.lower(F.regexp_replace(F.translate(given, *_bases()), r"\p{M}", ""))
    if punctuation:
        value = F.regexp_replace(value, r"(?U)[^\p{L}\p{N}_\s]", " ")
    if digits:
        value = F.regexp_replace(value, r"(?U)\d+", " ")
    return collapse(value)


def fold_everything(text: Column) -> Column:
    """`fold` for all of Unicode, with compatibility forms; an Arrow function, for corpora beyond Latin script."""

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        def one(s: str | None) -> str:
            plain = "".join(c for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", s or "")) if not unicodedata.combining(c))
            return " ".join(re.sub(r"[^\w\s]", " ", plain.lower()).split())

        return pa.array([one(s) for s in values.to_pylist()], pa.string())

    return run(text)


def tidy(text: Column, limit: int | None = None) -> Column:
    """White space collapsed, zero-width characters dropped, cut at `limit`; null if nothing is left."""
    value = collapse(F.regexp_replace(F.replace(text, F.lit(" "), F.lit(" ")), "[​﻿]", ""))
    if limit:
        value = F.rtrim(F.substring(value, 1, limit))
    return F.nullif(value, F.lit(""))


def without(text: Column, patterns: list[str]) -> Column:
    """Text without the given patterns, letter case aside; patterns that don't compile are skipped."""
    value = text
    for pattern in patterns:
        try:
            re.compile(pattern)
        except re.error:
            continue
        value = F.regexp_replace(value, f"(?i){pattern}", "")
    return tidy(value)


def clean_document(text: Column, limit: int = 200_000) -> Column:
    """Extracted text made readable: struct of text and truncated."""
    # Typographic characters and their plain forms.
    value = F.translate(text, "‘’“”–— ­", "''\"\"-- ")
    for mark, plain in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("…", "...")):
        value = F.replace(value, F.lit(mark), F.lit(plain))
    value = F.regexp_replace(value, "\r\n?", "\n")
    value = F.regexp_replace(value, r"(?U)(\w)-\n(\w)", "$1$2")
    value = F.regexp_replace(value, r"[ \t]+", " ")
    value = F.regexp_replace(value, r" ?\n ?", "\n")
    value = F.trim(F.regexp_replace(value, r"\n{3,}", "\n\n"), F.lit(" \n"))
    short = F.substring(value, 1, limit)
    cut = F.when(F.length(value) > limit, F.rtrim(F.regexp_replace(short, r"\s\S*\z", ""))).otherwise(value)
    return F.struct(F.coalesce(cut, F.lit("")).alias("text"), F.coalesce(F.length(value) > limit, F.lit(False)).alias("truncated"))


def tokens(text: Column, folded: bool = False) -> Column:
    """Folded words of three letters and more that aren't stop words."""
    return F.filter(F.split(text if folded else fold(text), " "), lambda t: (F.length(t) > 2) & ~t.isin(*STOP_WORDS))


def char_grams(text: Column, n: int = 4, folded: bool = False) -> Column:
    """Runs of n characters of the folded text with _ for spaces; a shorter text whole; none for an empty one."""
    compact = F.replace(text if folded else fold(text), F.lit(" "), F.lit("_"))

    def of(chars: Column) -> Column:
        whole = F.when(F.size(chars) > 0, F.array(F.array_join(chars, ""))).otherwise(F.array().cast("array<string>"))
        joined = lambda i: F.concat(*(F.get(chars, i + k) for k in range(n)))
        return F.when(F.size(chars) < n, whole).otherwise(F.transform(F.sequence(F.lit(0), F.size(chars) - n), joined))

    return let(F.filter(F.split(compact, ""), lambda c: c != ""), of)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def chunks_overlapping(text: Column, size: int = 150, overlap: int = 30) -> Column:
    """Windows of `size` words that share `overlap`, until the tail is covered; an empty text gives one empty chunk."""
    def of(w: Column) -> Column:
        n = F.size(w)
        step = size - overlap
        last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / step).cast("int"))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i * step + 1, size), " "))

    return let(words(text), of)


def chunks_fixed(text: Column, size: int = 70) -> Column:
    """Passages of `size` words; none for an empty text."""
    def of(w: Column) -> Column:
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), ((F.size(w) - 1) / size).cast("int")), lambda i: F.array_join(F.slice(w, i * size + 1, size), " ")))

    return let(words(text), of)


def plain_fold(text: str) -> str:
    """`fold` of a literal, on the driver."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text)) if not unicodedata.combining(c))
    return " ".join(re.sub(r"[^\w\s]", " ", plain.lower()).split())


def whole_word(folded: Column, term: str) -> Column:
    """Whether a folded text holds a term between word boundaries; a boundary is only asked for beside a letter or digit."""
    term = plain_fold(term)
    if not term:
        return F.lit(False)
    left = r"\b" if term[0].isalnum() else ""
    right = r"\b" if term[-1].isalnum() else ""
    return folded.rlike(f"(?U){left}{re.escape(term)}{right}")


def first_email(text: Column) -> Column:
    value = F.when(F.lower(text).startswith("mailto:"), F.substring_index(F.substring(text, 8, 1 << 30), "?", 1)).otherwise(text)
    return F.nullif(F.lower(F.regexp_extract(value, r"[\w.+-]+@[\w-]+\.[\w.-]+", 0)), F.lit(""))


def to_bool(text: Column, default: bool = False) -> Column:
    value = F.lower(F.trim(text))
    # Words for yes and no.
    return F.when(value.isin("true", "1", "yes", "y", "oui", "vrai", "on"), True).when(value.isin("false", "0", "no", "n", "non", "faux", "off"), False).otherwise(default)


def to_enum(text: Column, members: list[str], default: str = "unknown") -> Column:
    """A member of a vocabulary, read tolerantly."""
    value = F.regexp_replace(F.lower(F.trim(text)), "[- ]", "_")
    return F.when(value.isin(*members), value).otherwise(default)


#: Currency marks in the order in which they are tried, as plain substrings.
CURRENCY_MARKS = [("€", "EUR"), ("$", "USD"), ("£", "GBP"), ("dt", "TND"), ("tnd", "TND"), ("dinar", "TND"), ("dinars", "TND"), ("eur", "EUR"), ("euro", "EUR"), ("euros", "EUR"), ("usd", "USD"), ("dollar", "USD"), ("dollars", "USD"), ("mad", "MAD"), ("dzd", "DZD"), ("xof", "XOF"), ("fcfa", "XOF"), ("cfa", "XOF")]


def currency(text: Column, default: str | None = None) -> Column:
    """Currency code of a money text."""
    found = F.lit(None).cast("string")
    for mark, code in reversed(CURRENCY_MARKS):
        found = F.when(F.contains(F.lower(text), F.lit(mark)), code).otherwise(found)
    code = F.nullif(F.regexp_extract(text, r"\b([A-Z]{3})\b", 1), F.lit(""))
    return F.coalesce(found, F.when(~code.isin("THE", "AND", "FOR"), code), F.lit(default))


def money(text: Column, decimal: str = ",", thousands: str = " ") -> Column:
    """Amount of a money text as decimal(18,2), multipliers applied; null if there is none or it is negative."""
    value = tidy(text)
    low = F.lower(value)
    # Words that multiply an amount.
    factor = F.when(low.rlike(r"\bmillions?\b|\bmd\b"), 1_000_000).when(low.rlike(r"\bmilliers?\b|\bk\b(?!\w)"), 1_000).otherwise(1)
    number = F.regexp_replace(F.regexp_replace(value, r"[^\d.,\s' -]", ""), r"['\s]", "")
    if thousands:
        number = F.replace(number, F.lit(thousands), F.lit(""))
    number = F.replace(F.replace(number, F.lit("."), F.lit("")), F.lit(","), F.lit(".")) if decimal == "," else F.replace(number, F.lit(","), F.lit(""))
    amount = F.try_multiply(F.regexp_extract(number, r"-?\d+(?:\.\d+)?", 0).try_cast("decimal(28,6)"), factor.cast("decimal(8,0)"))
    return F.when(amount >= 0, F.bround(amount, 2).try_cast("decimal(18,2)"))


#: French and English month names and short forms, accents off.
MONTHS = {
    1: "janvier january jan janv", 2: "fevrier february feb fev fevr", 3: "mars march mar", 4: "avril april apr avr", 5: "mai may", 6: "juin june jun",
    7: "juillet july jul juil", 8: "aout august aug", 9: "septembre september sep sept", 10: "octobre october oct", 11: "novembre november nov", 12: "decembre december dec",
}


def timestamp(text: Column, formats: list[str] | None = None, zone: str | None = None) -> Column:
    """Declared formats, ISO, day with a French or English month name, then day-first figures; naive times are the zone's."""
    value = tidy(text)
    local = [F.try_to_timestamp(value, F.lit(f)) for f in formats or []]
    iso = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"), value.try_cast("timestamp"))
    shifted = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$"), value.try_cast("timestamp"))
    plain = F.translate(F.lower(value), "éèûî", "eeui")
    # Fixed value: the accepted form, a day, a month's name and a year, then perhaps a time such as 14h30.
    day, month_name, year, clock = r"(\d{1,2})\s*(?:er)?", r"([a-z]+)\.?", r"(\d{4})", r"(\d{1,2})[:h](\d{2})"
    pattern = rf"{day}\s+{month_name}\s+{year}(?:\D+{clock})?"
    part = lambda i: F.regexp_extract(plain, pattern, i)
    month = F.lit(None).cast("int")
    for number, names in MONTHS.items():
        month = F.when(part(2).isin(*names.split()), number).otherwise(month)
    number = lambda i: F.coalesce(part(i).try_cast("int"), F.lit(0))
    textual = F.when(month.isNotNull(), F.try_make_timestamp(number(3), month, number(1), number(4), number(5), F.lit(0)))
    # Fixed value: the accepted form, day first.
    figures = r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})(?:\D+(\d{1,2}):(\d{2}))?"
    figure = lambda i: F.coalesce(F.regexp_extract(value, figures, i).try_cast("int"), F.lit(0))
    loose = F.when(value.rlike(figures), F.try_make_timestamp(figure(3), figure(2), figure(1), figure(4), figure(5), F.lit(0)))
    in_zone = lambda t: F.to_utc_timestamp(t, zone) if zone else t
    return F.coalesce(*(in_zone(t) for t in local), shifted, in_zone(iso), textual, in_zone(loose))


def clean_codes(codes: Column) -> Column:
    """CPV codes as digits, eight at most, distinct, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(codes, lambda c: F.substring(F.regexp_replace(c, r"\D", ""), 1, 8)), lambda c: c != "")))


def code_matches(codes: Column, prefix: str) -> Column:
    """Whether a code starts with a prefix, trailing zeros of the prefix aside."""
    stem = prefix.rstrip("0") or prefix
    return F.exists(codes, lambda c: F.startswith(c, F.lit(stem)))


def pii_rules() -> list[tuple[str, str]]:
    """Patterns of personal data with their markers, in the order in which they apply."""
    return [
        (r"[\w.+-]+@[\w-]+\.[\w.-]+", "[EMAIL]"),
        (r"(?i)https?://(?:www\.)?(?:linkedin\.com|github\.com)/\S+", "[PROFILE]"),
        (r"(?i)\b(?:né|née|born|birth date|date de naissance)[^\d\n]{0,20}\d{1,2}[/.-]\d{1,2}[/.-]\d{4}", "[BIRTH_DATE]"),
        (r"(?i)\b(?:cin|passport|passeport|ssn)\W{0,3}\w*\d{5,}\b", "[ID_NUMBER]"),
        (r"\+?\d[\d ().-]{7,}\d", "[PHONE]"),
        (r"(?i)\b\d{1,4},? (?:rue|avenue|boulevard|street|road)\b[^\n,]*", "[ADDRESS]"),
    ]


def masked(text: Column) -> Column:
    """Personal data replaced by typed markers."""
    for pattern, marker in pii_rules():
        text = F.regexp_replace(text, pattern, F.lit(marker))
    return text


def masked_with_counts(text: Column) -> Column:
    """A struct of the masked text and a map from marker to what it stands for: markers that a rule sets, not those the text had."""
    counts = []
    for pattern, marker in pii_rules():
        counts += [F.lit(marker), F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))]
        text = F.regexp_replace(text, pattern, F.lit(marker))
    return F.struct(text.alias("text"), F.create_map(*counts).alias("counts"))
