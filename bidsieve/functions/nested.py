"""Functions over maps, arrays and JSON bodies."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of key names whose values must not be shown.
SENSITIVE = r"(?i)password|passwd|secret|token|api_key|apikey|x-api-key|auth|credential|cookie|session|access_key|private_key|username|login"
#: Fixed value: what stands in the place of what must not be shown.
MASK = "***redacted***"
_SENSITIVE = re.compile(SENSITIVE)


def redact_map(m: Column) -> Column:
    """Values of sensitive keys masked."""
    return F.transform_values(m, lambda k, v: F.when(k.rlike(SENSITIVE), F.lit(MASK)).otherwise(v))


@F.pandas_udf(T.StringType())
def redact_json(body: pd.Series) -> pd.Series:
    """A JSON text whose values under sensitive keys are masked, at any depth: objects and lists are entered, and the items of a
    list stand under its key. Null where the text is no JSON, so that nothing is shown that could not be read."""
    def masked(value: object, hidden: bool) -> object:
        if isinstance(value, dict):
            return {k: masked(v, bool(_SENSITIVE.search(k))) for k, v in value.items()}
        if isinstance(value, list):
            return [masked(v, hidden) for v in value]
        return MASK if hidden else value

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(masked(json.loads(text), False), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    return body.map(one)


def pick_amount(amounts: Column) -> Column:
    """From an array of kind and amount: the first non-zero total, else the first non-zero amount."""
    some = F.filter(amounts, lambda a: a["amount"] != 0)
    return F.coalesce(F.get(F.filter(some, lambda a: a["kind"] == "total"), F.lit(0))["amount"], F.get(some, F.lit(0))["amount"])


def collect_codes(body: Column) -> Column:
    """Codes under any of several keys of a JSON object, as a list of objects or a string; digits, eight at most, distinct, sorted."""
    listed = F.from_json(body, "cpv array<struct<code:string>>")["cpv"]
    single = F.array(F.get_json_object(body, "$.cpv_code"), F.get_json_object(body, "$.main_cpv"))
    found = F.concat(F.coalesce(F.transform(listed, lambda x: x["code"]), F.array().cast("array<string>")), single)
    cleaned = F.transform(F.filter(found, lambda c: c.isNotNull()), lambda c: F.substring(F.regexp_replace(c, r"\D", ""), 1, 8))
    return F.array_sort(F.array_distinct(F.filter(cleaned, lambda c: c != "")))


def join_highlights(description: Column, fragments: Column, limit: int = 4000) -> Column:
    """The description, or where there is none the fragments without their marks."""
    joined = F.array_join(F.transform(fragments, lambda x: F.regexp_replace(x, "</?em>", "")), " … ")
    return F.substring(F.coalesce(F.nullif(description, F.lit("")), joined), 1, limit)


def idempotency_key(*parts: str) -> Column:
    """32 hex digits that stand for the given parts; null parts are left out."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *(F.col(p).cast("string") for p in parts)), 256), 1, 32)


def title_of(text: Column, stem: Column) -> Column:
    """First line of 8 to 300 characters, else the stem."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.length(x).between(8, 300))
    return F.coalesce(F.get(lines, F.lit(0)), stem)
