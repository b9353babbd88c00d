"""URL functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nested import MASK, SENSITIVE

#: Query parameters that don't change which document is addressed.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "sessionid", "jsessionid", "phpsessid", "sid", "_ga", "ref"]

_PARTS = r"^\s*(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::(\d+))?)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _PARTS, i)


def host(url: Column) -> Column:
    return F.lower(_part(url, 2))


def pairs(query: Column) -> Column:
    """Non-empty name=value strings of a query."""
    return F.filter(F.split(query, "&"), lambda p: p != "")


def canonical(url: Column, strip: list[str] = TRACKING) -> Column:
    """Scheme and host in lower case, without user info, default port, trailing slash, tracking parameters and plain fragments; parameters sorted."""
    scheme = F.coalesce(F.nullif(F.lower(_part(url, 1)), F.lit("")), F.lit("https"))
    port = _part(url, 3)
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = _part(url, 4)
    path = F.when(F.regexp_replace(path, "/+$", "") == "", F.lit("/")).otherwise(F.regexp_replace(path, "/+$", ""))
    kept = F.filter(pairs(_part(url, 5)), lambda p: ~F.lower(F.substring_index(p, "=", 1)).isin(*strip))
    query = F.array_join(F.array_sort(F.transform(kept, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))), "&")
    fragment = _part(url, 6)
    whole = F.concat(scheme, F.lit("://"), host(url), F.when(usual, "").otherwise(F.concat(F.lit(":"), port)), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)), F.when(fragment.rlike("^[/!]"), F.concat(F.lit("#"), fragment)).otherwise(""))
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(whole)


def identity(url: Column) -> Column:
    """Scheme, host and path alone, for signed links."""
    return F.concat(F.lower(_part(url, 1)), F.lit("://"), host(url), _part(url, 4))


def guarded(url: Column) -> Column:
    """Why a URL must not be fetched: another scheme, no host, or a private host; null if it may."""
    private = r"^(localhost|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(1[6-9]|2\d|3[01])\..*|0\..*|.*\.local|.*\.internal)$"
    inside = r"^\[(::1?|fe80:.*|f[cd][0-9a-f]{2}:.*|::ffff:.*)\]$"
    return F.when(~F.lower(_part(url, 1)).isin("http", "https"), "scheme").when(host(url) == "", "host").when(host(url).rlike(private) | host(url).rlike(inside), "private")


def redacted(url: Column) -> Column:
    """User info and the values of secret parameters masked."""
    safe = F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@", f"$1{MASK}@")
    query = _part(url, 5)
    new = F.array_join(F.transform(F.split(query, "&"), lambda p: F.when(F.substring_index(p, "=", 1).rlike(SENSITIVE), F.concat(F.substring_index(p, "=", 1), F.lit(f"={MASK}"))).otherwise(p)), "&")
    return F.when(query == "", safe).otherwise(F.replace(safe, F.concat(F.lit("?"), query), F.concat(F.lit("?"), new)))


def file_name(path: Column) -> Column:
    """A safe ASCII name from the last part of a path."""
    base = F.regexp_replace(F.regexp_replace(path, r"[?#].*$", ""), r"^.*[/\\]", "")
    clean = F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    reserved = F.upper(F.substring_index(clean, ".", 1)).isin("CON", "PRN", "AUX", "NUL", "COM1", "LPT1")
    return F.substring(F.when(clean == "", "file").when(reserved, F.concat(F.lit("_"), clean)).otherwise(clean), 1, 120)
