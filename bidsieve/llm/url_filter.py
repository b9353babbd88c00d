"""URL filters by a temporal list join.

Dated entries of block lists (a domain or a URL prefix is put on a list, or taken off) become validity intervals; every
capture is judged by the entries in force when it was fetched. The as-of join is an equi-join on the listed key and the
month, with the interval as residual: a capture offers its host, the parent domains and its path's prefixes as keys, and an
interval is offered in the months it touches up to the last capture. No key's history or captures meet in one task beyond
a month, and Spark may split what is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def intervals(entries: DataFrame) -> DataFrame:
    """entries: key string, listed boolean, at timestamp. Returns key, valid_from, valid_to (null: still in force).

    Of several entries of a key at one time the listing wins; entries that change nothing are merged; null parts are ignored.
    The host of a key has no case; its path has, as in URLs.
    """
    host = F.substring_index("key", "/", 1)
    key = F.concat(F.lower(host), F.expr("substring(key, length(substring_index(key, '/', 1)) + 1)"))
    known = entries.where("key is not null and listed is not null and at is not null").groupBy(key.alias("key"), "at").agg(F.max("listed").alias("listed"))
    by_key = Window.partitionBy("key").orderBy("at")
    turns = known.withColumn("was", F.lag("listed").over(by_key)).where("listed <> coalesce(was, false)")
    return turns.withColumn("valid_to", F.lead("at").over(by_key)).where("listed").select("key", F.col("at").alias("valid_from"), "valid_to")


def keys_of(url: F.Column) -> F.Column:
    """Everything a list may name: the host, its parent domains of two labels at least, and host with each path prefix."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.+$", "")
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda p: p != "")
    prefixes = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"))))
    return F.when(host != "", F.array_distinct(F.concat(parents, F.coalesce(prefixes, F.array().cast("array<string>")))))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Whether each capture's URL was listed when it was fetched.

    captures: page_id long, url string, fetched_at timestamp; other columns are ignored, whatever their names. Returns one
    row per input row: page_id, url, fetched_at, blocked, listed_key (the longest key in force, the first of equals) and
    listed_since. An interval holds from its first instant to before its last. Rows whose URL is null, empty or has no host,
    or whose time is null, match nothing; repeated rows are all returned; an empty table or list gives no match.
    """
    rows = captures.select(captures["page_id"].cast("long").alias("page_id"), captures["url"].cast("string").alias("url"), captures["fetched_at"].cast("timestamp").alias("fetched_at"))
    offered = rows.where("url is not null and fetched_at is not null").select("url", "fetched_at").distinct().withColumn("key", F.explode(keys_of(F.col("url")))).withColumn("month", F.trunc("fetched_at", "month"))
    last = rows.agg(F.max("fetched_at").alias("last"))
    held = intervals(entries).join(F.broadcast(last), F.col("valid_from") <= F.col("last"))
    held = held.select("key", "valid_from", "valid_to", F.explode(F.sequence(F.trunc("valid_from", "month"), F.trunc(F.least(F.coalesce("valid_to", "last"), "last"), "month"), F.expr("interval 1 month"))).alias("month"))
    met = offered.join(held, ["key", "month"]).where("fetched_at >= valid_from and (valid_to is null or fetched_at < valid_to)")
    best = met.groupBy("url", "fetched_at").agg(F.min(F.struct((-F.length("key")).alias("n"), "key", "valid_from")).alias("best"))
    return rows.join(best, ["url", "fetched_at"], "left").select("page_id", "url", "fetched_at", F.col("best").isNotNull().alias("blocked"), F.col("best.key").alias("listed_key"), F.col("best.valid_from").alias("listed_since"))


def _spread(column: str, start: int) -> F.Column:
    """A number from the hexadecimal digits of a hash, alike in all engines."""
    return F.conv(F.substring(F.md5(F.col(column).cast("binary")), start, 6), 16, 10).cast("long")


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages as captures of the year 2024; the fetch time follows from the id, as the table has none."""
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.col("page_id") * 7_919_993, F.lit(31_536_000))).alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts and first path parts of pages: listed at one time, most taken off at another, some relisted."""
    host = F.lower(F.regexp_extract("url", _HOST, 1))
    named = pages.select(host.alias("host"), F.regexp_extract(F.regexp_extract("url", _PATH, 1), "^/([^/]+)", 1).alias("part")).where("host <> ''")
    keys = named.select(F.explode(F.array(F.col("host"), F.regexp_replace("host", r"^[^.]+\.(?=[^.]+\.[^.]+\.)", ""), F.when(F.col("part") != "", F.concat_ws("/", "host", "part")))).alias("key")).where("key is not null").distinct()
    chosen = keys.where(_spread("key", 1) % 3 == 0)
    at = lambda start, low: F.timestamp_seconds(F.lit(1_704_067_200) + low * 86_400 + _spread("key", start) % 10_368_000)
    dated = F.array(F.struct(F.lit(True).alias("listed"), at(7, 0).alias("at")), F.struct((_spread("key", 25) % 4 == 0).alias("listed"), at(13, 120).alias("at")), F.struct((_spread("key", 25) % 2 == 0).alias("listed"), at(19, 240).alias("at")))
    return chosen.select("key", F.explode(dated).alias("e")).select("key", "e.*")


SQL = r"""
WITH pages_ AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_seconds((page_id * 7919993) % 31536000) AS fetched_at,
         regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.+$', '') AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), keys AS (
  SELECT DISTINCT key FROM (
    SELECT host AS key FROM pages_ WHERE host <> ''
    UNION ALL SELECT CASE WHEN len(string_split(host, '.')) > 3 THEN array_to_string(list_slice(string_split(host, '.'), 2, 99), '.') ELSE host END FROM pages_ WHERE host <> ''
    UNION ALL SELECT host || '/' || regexp_extract(path, '^/([^/]+)', 1) FROM pages_ WHERE host <> '' AND regexp_extract(path, '^/([^/]+)', 1) <> '')
), hashed AS (
  SELECT key, ('0x' || substr(md5(key), 1, 6))::BIGINT AS a, ('0x' || substr(md5(key), 7, 6))::BIGINT AS b, ('0x' || substr(md5(key), 13, 6))::BIGINT AS c,
         ('0x' || substr(md5(key), 19, 6))::BIGINT AS d, ('0x' || substr(md5(key), 25, 6))::BIGINT AS e FROM keys
), entries AS (
  SELECT key, TRUE AS listed, TIMESTAMP '2024-01-01' + to_seconds(b % 10368000) AS told FROM hashed WHERE a % 3 = 0
  UNION ALL SELECT key, e % 4 = 0, TIMESTAMP '2024-01-01' + to_seconds(120 * 86400 + c % 10368000) FROM hashed WHERE a % 3 = 0
  UNION ALL SELECT key, e % 2 = 0, TIMESTAMP '2024-01-01' + to_seconds(240 * 86400 + d % 10368000) FROM hashed WHERE a % 3 = 0
), once AS (SELECT key, told, bool_or(listed) AS listed FROM entries GROUP BY key, told
), turns AS (
  SELECT * FROM (SELECT *, lag(listed) OVER (PARTITION BY key ORDER BY told) AS was FROM once) WHERE listed <> coalesce(was, FALSE)
), held AS (
  SELECT key, told AS valid_from, valid_to FROM (SELECT *, lead(told) OVER (PARTITION BY key ORDER BY told) AS valid_to FROM turns) WHERE listed
), met AS (
  SELECT p.page_id, h.key, h.valid_from, row_number() OVER (PARTITION BY p.page_id ORDER BY length(h.key) DESC, h.key, h.valid_from) AS r
  FROM pages_ p JOIN held h ON p.fetched_at >= h.valid_from AND (h.valid_to IS NULL OR p.fetched_at < h.valid_to)
   AND (p.host = h.key OR (ends_with(p.host, '.' || h.key) AND contains(h.key, '.')) OR starts_with(p.host || rtrim(p.path, '/') || '/', h.key || '/') AND contains(h.key, '/'))
)
SELECT p.page_id, p.url, p.fetched_at, m.key IS NOT NULL AS blocked, m.key AS listed_key, m.valid_from AS listed_since
FROM pages_ p LEFT JOIN met m ON p.page_id = m.page_id AND m.r = 1
"""
