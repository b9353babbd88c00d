"""Quality rules by robust multivariate outliers, in DataFrame and SQL functions only.

Each text becomes a vector of transformed statistics. Per language and source a minimum-covariance-determinant estimate
is made from the most central share of the rows, and a row whose Mahalanobis distance to it is too large is rejected.

The search has three starts: medians with median deviations, mean and covariance of all rows, and medians with the
covariance of directions from them. Each is refined by concentration steps (distances, a cut at the share's quantile, mean
and covariance of the rows inside); the one whose covariance has the smallest determinant is the group's estimate.
Statistics are fixed-point integers, so sums are exact whatever the order of tasks. A step moves one row per group, start
and bin of the distance, combined before the shuffle, and estimates go to the rows, not rows to the estimates, so a hot
source is no larger task than any other.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, kept_rows, row_key, text_of

_SPACE = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: Fixed point: statistics are kept as thousandths.
_UNIT = 1000
#: Smallest standard deviation per dimension, in units; most texts have no symbols or repeats at all.
_FLOOR = (0.15, 0.3, 0.1, 0.12, 0.2)
_DIM = len(_FLOOR)
_BINS = 4096
#: Groups whose parameters (about 250 bytes each) are broadcast; more are joined in salted parts.
_BROADCAST = 200_000
_SALTS = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column, window: int) -> Column:
    """Words inside windows that occur twice or more in the same text, the first included."""

    def covered(pairs: Column) -> Column:
        last = F.size(pairs) - 1
        hash_at = lambda i: F.get(pairs, i)["h"]
        twice = lambda i: F.coalesce(hash_at(i) == hash_at(i - 1), F.lit(False)) | F.coalesce(hash_at(i) == hash_at(i + 1), F.lit(False))
        starts = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), last), twice), lambda i: F.get(pairs, i)["i"]))
        return let(starts, lambda s: F.aggregate(F.transform(s, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(s, j + 1) - x, F.lit(window)))), F.lit(0), lambda a, b: a + b))

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))
        sorted_pairs = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(w) < window, 0).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(sorted_pairs(h), covered))))

    return let(words, of)


def statistics(docs: DataFrame, window: int = 8) -> DataFrame:
    """Per row: doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, and row_key."""
    text = text_of(docs)
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), row_key(docs, "lang", "source").alias("row_key"), docs["lang"].cast("string").alias("lang"), docs["source"].cast("string").alias("source"), text.alias("text"))
    trimmed = F.btrim("text", F.lit(_BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated_words(w, window).cast("long").alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    length = lambda c: F.length(c).cast("long")
    return base.select(
        "doc_id", "row_key", "lang", "source", counted.alias("w"), by_line.alias("l"),
        length(F.translate("text", _BLANKS, "")).alias("word_chars"),
        (length(F.col("text")) - length(F.translate("text", _SYMBOLS, ""))).alias("n_symbols"),
        (length(F.col("text")) - length(F.regexp_replace("text", r"\p{Lu}+", ""))).alias("n_upper"),
    ).select("doc_id", "row_key", "lang", "source", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_upper")


def _vector() -> list[Column]:
    """Transformed statistics in thousandths: log word length, log symbol rate, and roots of the shares of capitals, repeated lines and repeated words."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(b, F.lit(1)))
    values = [F.log(chars / words), F.log1p(100 * F.col("n_symbols") / chars), share("n_upper", chars), share("n_dup_lines", F.col("n_lines")), share("n_repeat_words", words)]
    return [F.round(v * _UNIT).cast("long").alias(f"x{i}") for i, v in enumerate(values)]


def gamma_share(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: chi-square probability with a = half the degrees, x = half the value."""
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi_square(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_share(degrees / 2, max(mid, 1e-12) / 2) < p else (low, mid)
    return high


_PAIRS = [(i, j) for i in range(_DIM) for j in range(i + 1)]
_X = [f"x{i}" for i in range(_DIM)]
_M = [f"m{i}" for i in range(_DIM)]
_S = [f"s{i}{j}" for i, j in _PAIRS]


def _beside(rows: DataFrame, facts: DataFrame, key: str = "g") -> DataFrame:
    """Rows with the facts of their group: broadcast where these are few enough, else both in salted parts."""
    if facts.count() <= _BROADCAST:
        return rows.join(F.broadcast(facts), key)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(_SALTS)))
    return salted.join(facts.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long")))), [key, "_salt"]).drop("_salt")


def _factor(params: DataFrame) -> DataFrame:
    """From means m0.. and covariance s00.. to m0.., the Cholesky factor l00.., column by column, and the log determinant."""
    for j in range(_DIM):
        for i in range(j, _DIM):
            rest = F.col(f"s{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            params = params.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit((_FLOOR[i] * _UNIT / 10) ** 2))) if i == j else rest / F.col(f"l{j}{j}"))
    spread = sum((F.log(F.col(f"l{i}{i}")) for i in range(_DIM)), F.lit(0.0)) * 2
    return params.select("g", "start", *_M, *(f"l{i}{j}" for i, j in _PAIRS), spread.alias("spread"))


def _distance(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance d2 of each row to each of its group's estimates."""
    rows = _beside(rows, params)
    for i in range(_DIM):
        rest = F.col(f"x{i}") - F.col(f"m{i}") - sum((F.col(f"l{i}{j}") * F.col(f"y{j}") for j in range(i)), F.lit(0.0))
        rows = rows.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(_DIM)), F.lit(0.0)))


def _sums() -> list[Column]:
    return [F.count("*").alias("n"), *(F.sum(x).alias(f"t{i}") for i, x in enumerate(_X)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in _PAIRS)]


def _estimate(total: DataFrame, grow: float) -> DataFrame:
    """Means and floored covariances (times `grow`) from counts n, sums t0.. and sums of products q00.. ."""
    total = total.withColumn("n", F.col("n").cast("double")).withColumns({f"m{i}": F.col(f"t{i}") / F.col("n") for i in range(_DIM)})
    spread = lambda i, j: (F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * grow + F.lit((_FLOOR[i] * _UNIT) ** 2 if i == j else 0.0)
    return total.select("g", "start", *_M, *(spread(i, j).alias(f"s{i}{j}") for i, j in _PAIRS))


def _starts(rows: DataFrame) -> DataFrame:
    """Three estimates per group to start from."""
    # percentile() combines counts of values, which are fixed-point, before the shuffle
    middle = durable(rows.groupBy("g").agg(*(F.percentile(x, F.lit(0.5)).alias(f"m{i}") for i, x in enumerate(_X))))
    away = _beside(rows, middle)
    length = F.sqrt(sum((F.pow(F.col(f"x{i}") - F.col(f"m{i}"), 2) for i in range(_DIM)), F.lit(0.0)))
    away = away.withColumn("length", length).withColumns({f"u{i}": F.when(F.col("length") > 0, F.round((F.col(f"x{i}") - F.col(f"m{i}")) / F.col("length") * _UNIT)).otherwise(0).cast("long") for i in range(_DIM)})
    off = away.groupBy("g").agg(
        *(F.first(m).alias(m) for m in _M),
        *(F.percentile(F.abs(F.col(x) - F.col(f"m{i}")), F.lit(0.5)).alias(f"a{i}") for i, x in enumerate(_X)),
        *(F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"v{i}{j}") for i, j in _PAIRS),
        *_sums(),
    )
    off = durable(off)
    floor = lambda i, j: F.lit((_FLOOR[i] * _UNIT) ** 2 if i == j else 0.0)
    var = lambda i: F.pow(F.col(f"a{i}") * 1.4826, 2)
    size = sum((var(i) for i in range(_DIM)), F.lit(0.0)) / (_UNIT * _UNIT)
    medians = off.select("g", F.lit(0).alias("start"), *_M, *(((var(i) if i == j else F.lit(0.0)) + floor(i, j)).alias(f"s{i}{j}") for i, j in _PAIRS))
    classic = _estimate(off.drop(*_M).withColumn("start", F.lit(1)), 1.0)
    signs = off.select("g", F.lit(2).alias("start"), *_M, *((F.col(f"v{i}{j}") / F.col("n") * size + floor(i, j)).alias(f"s{i}{j}") for i, j in _PAIRS))
    return durable(_factor(medians.unionByName(classic).unionByName(signs)))


def _concentrated(rows: DataFrame, params: DataFrame, share: float, grow: float) -> DataFrame:
    """One concentration step: estimates from the rows up to the bin of the distance that holds the share's quantile."""
    bin_of = F.least(F.floor(F.sqrt("d2") * 64), F.lit(_BINS)).cast("int")
    bins = _distance(rows, params).withColumn("bin", bin_of).groupBy("g", "start", "bin").agg(*_sums())
    key = Window.partitionBy("g", "start")
    below = key.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    inside = bins.withColumn("before", F.coalesce(F.sum("n").over(below), F.lit(0))).withColumn("of", F.sum("n").over(key)).where(F.col("before") < F.ceil(F.col("of") * share))
    total = inside.groupBy("g", "start").agg(*(F.sum(c).cast("double").alias(c) for c in ("n", *(f"t{i}" for i in range(_DIM)), *(f"q{i}{j}" for i, j in _PAIRS))))
    return durable(_factor(_estimate(total, grow)))


def estimates(rows: DataFrame, share: float = 0.75, steps: int = 3) -> DataFrame:
    """The minimum-covariance-determinant estimate of each group g over x0.. : of all starts the one of least determinant (the first of equals)."""
    cut = chi_square(share, _DIM)
    grow = share / gamma_share((_DIM + 2) / 2, cut / 2)
    params = _starts(rows)
    for _ in range(steps):
        params = _concentrated(rows, params, share, grow)
    best = params.groupBy("g").agg(F.min(F.struct(F.round("spread", 9).alias("spread"), "start", *_M, *(f"l{i}{j}" for i, j in _PAIRS))).alias("best"))
    return durable(best.select("g", "best.*"))


COUNTS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _facts(docs: DataFrame, *more: str) -> DataFrame:
    """Counts of every row, base_failed, the names of its groups from small to large, and its vector."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    tag = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    names = F.array(F.concat(tag("lang"), F.lit("\x1f"), tag("source")), F.concat(tag("lang"), F.lit("\x1f")), F.lit(""))
    return statistics(docs).withColumn("base_failed", failed).select(*COUNTS, *more, "base_failed", names.alias("names"), *_vector())


def _judged(facts: DataFrame, share: float, steps: int, least: int) -> DataFrame:
    """Rows of facts that the base rules let pass, with their distance d2 to their group's estimate."""
    sound = facts.where(~F.col("base_failed")).withColumn("own", F.col("names")[0])
    sizes = sound.groupBy("own", F.col("names")[1].alias("lang")).agg(F.count("*").alias("n"))
    sizes = durable(sizes.withColumn("of_lang", F.sum("n").over(Window.partitionBy("lang"))).select("own", F.when(F.col("n") >= least, 1).when(F.col("of_lang") >= least, 2).otherwise(3).alias("level")))
    #: every row shapes the estimate of each level that some group needs; it is judged by its own
    placed = _beside(sound, sizes, "own").withColumn("g", F.element_at("names", F.col("level"))).drop("own")
    slim = durable(placed.select("level", "g", "names", *_X))
    used = slim.select("g").where("level > 1").distinct()
    pooled = slim.select(F.explode(F.slice("names", 2, 2)).alias("g"), *_X)
    rows = slim.where("level = 1").select("g", *_X).unionByName(_beside(pooled, durable(used)))
    return _distance(placed, estimates(rows, share, steps))


def judge(docs: DataFrame, share: float = 0.75, steps: int = 3, least: int = 2 * _DIM, quantile: float = 1 - 1e-9) -> DataFrame:
    """Statistics of every row and whether it is kept.

    docs: doc_id long, text, lang and source string; other columns are ignored, whatever their names. Returns one row per
    input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept.
    base_failed: fewer than 20 words, or over 30 % of the words in repeated 8-word windows. Others are kept if their squared
    distance is at most the chi-square `quantile`; they alone shape the estimates. A language and source with fewer than
    `least` of them, too few for a covariance of five statistics, is judged with its whole language, and a language with
    fewer with all. Windows are equal by a 64-bit hash within one text. A null text is empty and fails; null languages or
    sources are groups of their own; repeated rows count each; ties in distance fall together; an empty table gives an empty
    result.
    """
    facts = durable(_facts(docs))
    passed = _judged(facts, share, steps, least).select(*COUNTS, F.lit(False).alias("base_failed"), F.sqrt("d2").alias("distance"), (F.col("d2") <= chi_square(quantile, _DIM)).alias("kept"))
    return passed.unionByName(facts.where("base_failed").select(*COUNTS, "base_failed", F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept")))


def keep_good(docs: DataFrame, share: float = 0.75, steps: int = 3, least: int = 2 * _DIM, quantile: float = 1 - 1e-9) -> DataFrame:
    """Rows of docs, with all their columns, that `judge` keeps."""
    judged = _judged(durable(_facts(docs, "row_key")), share, steps, least)
    return kept_rows(docs, judged.where(F.col("d2") <= chi_square(quantile, _DIM)), "lang", "source")


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns, and the distance."""
    return result.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
