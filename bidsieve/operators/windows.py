"""Sequences per source: streaks, health, caps, circuit states."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import parts


def document_rank(name: str) -> Column:
    """0 if the name carries a dossier marker, else 1."""
    # Words that mark a tender dossier.
    return F.when(F.lower(name).rlike(r"cahier|cdc|cctp|ccap|dao|dce|rfp|tdr|termes de reference|specification"), 0).otherwise(1)


def streaks(runs: DataFrame) -> DataFrame:
    """Consecutive failures, successes and empty runs up to each run of a source. runs: source_key, ts, run_id, failed, items."""
    order = Window.partitionBy("source_key").orderBy("ts", "run_id")
    flags = {"failures": F.col("failed"), "successes": ~F.col("failed"), "empties": ~F.col("failed") & (F.col("items") == 0)}
    out = runs
    for name, flag in flags.items():
        island = F.sum(F.when(flag, 0).otherwise(1)).over(order)
        out = out.withColumn(f"_{name}", island)
    for name, flag in flags.items():
        within = Window.partitionBy("source_key", f"_{name}").orderBy("ts", "run_id")
        out = out.withColumn(name, F.sum(F.when(flag, 1).otherwise(0)).over(within))
    return out.drop(*(f"_{n}" for n in flags))


def health(streaked: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """State and reason of each source after its last run: failing from 3 failures, degraded from 1 or from 3 empty runs, else healthy.

    streaked may have error_type, which the reason names. sources: source_key, enabled, credentials_missing; a source that is
    not enabled is disabled, one without its credentials stays so whatever its runs say, and sources that never ran are told of too.
    """
    error = F.col("error_type") if "error_type" in streaked.columns else F.lit(None).cast("string")
    last = streaked.withColumn("_error", F.coalesce(error, F.lit("unknown error"))).groupBy("source_key").agg(F.max_by(F.struct("failures", "successes", "empties", "ts", "_error"), F.struct("ts", "run_id")).alias("s")).select("source_key", "s.*")
    state = F.when(F.col("failures") >= 3, "failing").when((F.col("failures") >= 1) | (F.col("empties") >= 3), "degraded").otherwise("healthy")
    number = lambda c: F.col(c).cast("string")
    # The reasons' texts.
    reason = (
        F.when(F.col("failures") >= 3, F.concat(number("failures"), F.lit(" consecutive failures ("), "_error", F.lit(")"))).when(F.col("failures") >= 1, F.concat(F.lit("Last run failed: "), "_error"))
        .when(F.col("empties") >= 3, F.concat(number("empties"), F.lit(" consecutive runs returned no items — the portal markup may have changed.")))
    )
    if sources is not None:
        last = sources.select("source_key", "enabled", "credentials_missing").join(last, "source_key", "left").fillna(0, ["failures", "successes", "empties"])
        fixed = F.when(~F.col("enabled"), "disabled").when(F.col("credentials_missing"), "credentials_missing")
        state, reason = F.coalesce(fixed, state), F.when(fixed.isNull(), reason)
    return last.select("source_key", "failures", "successes", "empties", F.col("ts").alias("last_run"), state.alias("state"), reason.alias("reason"))


def silence_alerts(healths: DataFrame, now: Column, hours: int = 26) -> DataFrame:
    """One row per alert: no run for `hours`, failing, degraded."""
    silent = F.col("last_run") < now - F.make_dt_interval(hours=F.lit(hours))
    alerts = F.array_compact(F.array(F.when(silent, F.lit("silent")), F.when(F.col("state").isin("failing", "degraded"), F.col("state"))))
    return healths.select("source_key", F.explode(alerts).alias("alert"))


def rolling_cap(rows: DataFrame, key: str, counted: Column, cap: int, hours: int = 24) -> DataFrame:
    """Counted rows of a key in the `hours` before and including each row, and whether the row exceeds the cap."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    span = Window.partitionBy(key).orderBy(seconds).rangeBetween(-hours * 3_600_000_000 + 1, 0)
    return rows.withColumn("recent", F.sum(F.when(counted, 1).otherwise(0)).over(span)).withColumn("suppressed", F.col("recent") > cap)


@dataclass
class Breaker:
    """Circuit breaker of one source. The half-open state admits `probes` runs but needs `successes` to close; a success
    gives no probe back, so with probes < successes only `reset` seconds after opening bring it back to closed."""

    failures: int
    wait: float
    probes: int
    successes: int
    reset: float
    state: str = "closed"
    failed: int = 0
    won: int = 0
    used: int = 0
    opened: float = 0.0

    def before(self, at: float, bad: bool) -> str:
        """State that a run at a time meets; the run's result then moves the breaker."""
        if self.state != "closed" and at - self.opened >= self.reset:
            self.state, self.failed = "closed", 0
        if self.state == "open" and at - self.opened >= self.wait:
            self.state, self.won, self.used = "half_open", 0, 0
        met = self.state
        if met == "half_open" and self.used >= self.probes:
            return "half_open_refused"
        if met == "half_open":
            self.used += 1
            self.won += not bad
            if bad:
                self.state, self.opened = "open", at
            elif self.won >= self.successes:
                self.state, self.failed = "closed", 0
        elif met == "closed":
            self.failed = self.failed + 1 if bad else 0
            if self.failed >= self.failures:
                self.state, self.opened = "open", at
        return met


def circuit_states(runs: pd.DataFrame, failures: int, wait: float, probes: int, successes: int, reset: float) -> list[str]:
    """State before each run of one source, in order."""
    breaker = Breaker(failures, wait, probes, successes, reset)
    return [breaker.before(at, bad) for at, bad in zip(runs["seconds"], runs["failed"], strict=True)]


def circuit_timeline(runs: DataFrame, failures: int = 5, wait: float = 600, probes: int = 1, successes: int = 2, reset: float = 6000) -> DataFrame:
    """Circuit breaker state before each run: an ordered fold. Runs come sorted by source and time, batch by batch, and the
    breaker of the source at hand is all that is kept, however many runs it has."""

    def folded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, breaker = None, None
        for frame in frames:
            states = []
            for key, at, bad in zip(frame["source_key"], frame["seconds"], frame["failed"], strict=True):
                if breaker is None or key != source:
                    source, breaker = key, Breaker(failures, wait, probes, successes, reset)
                states.append(breaker.before(at, bad))
            yield pd.DataFrame({"run_id": frame["run_id"], "source_key": frame["source_key"], "circuit": states})

    slim = runs.select("source_key", "run_id", "failed", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"))
    return slim.repartition(parts(runs), "source_key").sortWithinPartitions("source_key", "seconds", "run_id").mapInPandas(folded, "run_id long, source_key long, circuit string")


def top_documents(attachments: DataFrame, most: int = 40) -> DataFrame:
    """Documents of a notice in order of priority and name; those beyond `most` are marked."""
    order = Window.partitionBy("notice_id").orderBy(document_rank("name"), "name", "position")
    return attachments.withColumn("rank", F.row_number().over(order)).withColumn("over_limit", F.col("rank") > most)


def merged_text(rows: DataFrame, key: str, order: list[str], limit: int = 500_000) -> DataFrame:
    """Texts of a key in order with a marker line each, cut at `limit`; digital, ocr, mixed or none as method; and where rows
    have an error, what went wrong by name, joined in order up to 2,000 characters, and whether the key is extracted, failed
    or empty.

    Only texts that start before the limit, or right behind it, as the break before them may lie on it, are gathered; the rest
    are counted.
    """
    full = rows.where(F.length("text") > 0).withColumn("_piece", F.concat(F.lit("=== "), "name", F.lit(" ===\n"), "text"))
    before = F.sum(F.length("_piece") + 2).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    item = F.when(F.col("_before") < limit + 2, F.struct(*order, F.substring("_piece", 1, limit).alias("piece")))
    lists = full.withColumn("_before", F.coalesce(before, F.lit(0))).groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("items"), F.count("*").alias("documents"), F.count_distinct("method").alias("methods"), F.max("method").alias("one"))
    text = F.substring(F.array_join(F.transform("items", lambda x: x["piece"]), "\n\n"), 1, limit)
    method = F.when(F.col("methods") > 1, "mixed").otherwise(F.col("one"))
    named = lists.select(key, text.alias("text"), "documents", method.alias("method"))
    columns = [F.coalesce("text", F.lit("")).alias("text"), F.coalesce("documents", F.lit(0).cast("long")).alias("documents"), F.when(F.col("documents").isNull(), "none").otherwise(F.col("method")).alias("method")]
    if "error" not in rows.columns:
        return rows.select(key).distinct().join(named, key, "left").select(key, *columns)
    # an error's place in the joined text is known before any is gathered, as with the texts
    wrong = rows.where("error is not null and coalesce(text, '') = ''").withColumn("_told", F.concat("name", F.lit(": "), "error"))
    at = F.coalesce(F.sum(F.length("_told") + 2).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = wrong.withColumn("_at", at).where("_at < 2000 + 2").groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, "_told"))).alias("_items"))
    errors = told.select(key, F.substring(F.array_join(F.transform("_items", lambda x: x["_told"]), "; "), 1, 2000).alias("errors"))
    status = F.when(F.col("documents").isNotNull(), "extracted").when(F.col("errors").isNotNull(), "failed").otherwise("empty")
    return rows.select(key).distinct().join(named, key, "left").join(errors, key, "left").select(key, *columns, "errors", status.alias("status"))
