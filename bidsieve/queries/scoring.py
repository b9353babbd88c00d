"""Criteria, their combination, and what follows from scores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import CODES, NOTICES, codes, notices, now, submissions
from ..functions import text as X
from ..operators import joins as J
from ..operators import scoring as S
from ..operators.shared import shared_folder
from ..registry import query
from ..sources.sinks import append_once, appended
from ..sources.tables import read
from .listing import KEYWORDS
from .duplicates import VECTOR
from .lookups import HISTORY
from .scalars import fold_sql
from .sqltext import AMOUNT, BUDGET, DAYS, DEADLINE, LOCATION, ORGANIZATION, PROCEDURE, SCORED, VALUES


def scored(spark: SparkSession, sf_dir: str, profile: S.Profile | None = None) -> DataFrame:
    return S.score_notices(notices(spark, sf_dir, costly=True), profile or S.Profile(), now())


@query(f"WITH {NOTICES} SELECT notice_id, {fold_sql('title')} || ' ' || {fold_sql('sector')} || ' ' || {fold_sql('buyer')} AS blob FROM notices")
def score_text_blob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(spark, sf_dir).select("notice_id", S.text_blob("title", "sector", "buyer").alias("blob"))


#: Fields of work over the documents' languages.
FIELDS = [("english", 1.0, ["the", "with"]), ("german", 0.95, ["der", "und die"]), ("french", 0.9, ["les", "que"]), ("licence", 0.8, ["published under creative commons licence"])]


@query(rf"""
WITH d AS (SELECT doc_id, {fold_sql('text')} AS f FROM documents), t(tid, profile, rank, weight, tf) AS (VALUES {', '.join(f"('t{i}', '{n}', {r}, {w}::DOUBLE, '{t}')" for i, (n, r, w, t) in enumerate((n, r, w, t) for r, (n, w, some) in enumerate(FIELDS) for t in some))}),
folded AS (SELECT 'd' || doc_id AS id, f FROM d UNION ALL SELECT tid, tf FROM t), {VECTOR},
s AS (SELECT a.id, b.id AS tid, greatest(0, least(1, sum(a.weight * b.weight))) AS near FROM vectors a JOIN vectors b ON a.term = b.term AND a.id[1] = 'd' AND b.id[1] = 't' GROUP BY 1, 2),
p AS (SELECT doc_id, f, profile, rank, weight * CASE WHEN bool_or(contains(' ' || f || ' ', ' ' || tf || ' ')) THEN 1 ELSE max(coalesce(near, 0)) END AS v FROM d CROSS JOIN t LEFT JOIN s ON s.id = 'd' || doc_id AND s.tid = t.tid GROUP BY doc_id, f, profile, rank, weight),
b AS (SELECT doc_id, f, max(v) AS v, arg_max(profile, (v, -rank)) AS profile FROM p GROUP BY 1, 2)
SELECT doc_id, CASE WHEN f = '' THEN NULL WHEN v < 0.15 THEN 0 ELSE round(v, 6) END::DOUBLE AS value, CASE WHEN f <> '' AND v > 0 THEN profile END AS profile FROM b""")
def score_field_of_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", X.fold(F.col("text")).alias("blob"))
    return rows.select("doc_id", S.field_score(F.col("blob"), FIELDS).alias("s")).select("doc_id", F.round("s.value", 6).alias("value"), "s.profile")


@query(f"WITH {NOTICES} SELECT notice_id, round({DEADLINE}, 6) AS value FROM notices")
def score_deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(spark, sf_dir).select("notice_id", F.round(S.deadline_score(S.days_until("deadline", now())), 6).alias("value"))


@query(rf"""
WITH f AS (SELECT doc_id, ' ' || {fold_sql('text')} || ' ' AS f FROM documents), s AS (SELECT doc_id, f, {' + '.join(f"CASE WHEN contains(f, ' {k} ') THEN {w}::DOUBLE ELSE 0 END" for k, w in KEYWORDS.items())} AS total FROM f)
SELECT doc_id, CASE WHEN trim(f) = '' THEN NULL WHEN contains(f, ' apache ') THEN 0 ELSE round(least(1, total / 6), 6) END::DOUBLE AS value, contains(f, ' apache ') AS veto FROM s""")
def score_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", X.fold(F.col("text")).alias("blob"))
    return rows.select("doc_id", S.keyword_score(F.col("blob"), KEYWORDS, ["Apache"]).alias("s")).select("doc_id", F.round("s.value", 6).alias("value"), "s.veto")


@query(f"WITH {NOTICES} SELECT notice_id, round({BUDGET}, 11) AS value FROM notices")
def score_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notices(spark, sf_dir)
    return rows.select("notice_id", F.round(S.CRITERIA["budget"](rows, S.Profile(), now()), 11).alias("value"))


@query(f"WITH {NOTICES} SELECT notice_id, {LOCATION} AS value FROM notices")
def score_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notices(spark, sf_dir)
    return rows.select("notice_id", S.CRITERIA["location"](rows, S.Profile(), now()).alias("value"))


@query(f"WITH {NOTICES} SELECT notice_id, {ORGANIZATION} AS value FROM notices")
def score_organization(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notices(spark, sf_dir)
    return rows.select("notice_id", S.CRITERIA["organization"](rows, S.Profile(), now()).alias("value"))


@query(f"""
WITH {CODES}, p(t) AS (VALUES {', '.join(f"('{c}')" for c in S.Profile().cpv)}), u AS (SELECT notice_id, unnest(cpv_codes) AS c FROM codes),
m AS (SELECT notice_id, max(CASE WHEN c = t THEN 8 WHEN c[1:7] = t[1:7] THEN 7 WHEN c[1:6] = t[1:6] THEN 6 WHEN c[1:5] = t[1:5] THEN 5 WHEN c[1:4] = t[1:4] THEN 4 WHEN c[1:3] = t[1:3] THEN 3 WHEN c[1:2] = t[1:2] THEN 2 ELSE 0 END) AS n FROM u, p GROUP BY 1)
SELECT notice_id, round(CASE WHEN n >= 2 THEN 0.4 + 0.6 * (n - 2) / 6.0 ELSE 0 END::DOUBLE, 6) AS value FROM m""")
def score_cpv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes(spark, sf_dir).select("notice_id", F.round(S.cpv_score(F.col("cpv_codes"), list(S.Profile().cpv)), 6).alias("value"))


@query(f"""
WITH {NOTICES}, {HISTORY}, j AS (SELECT notice_id, coalesce(bb.wins, bs.wins) AS w, coalesce(bb.decided, bs.decided) AS d FROM notices LEFT JOIN bb USING (buyer) LEFT JOIN bs USING (sector))
SELECT notice_id, CASE WHEN d IS NULL OR d = 0 THEN NULL WHEN d < 5 THEN 0.5 ELSE round(w / d::DOUBLE, 6) END::DOUBLE AS value FROM j""")
def score_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = J.win_history(notices(spark, sf_dir), submissions(spark, sf_dir).where("buyer <> 'Customer#000000003'"))
    return rows.select("notice_id", F.round(S.history_score(F.col("wins"), F.col("decided")), 6).alias("value"))


@query(f"WITH {NOTICES} SELECT notice_id, {PROCEDURE} AS value FROM notices")
def score_procedure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notices(spark, sf_dir)
    return rows.select("notice_id", S.CRITERIA["procurement_type"](rows, S.Profile(), now()).alias("value"))


@query(f"WITH {NOTICES}, {SCORED} SELECT notice_id, score FROM scored")
def combine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("notice_id", F.col("score"))


@query(f"WITH {NOTICES}, {SCORED} SELECT notice_id, CASE WHEN notice_id % 17 = 0 THEN 'out_of_scope' WHEN band = 'out_of_scope' THEN 'low_relevance' ELSE band END AS band FROM scored")
def score_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("notice_id", S.band(F.col("score"), veto=F.col("notice_id") % 17 == 0).alias("band"))


ENTRIES = f"""{NOTICES}, {SCORED}, e AS (SELECT notice_id, unnest([{', '.join(f"{{'criterion': '{k}', 'value': {v}, 'weight': {w}::DOUBLE}}" for k, v, w in VALUES)}], recursive := true) FROM scored)"""


_DAYS = f"floor({DAYS})::BIGINT"
_NAMED = " ".join(f"WHEN '{k.lower()}' THEN 'Preferred: {k}'" for k in S.Profile().locations)
_ORGANIZED = " ".join(f"WHEN '{k}' THEN 'Preferred: {k}'" for k in S.Profile().organizations)
_WORDS = "[x.k FOR x IN [" + ", ".join(f"{{'k': '{k}', 'h': contains(' ' || f || ' ', ' {k} ')}}" for k in sorted(S.Profile().keywords, key=lambda k: -S.Profile().keywords[k])) + "] IF x.h][1:5]"
_BARRED = "'Excluded: ' || " + " || ".join(f"'{k}'" for k in S.Profile().excluded)
#: Explanation and one fact of each criterion but the field of work, whose terms only the operator names.
_SAID = f"""CASE criterion WHEN 'deadline_proximity' THEN CASE WHEN deadline IS NULL THEN 'No deadline published' WHEN {DAYS} < 0 THEN 'Deadline has passed'
  ELSE {_DAYS} || ' days left: ' || CASE WHEN {DAYS} < 5 THEN 'too short' WHEN {DAYS} < 12 THEN 'tight' WHEN {DAYS} <= 45 THEN 'ideal' WHEN {DAYS} <= 180 THEN 'distant' ELSE 'beyond the horizon' END END
 WHEN 'budget' THEN CASE WHEN budget IS NULL THEN 'No budget published' ELSE floor({AMOUNT})::BIGINT || ': ' || CASE WHEN {AMOUNT} < 50000 THEN 'too small' WHEN {AMOUNT} < 250000 THEN 'modest' WHEN {AMOUNT} <= 5000000 THEN 'in range' WHEN {AMOUNT} <= 25000000 THEN 'large' ELSE 'too large to bid alone' END END
 WHEN 'keywords' THEN CASE WHEN veto THEN {_BARRED} WHEN len(words) > 0 THEN 'Keywords: ' || array_to_string(words, ', ') ELSE 'No keyword found' END
 WHEN 'location' THEN CASE lower(country) {_NAMED} ELSE 'Not among those preferred' END
 WHEN 'organization' THEN CASE buyer {_ORGANIZED} ELSE 'Not among those preferred' END END"""
_FACT = f"CASE criterion WHEN 'deadline_proximity' THEN {_DAYS}::VARCHAR WHEN 'budget' THEN floor({AMOUNT})::BIGINT::VARCHAR WHEN 'keywords' THEN nullif(array_to_string(words, ', '), '') WHEN 'location' THEN country WHEN 'organization' THEN buyer END"


@query(f"""
WITH {ENTRIES}, w AS (SELECT s.*, {_WORDS} AS words FROM scored s JOIN blobs_ USING (notice_id))
SELECT notice_id, criterion, round_even(e.value, 4) AS value, weight, TRUE AS applicable, {_SAID} AS explanation, {_FACT} AS fact FROM e JOIN w USING (notice_id)""")
def score_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per criterion of each notice: what it adds, why, and the fact behind it (for the field of work in `explain` alone)."""
    rows = S.score_notices(notices(spark, sf_dir, costly=True), S.Profile(), now(), explain=True).select("notice_id", F.explode("breakdown").alias("criterion", "b"))
    fact = F.coalesce(*(F.col("b.details")[k] for k in ("days", "amount", "keywords", "stated")))
    return rows.select("notice_id", "criterion", "b.value", "b.weight", "b.applicable", F.when(F.col("criterion") != "field_of_work", F.col("b.explanation")).alias("explanation"), fact.alias("fact"))


@query(f"WITH {ENTRIES} SELECT notice_id, string_agg(criterion, ' > ' ORDER BY round_even(value * weight, 4) DESC, criterion) AS explanation FROM e GROUP BY 1")
def explain_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.transform(F.map_entries("breakdown"), lambda e: F.struct((-e["value"]["weighted"]).alias("w"), e["key"].alias("criterion")))
    return scored(spark, sf_dir).select("notice_id", F.array_join(F.transform(F.array_sort(entries), lambda x: x["criterion"]), " > ").alias("explanation"))


@query(f"""
WITH {NOTICES}, v AS (SELECT notice_id, {DEADLINE} AS a, CASE WHEN notice_id % 3 <> 0 AND notice_id % 5 <> 0 THEN 0.5::DOUBLE END AS b FROM notices)
SELECT notice_id, round(CASE WHEN b IS NULL THEN a ELSE (a * 0.6::DOUBLE + b * 0.4::DOUBLE) / (0.6::DOUBLE + 0.4::DOUBLE) END, 4) AS score, b IS NULL AS failed FROM v""")
def criterion_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A criterion that divides by zero or gives nonsense is left out; the rest still scores."""
    bad = F.when(F.col("notice_id") % 3 == 0, F.try_divide(F.lit(1.0), F.lit(0.0))).when(F.col("notice_id") % 5 == 0, F.lit("oops").try_cast("double")).otherwise(0.5)
    rows = notices(spark, sf_dir).select("notice_id", S.deadline_score(S.days_until("deadline", now())).alias("a"), S.isolated(bad).alias("b"))
    return rows.select("notice_id", F.round(S.combined({"a": F.col("a"), "b": F.col("b")}, {"a": 0.6, "b": 0.4}), 4).alias("score"), F.col("b").isNull().alias("failed"))


@query(f"""
WITH {NOTICES}, {SCORED}, h AS (SELECT notice_id, '2026.3' AS version, score, 1 AS run FROM scored UNION ALL SELECT notice_id, '2026.4', round(v_deadline, 6), 2 FROM scored WHERE notice_id % 2 = 0)
SELECT notice_id, arg_max(version, run) AS version, arg_max(score, run) AS score, count(*) AS runs FROM h GROUP BY 1""")
def score_history_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scoring runs appended to one history, the second of them twice; the newest is current."""
    second = S.Profile(version="2026.4", weights={"deadline_proximity": 1.0})
    folder, columns = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}", ["notice_id", "profile_version", "score", "run"]
    first, again = scored(spark, sf_dir).withColumn("run", F.lit(1)).select(columns), scored(spark, sf_dir, second).where("notice_id % 2 = 0").withColumn("run", F.lit(2)).select(columns)
    for rows, batch in ((first, "run-1"), (again, "run-2"), (again, "run-2")):
        append_once(rows, folder, batch)
    runs = appended(spark, folder, first.schema)
    current = F.max_by(F.struct("profile_version", "score"), "run").alias("c")
    return runs.groupBy("notice_id").agg(current, F.count("*").alias("runs")).select("notice_id", F.col("c.profile_version").alias("version"), F.col("c.score").alias("score"), "runs")


@query(f"WITH {NOTICES}, {SCORED} SELECT notice_id, round(v_deadline, 6) AS score FROM scored WHERE band = 'relevant' ORDER BY publication DESC, notice_id DESC LIMIT 200")
def rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest notices of a band, scored again by changed weights."""
    newest = scored(spark, sf_dir).where("band = 'relevant'").orderBy(F.desc("publication"), F.desc("notice_id")).limit(200)
    again = S.score_notices(newest.drop("score", "band", "breakdown", "profile_version"), S.Profile(weights={"deadline_proximity": 2.0}), now())
    return again.select("notice_id", F.col("score"))


@query(f"WITH {NOTICES}, {SCORED} SELECT notice_id, score FROM scored WHERE score >= 0.2 AND notice_id % 3 <> 0 AND zone <> 'AFRICA' ORDER BY scored.score DESC NULLS LAST, notice_id LIMIT 300")
def enrichment_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices worth fetching in full: scored, not enriched yet, from a source with details; best first."""
    rows = scored(spark, sf_dir).withColumn("enriched", F.col("notice_id") % 3 == 0).withColumn("details", F.col("zone") != "AFRICA")
    chosen = rows.where((F.col("score") >= 0.2) & ~F.col("enriched") & F.col("notice_id").isNotNull() & F.col("details"))
    return chosen.orderBy(F.desc_nulls_last("score"), "notice_id").limit(300).select("notice_id", F.col("score"))


@query(f"WITH {NOTICES} SELECT notice_id, round((({DEADLINE}) * 0.22::DOUBLE + least(1.0, length(title) / 40.0::DOUBLE) * 0.5::DOUBLE) / (0.22::DOUBLE + 0.5::DOUBLE), 6) AS score FROM notices")
def register_criterion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A criterion of one's own joins by name; weights of unknown names are skipped."""
    S.criterion("title_length")(lambda rows, profile, clock: F.least(F.lit(1.0), F.length("title") / F.lit(40.0)))
    return scored(spark, sf_dir, S.Profile(weights={"deadline_proximity": 0.22, "title_length": 0.5, "no_such_criterion": 3.0})).select("notice_id", F.col("score"))
