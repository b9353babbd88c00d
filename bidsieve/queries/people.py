"""CVs and notifications. The general tables' prose has no CV wording, so documents are given some lines of it by their id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import NOTICES
from ..operators import cv as C
from ..operators import notify as N
from ..operators.shared import durable
from ..registry import query
from ..sources.tables import read
from .scoring import scored
from .sqltext import SCORED

TODAY = "2026-01-01"


def cvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CV per document: experience, languages and certifications that follow from the id, then the whole text as its summary."""
    line = lambda when, text: F.expr(f"case when {when} then {text} end")
    parts = [
        F.lit("Work experience"), line("doc_id % 3 = 0", "concat('Over ', doc_id % 20, ' years of experience')"), line("doc_id % 3 = 1", "concat('01/', 2000 + doc_id % 10, ' - 01/', 2003 + doc_id % 10)"),
        line("doc_id % 3 = 1", "concat('06/', 2001 + doc_id % 10, ' - 01/', 2008 + doc_id % 10)"), line("doc_id % 7 = 0", "concat('Age: ', 20 + doc_id % 40)"), F.lit("Languages"), line("doc_id % 2 = 0", "'English'"), line("doc_id % 5 = 0", "'French (in progress)'"),
        F.lit("Certifications"), line("doc_id % 4 = 0", "'PMP'"), F.lit("Education"), line("doc_id % 6 < 3", "'Master'"), F.lit("Summary"), F.col("text"),
    ]
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("cv_id"), F.concat_ws("\n", *parts).alias("text"))


@query("""
WITH l AS (SELECT doc_id AS cv_id, [6 + CASE WHEN doc_id % 3 = 1 THEN 2 WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END + (doc_id % 7 = 0)::INT + (doc_id % 2 = 0)::INT + (doc_id % 5 = 0)::INT + (doc_id % 4 = 0)::INT + (doc_id % 6 < 3)::INT - 1][1] AS fixed FROM documents)
SELECT cv_id, fixed + coalesce(len([x FOR x IN string_split(text, chr(10)) IF trim(x) <> '']), 0) AS lines, 5 AS sections FROM l JOIN documents ON doc_id = cv_id""")
def cv_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sections(cvs(spark, sf_dir)).groupBy("cv_id").agg(F.count("*").alias("lines"), F.count_distinct("section").alias("sections"))


@query("""
SELECT doc_id AS cv_id, CASE WHEN doc_id % 2 = 0 THEN 'pass' ELSE 'unknown' END AS english, CASE WHEN doc_id % 4 = 0 THEN 'pass' ELSE 'unknown' END AS pmp, CASE WHEN doc_id % 6 < 3 THEN 'pass' ELSE 'unknown' END AS master, 'unknown' AS french FROM documents""")
def cv_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """French is only in progress, which leaves it unknown."""
    found = C.facts(C.sections(cvs(spark, sf_dir)), [("languages", "Anglais"), ("languages", "Français"), ("certifications", "PMP"), ("education", "Master")])
    one = lambda label, name: F.max(F.when(F.col("label") == label, F.col("status"))).alias(name)
    return found.groupBy("cv_id").agg(one("Anglais", "english"), one("PMP", "pmp"), one("Master", "master"), one("Français", "french"))


@query("SELECT doc_id AS cv_id, (doc_id % 20)::DOUBLE AS stated, TRUE AS lower_bound FROM documents WHERE doc_id % 3 = 0")
def cv_experience_stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stated_experience(C.sections(cvs(spark, sf_dir))).select("cv_id", "stated", "lower_bound")


@query("SELECT doc_id AS cv_id, 8.0 AS dated FROM documents WHERE doc_id % 3 = 1")
def cv_experience_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dated_experience(C.sections(cvs(spark, sf_dir)), TODAY)


@query("SELECT doc_id AS cv_id, 20 + doc_id % 40 AS age FROM documents WHERE doc_id % 7 = 0")
def cv_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ages(C.sections(cvs(spark, sf_dir)), TODAY)


VERDICT = """v AS (SELECT doc_id AS cv_id, (doc_id % 2 = 0)::INT + (doc_id % 4 = 0)::INT + (doc_id % 6 < 3)::INT + CASE WHEN doc_id % 3 = 0 THEN (doc_id % 20 >= 5)::INT WHEN doc_id % 3 = 1 THEN 1 ELSE 0 END + (doc_id % 7 = 0 AND 20 + doc_id % 40 BETWEEN 25 AND 45)::INT AS confirmed,
  doc_id % 7 = 0 AND NOT 20 + doc_id % 40 BETWEEN 25 AND 45 AS failed, CASE WHEN doc_id % 3 = 0 THEN doc_id % 20 WHEN doc_id % 3 = 1 THEN 8 END::DOUBLE AS years FROM documents),
s AS (SELECT cv_id, CASE WHEN failed THEN 'fail' WHEN confirmed = 5 THEN 'pass' ELSE 'unknown' END AS status, confirmed, years FROM v)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.verdicts(cvs(spark, sf_dir), TODAY, min_years=5, age=(25, 45), languages=["Anglais"], certifications=["PMP"], education=["Licence", "Master"])


@query(f"WITH {VERDICT} SELECT cv_id, status, confirmed, years FROM s")
def cv_filter_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("cv_id", "status", F.col("confirmed").cast("long").alias("confirmed"), "years")


@query("""
SELECT doc_id AS cv_id, criterion, requested, status, observed, evidence, reason FROM (
  SELECT doc_id, 'experience' AS criterion, '5 years at least' AS requested, CASE WHEN doc_id % 3 = 2 THEN 'unknown' WHEN doc_id % 3 = 1 OR doc_id % 20 >= 5 THEN 'pass' ELSE 'unknown' END AS status, CASE doc_id % 3 WHEN 0 THEN (doc_id % 20) || '.0' WHEN 1 THEN '8.0' END AS observed,
    CASE doc_id % 3 WHEN 0 THEN 'Over ' || doc_id % 20 || ' years of experience' WHEN 1 THEN '01/' || 2000 + doc_id % 10 || ' - 01/' || 2003 + doc_id % 10 || '|06/' || 2001 + doc_id % 10 || ' - 01/' || 2008 + doc_id % 10 ELSE '' END AS evidence,
    ['stated_lower_bound', 'dates_lower_bound', 'unavailable'][doc_id % 3 + 1] AS reason FROM documents
  UNION ALL SELECT doc_id, 'languages', 'Français', 'unknown', NULL, CASE WHEN doc_id % 5 = 0 THEN 'French (in progress)' ELSE '' END, CASE WHEN doc_id % 5 = 0 THEN 'doubtful' ELSE 'not_found' END FROM documents
  UNION ALL SELECT doc_id, 'certifications', 'PMP', CASE WHEN doc_id % 4 = 0 THEN 'pass' ELSE 'unknown' END, NULL, CASE WHEN doc_id % 4 = 0 THEN 'PMP' ELSE '' END, CASE WHEN doc_id % 4 = 0 THEN 'found' ELSE 'not_found' END FROM documents)""")
def cv_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each check of a CV has found, with the lines that say so."""
    rows = C.evaluated(cvs(spark, sf_dir), TODAY, min_years=5, languages=["Français"], certifications=["PMP"])
    return rows.select("cv_id", F.explode("checks").alias("c")).select("cv_id", "c.criterion", "c.requested", "c.status", "c.observed", F.array_join("c.evidence", "|").alias("evidence"), "c.reason")


@query(f"""
WITH {VERDICT}, r AS (SELECT *, row_number() OVER (ORDER BY CASE status WHEN 'pass' THEN 1 WHEN 'unknown' THEN 2 ELSE 3 END, confirmed DESC, cv_id % 10 DESC, cv_id) AS position FROM s)
SELECT cv_id, status, position, (SELECT count(*) FROM s WHERE status = 'pass') AS total_pass, (SELECT count(*) FROM s WHERE status = 'unknown') AS total_unknown, (SELECT count(*) FROM s WHERE status = 'fail') AS total_fail FROM r WHERE position <= 50""")
def cv_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = durable(judged(spark, sf_dir)).withColumn("confirmed_ratio", F.col("confirmed") / F.col("asked")).withColumn("score", F.col("cv_id") % 10)
    return C.rank(rows, 50).select("cv_id", "status", F.col("position").cast("long").alias("position"), "total_pass", "total_unknown", "total_fail")


@query("""
SELECT doc_id, CASE WHEN doc_id % 10 < 3 THEN 'experience' WHEN lang = 'de' THEN 'languages' WHEN doc_id % 4 = 0 THEN 'education' END AS rejected_by FROM documents""")
def profile_filter_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 10).alias("years"), F.when(F.col("lang") != "es", F.array("lang")).alias("languages"), F.expr("case when doc_id % 4 = 0 then array('BTS') when doc_id % 4 = 1 then array() else array('Master', 'BTS') end").cast("array<string>").alias("education"))
    return C.profile_any(rows, ["en", "fr"], 3, ["Master"]).select("doc_id", "rejected_by")


@query("""
SELECT event_id, CASE WHEN user_id BETWEEN 16 AND 75 THEN user_id END::INT AS age, CASE WHEN event_id % 80 <= 50 THEN event_id % 80 END::INT AS years, event_type || '|python' AS skills FROM events""")
def profile_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.expr("""concat('{"age": "', user_id, '", "years": ', event_id % 80, ', "skills": ["', event_type, '", "', event_type, '", {"label": "python"}, "', repeat('x', 130), '", " "]}')""")
    return read(spark, sf_dir, "events").select("event_id", C.clean_profile(body).alias("p")).select("event_id", "p.age", "p.years", F.array_join("p.skills", "|").alias("skills"))


#: The candidates that are compared.
COMPARED = (4, 5, 8, 9)
_COMPARED = ", ".join(f"max(value) FILTER (doc_id = {i}) AS \"{i}\"" for i in COMPARED)


@query(f"""
WITH c AS (SELECT doc_id, (doc_id % 4 = 0)::INT AS sure, CASE doc_id % 3 WHEN 0 THEN (doc_id % 20 >= 5)::INT WHEN 1 THEN 1 ELSE 0 END AS long, lang = 'en' AS en FROM documents WHERE doc_id IN {COMPARED}),
f AS (SELECT doc_id, 'confirmed' AS field, floor((sure + long) / 2 * 100 + 0.5)::BIGINT::VARCHAR AS value FROM c UNION ALL SELECT doc_id, 'checks', (sure + long) || '/' || (2 - sure - long) || '/0' FROM c
  UNION ALL SELECT doc_id, 'score', (doc_id % 10 * 10)::VARCHAR FROM c UNION ALL SELECT doc_id, 'skills', CASE WHEN en THEN 'english' END FROM c
  UNION ALL SELECT doc_id, 'certifications', CASE WHEN sure = 1 THEN 'PMP' END FROM c)
SELECT field, {_COMPARED} FROM f GROUP BY 1""")
def cv_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four candidates side by side; the twin has the fields that follow from the lines added by id."""
    rows = C.evaluated(cvs(spark, sf_dir), TODAY, min_years=5, certifications=["PMP"])
    skills = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("cv_id"), (F.col("doc_id") % 10 / 10).alias("score"), *(F.when(known, F.array(F.lit("english"))).otherwise(F.array().cast("array<string>")).alias(n) for n, known in (("matched", F.col("lang") == "en"), ("missing", F.col("lang") != "en"))))
    return C.compare(rows.join(skills, "cv_id"), [str(i) for i in COMPARED]).where(F.col("field").isin("confirmed", "checks", "score", "skills", "certifications"))


def preferences(spark: SparkSession) -> DataFrame:
    """A configuration table of users; the driver has no such table."""
    rows = [
        ("u1", True, "low_relevance", None, None, [], [], [], [], [], ["in_app", "email", "fax"], "u1@example.org", "immediate"),
        ("u2", True, "relevant", 0.55, 1000.0, ["low"], ["China"], [], [], [], ["email"], "u2@example.org", "daily"),
        ("u3", True, "low_relevance", None, None, [], [], ["Building"], [], ["urgent", "high"], [], None, "immediate"),
        ("u4", False, "low_relevance", None, None, [], [], [], [], [], ["in_app"], None, "immediate"),
    ]
    return spark.createDataFrame(rows, N.PREFERENCES)


PREFS = """r AS (SELECT *, CASE band WHEN 'highly_relevant' THEN 3 WHEN 'relevant' THEN 2 WHEN 'out_of_scope' THEN -1 ELSE 1 END AS b, lower(title) AS t FROM scored),
m AS (SELECT notice_id, title, buyer, country, zone, deadline, score, band, b, 'u1' AS user_id, CASE WHEN b < 0 THEN 'out_of_scope' END AS rejected_by FROM r
  UNION ALL SELECT notice_id, title, buyer, country, zone, deadline, score, band, b, 'u2', CASE WHEN b < 0 THEN 'out_of_scope' WHEN b < 2 THEN 'below_relevance_floor' WHEN score < 0.55 THEN 'below_score_floor' WHEN budget < 1000 THEN 'below_budget_floor' WHEN contains(t, 'low') THEN 'excluded_keyword' WHEN country <> 'CHINA' THEN 'country_mismatch' END FROM r
  UNION ALL SELECT notice_id, title, buyer, country, zone, deadline, score, band, b, 'u3', CASE WHEN b < 0 THEN 'out_of_scope' WHEN sector <> 'BUILDING' THEN 'sector_mismatch' WHEN NOT (contains(t, 'urgent') OR contains(t, 'high')) THEN 'keyword_mismatch' END FROM r
  UNION ALL SELECT notice_id, title, buyer, country, zone, deadline, score, band, b, 'u4', 'inactive_user' FROM r)"""


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.targets(scored(spark, sf_dir), preferences(spark))


@query(f"WITH {NOTICES}, {SCORED}, {PREFS} SELECT user_id, notice_id, rejected_by FROM m")
def match_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(spark, sf_dir).select("user_id", "notice_id", "rejected_by")


@query(f"WITH {NOTICES}, {SCORED}, {PREFS} SELECT user_id, notice_id, band, CASE WHEN user_id = 'u2' THEN country END AS country FROM m WHERE rejected_by IS NULL")
def notify_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(spark, sf_dir).where("rejected_by is null").withColumn("why", N.reasons()).select("user_id", "notice_id", F.col("why")["band"].alias("band"), F.col("why")["country"].alias("country"))


@query(f"WITH {NOTICES}, {SCORED}, {PREFS} SELECT user_id, notice_id, 'in_app' AS channel FROM m WHERE rejected_by IS NULL AND user_id IN ('u1', 'u3') UNION ALL SELECT user_id, notice_id, 'email' FROM m WHERE rejected_by IS NULL AND user_id = 'u1' AND b >= 2")
def notify_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.fanout(matched(spark, sf_dir).where("rejected_by is null")).select("user_id", "notice_id", "channel")


@query(f"""
WITH {NOTICES}, {SCORED}, {PREFS} SELECT notice_id, '[' || CASE band WHEN 'relevant' THEN 'Relevant' WHEN 'highly_relevant' THEN 'Highly Relevant' WHEN 'out_of_scope' THEN 'Out Of Scope' ELSE 'Low Relevance' END || '] ' || title AS subject,
  CASE WHEN notice_id % 5 = 0 THEN '' ELSE title || chr(10) || chr(10) || 'Buyer: ' || buyer || chr(10) || 'Country: ' || country || chr(10) || 'Deadline: ' || coalesce(strftime(deadline, '%d/%m/%Y'), 'unpublished') || chr(10) END || 'Source: ' || zone AS body FROM m WHERE user_id = 'u1'""")
def notify_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matched(spark, sf_dir).where("user_id = 'u1'").withColumn("score", F.when(F.col("notice_id") % 5 != 0, F.col("score")))
    # the score's two decimals are left out: engines round halves differently
    return rows.select("notice_id", N.rendered().alias("r")).select("notice_id", "r.subject", F.rtrim(F.regexp_replace("r.body", r"Score: [^\n]*\n", ""), F.lit("\n")).alias("body"))


@query("""
WITH e AS (SELECT user_id, event_id, value, date_trunc('day', ts::TIMESTAMP) AS window_start, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts::TIMESTAMP) ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type <> 'error')
SELECT user_id, window_start, count(*) AS items, string_agg(event_id::VARCHAR, ',' ORDER BY value DESC, event_id) AS item_ids FROM e WHERE r <= 25 AND NOT (user_id % 3 = 0 AND window_start = TIMESTAMP '2024-01-05') GROUP BY 1, 2""")
def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").where("event_type <> 'error'").select("user_id", F.col("event_id").alias("item_id"), F.col("value").alias("score"), F.col("ts").cast("timestamp").alias("ts"))
    sent = rows.where("user_id % 3 = 0").select("user_id").distinct().withColumn("window_start", F.lit("2024-01-05 00:00:00").cast("timestamp"))
    return N.digests(rows, sent).select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "items", F.array_join("item_ids", ",").alias("item_ids"))
