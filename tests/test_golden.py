"""Expected values of single functions and rules."""

from __future__ import annotations

import datetime as dt
import io
import zipfile

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bidsieve.functions import nested
from bidsieve.functions import text as X
from bidsieve.functions import url as U
from bidsieve.operators import aggregates as A
from bidsieve.operators import cv as C
from bidsieve.operators import filters as L
from bidsieve.operators import joins as J
from bidsieve.operators import scoring as S
from bidsieve.operators import similarity as V
from bidsieve.operators import staffing as T
from bidsieve.operators import windows as W
from bidsieve.sources import extract as E
from bidsieve.sources import sinks, tables


def one(spark, make, *values):
    columns = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{c} string" for c in columns))
    return df.select(make(*map(F.col, columns)).alias("x")).first().x


@pytest.mark.parametrize("url, want", [
    ("https://Portal.Example.TN:443/avis/12?utm_source=mail&sessionid=abc&ref=42#section-2", "https://portal.example.tn/avis/12"),
    ("http://u:p@a.org/x/?b=2&a=1&utm_source=x", "http://a.org/x?a=1&b=2"),
    ("https://app.example.org/#/announce/55", "https://app.example.org/#/announce/55"),
    ("", ""),
])
def test_canonical_url(spark, url, want):
    got = one(spark, U.canonical, url)
    assert got == want
    assert one(spark, U.canonical, got) == got


@pytest.mark.parametrize("text, amount, code", [("1 250 000,000 TND", 1250000, "TND"), ("2,5 millions EUR", 2500000, "EUR"), ("450 000 €", 450000, "EUR"), ("THE AND FOR", None, None), (None, None, None)])
def test_money(spark, text, amount, code):
    got = one(spark, X.money, text)
    assert (None if got is None else float(got)) == amount
    assert one(spark, X.currency, text) == code


def test_money_us(spark):
    assert float(one(spark, lambda c: X.money(c, ".", ","), "1,250,000.50")) == 1250000.5


@pytest.mark.parametrize("text, want", [("15 janvier 2026", dt.datetime(2026, 1, 15)), ("15 January 2026", dt.datetime(2026, 1, 15)), ("bientôt", None), ("", None), (None, None)])
def test_date(spark, text, want):
    assert one(spark, lambda c: X.timestamp(c).cast("timestamp_ntz"), text) == want


def test_date_in_a_zone(spark):
    assert one(spark, lambda c: X.timestamp(c, ["dd/MM/yyyy"], "Africa/Tunis").cast("timestamp_ntz"), "28/08/2026") == dt.datetime(2026, 8, 27, 23)


def test_ranking_demo(spark):
    posting = "Python developer building REST APIs with SQL and Docker."
    rows = spark.createDataFrame([(1, posting)], "id long, text string")
    assert V.lexical_vectors(rows, "id", "text").where("weight < 0").count() > 0  # a run seen once weighs less than nothing
    assert one(spark, lambda c: T.mixed_score(F.lit(0.5034), T.coverage(X.fold(c), ["Python", "SQL", "Docker"])), posting) == pytest.approx(0.6275, abs=1e-4)
    assert one(spark, lambda c: T.mixed_score(F.lit(0.1637), T.coverage(X.fold(c), ["Python", "SQL", "Docker"])), "python sql") == pytest.approx(0.2895, abs=1e-4)


@pytest.mark.parametrize("days, low, high", [(25, 1, 1), (2, 0, 0.2), (120, 0.3, 0.99), (-5, 0, 0), (None, 0.2, 0.6)])
def test_deadline_curve(spark, days, low, high):
    assert low <= one(spark, lambda c: S.deadline_score(c.cast("double")), None if days is None else str(days)) <= high


@pytest.mark.parametrize("score, want", [(0.95, "highly_relevant"), (0.75, "highly_relevant"), (0.6, "relevant"), (0.5, "relevant"), (0.2, "low_relevance")])
def test_bands(spark, score, want):
    assert one(spark, lambda c: S.band(c.cast("double")), str(score)) == want


def test_cv_evidence(spark):
    cvs = spark.createDataFrame([
        ("full", "7 ans d'expérience\nLangues\nFrançais, Anglais C1\nCertifications\nPMP\nITIL\nFormation\nMaster"),
        ("half", "Languages: French\nCertifications: PMP"),
        ("doubt", "Certifications: PMP in progress"),
        ("clash", "5 years of experience\n3 years of experience"),
        ("dated", "Education\n2010 - 2016\nExperience\n01/2020 - 01/2023 A\n01/2022 - 01/2024 B"),
        ("bare", "Experience\n2020 - 2024 Engineer"),
        ("named", "Experience\nJanvier 2020 - December 2024"),
        ("none", None),
        ("sans", "10 ans d'experience sans interruption\nCertifications\nAucun PMP\nPMI-ACP\nAZ-900\nFormation\nBac+5\nBTS"),
        ("seeks", "Recherche: 4 years of experience required"),
        ("lower", "More than 6,5 years of professional experience"),
    ], "cv_id string, text string")
    lined = C.sections(cvs)
    status = {(r.cv_id, r.label): r.status for r in C.facts(lined).collect()}
    assert status["full", "PMP"] == status["full", "Anglais"] == status["full", "Master"] == status["half", "PMP"] == "pass"
    assert status["half", "Anglais"] == status["doubt", "PMP"] == "unknown"
    stated = {r.cv_id: r.stated for r in C.stated_experience(lined).collect()}
    assert stated["full"] == 7 and stated["clash"] is None and stated["sans"] == 10 and stated["lower"] == 6.5 and "seeks" not in stated
    assert status["sans", "PMP"] == "unknown" and status["sans", "PMI-ACP"] == status["sans", "Azure Fundamentals"] == status["sans", "Bac+5"] == status["sans", "BTS"] == "pass"
    dated = {r.cv_id: round(r.dated, 2) for r in C.dated_experience(lined, "2026-01-01").collect()}
    assert dated == {"dated": 4.0, "bare": 3.08, "named": 4.92}


def test_half_open_breaker_stays_stuck():
    runs = pd.DataFrame({"seconds": [0.0, 1, 2, 3, 4, 700, 701, 1000, 7000], "failed": [True] * 5 + [False] * 4})
    states = W.circuit_states(runs, 5, 600, 1, 2, 6000)
    assert states == ["closed"] * 5 + ["half_open", "half_open_refused", "half_open_refused", "closed"]
    assert W.circuit_states(runs, 5, 600, 2, 2, 6000)[7] == "closed"


def test_write_partitioned(spark, tmp_path):
    rows = spark.createDataFrame([(1, dt.date(2024, 1, 5)), (2, dt.date(2024, 2, 1))], "id long, day date")
    sinks.write_days(rows, str(tmp_path / "out"), "day")
    assert (tmp_path / "out/y=2024/m=01/d=05").is_dir()
    sinks.write_days(spark.createDataFrame([(3, dt.date(2024, 2, 1)), (4, None)], "id long, day date"), str(tmp_path / "out"), "day")
    back = sinks.read_days(spark, str(tmp_path / "out"), rows.schema)
    assert sorted((r.id, r.y, r.m, r.d) for r in back.collect()) == [(1, "2024", "01", "05"), (3, "2024", "02", "01"), (4, None, None, None)]
    plan = back.where("y = '2024' and m = '02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(y" in plan and "PushedFilters: []" in plan


def test_a_batch_counts_once(spark, tmp_path):
    rows, path = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), str(tmp_path / "t")
    for batch, part in (("x", rows), ("y", rows.where("id = 1")), ("x", rows), ("y", rows.where("id = 9"))):
        sinks.append_once(part, path, batch)
    table = sinks.appended(spark, path, rows.schema)
    assert sorted(map(tuple, table.collect())) == [(1, "a", "x"), (1, "a", "y"), (2, "b", "x")]
    assert "PartitionFilters: [isnotnull(batch" in table.where("batch = 'x'")._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        sinks.append_once(rows, path, "../x")


def test_csv_with_rejects(spark, tmp_path):
    made = [(1, 'line\nbreak, "quoted"\r\n', "en"), (2, None, ""), (3, "", None), (4, "\\ back\\N", "x")]
    sinks.write_csv(spark.createDataFrame(made, "id long, text string, lang string"), str(tmp_path / "a"))
    rows, rejects = sinks.read_csv(spark, str(tmp_path / "a"), "id long, text string, lang string")
    assert sorted(map(tuple, rows.collect()), key=repr) == sorted(made, key=repr) and rejects.count() == 0
    (tmp_path / "b.csv").write_text('id,text,lang\n1,"a",en\nx,"b",en\n3,"c"\n4,"d",en,more\n\\N,"e",fr\n')
    rows, rejects = sinks.read_csv(spark, str(tmp_path / "b.csv"), "id long, text string, lang string")
    assert sorted(map(tuple, rows.collect()), key=repr) == [(1, "a", "en"), (None, "e", "fr")]
    assert sorted(r.line for r in rejects.collect()) == ['3,"c"', '4,"d",en,more', 'x,"b",en']


def test_json_is_masked_at_any_depth(spark):
    body = '{"a": [{"Password": "x", "b": {"api_key": [1, {"c": 2}]}}], "token": {"n": 1}, "é": null}'
    rows = spark.createDataFrame([(body,), ("{broken",), (None,)], "body string").select(nested.redact_json("body").alias("b"))
    assert [r.b for r in rows.collect()] == ['{"a": [{"Password": "***redacted***", "b": {"api_key": ["***redacted***", {"c": 2}]}}], "token": {"n": 1}, "é": null}', None, None]


def test_files_are_scanned_and_told_apart(spark, tmp_path):
    def container(*names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, "x" * 100)
        return out.getvalue()

    office = "application/vnd.openxmlformats-officedocument."
    cases = {
        "a.docx": (container("word/document.xml"), office + "wordprocessingml.document"), "b.xlsx": (container("xl/workbook.xml"), office + "spreadsheetml.sheet"), "c.pptx": (container("ppt/presentation.xml"), office + "presentationml.presentation"),
        "d.odt": (container("content.xml", "META-INF/manifest.xml"), "application/vnd.oasis.opendocument.text"), "e.zip": (container("content.xml"), "application/zip"), "f.zip": (container("word/document.xml")[:-30], "application/zip"),
        "g.txt": ("é".encode(), "text/plain"), "h.bin": (b"\xff\xfe\x00", "application/octet-stream"), "i.htm": (b"  \n<!-- x --><HTML>", "text/html"), "k.pdf": (b"%PDF-1.7", "application/pdf"),
    }
    (tmp_path / "in/deep").mkdir(parents=True)
    for i, (name, (data, _)) in enumerate(cases.items()):
        (tmp_path / "in" / ("deep" if i % 2 else "") / name).write_bytes(data)
    (tmp_path / "in/large.txt").write_bytes(b"x" * 2000)
    found = E.scan_files(spark, str(tmp_path / "in"), limit=1000).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content", E.triaged(F.col("content")).alias("kind"))
    got = {r.name: r for r in found.collect()}
    assert {n: got[n].kind for n in cases} == {n: kind for n, (_, kind) in cases.items()}
    assert got["large.txt"].content is None and len(got) == len(cases) + 1
    assert E.scan_files(spark, str(tmp_path / "in"), "*.docx").count() == 1


def test_fold_everything_agrees(spark, small):
    docs = tables.read(spark, small, "documents").select(X.fold(F.col("text")).alias("a"), X.fold_everything(F.col("text")).alias("b"))
    assert docs.where("a <> b").count() == 0


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aéß, .-_1\n", max_size=20), min_size=1, max_size=5))
def test_fold_is_idempotent(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(X.fold(F.col("t")).alias("f"))
    assert df.where(F.col("f") != X.fold(F.col("f"))).count() == 0


@pytest.mark.parametrize("text, want", [("Ｆｕｌｌ－ｗｉｄｔｈ", "full width"), ("ﬁn ﬂux Ǆ", "fin flux dz"), ("Άλφα", "αλφα"), ("ؤمن", "ومن"), ("x²", "x2")])
def test_fold_beyond_latin(spark, text, want):
    assert one(spark, X.fold, text) == want == one(spark, X.fold_everything, text)


@pytest.mark.parametrize("url, want", [("http://[::1]/x", "private"), ("http://[fe80::1]/", "private"), ("http://[fc00::2]:80/", "private"), ("http://0.1.2.3/", "private"), ("http://[2001:db8::1]/x", None), ("http://a.org/0.1", None), ("ftp://a.org", "scheme"), ("http:///x", "host")])
def test_url_guard(spark, url, want):
    assert one(spark, U.guarded, url) == want


def test_nested_paths_are_mapped(spark):
    body = '{"data": {"notice": {"titre": "x", "lots": [{"montant": 1}, {"montant": 2}]}}, "buyer_name": "y"}'
    rows = spark.createDataFrame([(body,), (body,), (None,), ("[1, 2]",)], "body string")
    counts = {r.path: r["count"] for r in E.json_paths(rows, "body").groupBy("path").count().collect()}
    assert counts == {"data": 2, "data.notice": 2, "data.notice.titre": 2, "data.notice.lots": 2, "data.notice.lots.montant": 4, "buyer_name": 2}
    # lists are not entered, so there is no amount
    found = {r.field: (r.path, round(r.score, 4), r.seen) for r in E.field_mapping(rows, "body").collect()}
    assert found == {"title": ("data.notice.titre", 0.95, 2), "buyer": ("buyer_name", 0.7, 2)}


def test_fields_choose_in_turn(spark):
    """Each path goes to one field; a field whose best path is taken gets the next one."""

    def mapped(*bodies):
        return {r.field: (r.path, round(r.score, 4)) for r in E.field_mapping(spark.createDataFrame([(b,) for b in bodies], "body string"), "body").collect()}

    hints = {"title": ["name"], "buyer": ["name", "organization"]}
    got = {r.field: r.path for r in E.field_mapping(spark.createDataFrame([('{"name": "x", "organization_name": "y"}',)], "body string"), "body", hints).collect()}
    assert got == {"title": "name", "buyer": "organization_name"}
    assert mapped('{"buyer": {"name": "x"}, "id": 4}') == {"external_id": ("id", 1.0), "title": ("buyer.name", 0.75)}
    assert mapped('{"titre_b": "x", "titre_a": "y"}') == {"title": ("titre_b", 0.665)}
    assert mapped('{"cpv": ["72"], "link": "u", "state_code": 1}') == {"reference": ("state_code", 0.5133), "cpv_codes": ("cpv[]", 1.0), "source_url": ("link", 0.92)}
    assert mapped('{"a": {"b": {"c": {"status": 1}}}}') == {"status": ("a.b.c.status", 1.0)}
    assert mapped('{"a": {"b": {"c": {"d": {"status": 1}}}}}', "{broken", None, "", "7", '{"status": {}}') == {}


def test_bodies_that_are_no_json(spark):
    rows = spark.createDataFrame([(1, '{"a": {"b": [1, " ", null, true]}}'), (2, "{broken"), (3, None), (4, ""), (5, "[" * 5000), (6, '{"k": 1, "k": 2}')], "id long, body string")
    lines = E.json_lines(rows, "body").select("id", "line", "rejected").collect()
    assert sorted(map(tuple, lines), key=repr) == [(1, "b: 1", False), (1, "b: True", False), (2, None, True), (5, None, True), (6, None, True)]
    rows = spark.createDataFrame([(1, '{"list": [{"role": "dev", "nb": 2}, {}]}'), (2, "{broken"), (3, "null"), (4, None)], "id long, body string")
    got = E.json_profiles(rows, "body").select("id", "position", "title", "needed", "rejected").collect()
    assert sorted(map(tuple, got), key=repr) == [(1, 0, "dev", 2, False), (1, 1, "Profile 2", 1, False), (2, None, None, None, True)]


def test_json_values_of_all_kinds_and_depths(spark):
    deep = '{"x": ' * 40 + '"end"' + "}" * 40
    bodies = [
        (1, '{"b": [1, 2.0, 2.50, 1e5, {"c": "quote \\" { [ ", "a": false}], "": "bare"}'), (2, deep), (3, '["top", [["in"]], {}]'), (4, '"alone"'), (5, "[]"), (6, '{"long": "' + "\\n[{" * 20000 + '"}'),
    ]
    got: dict[int, list[str]] = {}
    for r in E.json_lines(spark.createDataFrame(bodies, "id long, body string"), "body").orderBy("id", "position").collect():
        got.setdefault(r.id, []).append(r.line)
    assert got.pop(6) == ["long: " + "\n[{" * 20000]
    assert got == {1: ["bare", "b: 1", "b: 2.0", "b: 2.5", "b: 100000.0", "a: False", 'c: quote " { [ '], 2: ["x: end"], 3: ["top", "in"], 4: ["alone"]}


def test_profiles_by_the_longest_list(spark):
    bodies = [
        (1, '{"a": [{"t": 1}], "z": {"roles": [{"title": "", "name": "two", "count": "7", "nb": 3.9}, {"role": 0, "profile": ["x"], "count": true}]}}'),
        (2, '{"project": "p", "name": "whole", "quantity": 4}'), (3, "[1, 2]"), (4, '[[{"role": "in"}], 5]'), (5, '{"l": [{"role": "a"}, 3]}'), (6, "{}"),
    ]
    got = E.json_profiles(spark.createDataFrame(bodies, "id long, body string"), "body").orderBy("id", "position")
    assert not any(x in got._jdf.queryExecution().toString() for x in ("Python", "Arrow"))
    assert [(r.id, r.position, r.title, r.needed) for r in got.collect()] == [(1, 0, "two", 3), (1, 1, '["x"]', 1), (2, 0, "whole", 4), (4, 0, "in", 1), (5, 0, "Profile 1", 1), (6, 0, "Profile 1", 1)]


def test_files(spark):
    def docx(**members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in members.items():
                z.writestr(name.replace("__", "/").replace("_", "."), text)
        return out.getvalue()

    good = docx(word__document_xml="x")
    cases = [
        (b"", "a.pdf", "empty"), (b"%PDF-1.7 text %%EOF", "a.pdf", None), (b"%PDF-1.7 text", "a.pdf", "truncated"), (b"%PDF-1.7 /JS 1 %%EOF", "a.pdf", "active_content"), (b"MZ..", "a.pdf", "executable"), (b"#!/bin/sh", "a.html", "executable"),
        (b"<html>x</html>", "a.pdf", "type"), (b"<html>x</html>", "a.htm", None), (b"<html><p> </p></html>", "a.htm", "no_text"), (b"<html><iframe></html>", "a.html", "active_content"), (b"x", "a.sh", "extension"), (b"x", "a", "extension"), (None, "a.pdf", "empty"),
        (good, "a.docx", None), (docx(x="x"), "a.docx", "incomplete"), (docx(word__document_xml="x", word__vbaProject_bin="x"), "a.docx", "macros"), (good[:-30], "a.docx", "corrupted"), (b"%PDF-1.7 %%EOF", "a.docx", "type"),
    ]
    frame = spark.createDataFrame([(i, c, n) for i, (c, n, _) in enumerate(cases)], "i int, content binary, name string")
    got = {r.i: r.p for r in frame.select("i", E.file_problem(F.col("content"), F.col("name")).alias("p")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, _, w in cases]
    told = frame.where("name = 'a.htm'").select(E.warnings_of(F.col("content"), F.lit("text/plain; charset=utf-8")).alias("w")).first().w
    assert told == ["declared_type"]


def test_references_need_their_semicolon(spark):
    text = lambda page: one(spark, E.html_text, page)
    assert text("<p>a &amp; b &lt;c&gt; &quot;d&quot; &#39;e&#39; &eacute;&#xe9;&#233; f&nbsp;g</p>") == "a & b <c> \"d\" 'e' ééé f g"
    assert text("<title>cut &amp;&amp</title><p>&copy=1 &notit; &ampx; &amp;lt; &lt &#39</p>") == "cut &&amp\n&copy=1 &notit; &ampx; &lt; &lt &#39"
    assert text("<p>a\xa0b</p>") == "a\xa0b" == text("<p>a\xa0b</p>&amp;").split("\n")[0]


def test_posting_of_a_cut_page(spark):
    page = "<title>x &amp;&amp</title><h1>a" + "<b> </b>" * 5000 + "&amp;&amp</h1>"
    got = spark.createDataFrame([(page,)], "html string").select(E.posting(F.col("html")).alias("p")).first().p
    assert (got.title, got.description) == ("a &amp;&amp", "x &&amp\na &&amp")


def test_scripts_leave_before_what_they_quote(spark):
    assert one(spark, E.html_text, "<nav>a<script>'</nav>'</script>b</nav>c <header>d<script>'</header>'</script></header>e\x0bf") == "c e\x0bf"


def test_posting_in_a_graph(spark):
    page = '<script type="application/ld+json">{"@type": "Organization"}</script><h1>Other</h1><script type="application/ld+json">{"@graph": [{"@type": "Thing"}, {"@type": "JobPosting", "title": "Engineer", "description": "<p>Build</p>"}]}</script>'
    got = spark.createDataFrame([(page,), ("<h1>Plain <b>page</b></h1><p>text</p>",)], "html string").select(E.posting(F.col("html")).alias("p")).select("p.*").collect()
    assert [(r.title, r.description) for r in got] == [("Engineer", "Build"), ("Plain page", "Plain page\ntext")]


def test_candidates_without_a_country(spark):
    day = dt.datetime(2024, 5, 1)
    frame = spark.createDataFrame([(1, "FR", day, None), (2, None, day, day), (3, "DE", day - dt.timedelta(days=100), day + dt.timedelta(days=3)), (4, "DE", day - dt.timedelta(days=200), None)], "notice_id long, country string, publication timestamp_ntz, deadline timestamp_ntz")
    got = {(r.incoming_id, r.stored_id) for r in J.candidate_window(frame, frame).collect()}
    assert got == {(1, 2), (2, 1), (2, 3), (3, 4)}


def test_blocks_give_every_pair(spark):
    left, right = spark.range(50).withColumnRenamed("id", "a"), spark.range(23).withColumnRenamed("id", "b")
    for most in (100, 4):
        assert J.blocked_pairs(left, right, most, salts=3).distinct().count() == J.blocked_pairs(left, right, most, salts=3).count() == 50 * 23


def test_a_whole_pool_is_ranked(spark):
    rows = spark.range(500).select(F.col("id").cast("string").alias("cv_id"), F.element_at(F.array(*map(F.lit, ["pass", "unknown", "fail"])), (F.col("id") % 3 + 1).cast("int")).alias("status"), (F.col("id") % 7 / 7).alias("confirmed_ratio"), (F.col("id") % 5).alias("score"))
    whole = [(r.cv_id, r.position) for r in C.rank(rows).orderBy("position").collect()]
    assert [p for _, p in whole] == list(range(1, 501)) and whole[:40] == [(r.cv_id, r.position) for r in C.rank(rows, 40).orderBy("position").collect()]


def test_source_states_and_reasons(spark):
    at = dt.datetime(2024, 1, 1)
    runs = spark.createDataFrame([(i, s, at + dt.timedelta(hours=i), f, n, e) for i, (s, f, n, e) in enumerate([(1, True, 0, "X")] * 3 + [(2, True, 0, None)] + [(3, False, 0, None)] * 3 + [(4, True, 0, "X"), (5, True, 0, "X"), (6, False, 2, None)])], "run_id long, source_key long, ts timestamp_ntz, failed boolean, items long, error_type string")
    sources = spark.createDataFrame([(i, i != 4, i == 5) for i in range(1, 8)], "source_key long, enabled boolean, credentials_missing boolean")
    got = {r.source_key: (r.state, r.reason) for r in W.health(W.streaks(runs), sources).collect()}
    assert got == {
        1: ("failing", "3 consecutive failures (X)"), 2: ("degraded", "Last run failed: unknown error"), 3: ("degraded", "3 consecutive runs returned no items — the portal markup may have changed."),
        4: ("disabled", None), 5: ("credentials_missing", None), 6: ("healthy", None), 7: ("healthy", None),
    }


def test_lists_with_text_and_total(spark):
    now, day = dt.datetime(2024, 1, 1), dt.timedelta(days=1)
    made = [
        (1, "Road works", "City", "R-1", "relevant", 0.6, now + day, "open"), (2, "x", "ROADS Ltd", None, "relevant", 0.7, None, "open"), (3, "x", "y", "ab-road", "low_relevance", None, now, "open"), (4, "Road", "y", "z", "out_of_scope", 0.9, None, "open"),
        (5, "Road", "y", "z", "relevant", 0.9, now - day, "open"), (6, "Road", "y", "z", "relevant", 0.9, None, "awarded"), (7, None, None, None, "relevant", 0.9, None, "open"),
    ]
    rows = spark.createDataFrame(made, "id long, title string, buyer string, reference string, band string, score double, deadline timestamp_ntz, status string")
    listed = lambda **more: sorted((r.id, r.total) for r in L.listed(rows, F.lit(now).cast("timestamp_ntz"), **more).collect())
    assert listed(text=" road ") == [(1, 3), (2, 3), (3, 3)]
    assert listed(text="road", only_open=False) == [(i, 5) for i in (1, 2, 3, 5, 6)]
    assert listed(least=0.65) == [(2, 2), (7, 2)]
    assert listed(among={"buyer": ["City"], "title": []}) == [(1, 1)]
    assert listed(text="nothing") == []


def test_an_address_is_no_age(spark):
    lines = {1: "Kundage age 70.214.118.188 the", 2: "Age: 30\nKeit age 46.1.2.3", 3: "age 12/03/1990", 4: "Age: 31, 12 years of work", 5: "aged 32.", 6: "Age 33-35"}
    cvs = spark.createDataFrame([(i, f"Summary\n{x}") for i, x in lines.items()], "cv_id long, text string")
    assert {r.cv_id: r.age for r in C.ages(C.sections(cvs), "2026-01-01").collect()} == {2: 30, 4: 31, 5: 32, 6: 33}
    assert {r.cv_id: r.status for r in C.verdicts(cvs, "2026-01-01", age=(25, 45)).collect()} == {1: "unknown", 3: "unknown"} | dict.fromkeys((2, 4, 5, 6), "pass")


def test_errors_are_told_beside_the_merged_text(spark):
    made = [("a", 2, "two", None, "digital", "bad"), ("a", 1, "one", "text", "ocr", None), ("a", 3, "three", "", "ocr", "worse"), ("b", 1, "one", None, None, "bad"), ("c", 1, "one", None, None, None)]
    rows = spark.createDataFrame(made, "k string, i long, name string, text string, method string, error string")
    got = {r.k: (r.text, r.documents, r.method, r.errors, r.status) for r in W.merged_text(rows, "k", ["i"]).collect()}
    assert got == {"a": ("=== one ===\ntext", 1, "ocr", "two: bad; three: worse", "extracted"), "b": ("", 0, "none", "one: bad", "failed"), "c": ("", 0, "none", None, "empty")}
    many = spark.createDataFrame([("a", i, "n" * 50, None, None, "e" * 50) for i in range(100)], rows.schema)
    assert W.merged_text(many, "k", ["i"]).first().errors == "; ".join(["n" * 50 + ": " + "e" * 50] * 100)[:2000]


@pytest.mark.parametrize("length", [94])
def test_merged_text_is_cut_as_if_joined_whole(spark, length):
    pieces = [f"=== n{i} ===\n" + "t" * length for i in range(6)]
    texts = spark.createDataFrame([("k", i, f"n{i}", "t" * length, "digital", None) for i in range(6)], "k string, i int, name string, text string, method string, error string")
    for limit in range(2 * len(pieces[0]), 2 * len(pieces[0]) + 6):
        assert W.merged_text(texts, "k", ["i"], limit).first().text == "\n\n".join(pieces)[:limit]
    told = [f"n{i}: " + "e" * (400 + length) for i in range(6)]
    errors = spark.createDataFrame([("k", i, f"n{i}", None, "digital", "e" * (400 + length)) for i in range(6)], texts.schema)
    assert W.merged_text(errors, "k", ["i"]).first().errors == "; ".join(told)[:2000]


def test_masked_data_is_counted(spark):
    text = "Mail a.b@c.org or d@e.fr, +216 71 123 456, born 01/02/1990, 12 rue de Paris, [EMAIL]"
    m = spark.createDataFrame([(text,), (None,)], "t string").select(X.masked_with_counts(F.col("t")).alias("m")).collect()
    assert m[0].m.text == "Mail [EMAIL] or [EMAIL], [PHONE], [BIRTH_DATE], [ADDRESS], [EMAIL]"
    assert m[0].m.counts == {"[EMAIL]": 2, "[PROFILE]": 0, "[BIRTH_DATE]": 1, "[ID_NUMBER]": 0, "[PHONE]": 1, "[ADDRESS]": 1}
    assert m[1].m.text is None and set(m[1].m.counts.values()) == {0}


def test_sketches_merge_to_the_quantile(spark):
    rows = spark.range(40_000).selectExpr("id % 3 as part", "cast(hash(id) as double) as v")
    for share in (0.05, 0.5, 0.95):
        estimate = A.merged_quantile(A.sketched(rows, ["part"], "v"), [], share).first().estimate
        assert abs(rows.where(F.col("v") <= estimate).count() / 40_000 - share) < 0.01


def test_cv_checks_carry_evidence_and_a_profile(spark):
    made = {
        1: "Experience\nSenior dev, 6 years of experience\nLanguages\nEnglish\nFrench: fluent\nCertifications\nITIL\nIn progress\nEducation\nBachelor of science\nAge: 30",
        2: "Over 4 years of experience\n7 years of experience\nAge: 30\n31 years old",
        3: "Work experience\nJan 2019 - 03/2021\n2020 to 2022\nEducation\nMaster en cours\nBorn 02/01/1990",
        4: "3 years of experience\nAge: 50",
        5: "",
        6: None,
    }
    cvs = spark.createDataFrame([*made.items()], "cv_id long, text string")
    got = {r.cv_id: r for r in C.evaluated(cvs, "2026-01-01", min_years=5, age=(25, 45), languages=["Anglais"], certifications=["ITIL"], education=["Licence", "Master"]).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "unknown", 2: "unknown", 3: "unknown", 4: "fail", 5: "unknown", 6: "unknown"}
    checks = {k: {c.criterion: (c.status, c.observed, c.evidence, c.reason) for c in r.checks} for k, r in got.items()}
    assert checks[1] == {
        "age": ("pass", "30", ["Age: 30"], "stated"), "experience": ("pass", "6.0", ["Senior dev, 6 years of experience"], "stated"), "languages": ("pass", None, ["English"], "found"),
        "certifications": ("unknown", None, ["ITIL"], "doubtful"), "education": ("pass", None, ["Bachelor of science"], "found"),
    }
    assert checks[2]["experience"] == ("unknown", None, ["Over 4 years of experience", "7 years of experience"], "conflicting") and checks[2]["age"] == ("unknown", None, ["Age: 30", "31 years old"], "conflicting")
    assert checks[3]["experience"] == ("unknown", "3.0", ["Jan 2019 - 03/2021", "2020 to 2022"], "dates_lower_bound")
    assert checks[3]["education"] == ("unknown", None, ["Master en cours"], "doubtful") and checks[3]["age"][:2] == ("pass", "35")
    assert checks[4]["experience"] == ("fail", "3.0", ["3 years of experience"], "stated") and checks[4]["age"][0] == "fail"
    assert all(c == ("unknown", None, [], "unavailable" if k in ("age", "experience") else "not_found") for i in (5, 6) for k, c in checks[i].items())
    assert got[1].profile.asDict() == {"age": 30, "years": 6.0, "languages": ["Français", "Anglais"], "certifications": [], "education": ["Licence"]}
    plain = C.verdicts(cvs, "2026-01-01").collect()
    assert {(r.status, r.confirmed, r.asked) for r in plain} == {("pass", 0, 0)} and len(plain) == 6


def test_a_cv_is_read_once(spark, small):
    cvs = spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id as cv_id", "text")
    plan = C.sections(cvs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_breakdown_explains_each_criterion(spark):
    notices = spark.createDataFrame([(1, "Urgent building works", "Buyer", "France", None, 300000.0, "EUR", "open", ["72000000"]), (2, "not specified", "", "", dt.datetime(2026, 1, 1), None, None, "other", [])], "notice_id long, title string, buyer string, country string, deadline timestamp, budget double, currency string, procedure string, cpv_codes array<string>")
    profile = S.Profile(weights={**dict.fromkeys(S.CRITERIA, 0.1), "historical_success": 0.1, "unregistered": 0.2})
    now = F.lit(dt.datetime(2026, 1, 10))
    rows = S.score_notices(notices, profile, now, explain=True).orderBy("notice_id").collect()
    first, second = ({k: (v.explanation, v.details) for k, v in r.breakdown.asDict().items()} if not isinstance(r.breakdown, dict) else {k: (v.explanation, v.details) for k, v in r.breakdown.items()} for r in rows)
    assert first["field_of_work"] == ("Field construction: building", {"field": "construction", "terms": "building"})
    assert first["deadline_proximity"] == ("No deadline published", {}) and second["deadline_proximity"] == ("Deadline has passed", {"days": "-9"})
    assert first["keywords"] == ("Keywords: building, urgent", {"keywords": "building, urgent"}) and second["keywords"] == ("Excluded: not specified", {"excluded": "not specified"})
    assert first["budget"] == ("1005000: in range", {"amount": "1005000", "currency": "EUR"}) and second["budget"] == ("No budget published", {})
    assert first["location"] == ("Preferred: France", {"stated": "France"}) and second["location"] == ("Not stated", {})
    assert first["cpv_similarity"] == ("Digits shared with a preferred code: 8", {"codes": "72000000"}) and second["cpv_similarity"] == ("No codes", {})
    assert first["historical_success"] == (None, None)  # without any, it does not apply
    assert first["procurement_type"] == ("Procedure open", {"procedure": "open"}) and second["procurement_type"] == ("No preference for the procedure", {"procedure": "other"})
    assert rows[0].weights["unregistered"] == 0.2 and "unregistered" not in first
    assert "explanation" not in S.score_notices(notices, profile, now).schema["breakdown"].dataType.valueType.fieldNames()


def test_candidates_side_by_side(spark):
    cvs = spark.createDataFrame([(1, "Experience\nOver 7 years of experience\nLanguages\nEnglish"), (2, ""), (3, "Age: 30")], "cv_id long, text string")
    rows = C.evaluated(cvs, "2026-01-01", min_years=5, languages=["Anglais"])
    held = rows.withColumns({"score": F.lit(0.125), "matched": F.expr("if(cv_id = 1, array('python', 'sql'), array())").cast("array<string>"), "missing": F.expr("if(cv_id = 2, array('sql'), array())").cast("array<string>")})
    got = {r.field: tuple(r)[1:] for r in C.compare(held, ["1", "2", "9"]).collect()}
    assert list(got) == ["confirmed", "checks", "score", "skills", "years", "education", "languages", "certifications", "open", "evidence"]
    assert got["confirmed"] == ("100", "0", None) and got["checks"] == ("2/0/0", "0/2/0", None) and got["score"] == ("13", "13", None)
    assert got["skills"] == ("python, sql", None, None) and got["languages"] == ("Anglais", None, None) and got["evidence"][1] is None
    assert got["open"][0] is None and got["open"][1].startswith("sql, 5 years at least (unknown, unavailable), Anglais (unknown, not_found)")
