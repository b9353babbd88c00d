"""Pages, JSON bodies and files."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.shared import shared_folder
from ..registry import query
from ..sources import extract as E
from ..sources import sinks as K
from ..sources.tables import SCHEMAS, read


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'pages', count(*) FROM pages")
def scan_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in ("orders", "documents", "events", "pages"):
        table = read(spark, sf_dir, name)
        assert set(table.columns) == {c.split()[0] for c in SCHEMAS[name].split(", ")}
        part = table.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, length(regexp_extract(html, '<title>([^<]*)</title>', 1)) > 0 AS titled, len(regexp_extract_all(html, '<a href=')) AS links FROM pages""")
def extract_html_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.html_fields(read(spark, sf_dir, "pages"), "page_id", "html", {"lang": "html@lang", "title": "h9,title,h1", "links": "a@href"}, ("links",))
    return found.select("page_id", "lang", F.col("title").isNotNull().alias("titled"), F.size("links").cast("long").alias("links"))


@query("SELECT page_id, regexp_matches(html, '(?i)<article[\\s>]') AS kept, NOT regexp_matches(html, '(?i)<table[\\s>]') AND NOT contains(html, 'no results') AS broken FROM pages")
def require_guard_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", E.has_element(F.col("html"), "article").alias("kept"), (~E.has_element(F.col("html"), "table") & ~F.contains("html", F.lit("no results"))).alias("broken"))


@query("SELECT event_id, props->>'k' AS k, 'none' AS missing FROM events")
def json_path_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", E.json_path(F.col("props"), "k").alias("k"), E.json_path(F.col("props"), "a[0].b", "none").alias("missing"))


@query("SELECT user_id, NULL::VARCHAR AS k, TRUE AS rejected FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 10 = 0) UNION ALL SELECT user_id, props->>'k', FALSE FROM events WHERE user_id % 10 <> 0")
def json_items_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = read(spark, sf_dir, "events").groupBy("user_id").agg(F.concat(F.lit('{"count": 1, "'), F.expr("case when user_id % 10 = 0 then 'none' else 'results' end"), F.lit('": ['), F.array_join(F.collect_list("props"), ","), F.lit("]}")).alias("body"))
    return E.json_items(grouped, "body", "results", {"k": "k"}).select("user_id", "k", "rejected")


_HINTS = ", ".join(f"({i}, '{f}', '{h}', {r}, {len(hs)})" for i, (f, hs) in enumerate(E.HINTS.items()) for r, h in enumerate(hs))
_RECORD = """json_object('uuid', o_orderkey, 'ref_no', 'R-' || o_orderkey, 'name', 'Notice', 'objet', o_orderpriority, 'detail_text', 'x', 'organisation', json_object('name', c_name, 'contact', json_object('mail', 'a@b.org', 'pays', n_name)), 'dates', json_object('date_pub', o_orderdate, 'closing_at', o_orderdate),
  'montant', json_object('total_value', o_totalprice, 'devise', 'EUR'), 'lieu_name', n_name, 'activity', c_mktsegment, 'lots', json_array(json_object('status', 'x')), 'cpv_list', json_array('72000000'), 'permalink', 'https://x.org/' || o_orderkey)"""


@query(rf"""
WITH RECURSIVE bodies AS (
  SELECT CASE WHEN o_orderkey % 97 = 0 THEN '{{broken' WHEN o_orderkey % 5 = 0 THEN json_merge_patch({_RECORD}, json_object('etat', o_orderstatus, 'type', 'open'))::VARCHAR ELSE {_RECORD}::VARCHAR END AS b FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
level AS (
  SELECT json(b) AS v, '' AS prefix, '' AS place, 1 AS depth FROM bodies WHERE json_valid(b)
  UNION ALL SELECT json_extract(v, '$."' || k || '"'), prefix || k || '.', place || lpad(i::VARCHAR, 6, '0'), depth + 1
  FROM (SELECT v, prefix, place, depth, unnest(json_keys(v)) AS k, unnest(range(len(json_keys(v)))) AS i FROM level WHERE depth < 4) WHERE json_type(v, '$."' || k || '"') = 'OBJECT'),
ends AS (
  SELECT prefix || k || CASE WHEN json_type(v, '$."' || k || '"') = 'ARRAY' AND json_type(v, '$."' || k || '"[0]') NOT IN ('OBJECT', 'ARRAY') THEN '[]' ELSE '' END AS path, place || lpad(i::VARCHAR, 6, '0') AS place
  FROM (SELECT v, prefix, place, unnest(json_keys(v)) AS k, unnest(range(len(json_keys(v)))) AS i FROM level) WHERE json_type(v, '$."' || k || '"') <> 'OBJECT'),
paths AS (SELECT path, string_split(replace(lower(path), '[]', ''), '.') AS s, count(*) AS seen, min(place) AS place FROM ends GROUP BY path), h(turn, field, hint, rank, hints) AS (VALUES {_HINTS}),
scored AS (SELECT turn, field, path, seen, place, (CASE WHEN s[-1] = hint THEN 1.0 ELSE CASE WHEN list_contains(s, hint) THEN 0.9 WHEN starts_with(s[-1], hint) OR ends_with(s[-1], hint) THEN 0.7 WHEN contains(s[-1], hint) THEN 0.55 WHEN contains(lower(path), hint) THEN 0.4 END
  - CASE WHEN len(s) > 1 THEN 0.05 ELSE 0 END END)::DOUBLE * (1 - rank / (hints + 1)::DOUBLE * 0.4) AS score FROM paths, h),
best AS (SELECT turn, field, path, max(score) AS score, any_value(seen) AS seen, any_value(place) AS place FROM scored WHERE score IS NOT NULL GROUP BY 1, 2, 3),
picks AS (
  SELECT -1 AS turn, []::VARCHAR[] AS used
  UNION ALL SELECT p.turn + 1, p.used || coalesce((SELECT [arg_min(b.path, (-b.score, b.place, b.path))] FROM best b WHERE b.turn = p.turn + 1 AND NOT list_contains(p.used, b.path) HAVING count(*) > 0), [NULL]::VARCHAR[]) FROM picks p WHERE p.turn < {len(E.HINTS) - 1})
SELECT b.field, b.path, b.score, b.seen FROM (SELECT turn, used[turn + 1] AS path FROM picks WHERE turn >= 0) p JOIN best b ON b.turn = p.turn AND b.path = p.path""")
def infer_field_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a portal's records: nested, some with keys that others lack, some broken."""
    orders, customer, nation = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    record = {
        "uuid": "o_orderkey", "ref_no": "concat('R-', o_orderkey)", "name": "'Notice'", "objet": "o_orderpriority", "detail_text": "'x'", "organisation": "named_struct('name', c_name, 'contact', named_struct('mail', 'a@b.org', 'pays', n_name))",
        "dates": "named_struct('date_pub', o_orderdate, 'closing_at', o_orderdate)", "montant": "named_struct('total_value', o_totalprice, 'devise', 'EUR')", "lieu_name": "n_name", "activity": "c_mktsegment", "lots": "array(named_struct('status', 'x'))",
        "cpv_list": "array('72000000')", "permalink": "concat('https://x.org/', o_orderkey)", "etat": "case when o_orderkey % 5 = 0 then o_orderstatus end", "type": "case when o_orderkey % 5 = 0 then 'open' end",
    }
    body = F.when(F.col("o_orderkey") % 97 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(*(F.expr(v).alias(k) for k, v in record.items()))))
    return E.field_mapping(rows.select(body.alias("body")), "body")


_VISIBLE = "html"
for _tag in ("script", "style", "nav", "footer", "header", "noscript"):
    _VISIBLE = rf"regexp_replace({_VISIBLE}, '(?is)<{_tag}\b.*?</{_tag}\s*>', ' ', 'g')"
_PLAIN = rf"regexp_replace(regexp_replace(regexp_replace({_VISIBLE}, '(?s)<!--.*?-->', ' ', 'g'), '(?i)<(br|/p|/div|/h\d|/li|/tr|/title)\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g')"
for _name, _mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, '{_name}', '{_mark}')"


_TEXT = rf"array_to_string([x FOR x IN [trim(regexp_replace(l, '\s+', ' ', 'g')) FOR l IN string_split({_PLAIN}, chr(10))] IF x <> ''], chr(10))"


@query(f"SELECT page_id, {_TEXT} AS text FROM pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", E.html_text(F.col("html")).alias("text"))


@query("""SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/files/' || page_id || '.pdf' AS href, 'extension' AS reason FROM pages UNION ALL SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/download?id=' || page_id || '&v=2', 'path' FROM pages""")
def harvest_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables' pages have no document links: each gets two of its own, one of them twice, and a mail address."""
    pid = F.col("page_id").cast("string")
    added = F.concat(F.col("html"), F.lit('<a href="/files/'), pid, F.lit('.pdf#p2">x</a><a class="b" href="/download?id='), pid, F.lit('&amp;v=2">get</a><a href="/files/'), pid, F.lit('.pdf">again</a><a href="mailto:a@b.org">a.pdf</a>'))
    return E.links(read(spark, sf_dir, "pages").withColumn("html", added), "page_id", "url", "html").select("page_id", "href", "reason")


@query("SELECT doc_id, source AS \"Source\", lang AS \"Lang\", CASE WHEN doc_id % 2 = 0 THEN 'x' || doc_id END AS \"Ref\" FROM documents")
def labelled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Source: "), F.col("source"), F.lit("\nLang:\n  "), F.col("lang"), F.lit("\nRef:"), F.expr("case when doc_id % 2 = 0 then concat(' x', doc_id) else '' end"), F.lit("\nSource : other\n"))
    return read(spark, sf_dir, "documents").select("doc_id", *(v.alias(k) for k, v in E.labelled(text, ["Source", "Lang", "Ref"]).items()))


@query(rf"""
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Role ' || page_id ELSE nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '(<[^>]*>|\s)+', ' ', 'g')), '') END AS title,
  CASE WHEN page_id % 2 = 0 THEN 'Do it' ELSE substr({_TEXT}, 1, 50000) END AS description FROM pages""")
def jsonld_posting_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<script type="application/ld+json">{"@type": "JobPosting", "title": "Role '), F.col("page_id").cast("string"), F.lit('", "description": "<p>Do it</p>"}</script>'), F.col("html"))).otherwise(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", E.posting(added).alias("p")).select("page_id", "p.title", "p.description")


@query("SELECT event_id, 'k: ' || (props->>'k') AS line FROM events UNION ALL SELECT event_id, 'type: ' || event_type FROM events")
def flatten_json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", F.expr("concat('{\"a\": [', props, ', {\"type\": \"', event_type, '\"}, null]}')").alias("body"))
    return E.json_lines(rows, "body").where("not rejected").select("event_id", "line")


@query("SELECT user_id, event_type AS title, CASE WHEN event_type = 'error' THEN 3 ELSE 1 END AS needed, count(*) AS n FROM events GROUP BY 1, 2")
def explode_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.expr("concat('{\"role\": \"', event_type, '\"', case when event_type = 'error' then ', \"count\": 3' else '' end, '}')")
    bodies = read(spark, sf_dir, "events").groupBy("user_id").agg(F.concat(F.lit('{"project": "p", "profiles": ['), F.array_join(F.collect_list(item), ","), F.lit("]}")).alias("body"))
    return E.json_profiles(bodies, "body").groupBy("user_id", "title", "needed").agg(F.count("*").alias("n"))


@query("""
WITH b AS (SELECT user_id, list({'id': event_id, 't': event_type} ORDER BY event_id) AS l FROM events GROUP BY 1)
SELECT user_id, i AS position, l[i + 1].t AS title, CASE WHEN l[i + 1].t = 'error' THEN 3 ELSE 1 END AS needed FROM (SELECT user_id, l, unnest(range(len(l))) AS i FROM b)""")
def profiles_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row generator by itself: a row per profile of each body, in order."""
    item = F.expr("concat('{\"role\": \"', event_type, '\"', case when event_type = 'error' then ', \"count\": 3' else '' end, '}')")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("event_id", item.alias("item")))), lambda x: x["item"])
    bodies = read(spark, sf_dir, "events").groupBy("user_id").agg(F.concat(F.lit('{"project": "p", "profiles": ['), F.array_join(listed, ","), F.lit("]}")).alias("body"))
    return E.json_profiles(bodies, "body").select("user_id", F.col("position").cast("long").alias("position"), "title", "needed")


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, i AS line_no, sha256(trim(l[i + 1], ' ')) AS line FROM (SELECT doc_id, l, unnest(range(len(l))) AS i FROM l) WHERE trim(l[i + 1], ' ') <> ''""")
def lines_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "text")
    return rows.lateralJoin(E.Lines(F.col("text").outer())).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.sha2("line", 256).alias("line"))


#: Pages as files of nine kinds: name and content.
NAMES = ["a.pdf", "a.pdf", "a.pdf", "a.pdf", "a.exe", "a.PDF", "a.pdf", "a.html", "a.htm"]
_KINDS = ["''", "'%PDF-1.4 ' || url || ' %%EOF'", "'%PDF-1.4 ' || html", "'%PDF-1.4 ' || url || ' /OpenAction %%EOF'", "url", "'MZ' || html", "html", "html", "regexp_replace(regexp_replace(html, '(?s)<script.*?</script>', ''{g}), ' on[a-z]+=', ' '{g})"]


def _content(flags: str = "") -> str:
    return "CASE page_id % 9 " + " ".join(f"WHEN {i} THEN {k.replace('{g}', flags)}" for i, k in enumerate(_KINDS)) + " END"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("page_id") % 9 + 1).cast("int"))
    return read(spark, sf_dir, "pages").where("html is not null and url is not null").select("page_id", name.alias("name"), F.expr(_content()).cast("binary").alias("content"))


FILES = f"f AS (SELECT page_id, page_id % 9 AS k, {_content(", 'g'")} AS c FROM pages WHERE html IS NOT NULL AND url IS NOT NULL)"


@query(f"WITH {FILES} SELECT page_id, CASE WHEN starts_with(c, '%PDF-') THEN 'application/pdf' WHEN starts_with(c, 'MZ') THEN 'application/x-msdownload' WHEN regexp_matches(lower(c[1:1024]), '<(!doctype html|html|head|body|\\?xml)') THEN 'text/html' ELSE 'text/plain' END AS kind FROM f")
def triage_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("page_id", E.triaged(F.col("content")).alias("kind"))


_MEMBERS = ["word/document.xml", "xl/workbook.xml", "ppt/presentation.xml", "content.xml", "notes.txt", "word/document.xml"]


@F.pandas_udf(T.BinaryType())
def packed(kind: pd.Series, html: pd.Series) -> pd.Series:
    """Containers of six kinds around a page; those of the last are cut off."""
    def one(k: int, text: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("META-INF/manifest.xml" if k == 3 else "other.xml", "x")
            z.writestr(_MEMBERS[k], text)
        return out.getvalue()[: -40 if k == 5 else None]

    return pd.Series([one(k, t) for k, t in zip(kind, html, strict=True)])


@query("SELECT page_id, CASE page_id % 6 " + " ".join(f"WHEN {i} THEN '{kind}'" for i, (_, kind) in enumerate(E.CONTAINERS)) + " ELSE 'application/zip' END AS kind FROM pages WHERE html IS NOT NULL")
def triage_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a member of an office file, a plain ZIP or a damaged one."""
    rows = read(spark, sf_dir, "pages").where("html is not null").select("page_id", packed((F.col("page_id") % 6).cast("int"), "html").alias("content"))
    return rows.select("page_id", E.triaged(F.col("content")).alias("kind"))


@query("SELECT doc_id, sha256(text) AS text, lang, source, n_chars FROM documents")
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents written as CSV and read again by the declared schema."""
    folder = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    K.write_csv(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"), folder)
    rows, _ = K.read_csv(spark, folder, SCHEMAS["documents"])
    return rows.select("doc_id", F.sha2("text", 256).alias("text"), "lang", "source", "n_chars")


@query(rf"""
WITH {FILES} SELECT page_id, CASE k WHEN 0 THEN 'empty' WHEN 2 THEN 'truncated' WHEN 3 THEN 'active_content' WHEN 4 THEN 'extension' WHEN 5 THEN 'executable' WHEN 6 THEN 'type'
  WHEN 1 THEN CASE WHEN regexp_matches(c, '/(JavaScript|JS|OpenAction|AA|Launch|EmbeddedFile|RichMedia|XFA)') THEN 'active_content' END
  ELSE CASE WHEN regexp_matches(c, '(?i)<\s*(script|iframe|object|embed)|javascript\s*:|\son\w+\s*=|<\s*meta[^>]+http-equiv\s*=\s*["'']?refresh') THEN 'active_content' END END AS reason,
  k IN (1, 2, 3) AS as_declared FROM f""")
def validate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = ~F.array_contains(E.warnings_of(F.col("content"), F.lit("application/pdf; charset=x")), "declared_type")
    return files(spark, sf_dir).select("page_id", E.file_problem(F.col("content"), F.col("name")).alias("reason"), told.alias("as_declared"))


@query("SELECT strftime(ts, '%Y/%m/%d') || '/' || event_id AS key, event_id FROM events")
def write_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written by day and read back; a second run of the first days replaces them with the same rows."""
    folder = f"{shared_folder(spark)}/days-{uuid.uuid4().hex}"
    rows = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    K.write_days(rows, folder, "ts")
    K.write_days(rows.where("ts < timestamp_ntz'2024-01-10'"), folder, "ts")
    return K.read_days(spark, folder, rows.schema).select(F.concat_ws("/", "y", "m", "d", "event_id").alias("key"), "event_id")


@query("""
SELECT event_id, 'batch-' || event_id % 2 AS batch, event_id % 3 = 0 AS truncated, '***redacted***' AS inner_token, CASE WHEN event_id % 3 <> 0 THEN props->>'k' END AS k FROM events""")
def append_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of audit rows, the first of them written twice, read back from the table."""
    folder = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    note = F.expr("case when event_id % 3 = 0 then repeat('n', 9000) else 'n' end")
    context = F.concat(F.lit('{"user": {"api_token": "s3cr3t", "tags": [{"password": 1}]}, "props": '), F.col("props"), F.lit(', "note": "'), note, F.lit('"}'))
    rows = E.audit_rows(read(spark, sf_dir, "events").select("event_id", context.alias("context")), "context")
    for i in (0, 1, 0):
        K.append_once(rows.where(F.col("event_id") % 2 == i), folder, f"batch-{i}")
    table = K.appended(spark, folder, rows.schema)
    shown = F.when(F.get_json_object("context", "$.truncated") == "true", F.get_json_object("context", "$.preview")).otherwise(F.col("context"))
    token = F.regexp_extract(shown, r'"api_token": "([^"]*)"', 1)
    return table.select("event_id", "batch", F.coalesce(F.get_json_object("context", "$.truncated") == "true", F.lit(False)).alias("truncated"), token.alias("inner_token"), F.get_json_object("context", "$.props.k").alias("k"))
