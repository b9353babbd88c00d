"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import ATTACHMENTS, CODES, NOTICES, attachments, codes, notices, now
from ..functions import text as X
from ..functions import url as U
from ..registry import query
from ..sources.tables import read

FOLD = r"trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce({0}, ''))), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def fold_sql(x: str) -> str:
    return FOLD.format(x)


STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
SHA = "sha256({})"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


@query(f"SELECT doc_id, sha256({fold_sql('text')}) AS folded FROM documents")
def fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.sha2(X.fold(F.col("text")), 256).alias("folded"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g'))) AS folded FROM documents")
def fold_keep_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.sha2(X.fold(F.col("text"), punctuation=False), 256).alias("folded"))


@query(r"SELECT doc_id, nullif(rtrim(substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 500)), '') AS tidy FROM documents")
def tidy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", X.tidy(F.col("text"), 500).alias("tidy"))


@query(r"SELECT doc_id, sha256(nullif(trim(regexp_replace(regexp_replace(regexp_replace(text, 'licensed under [^.]*\.', '', 'gi'), '\bthe\b', '', 'gi'), '\s+', ' ', 'g')), '')) AS stripped FROM documents")
def strip_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.sha2(X.without(F.col("text"), [r"licensed under [^.]*\.", "([unclosed", r"\bthe\b"]), 256).alias("stripped"))


@query(r"""
WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS v FROM documents)
SELECT doc_id, sha256(CASE WHEN length(v) > 2000 THEN rtrim(regexp_replace(substr(v, 1, 2000), '\s\S*$', '')) ELSE v END) AS cleaned, length(v) > 2000 AS truncated FROM c""")
def clean_document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", X.clean_document(F.col("text"), 2000).alias("c")).select("doc_id", F.sha2("c.text", 256).alias("cleaned"), "c.truncated")


@query(r"""
SELECT o_orderkey, o_orderdate::TIMESTAMP AS declared, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::TIMESTAMP END AS iso, date_trunc('day', o_orderdate::TIMESTAMP) AS textual,
  date_trunc('day', o_orderdate::TIMESTAMP) AS figures, NULL::TIMESTAMP AS junk FROM orders""")
def parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("timestamp")
    french = F.element_at(F.array(*(F.lit(X.MONTHS[i].split()[0]) for i in range(1, 13))), F.month(day))
    texts = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format(day, "dd/MM/yyyy HH:mm:ss").alias("a"), F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss")).alias("b"),
        F.concat(F.dayofmonth(day).cast("string"), F.lit(" "), french, F.lit(" "), F.year(day).cast("string")).alias("c"), F.date_format(day, "dd.MM.yyyy").alias("d"), F.lit("bientôt").alias("e"),
    )
    ntz = lambda c, *a: X.timestamp(F.col(c), *a).cast("timestamp_ntz")
    return texts.select("o_orderkey", ntz("a", ["dd/MM/yyyy HH:mm:ss"]).alias("declared"), ntz("b").alias("iso"), ntz("c").alias("textual"), ntz("d").alias("figures"), ntz("e").alias("junk"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'EUR' WHEN 1 THEN 'TND' WHEN 2 THEN 'XOF' WHEN 3 THEN 'CHF' WHEN 4 THEN 'EUR' ELSE NULL END AS code FROM orders""")
def detect_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.expr("concat(cast(cast(o_totalprice as bigint) as string), case o_orderkey % 6 when 0 then ' €' when 1 then ' DT' when 2 then ' FCFA' when 3 then ' CHF' when 4 then ' valeur' else ' THE SUM' end)")
    return read(spark, sf_dir, "orders").select("o_orderkey", X.currency(shown).alias("code"))


@query("""
SELECT o_orderkey, floor(o_totalprice)::DECIMAL(18,2) AS spaced, (floor(o_totalprice)::DECIMAL(18,2) + 0.5)::DECIMAL(18,2) AS dotted, ((o_orderkey % 90 + 0.5) * 1000000)::DECIMAL(18,2) AS millions, CASE WHEN o_orderkey = 0 THEN 0 END::DECIMAL(18,2) AS negative FROM orders""")
def parse_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.floor("o_totalprice").cast("long")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.replace(F.format_number(whole, 0), F.lit(","), F.lit(" ")), F.lit(",000 TND")).alias("a"), F.concat(F.lit("USD "), F.format_number(whole, 0), F.lit(".50")).alias("b"), F.concat((F.col("o_orderkey") % 90).cast("string"), F.lit(",5 millions EUR")).alias("c"))
    return rows.select("o_orderkey", X.money(F.col("a")).alias("spaced"), X.money(F.col("b"), decimal=".", thousands=",").alias("dotted"), X.money(F.col("c")).alias("millions"), X.money(F.concat(F.lit("-"), F.col("o_orderkey").cast("string"))).alias("negative"))


@query(r"SELECT doc_id, nullif(lower(regexp_extract(text, '[\w.+-]+@[\w-]+\.[\w.-]+', 0)), '') AS email FROM documents")
def parse_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", X.first_email(F.col("text")).alias("email"))


@query("SELECT event_id, event_type IN ('click', 'purchase') AS flag FROM events")
def parse_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.expr("case event_type when 'click' then ' Oui' when 'purchase' then 'TRUE' when 'view' then 'non' when 'error' then 'maybe' else null end")
    return read(spark, sf_dir, "events").select("event_id", X.to_bool(word).alias("flag"))


@query("""
SELECT o_orderkey, CASE o_orderpriority[1] WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' ELSE 'unknown' END AS level, CASE WHEN o_orderkey % 2 = 0 THEN 'framework_agreement' ELSE 'unknown' END AS kind FROM orders""")
def coerce_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", X.to_enum(F.expr("concat(' ', substring(o_orderpriority, 3))"), ["urgent", "high"]).alias("level"), X.to_enum(F.expr("case when o_orderkey % 2 = 0 then 'Framework Agreement' else 'none of these' end"), ["open", "framework_agreement"]).alias("kind"))


@query(f"""
WITH {NOTICES} SELECT notice_id, CASE procedure WHEN 'open' THEN 'Appel ouvert' WHEN 'restricted' THEN 'Appel restreint' ELSE procedure END AS label FROM notices""")
def reverse_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.joins import reverse_lookup

    known = spark.createDataFrame([("OPEN", "Appel ouvert"), ("Restricted", "Appel restreint")], "code string, label string")
    return reverse_lookup(notices(spark, sf_dir), "procedure", known, "label").select("notice_id", "label")


@query(f"""
WITH {CODES} SELECT notice_id, list_sort(list_distinct([substr(c, 1, 8) FOR c IN cpv_codes])) AS codes FROM codes""")
def clean_cpv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rough = F.flatten(F.transform("cpv_codes", lambda c: F.array(F.concat(c, F.lit("-7")), F.concat(F.lit("CPV "), c))))
    return codes(spark, sf_dir).select("notice_id", X.clean_codes(rough).alias("codes"))


@query(f"""
WITH {CODES} SELECT notice_id, len([c FOR c IN cpv_codes IF starts_with(c, '72')]) > 0 AS division, len([c FOR c IN cpv_codes IF starts_with(c, '480001')]) > 0 AS family FROM codes""")
def cpv_prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes(spark, sf_dir).select("notice_id", X.code_matches(F.col("cpv_codes"), "72000000").alias("division"), X.code_matches(F.col("cpv_codes"), "48000100").alias("family"))


#: Canonical form of the web table's URLs, which have no ports or user info.
CANONICAL = r"""
  lower(regexp_extract(url, '^([A-Za-z]+)://([^/?#]*)', 1)) || '://' || lower(regexp_extract(url, '^([A-Za-z]+)://([^/?#]*)', 2))
  || CASE WHEN rtrim(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/') = '' THEN '/' ELSE rtrim(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/') END
  || coalesce('?' || nullif(array_to_string(list_sort([p FOR p IN string_split(regexp_extract(url, '\?([^#]*)', 1), '&') IF p <> '' AND NOT (split_part(lower(p), '=', 1) IN (""" + ", ".join(f"'{p}'" for p in U.TRACKING) + r"""))]), '&'), ''), '')
  || CASE WHEN regexp_matches(url, '#[/!]') THEN '#' || regexp_extract(url, '#(.*)$', 1) ELSE '' END"""


@query(f"SELECT page_id, {CANONICAL} AS canonical FROM pages")
def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", U.canonical(F.col("url")).alias("canonical"))


@query(r"SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://([^/?#]*)', 1)) || '://' || lower(regexp_extract(url, '^([A-Za-z]+)://([^/?#]*)', 2)) || regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS identity FROM pages")
def url_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", U.identity(F.col("url")).alias("identity"))


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'scheme' WHEN page_id % 4 = 1 THEN 'private' END AS reason FROM pages")
def url_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("page_id") % 4 == 0, F.regexp_replace("url", "^https?", "ftp")).when(F.col("page_id") % 4 == 1, F.regexp_replace("url", "//[^/]*", "//10.0.0.7:80")).otherwise(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", U.guarded(moved).alias("reason"))


@query(r"SELECT page_id, 'https://***redacted***@' || regexp_extract(url, '//([^/?#]*)', 1) || regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) || '?token=***redacted***&page=2' AS safe FROM pages")
def redact_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_url = F.concat(F.lit("https://me:pw@"), U.host(F.col("url")), F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1), F.lit("?token=abc&page=2"))
    return read(spark, sf_dir, "pages").select("page_id", U.redacted(open_url).alias("safe"))


@query("""SELECT event_id, '***redacted***' AS token, props->>'k' AS k FROM events""")
def redact_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.nested import redact_map as redact

    given = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("api_token"), F.lit("s3cr3t")))
    return read(spark, sf_dir, "events").select("event_id", redact(given).alias("m")).select("event_id", F.col("m")["api_token"].alias("token"), F.col("m")["k"].alias("k"))


@query("""
WITH a AS (SELECT l_orderkey, list({'kind': CASE WHEN l_linenumber % 3 = 0 THEN 'total' ELSE 'part' END, 'amount': CASE WHEN l_linenumber % 4 = 1 THEN 0 ELSE l_extendedprice END} ORDER BY l_linenumber, l_partkey, l_extendedprice) AS amounts FROM lineitem GROUP BY 1)
SELECT l_orderkey, coalesce([x.amount FOR x IN amounts IF x.kind = 'total' AND x.amount <> 0][1], [x.amount FOR x IN amounts IF x.amount <> 0][1]) AS amount FROM a""")
def pick_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.nested import pick_amount as pick

    item = F.struct("l_linenumber", "l_partkey", "l_extendedprice", F.expr("case when l_linenumber % 3 = 0 then 'total' else 'part' end").alias("kind"), F.expr("case when l_linenumber % 4 = 1 then 0D else l_extendedprice end").alias("amount"))
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("amounts")).select("l_orderkey", pick(F.col("amounts")).alias("amount"))


@query("""
SELECT p_partkey, list_sort(list_distinct([lpad((p_partkey % 1000000)::VARCHAR, 8, '0'), lpad((p_size)::VARCHAR, 8, '7')])) AS codes FROM part""")
def collect_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.nested import collect_codes as collect

    body = F.expr("concat('{\"cpv\":[{\"code\":\"', lpad(cast(p_partkey % 1000000 as string), 8, '0'), '-3\"}],\"cpv_code\":\"', lpad(cast(p_size as string), 8, '7'), '\",\"main_cpv\":null}')")
    return read(spark, sf_dir, "part").select("p_partkey", collect(body).alias("codes"))


@query(r"""
SELECT doc_id, substr(CASE WHEN doc_id % 2 = 0 THEN 'given' ELSE array_to_string([regexp_replace(x, '</?em>', '', 'g') FOR x IN string_split(text, chr(10))], ' … ') END, 1, 4000) AS description FROM documents""")
def join_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.nested import join_highlights as join

    marked = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("<em>"), x, F.lit("</em>")))
    return docs(spark, sf_dir).select("doc_id", join(F.when(F.col("doc_id") % 2 == 0, "given"), marked).alias("description"))


@query(f"""
WITH {NOTICES} SELECT notice_id, CASE WHEN status <> 'unknown' OR deadline IS NULL THEN status WHEN deadline > TIMESTAMP '1998-06-01' THEN 'open' ELSE 'closed' END AS status, status = 'unknown' AND deadline IS NOT NULL AS derived FROM notices""")
def derive_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.maintenance import derived_status

    return notices(spark, sf_dir).select("notice_id", derived_status(now()).alias("s")).select("notice_id", "s.status", "s.derived")


@query(f"WITH {NOTICES} SELECT notice_id, round(epoch(deadline - TIMESTAMP '1998-06-01') / 86400.0, 6) AS days FROM notices")
def days_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.scoring import days_until

    return notices(spark, sf_dir).select("notice_id", F.round(days_until("deadline", now()), 6).alias("days"))


@query(f"""
WITH {NOTICES}, t AS (SELECT *, 'Notice ' || notice_id AS head FROM notices)
SELECT notice_id, CASE WHEN notice_id % 13 = 0 THEN NULL ELSE head END AS title, CASE WHEN notice_id % 13 = 0 THEN 'title' END AS rejected, date_trunc('day', publication) AS publication,
  floor(budget)::DECIMAL(18,2) AS budget, CASE WHEN budget IS NULL THEN NULL ELSE currency END AS currency, procedure, lower(replace(buyer, '#', '.')) || '@example.org' AS email, country FROM t""")
def normalize_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.normalize import normalize

    rough = notices(spark, sf_dir).select(
        "notice_id", F.expr("case when notice_id % 13 = 0 then '  ' else concat(' Notice  ', notice_id, ' ') end").alias("title"), F.date_format("publication", "dd/MM/yyyy").alias("publication"),
        F.expr("concat(cast(cast(floor(budget) as bigint) as string), ' ', currency)").alias("budget"), F.upper(F.replace("procedure", F.lit("_"), F.lit("-"))).alias("procedure"),
        F.concat(F.lit("contact: "), F.replace("buyer", F.lit("#"), F.lit(".")), F.lit("@Example.org")).alias("contact"), "country",
    )
    return normalize(rough)


@query(r"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[\w.+-]+@[\w-]+\.[\w.-]+', '[EMAIL]', 'g'), '\+?\d[\d ().-]{7,}\d', '[PHONE]', 'g')) AS masked, coalesce(len(regexp_extract_all(text, '[\w.+-]+@[\w-]+\.[\w.-]+')), 0) AS emails,
  coalesce(len(regexp_extract_all(regexp_replace(text, '[\w.+-]+@[\w-]+\.[\w.-]+', '[EMAIL]', 'g'), '\+?\d[\d ().-]{7,}\d')), 0) AS phones FROM documents""")
def mask_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = docs(spark, sf_dir).select("doc_id", X.masked_with_counts(F.col("text")).alias("m"))
    return found.select("doc_id", F.sha2("m.text", 256).alias("masked"), F.col("m.counts")["[EMAIL]"].cast("long").alias("emails"), F.col("m.counts")["[PHONE]"].cast("long").alias("phones"))


@query(f"SELECT doc_id, sha256(text) AS raw_sha256, sha256({fold_sql('text')}) AS text_sha256 FROM documents")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("raw_sha256"), F.sha2(X.fold(F.col("text")), 256).alias("text_sha256"))


@query(f"WITH {NOTICES} SELECT notice_id, substr(sha256(buyer || chr(31) || country || chr(31) || notice_id), 1, 32) AS key FROM notices")
def stable_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.nested import idempotency_key

    return notices(spark, sf_dir).select("notice_id", idempotency_key("buyer", "country", "notice_id").alias("key"))


@query(r"""
WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^.*[/\\]', ''), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS n FROM pages)
SELECT page_id, substr(CASE WHEN n = '' THEN 'file' ELSE n END, 1, 120) AS name FROM b""")
def safe_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", U.file_name(F.col("url")).alias("name"))


@query(f"WITH {ATTACHMENTS} SELECT notice_id, position, name, CASE WHEN contains(name, 'cahier') THEN 0 ELSE 1 END AS priority FROM attachments")
def document_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.windows import document_rank

    return attachments(spark, sf_dir).select("notice_id", "position", "name", document_rank("name").alias("priority"))


@query("SELECT doc_id, coalesce([trim(x) FOR x IN string_split(text, chr(10)) IF length(trim(x)) BETWEEN 8 AND 300][1], 'doc-' || doc_id) AS title FROM documents")
def title_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.nested import title_of

    return docs(spark, sf_dir).select("doc_id", title_of(F.col("text"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("title"))


TOKENS = f"[t FOR t IN string_split({fold_sql('text')}, ' ') IF length(t) > 2 AND t NOT IN ({STOPS})]"


@query(f"SELECT doc_id, len({TOKENS}) AS n, sha256(array_to_string({TOKENS}, ' ')) AS tokens FROM documents")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", X.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("tokens"))


@query(f"""
WITH f AS (SELECT doc_id, replace({fold_sql('text')}, ' ', '_') AS f FROM documents)
SELECT doc_id, CASE WHEN f = '' THEN 0 WHEN length(f) < 4 THEN 1 ELSE length(f) - 3 END AS n, sha256(array_to_string(CASE WHEN f = '' THEN [] WHEN length(f) < 4 THEN [f] ELSE [f[i:i+3] FOR i IN range(1, length(f) - 2)] END, '|')) AS grams FROM f""")
def char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", X.char_grams(F.col("text")).alias("g")).select("doc_id", F.size("g").cast("long").alias("n"), F.sha2(F.array_join("g", "|"), 256).alias("grams"))


WORDS = r"[w FOR w IN regexp_split_to_array(text, '\s+') IF w <> '']"


@query(f"""
WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents), i AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) <= 150 THEN 1 ELSE ceil((len(w) - 150) / 120.0)::INT + 1 END)) AS i FROM w)
SELECT doc_id, i AS position, sha256(array_to_string(w[i * 120 + 1 : i * 120 + 150], ' ')) AS chunk FROM i""")
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.posexplode(X.chunks_overlapping(F.col("text"))).alias("p", "c")).select("doc_id", F.col("p").cast("long").alias("position"), F.sha2("c", 256).alias("chunk"))


@query(f"""
WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents), i AS (SELECT doc_id, w, unnest(range(0, (len(w) + 69) // 70)) AS i FROM w)
SELECT doc_id, i AS position, sha256(array_to_string(w[i * 70 + 1 : i * 70 + 70], ' ')) AS chunk FROM i""")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.posexplode(X.chunks_fixed(F.col("text"))).alias("p", "c")).select("doc_id", F.col("p").cast("long").alias("position"), F.sha2("c", 256).alias("chunk"))


@query(rf"""
WITH f AS (SELECT doc_id, {fold_sql('text')} AS f FROM documents)
SELECT doc_id, regexp_matches(f, '(^|[^\p{{L}}\p{{N}}_])edition([^\p{{L}}\p{{N}}_]|$)') AS single, regexp_matches(f, '(^|[^\p{{L}}\p{{N}}_])of the([^\p{{L}}\p{{N}}_]|$)') AS phrase FROM f""")
def whole_word_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = docs(spark, sf_dir).select("doc_id", X.fold(F.col("text")).alias("f"))
    return folded.select("doc_id", X.whole_word(F.col("f"), "Édition").alias("single"), X.whole_word(F.col("f"), "of the").alias("phrase"))
