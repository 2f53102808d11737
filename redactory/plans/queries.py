"""One query for each operator over the given tables, with DuckDB SQL where SQL
can express it. Names are those of the operators."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redactory.functions import text as X
from redactory.functions.let import let, let_all
from redactory.operators import consistency, entities, lexicon, merge, metadata, model, organisations, report, reshape, rewrite, scan, score
from redactory.plans import model_chain, pipeline
from redactory.plans import rules as R
from redactory.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_documents(spark, f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """A pattern of ours for the SQL engine, whose blanks lack the vertical tab."""
    within = re.sub(r"\[[^]]*\]", lambda m: m[0].replace(r"\s", r"\s\x0B"), pattern)
    bare = re.sub(r"(\[[^]]*\])|\\s", lambda m: m[1] or r"[\s\x0B]", within)
    return re.sub(r"\\S", r"[^\\s\\x0B]", bare)


# --- base spans: overlapping patterns both engines understand ------------------------
BASE = (("EMAIL", R.EMAIL, 0.98), ("URL", r"[A-Za-z0-9-]+\.example\.[a-z]+", 0.90), ("IP", R.IPV4, 0.90), ("NUMBER", r"[0-9]{2,}", 0.70))


def base_spans(spark: SparkSession, sf_dir: str, kinds=BASE) -> DataFrame:
    """One pass over the texts for all patterns."""

    def found(label: str, pattern: str, confidence: float):
        return F.transform(scan.matches(F.col("text"), pattern), lambda m: scan.span(m["start"], m["end"], label, m["text"], confidence, "rule"))

    return docs(spark, sf_dir).select("doc_id", F.inline(F.concat(*(found(*kind) for kind in kinds))))


def span_sql(label: str, pattern: str, confidence: float, source: str = "documents") -> str:
    p = q(pattern)
    return f"""SELECT doc_id, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::INTEGER AS "start",
  (list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))))::INTEGER AS "end",
  '{label}' AS label, m[i] AS text, {confidence}::DOUBLE AS confidence, 'rule' AS source
FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS g FROM {source}))"""


BASE_SQL = " UNION ALL ".join(span_sql(*kind) for kind in BASE)
EMAILS_SQL = span_sql(*BASE[0])
WITH_B = f"WITH b AS ({BASE_SQL})"
RANK_SQL = "CASE WHEN label IN ('EMAIL','PHONE','SSN','CARD','ACCOUNT','SWIFT','URL','IP','DOCID') THEN 3 WHEN label IN ('NAME','ORG','BRAND','LOC') THEN 2 WHEN label IN ('MONEY','NUMBER','DATE','PERCENT') THEN 1 ELSE 0 END"


def columns(name: str, sql: str | None, fn):
    """A query that is a projection of documents."""

    @query(name, None if sql is None else f"SELECT doc_id, {sql} FROM documents")
    def run(spark, sf_dir):
        return docs(spark, sf_dir).select("doc_id", *fn(F.col("text")))

    return run


LINE_SQL = "line"
LINES_SQL = "(SELECT doc_id, i - 1 AS line_no, ls[i] AS line, n_chars FROM (SELECT doc_id, ls, n_chars, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, n_chars, string_split(text, chr(10)) AS ls FROM documents)))"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every text is a phrase: (doc_id, line_no, line, n_chars)."""
    return docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"), "n_chars").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line", "n_chars")


def line_columns(name: str, sql: str, fn):
    """A query that is a projection of all lines."""

    @query(name, f"SELECT doc_id, line_no, {sql} FROM {LINES_SQL}")
    def run(spark, sf_dir):
        return lines(spark, sf_dir).select("doc_id", "line_no", *fn(F.col("line")))

    return run


# --- S1, S2 -----------------------------------------------------------------------------
query("s1_read_documents", "SELECT doc_id, coalesce(text, '') AS text, lang, source, n_chars FROM documents")(docs)


def _parts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("part_rank"), F.col("turn").alias("seq"), "text")


@query("s2_stitch_parts", "SELECT conv_id AS doc_id, string_agg(text || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def s2_stitch(spark, sf_dir):
    return tables.stitch_parts(_parts(spark, sf_dir))


@query("s2_map_spans_to_parts", f"""WITH p AS (SELECT conv_id AS doc_id, turn AS seq, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM conversations),
t AS (SELECT doc_id, string_agg(text || chr(10), '' ORDER BY seq) AS text FROM p GROUP BY doc_id), s AS ({span_sql('WORD', '[A-Z][a-z]{6,}', 0.5, 't')})
SELECT s.doc_id, s."start", s."end", s.text, seq, ("start" - lo)::INTEGER AS part_start, (least("end", lo + length(p.text)) - lo)::INTEGER AS part_end FROM s JOIN p ON s.doc_id = p.doc_id AND s."start" >= lo AND s."start" <= lo + length(p.text)""")
def s2_map(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    found = scan.scan_regex(tables.stitch_parts(parts), "WORD", "[A-Z][a-z]{6,}", 0.5)
    return tables.map_spans_to_parts(found, parts).select("doc_id", "start", "end", "text", "seq", "part_start", "part_end")


@query("s6_audit_records", f"""{WITH_B} SELECT d.doc_id, sha256(d.text) AS input_sha256, count(b.doc_id) AS n_spans, coalesce(min(b."start"), -1)::INTEGER AS first_start FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id GROUP BY d.doc_id, d.text""")
def s6_audit(spark, sf_dir):
    spans = base_spans(spark, sf_dir).withColumn("entity_id", F.lit(None).cast("string"))
    packed = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "label", "text", "confidence", "source", "entity_id"))).alias("spans"))
    whole = docs(spark, sf_dir).join(packed, "doc_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast(pipeline.IDENTIFIED))).withColumn("suppressed", F.array().cast(pipeline.SUPPRESSED))
    return report.audit_records(whole).select("doc_id", "input_sha256", F.size("spans").cast("long").alias("n_spans"), F.coalesce(F.get("spans", F.lit(0))["start"], F.lit(-1)).alias("first_start"))


@query("s8_failure_rows", r"""SELECT page_id AS doc_id, 'FETCH' AS code, 'failed' AS message, regexp_replace('see /home/u/' || page_id || '.txt', '/(?:[\w.\-]+/)+[\w.\-]*', '<path>', 'g') AS details FROM pages""")
def s8_failures(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    rows = p.select(F.col("page_id").alias("doc_id"), F.lit("FETCH").alias("code"), F.lit("failed").alias("message"), F.concat(F.lit("see /home/u/"), "page_id", F.lit(".txt")).alias("details"))
    return tables.failure_rows(rows)


@query("s5_parse_model_responses", "SELECT conv_id AS doc_id, turn::INTEGER AS chunk_no, 'Jane ' || conv_id AS text, 'NAME' AS label FROM conversations")
def s5_parse(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    body = F.concat(F.lit('{"entities":[{"text":"Jane '), F.col("conv_id").cast("string"), F.lit('","type":"PERSON"}'))
    # every other response is cut off, every third fenced: both parsers are used
    end = F.when(F.col("turn") % 2 == 0, F.lit("]}")).otherwise(F.lit(""))
    response = F.when(F.col("turn") % 3 == 2, F.concat(F.lit("```json\n"), body, end, F.lit("\n```"))).otherwise(F.concat(F.lit("Here: "), body, end))
    found, _ = model.parse_model_responses(c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("chunk_no"), response.alias("response")))
    return found.select("doc_id", "chunk_no", "text", "label")


# --- X: scalar expressions -----------------------------------------------------------------
columns("x1_scan_normalize", f"translate(text, {q(X.APOSTROPHES + X.DASHES)}, {q(chr(39) * 5 + '-' * 6)}) AS folded", lambda t: [X.scan_normalize(t).alias("folded")])
columns("x2_ascii_fold", reduce(lambda a, kv: f"replace({a}, {q(kv[0])}, {q(kv[1])})", X.ASCII_FORMS.items(), "text") + " AS folded", lambda t: [X.ascii_fold(t).alias("folded")])
columns("x3_fold_quotes", "translate(text, '‘’', '''''') AS folded", lambda t: [X.fold_quotes(t).alias("folded")])
DET = "|".join(X.DETERMINERS)
BARE_SQL = rf"regexp_replace(regexp_replace({LINE_SQL}, '^\s+|\s+$', '', 'g'), '(?i)^(?:{DET})\s+', '')"
KEY_SQL = rf"""regexp_replace(regexp_replace(regexp_replace(lower(trim({BARE_SQL})), '[''’]s\s*$|[''’]\s*$', ''), '[.,;:!?"'']+$', ''), '\s+', ' ', 'g')"""
line_columns("x4_exclusion_key", f"{KEY_SQL} AS key", lambda t: [X.exclusion_key(F.col("line")).alias("key")])
line_columns("x5_singular_keys", rf"""len(list_filter([{KEY_SQL}, CASE WHEN {KEY_SQL} LIKE '%ies' AND length({KEY_SQL}) > 3 THEN {KEY_SQL}[:-4] || 'y' WHEN {KEY_SQL} LIKE '%s' AND length({KEY_SQL}) > 1 THEN rtrim({KEY_SQL}[:-2]) END], lambda x: x IS NOT NULL AND x <> ''))::INTEGER AS n_keys""", lambda t: [F.size(X.singular_keys(X.exclusion_key(F.col("line")))).alias("n_keys")])


# every line with and without legal forms behind it: each suffix goes once, in list order
FORMED_SQL = "line || CASE doc_id % 4 WHEN 0 THEN ' co inc' WHEN 1 THEN ' Inc.' WHEN 2 THEN ' L.L.C.' ELSE '' END"
TAILLESS_SQL = reduce(lambda x, suffix: f"regexp_replace({x}, ' {re.escape(suffix)}$', '')", X.LEGAL_SUFFIXES, f"replace(lower({FORMED_SQL}), '&', 'and')")


@query("x6_cluster_key", rf"SELECT doc_id, line_no, regexp_replace(trim(regexp_replace({TAILLESS_SQL}, '[^\p{{L}}\p{{N}}\s]', '', 'g')), ' {{2,}}', ' ', 'g') AS key FROM {LINES_SQL}")
def x6_key(spark, sf_dir):
    formed = F.concat("line", F.expr("CASE doc_id % 4 WHEN 0 THEN ' co inc' WHEN 1 THEN ' Inc.' WHEN 2 THEN ' L.L.C.' ELSE '' END"))
    return lines(spark, sf_dir).select("doc_id", "line_no", X.cluster_key(formed).alias("key"))


line_columns("x7_org_key", rf"""lower(trim(regexp_replace(regexp_replace({LINE_SQL}, '[^\p{{L}}\p{{N}}\p{{M}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS key, list_filter(regexp_extract_all({LINE_SQL}, '[A-Za-z0-9]+'), lambda x: length(x) >= 2) AS tokens""", lambda t: [X.org_key(F.col("line")).alias("key"), X.org_tokens(F.col("line")).alias("tokens")])
DIGITS_SQL = "regexp_replace(text, '[^0-9]', '', 'g')"
LUHN_SQL = "list_sum(list_transform(range(1, length(d) + 1), lambda k: CASE WHEN (length(d) - k) % 2 = 1 THEN (CASE WHEN d[k]::INT > 4 THEN d[k]::INT * 2 - 9 ELSE d[k]::INT * 2 END) ELSE d[k]::INT END)) % 10 = 0"
CARD_RUN = r"[0-9](?:[ -]?[0-9]){12,18}"


@query("x8_luhn_ok", f"WITH s AS ({span_sql('CARD', CARD_RUN, 0.92)}), n AS (SELECT *, {DIGITS_SQL} AS d FROM s) SELECT doc_id, \"start\", text, {LUHN_SQL} AS ok FROM n")
def x8_luhn(spark, sf_dir):
    return scan.scan_regex(docs(spark, sf_dir), "CARD", CARD_RUN, 0.92).select("doc_id", "start", "text", X.luhn_ok(F.col("text")).alias("ok"))


STOP_SQL = ", ".join(q(w) for w in X.ACRONYM_STOP_WORDS)
line_columns("x9_org_acronym", f"array_to_string(list_transform(list_filter(regexp_extract_all({LINE_SQL}, '[A-Za-z]+'), lambda x: (lower(x) NOT IN ({STOP_SQL}) OR (lower(x) = 'a' AND x[1] = 'A')) AND lower(x) NOT IN ({', '.join(q(s) for s in X.ACRONYM_SUFFIXES)})), lambda x: upper(x[1])), '') AS acronym", lambda t: [X.org_acronym(F.regexp_extract_all(F.col("line"), F.lit("[A-Za-z]+"), F.lit(0))).alias("acronym")])
NAMES = ("person", "Company", " gpe ", "PRODUCT", "currency", "quantity", "date", "weapon", "HUMAN", "brand", "place", "")
columns("x10_canonical_label", f"CASE upper(trim([{', '.join(q(n) for n in NAMES)}][doc_id % 12 + 1])) " + " ".join(f"WHEN {q(a)} THEN {q(label)}" for label, names in X.LABEL_NAMES.items() for a in names) + " END AS label", lambda t: [X.canonical_label(F.get(F.array(*(F.lit(n) for n in NAMES)), (F.col("doc_id") % 12).cast("int"))).alias("label")])


@query("x11_label_rank", f"{WITH_B} SELECT doc_id, \"start\", label, ({RANK_SQL})::INTEGER AS rank FROM b")
def x11_rank(spark, sf_dir):
    return base_spans(spark, sf_dir).select("doc_id", "start", "label", X.label_rank(F.col("label")).alias("rank"))


columns("x12_combine_confidence", "greatest(0.0, least(1.0, n_chars / 10000.0::DOUBLE + (doc_id % 3) * 0.07::DOUBLE + 0.0 - 0.05::DOUBLE)) < 0.88::DOUBLE AS low", lambda t: [X.is_low_confidence(X.combine_confidence(F.col("n_chars") / 10000.0, F.col("doc_id") % 3, 0.0, 0.05)).alias("low")])
columns("x13_confidence_band", "CASE WHEN n_chars / 5000.0::DOUBLE >= 0.9 THEN 'high' WHEN n_chars / 5000.0::DOUBLE >= 0.7 THEN 'medium' ELSE 'low' END AS band", lambda t: [X.confidence_band(F.col("n_chars") / 5000.0).alias("band")])
MADE_SQL = "CASE doc_id % 5 WHEN 0 THEN CAST(n_chars AS STRING) WHEN 1 THEN '0.' || CAST(doc_id AS STRING) WHEN 2 THEN lang WHEN 3 THEN '-3' ELSE '87.5' END"
query("x22_normalize_confidence", f"WITH c AS (SELECT doc_id, coalesce(try_cast({MADE_SQL} AS DOUBLE), 0.95) AS x FROM documents) SELECT doc_id, greatest(0.0, least(1.0, CASE WHEN x > 1 THEN x / 100 ELSE x END))::DOUBLE AS confidence FROM c")(
    lambda spark, sf_dir: docs(spark, sf_dir).select("doc_id", X.normalize_confidence(F.expr(MADE_SQL)).alias("confidence"))
)
columns("x15_doc_type", "CASE WHEN contains(lower(left(text, 1000)), 'shareholder') AND contains(lower(left(text, 1000)), 'consent') THEN 'shareholder_consent' WHEN contains(lower(left(text, 1000)), 'purchase agreement') THEN 'purchase_agreement' WHEN contains(lower(left(text, 1000)), 'employment agreement') THEN 'employment_agreement' ELSE 'legal_document' END AS kind", lambda t: [X.doc_type(t).alias("kind")])
line_columns("x16_looks_like_title", rf"regexp_matches({LINE_SQL}, {q(X.TITLE_WORDS)}) AND NOT regexp_matches({LINE_SQL}, {q(X.COMPANY_HINTS)}) AND len(list_filter(string_split_regex({LINE_SQL}, '\s+'), lambda x: trim(x, ',.;:()[]{{}}') <> '')) >= 2 AS title", lambda t: [X.looks_like_title(F.col("line")).alias("title")])
WORDS_SQL = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"
SCORE_SQL = f"greatest(0.3, least(3.0, (CASE WHEN len({WORDS_SQL}) < 500 THEN 0.6 WHEN len({WORDS_SQL}) < 2000 THEN 1.0 WHEN len({WORDS_SQL}) < 5000 THEN 1.4 ELSE 2.0 END)::DOUBLE * (1 + (" + " + ".join(f"contains(lower(text), '{t}')::INT" for t in X.LEGAL_TERMS) + f") / 6.0::DOUBLE * 0.3::DOUBLE + len(list_filter({WORDS_SQL}, lambda x: regexp_matches(x, '^[A-Z]') AND length(x) > 2)) / greatest(len({WORDS_SQL}), 1)::DOUBLE * 0.2::DOUBLE)))"
columns("x17_complexity_score", f"round({SCORE_SQL}, 6) AS score", lambda t: [F.round(X.complexity_score(t), 6).alias("score")])


@query("x17_phase_seconds", "WITH p(phase, base, factor) AS (VALUES " + ", ".join(f"('{n}', {b}::DOUBLE, {f}::DOUBLE)" for n, b, f in X.PHASES) + f"), s AS (SELECT doc_id, {SCORE_SQL} AS score FROM documents) SELECT doc_id, phase, round(base + base * factor * (score - 1.0), 5) AS seconds FROM s, p")
def x17_phases(spark, sf_dir):
    # the score is computed before a document becomes a row a phase
    timed = let(X.complexity_score(F.col("text")), lambda score: F.array(*(F.struct(F.lit(n).alias("phase"), F.round(X.phase_seconds(F.lit(b), F.lit(f), score), 5).alias("seconds")) for n, b, f in X.PHASES)))
    return docs(spark, sf_dir).select("doc_id", F.inline(timed))


@query("x18_target_class", r"""WITH t AS (SELECT page_id, unnest([url, '//srv/' || page_id, 'C:\Users\x', '/a/b', 'http://10.0.0.' || (page_id % 9), 'http://intranet/x', '../up']) AS target FROM pages)
SELECT page_id, target, CASE WHEN starts_with(target, '\\') OR starts_with(target, '//') THEN 'unc_path' WHEN contains(target, '\Users\') OR contains(target, '/Users/') OR contains(target, '/home/') THEN 'user_path'
WHEN regexp_matches(target, '^https?://') AND (regexp_matches(regexp_extract(target, '^https?://([^/]*)', 1), '^(127\.|10\.|192\.168\.|169\.254\.)|\.local$|\.lan$') OR NOT contains(regexp_extract(target, '^https?://([^/]*)', 1), '.')) THEN 'internal_url'
WHEN regexp_matches(target, '^[A-Za-z]:[\\/]') OR starts_with(target, '/') OR starts_with(target, '../') THEN 'file_path' ELSE 'external' END AS kind FROM t""")
def x18_targets(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    made = F.array("url", F.concat(F.lit("//srv/"), "page_id"), F.lit("C:\\Users\\x"), F.lit("/a/b"), F.concat(F.lit("http://10.0.0."), F.col("page_id") % 9), F.lit("http://intranet/x"), F.lit("../up"))
    return p.select("page_id", F.explode(made).alias("target")).withColumn("kind", metadata.target_class(F.col("target")))


@query("x18_sanitize_links", r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) SELECT page_id, CASE WHEN starts_with(href, '/') THEN 'urn:redactory:redacted' ELSE href END AS target FROM h""")
def x18_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    hrefs = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return hrefs.select("page_id", metadata.sanitize_target(F.col("href")).alias("target"))


columns("x19_content_hash", "sha256(text) AS sha256", lambda t: [X.content_hash(t).alias("sha256")])
columns("x20_bounded_value", "CASE WHEN length(text) <= 2000 THEN text END AS value, CASE WHEN length(text) > 2000 THEN left(text, 2000) END AS preview, length(text) > 2000 AS truncated", lambda t: [X.bounded_value(t, 2000).alias("v")[c].alias(c) for c in ("value", "preview", "truncated")])


@query("x21_context_snippet", f"WITH b AS ({EMAILS_SQL}) SELECT b.doc_id, b.\"start\", trim(replace(substring(d.text, greatest(0, b.\"start\" - 100) + 1, least(length(d.text), b.\"end\" + 100) - greatest(0, b.\"start\" - 100)), chr(10), ' ')) AS snippet FROM b JOIN documents d USING (doc_id)")
def x21_context(spark, sf_dir):
    b = base_spans(spark, sf_dir, BASE[:1]).drop("text").join(docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    return b.select("doc_id", "start", X.context_snippet(F.col("text"), F.col("start"), F.col("end"), F.col("label")).alias("snippet"))


# --- R: scans --------------------------------------------------------------------------
def _rule(name: str, label: str, pattern: str, confidence: float, portable: bool):
    @query(name, span_sql(label, pattern, confidence) if portable else None)
    def run(spark, sf_dir):
        rule = next(r for r in R.RULES if r.pattern == pattern)
        return docs(spark, sf_dir).select("doc_id", F.inline(scan.rule_spans(F.col("text"), rule)))


# What a rule finds is too rare in the tables for these queries to show anything, so each
# text is followed by a line of its document's own: forms that match, and near misses. One
# expression, for both engines.
_ID4 = "lpad(CAST(doc_id % 10000 AS STRING), 4, '0')"
FORMS = {
    "SSN": f"CASE doc_id % 3 WHEN 0 THEN 'No. 123-45-' || {_ID4} || '.' WHEN 1 THEN 'No. 123-456-7890 or 12-34-5678' ELSE 'x123-45-6789' END",
    "MONEY": "CASE doc_id % 4 WHEN 0 THEN 'a fee of $' || CAST(doc_id AS STRING) || ',500.00 due' WHEN 1 THEN 'EUR ' || CAST(doc_id % 90 + 1 AS STRING) || ' million or so' WHEN 2 THEN 'twenty five dollars' ELSE '12 dollar' END",
    "NUMBER": "CASE doc_id % 3 WHEN 0 THEN 'see [' || CAST(doc_id AS STRING) || '] and [1,234.5]' WHEN 1 THEN 'pay $[7] or [12,34]' ELSE '[x] [1' END",
    "SWIFT": "CASE doc_id % 3 WHEN 0 THEN 'code DEUTDE' || lpad(CAST(doc_id % 100 AS STRING), 2, '0') || ' or ABCDEFGH1JK' WHEN 1 THEN 'DEUTDEFF and deutde12' ELSE 'ABCDEF123' END",
    "IPV6": "CASE doc_id % 3 WHEN 0 THEN 'host 2001:db8:0:0:0:0:1:' || CAST(doc_id % 9999 AS STRING) || ' up' WHEN 1 THEN 'net fe80::1:' || CAST(doc_id % 9999 AS STRING) || ' up' ELSE 'at 10:45 or 1:2:3' END",
    "DOCID": "CASE doc_id % 3 WHEN 0 THEN 'Document ID: AB' || CAST(100000 + doc_id AS STRING) || ' here' WHEN 1 THEN 'see REF-' || CAST(1000 + doc_id AS STRING) || ' and CASEX' ELSE 'Doc: a1' END",
    "ADDRESS": "CASE doc_id % 3 WHEN 0 THEN 'at ' || CAST(doc_id % 900 + 1 AS STRING) || ' Evergreen Terrace, Springfield, IL 62704 now' WHEN 1 THEN 'to P.O. Box ' || CAST(doc_id AS STRING) || '; done' ELSE '12 Elm Street, Springfield' END",
    "COUNTY": "CASE doc_id % 3 WHEN 0 THEN 'in Orange County' WHEN 1 THEN 'the Borough of Kent' ELSE 'counties' END",
    "LABELLED": "CASE doc_id % 3 WHEN 0 THEN 'SSN: 1234' || lpad(CAST(doc_id % 100000 AS STRING), 5, '0') WHEN 1 THEN 'Social Security Number is 987654321' ELSE 'No. 123456789' END",
    "DEFINED": "'by ' || CASE doc_id % 3 WHEN 0 THEN 'Jane Anea (\"Anea\")' WHEN 1 THEN 'Mary B. Lorn (\"Lorn\")' ELSE 'Jane Anea (\"Bnea\")' END",
    "SIGNED": "CASE doc_id % 3 WHEN 0 THEN 'Name:   Jane Anea' WHEN 1 THEN 'Name: Mary B. Lorn' ELSE 'Name: JANE' END",
    "PLACE": "CASE doc_id % 6 WHEN 0 THEN 'said County' WHEN 1 THEN 'in Orange County' WHEN 2 THEN 'that County clerk' WHEN 3 THEN 'County clerk' WHEN 4 THEN 'the Parish of Kent' ELSE 'the County of Kent 3' END",
}


def formed(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    return docs(spark, sf_dir).withColumn("text", F.concat("text", F.lit("\n"), F.expr(FORMS[form])))


def formed_sql(form: str) -> str:
    return f"(SELECT doc_id, coalesce(text, '') || chr(10) || {FORMS[form]} AS text FROM documents)"


def _formed_rule(name: str, form: str, label: str, pattern: str, confidence: float, sql: str):
    """A rule over the formed texts; ``sql`` is its pattern without look-around."""

    @query(name, sql)
    def run(spark, sf_dir):
        rule = next(r for r in R.RULES if r.pattern == pattern)
        return formed(spark, sf_dir, form).select("doc_id", F.inline(scan.rule_spans(F.col("text"), rule)))


def planted_sql(form: str, label: str, confidence: float, source: str, *places: tuple[str, str, str]) -> str:
    """Spans on the formed line: (condition, offset in the line, text)."""
    return " UNION ALL ".join(
        f"SELECT doc_id, (length(coalesce(text, '')) + 1 + {at})::INTEGER AS \"start\", (length(coalesce(text, '')) + 1 + {at} + length({found}))::INTEGER AS \"end\", '{label}' AS label, {found} AS text, {confidence}::DOUBLE AS confidence, '{source}' AS source FROM documents WHERE {where}"
        for where, at, found in places
    )


query("r0_scan_regex", span_sql("WORD", "[A-Z][a-z]{8,}", 0.5))(lambda spark, sf_dir: scan.scan_regex(docs(spark, sf_dir), "WORD", "[A-Z][a-z]{8,}", 0.5))
_rule("r1_scan_email", "EMAIL", R.EMAIL, 0.98, True)
_rule("r2_scan_phone", "PHONE", R.PHONE, 0.96, False)
_formed_rule("r3_scan_ssn", "SSN", "SSN", R.SSN, 0.99, span_sql("SSN", R.SSN.replace("(?U)", ""), 0.99, formed_sql("SSN")))
_formed_rule("r5_scan_money", "MONEY", "MONEY", R.MONEY, 0.90, span_sql("MONEY", R.MONEY, 0.90, formed_sql("MONEY")))
_rule("r6_scan_percent", "PERCENT", R.PERCENT, 0.90, True)
BRACKET_SQL = r"[$€£¥]?\[(?:\d{1,3}(?:,\d{3})*|\d+)(?:\.\d+)?\]"  # the look-behind as a condition
_formed_rule("r7_scan_bracket_number", "NUMBER", "NUMBER", R.BRACKET_NUMBER, 0.70, f"SELECT * FROM ({span_sql('NUMBER', BRACKET_SQL, 0.70, formed_sql('NUMBER'))}) WHERE text[1] = '['")
_rule("r8_scan_account", "ACCOUNT", R.ACCOUNT, 0.80, False)
SWIFT_SQL = r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b"  # without the look-ahead, which is a condition then
_formed_rule("r9_scan_swift", "SWIFT", "SWIFT", R.SWIFT, 0.92, f"SELECT * FROM ({span_sql('SWIFT', SWIFT_SQL, 0.92, formed_sql('SWIFT'))}) WHERE regexp_matches(text, '[0-9]')")
_rule("r10_scan_card", "CARD", R.CARD, 0.92, False)
_rule("r11_scan_url", "URL", R.URL, 0.90, False)
_rule("r12_scan_ipv4", "IP", R.IPV4, 0.90, True)
_formed_rule("r12_scan_ipv6", "IPV6", "IP", R.IPV6, 0.90, span_sql("IP", R.IPV6, 0.90, formed_sql("IPV6")))
_formed_rule("r13_scan_doc_id", "DOCID", "DOCID", R.DOCID, 0.95, planted_sql("DOCID", "DOCID", 0.95, "rule", ("doc_id % 3 = 0", "0", "'Document ID: AB' || CAST(100000 + doc_id AS STRING)"), ("doc_id % 3 = 1", "4", "'REF-' || CAST(1000 + doc_id AS STRING)")))
_rule("r14_scan_date", "DATE", R.DATE, 0.88, False)
_rule("r15_scan_org", "ORG", R.ORG, 0.75, False)
# nothing follows an atomic alternative, so a plain group matches the same
ADDRESS_SQL = re2(R.ADDRESS.replace("(?>", "(?:"))
_formed_rule("r16_scan_address", "ADDRESS", "LOC", R.ADDRESS, 0.85, span_sql("LOC", ADDRESS_SQL, 0.85, formed_sql("ADDRESS")))
_formed_rule("r17_scan_county", "COUNTY", "LOC", R.COUNTY, 0.82, span_sql("LOC", R.COUNTY, 0.82, formed_sql("COUNTY")))
PLAIN_DATE = "(?i)" + "|".join(R.DATE_PLAIN)
query("r14_scan_plain_date", span_sql("DATE", PLAIN_DATE, 0.88))(lambda spark, sf_dir: scan.scan_regex(docs(spark, sf_dir), "DATE", PLAIN_DATE, 0.88))


@query("r4_scan_ssn_labelled", planted_sql("LABELLED", "SSN", 0.93, "rule", ("doc_id % 3 = 0", "5", f"'1234' || lpad(CAST(doc_id % 100000 AS STRING), 5, '0')"), ("doc_id % 3 = 1", "26", "'987654321'")))
def r4_ssn(spark, sf_dir):
    rule = next(r for r in R.RULES if r.label == "ACCOUNT")
    return formed(spark, sf_dir, "LABELLED").select("doc_id", F.inline(scan.rule_spans(F.col("text"), rule))).where("label = 'SSN'")


_NAMED = ("doc_id % 3 = 0", "'Jane Anea'"), ("doc_id % 3 = 1", "'Mary B. Lorn'")


@query("r18_scan_defined_name", planted_sql("DEFINED", "NAME", 0.90, "rule_defined_term", *((where, "3", name) for where, name in _NAMED)) + " UNION ALL " + planted_sql("DEFINED", "NAME", 0.88, "rule_defined_term", ("doc_id % 3 = 0", "15", "'Anea'"), ("doc_id % 3 = 1", "18", "'Lorn'")))
def r18_defined(spark, sf_dir):
    return formed(spark, sf_dir, "DEFINED").select("doc_id", F.inline(scan.defined_name_spans(F.col("text"))))


@query("r19_scan_signature_name", planted_sql("SIGNED", "NAME", 0.95, "rule_signature", ("doc_id % 3 = 0", "8", "'Jane Anea'"), ("doc_id % 3 = 1", "6", "'Mary B. Lorn'")))
def r19_signed(spark, sf_dir):
    return formed(spark, sf_dir, "SIGNED").select("doc_id", F.inline(scan.signature_spans(F.col("text"))))


query("r20_scan_gazetteer")(lambda spark, sf_dir: scan.scan_gazetteer(docs(spark, sf_dir)))
query("r22_scan_rules")(lambda spark, sf_dir: scan.scan_rules(docs(spark, sf_dir)))


@query("r21_scan_terms", f"""WITH e AS (SELECT DISTINCT doc_id, text AS term FROM ({EMAILS_SQL})), m AS (SELECT d.doc_id, d.text, e.term, unnest(range(1, len(string_split(d.text, e.term)))) AS i FROM documents d JOIN e USING (doc_id))
SELECT doc_id, (list_sum(list_transform(string_split(text, term)[1:i], lambda x: length(x))) + (i - 1) * length(term))::INTEGER AS "start", term AS text FROM m""")
def r21_terms(spark, sf_dir):
    terms = base_spans(spark, sf_dir, BASE[:1]).select("doc_id", F.col("text").alias("term"), F.lit("EMAIL").alias("label"))
    return scan.scan_terms(docs(spark, sf_dir), terms).select("doc_id", "start", "text")


# --- F: filters ---------------------------------------------------------------------------
@query("f1_filter_labels", f"{WITH_B} SELECT doc_id, \"start\", label FROM b WHERE label IN ('EMAIL', 'IP')")
def f1_labels(spark, sf_dir):
    return base_spans(spark, sf_dir).where(F.col("label").isin("EMAIL", "IP")).select("doc_id", "start", "label")


RUN = r"[0-9]{7,}"
CONTEXT_SQL = f"""WITH s AS ({span_sql('PHONE', RUN, 0.96)}) SELECT s.doc_id, s."start", regexp_matches(substring(d.text, greatest(s."start" - 120, 0) + 1, s."start" - greatest(s."start" - 120, 0)), {q(R.ACCOUNT_CONTEXT)}) OR regexp_matches(substring(d.text, s."end" + 1, 20), {q(R.CURRENCY_AFTER)}) AS account,
regexp_matches(substring(d.text, greatest(s."start" - 60, 0) + 1, s."start" - greatest(s."start" - 60, 0)), {q(R.PHONE_CONTEXT)}) OR regexp_matches(substring(d.text, s."end" + 1, 30), {q(R.PHONE_CONTEXT)}) AS phone FROM s JOIN documents d USING (doc_id)"""


@query("f2_f3_number_context", CONTEXT_SQL)
def f23_context(spark, sf_dir):
    s = scan.scan_regex(docs(spark, sf_dir), "PHONE", RUN, 0.96).drop("text").join(docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    return s.select("doc_id", "start", scan.account_context(F.col("text"), F.col("start"), F.col("end")).alias("account"), scan.phone_context(F.col("text"), F.col("start"), F.col("end")).alias("phone"))




@query("f4_excluded_phrases", f"""WITH k AS (SELECT DISTINCT {LINE_SQL} AS text, {KEY_SQL} AS key FROM {LINES_SQL}) SELECT text FROM k WHERE key IN (SELECT unnest([{', '.join(q(t) for t in lexicon.base_terms())}])) OR (key LIKE '%s' AND rtrim(key[:-2]) IN (SELECT unnest([{', '.join(q(t) for t in lexicon.base_terms())}]))) OR regexp_matches({BARE_SQL.replace(f'({LINE_SQL},', '(text,')}, '^(?i:t[a-z]+\\.$)')""")
def f4_excluded(spark, sf_dir):
    literals, _ = lexicon.read_exclusions(spark)
    patterns = spark.createDataFrame([(r"t[a-z]+\.$",)], "pattern string")
    return lexicon.excluded_phrases(lines(spark, sf_dir).select(F.col("line").alias("text")), literals, patterns)


def _orgs(spark, sf_dir):
    """Capitalised word pairs stand in for organisations."""
    return scan.scan_regex(docs(spark, sf_dir), "ORG", r"\b[A-Z][a-z]+ (?:of|the|and) [A-Z]?[a-z]+\b", 0.8)


@query("f5_drop_excluded_combinations")
def f5_combos(spark, sf_dir):
    kept, gone = organisations.drop_excluded_combinations(_orgs(spark, sf_dir), lexicon.Lexicon.read(spark))
    return kept.select("doc_id", "start", "text", F.lit(True).alias("kept")).unionByName(gone.select("doc_id", "start", "text", F.lit(False).alias("kept")))


@query("f8_classify_organisations")
def f8_generic(spark, sf_dir):
    return organisations.classify_organisations(_orgs(spark, sf_dir), lexicon.Lexicon.read(spark))


@query("x14_smart_split_clean")
def x14_split(spark, sf_dir):
    return organisations.split_clean(lines(spark, sf_dir).select(F.col("line").alias("text")), lexicon.Lexicon.read(spark))


LINE = r"[A-Z][^\n.]{40,80}"


@query("f6_drop_overlong_orgs", f"SELECT doc_id, \"start\", text FROM ({span_sql('ORG', LINE, 0.8)}) WHERE length(text) <= 60 OR (length(text) <= 90 AND regexp_matches(trim(text), {q(R.ORG_FORM_AT_END)}))")
def f6_overlong(spark, sf_dir):
    s = scan.scan_regex(docs(spark, sf_dir), "ORG", LINE, 0.8)
    return s.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "label", "text", "confidence", "source")).alias("spans")).select("doc_id", F.inline(reshape.drop_overlong_orgs(F.col("spans")))).select("doc_id", "start", "text")


PLACE = "(?i)(?:[a-z]+ )?(?:county|parish)(?: of [a-z]+| clerk)?(?: [0-9])?"
_LOW = "list_transform(regexp_extract_all(text, '[A-Za-z''’-]+'), lambda x: lower(x))"
_WORDS = ", ".join(q(w) for w in reshape.COUNTY_WORDS)
_GENERIC = ", ".join(q(w) for w in (*reshape.COUNTY_WORDS, *reshape.COUNTY_GENERIC, "of"))


@query("f9_drop_generic_county", f"""SELECT doc_id, "start", text FROM (SELECT *, {_LOW} AS low FROM ({span_sql('LOC', PLACE, 0.8, formed_sql('PLACE'))})) WHERE regexp_matches(text, '[0-9]')
OR (len(list_filter(low, lambda x: x NOT IN ({_GENERIC}))) > 0 AND NOT (low[-1] IN ({', '.join(q(w) for w in reshape.COUNTY_OFFICES)}) AND low[1] IN ({_WORDS})))""")
def f9_county(spark, sf_dir):
    s = scan.scan_regex(formed(spark, sf_dir, "PLACE"), "LOC", PLACE, 0.8)
    return s.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "label", "text", "confidence", "source")).alias("spans")).select("doc_id", F.inline(reshape.drop_generic_counties(F.col("spans")))).select("doc_id", "start", "text")


@query("f10_drop_invalid_spans", f"""{WITH_B}, s AS (SELECT doc_id, label, text, ("start" + CASE WHEN doc_id % 5 = 1 THEN 1 ELSE 0 END)::INTEGER AS "start", ("end" + CASE WHEN doc_id % 5 = 2 THEN 1000000 ELSE 0 END)::INTEGER AS "end" FROM b)
SELECT s.doc_id, s."start", s.label, CASE WHEN NOT (s."start" < s."end" AND s."end" <= length(d.text)) THEN 'invalid_span_bounds_out_of_range' ELSE 'invalid_span_text_mismatch' END AS reason FROM s JOIN documents d USING (doc_id)
WHERE NOT (s."start" < s."end" AND s."end" <= length(d.text)) OR substring(d.text, s."start" + 1, s."end" - s."start") <> s.text""")
def f10_invalid(spark, sf_dir):
    s = base_spans(spark, sf_dir).withColumn("start", F.col("start") + F.when(F.col("doc_id") % 5 == 1, 1).otherwise(0)).withColumn("end", F.col("end") + F.when(F.col("doc_id") % 5 == 2, 1000000).otherwise(0))
    return report.invalid_spans(s, docs(spark, sf_dir))[1].select("doc_id", "start", "label", "reason")


def _candidates(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", F.col("line").alias("text"), F.when(F.col("doc_id") % 2 == 0, "NAME").otherwise("ORG").alias("label"), (F.col("n_chars") % 100 / 100.0).alias("confidence"))


CAND_SQL = f"SELECT doc_id, {LINE_SQL} AS text, CASE WHEN doc_id % 2 = 0 THEN 'NAME' ELSE 'ORG' END AS label, (n_chars % 100 / 100.0)::DOUBLE AS confidence FROM {LINES_SQL}"


TITLE_SQL = rf"(regexp_matches(text, {q(X.TITLE_WORDS)}) AND NOT regexp_matches(text, {q(X.COMPANY_HINTS)}) AND len(list_filter(string_split_regex(text, '\s+'), lambda x: trim(x, ',.;:()[]{{}}') <> '')) >= 2)"
_TERMS_SQL = ", ".join(q(t) for t in lexicon.base_terms())
_OWN_KEY = KEY_SQL.replace(f"({LINE_SQL},", "(text,")
# a phrase's keys: with and without its determiner, and the singulars of both
GENERIC_SQL = " OR ".join(f"{k} IN ({_TERMS_SQL})" for key in (_OWN_KEY, _OWN_KEY.replace(BARE_SQL.replace(f"({LINE_SQL},", "(text,"), "text")) for k in (key, f"CASE WHEN {key} LIKE '%ies' AND length({key}) > 3 THEN {key}[:-4] || 'y' WHEN {key} LIKE '%s' AND length({key}) > 1 THEN rtrim({key}[:-2]) END"))


@query("f11_drop_titles_and_generics", f"SELECT doc_id, text FROM ({CAND_SQL}) WHERE NOT {TITLE_SQL} AND NOT coalesce({GENERIC_SQL}, false)")
def f11_titles(spark, sf_dir):
    return model.drop_titles_and_generics(_candidates(spark, sf_dir), *lexicon.read_exclusions(spark))[0].select("doc_id", "text")


# accented letters are letters to a word boundary here, but not to one of DuckDB's
@query("f12_valid_shape", rf"""WITH c AS ({CAND_SQL}), w AS (SELECT *, list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '') AS w FROM c)
SELECT doc_id, CASE WHEN trim(text) = '' THEN false WHEN label = 'NAME' THEN len(w) >= 2 AND len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z][a-z''’.-]*$'))) >= greatest(2, len(w) - 1)
ELSE len(w) >= 2 AND (regexp_matches(regexp_replace(text, '[À-ÿ]', 'x', 'g'), {q(model.DESIGNATORS)}) OR len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z][A-Za-z&''’.-]*$'))) >= 2) END AS valid FROM w""")
def f12_valid(spark, sf_dir):
    return _candidates(spark, sf_dir).select("doc_id", model.valid_shape(F.col("text"), F.col("label")).alias("valid"))


@query("f13_needs_validation", f"""WITH c AS ({CAND_SQL}), t AS (SELECT doc_id, label, CASE WHEN count(*) < 5 THEN 0.7 ELSE quantile_cont(confidence, 0.25) END AS threshold FROM c GROUP BY 1, 2)
SELECT doc_id, CASE WHEN coalesce({GENERIC_SQL}, false) OR confidence < threshold THEN true WHEN label = 'ORG' AND ({' OR '.join(f"contains(lower(text), {q(w)})" for w in model.ORG_DOUBTS)}) THEN true
WHEN label = 'NAME' AND ({' OR '.join(f"contains(lower(text), {q(w)})" for w in model.NAME_DOUBTS)}) THEN true WHEN length(text) > 60 THEN true WHEN confidence > 0.9 THEN false ELSE true END AS needs_validation FROM c JOIN t USING (doc_id, label)""")
def f13_needs(spark, sf_dir):
    return model.needs_validation(_candidates(spark, sf_dir), *lexicon.read_exclusions(spark)).select("doc_id", "needs_validation")


@query("f16_keep_redactable", f"{WITH_B} SELECT doc_id, \"start\", label, text FROM b WHERE length(text) % 3 <> 1")
def f16_redactable(spark, sf_dir):
    released = F.when(F.length("text") % 3 == 1, False).when(F.length("text") % 3 == 2, True)  # else nothing is said
    return rewrite.keep_redactable(base_spans(spark, sf_dir).withColumn("needs_redaction", released)).select("doc_id", "start", "label", "text")


def _decisions(spark, sf_dir):
    e = base_spans(spark, sf_dir, BASE[2:3])
    return e.select(model.decision_key(F.col("text"), F.col("label")).alias("key"), F.when(F.length("text") % 2 == 0, "SKIP").otherwise("REDACT").alias("classification"), F.when(F.length("text") % 4 == 0, 0.97).otherwise(0.94).alias("decision_confidence")).dropDuplicates(["key"])


@query("f14_j7_apply_cached_decisions", f"""{WITH_B} SELECT doc_id, "start", label, CASE WHEN label = 'IP' AND length(text) % 4 = 0 THEN 'skip' WHEN label = 'IP' AND length(text) % 2 = 0 THEN 'keep (low conf)' WHEN label <> 'IP' THEN 'keep (no decision)' ELSE 'keep' END AS validation_result, NOT (label = 'IP' AND length(text) % 4 = 0) AS needs_redaction FROM b""")
def f14_decisions(spark, sf_dir):
    joined = model.attach_cached_decisions(base_spans(spark, sf_dir), _decisions(spark, sf_dir))
    return model.apply_decisions(joined).select("doc_id", "start", "label", "validation_result", "needs_redaction")


@query("f15_override_rule_spans", f"{WITH_B} SELECT doc_id, \"start\", label FROM b WHERE NOT (label = 'IP' AND length(text) % 2 = 0)")
def f15_override(spark, sf_dir):
    return model.override_rule_spans(base_spans(spark, sf_dir), _decisions(spark, sf_dir), ("IP",))[0].select("doc_id", "start", "label")


# --- E: reshaping ------------------------------------------------------------------------
def _packed(spark, sf_dir, spans):
    packed = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "label", "text", "confidence", "source"))).alias("spans"))
    return packed.join(docs(spark, sf_dir).select("doc_id", "text"), "doc_id")


@query("e1_snap_to_tokens", f"""WITH s AS ({span_sql('NUMBER', '[0-9]{3}', 0.7)}), g AS (SELECT s.doc_id, s."start" - length(regexp_extract(left(d.text, s."start"), '[\\p{{Nd}}+\\-().,/]*$')) AS a, s."end" + length(regexp_extract(substring(d.text, s."end" + 1), '^[\\p{{Nd}}+\\-().,/]*')) AS b, d.text FROM s JOIN documents d USING (doc_id)),
t AS (SELECT doc_id, a, b, substring(text, a + 1, b - a) AS x FROM g) SELECT doc_id, (a + length(regexp_extract(x, '^[^\\p{{L}}\\p{{N}}]*')))::INTEGER AS "start", (b - length(regexp_extract(x, '[^\\p{{L}}\\p{{N}}]*$')))::INTEGER AS "end" FROM t""")
def e1_snap(spark, sf_dir):
    s = _packed(spark, sf_dir, scan.scan_regex(docs(spark, sf_dir), "NUMBER", "[0-9]{3}", 0.7))
    return s.select("doc_id", F.inline(let_all(reshape.snap_to_tokens, spans=F.col("spans"), text=F.col("text")))).select("doc_id", "start", "end")


@query("e2_settle_organisations")
def e2_clean(spark, sf_dir):
    return organisations.settle_organisations(_orgs(spark, sf_dir), lexicon.Lexicon.read(spark))


@query("e3_trim_jurisdiction")
def e3_trim(spark, sf_dir):
    s = _packed(spark, sf_dir, _orgs(spark, sf_dir))
    return s.select("doc_id", F.inline(reshape.trim_jurisdiction(F.col("spans")))).select("doc_id", "start", "end", "text")


@query("e4_trim_excluded_tails")
def e4_tails(spark, sf_dir):
    return organisations.trim_excluded_tails(_orgs(spark, sf_dir), lexicon.Lexicon.read(spark))


# the tail without its look-ahead, as a group: what ends it is no part of it
TAIL_SQL = re2("(" + R.ORG_TAIL.replace("(?=$|", r")(?:[\x{85}\x{2028}\x{2029}]?$|"))


@query("e5_extend_org_suffix", f"""WITH s AS ({span_sql('ORG', r'[A-Z][a-z]{9,}', 0.8)}) SELECT s.doc_id, s."start", (s."end" + length(regexp_extract(substring(d.text, s."end" + 1, 64), {q(TAIL_SQL)}, 1)))::INTEGER AS "end" FROM s JOIN documents d USING (doc_id)""")
def e5_suffix(spark, sf_dir):
    s = _packed(spark, sf_dir, scan.scan_regex(docs(spark, sf_dir), "ORG", r"[A-Z][a-z]{9,}", 0.8))
    return s.select("doc_id", F.inline(let_all(reshape.extend_org_suffix, spans=F.col("spans"), text=F.col("text")))).select("doc_id", "start", "end")


@query("e6_extend_addresses")
def e6_lines(spark, sf_dir):
    s = _packed(spark, sf_dir, scan.scan_regex(docs(spark, sf_dir), "LOC", "[0-9]{5}", 0.8))
    return s.select("doc_id", F.inline(let_all(reshape.extend_addresses, spans=F.col("spans"), text=F.col("text")))).select("doc_id", "start", "end", "text")


@query("e7_alias_spans")
def e7_alias(spark, sf_dir):
    s = _packed(spark, sf_dir, _orgs(spark, sf_dir))
    return s.select("doc_id", F.inline(let_all(reshape.alias_spans, spans=F.col("spans"), text=F.col("text"))))


@query("e9_make_chunks", """WITH n AS (SELECT doc_id, text, length(text) AS n FROM documents), s AS (SELECT doc_id, text, n, unnest(CASE WHEN n <= 4000 THEN [0] ELSE range(0, greatest(n - 200 - 1, 0) + 1, 2300) END) AS a FROM n)
SELECT doc_id, (a // 2300)::INTEGER AS chunk_no, a::INTEGER AS "start", (CASE WHEN n <= 4000 THEN n ELSE least(a + 2500, n) END)::INTEGER AS "end", CASE WHEN n <= 4000 THEN text ELSE substring(text, (a + 1)::BIGINT, 2500) END AS text FROM s""")
def e9_chunks(spark, sf_dir):
    return reshape.make_chunks(docs(spark, sf_dir))


@query("e8_w2_chunk_entities", f"SELECT DISTINCT doc_id, \"start\", \"end\", label FROM ({EMAILS_SQL})")
def e8_chunked(spark, sf_dir):
    chunks = reshape.make_chunks(docs(spark, sf_dir))
    found = chunks.select("doc_id", "chunk_no", F.inline(scan.matches(F.col("text"), R.EMAIL))).withColumn("label", F.lit("EMAIL"))
    return merge.dedupe_chunk_overlaps(reshape.rebase_chunk_spans(found, chunks).drop("chunk_no")).select("doc_id", "start", "end", "label")


REPS_SQL = f"""WITH e AS ({EMAILS_SQL}), f AS (SELECT doc_id, text, min("start") AS f FROM e GROUP BY 1, 2), k AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY f) AS k FROM f), r AS (SELECT e.doc_id, e."start", e."end", 'EMAIL_' || k AS id FROM e JOIN k USING (doc_id, text))"""


def _numbered(spark, sf_dir):
    return entities.number_entities(base_spans(spark, sf_dir, BASE[:1]))


@query("w3_number_entities", f"{REPS_SQL} SELECT doc_id, \"start\", \"end\", id AS entity_id FROM r")
def w3_numbers(spark, sf_dir):
    return _numbered(spark, sf_dir).select("doc_id", "start", "end", "entity_id")


@query("e10_build_replacements", f"""{REPS_SQL} SELECT r.doc_id, r."start", (r."end" + CASE WHEN substring(d.text, r."end" + 1, 2) = '''s' THEN 2 ELSE 0 END)::INTEGER AS "end", '[' || id || ']' || CASE WHEN substring(d.text, r."end" + 1, 2) = '''s' THEN '''s' ELSE '' END AS replacement FROM r JOIN documents d USING (doc_id)
WHERE NOT (r."start" > 0 AND substring(d.text, r."start", 1) = '[' AND substring(d.text, r."end" + 1, 1) = ']')""")
def e10_replacements(spark, sf_dir):
    s = _numbered(spark, sf_dir).drop("text").join(docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    one = F.struct("start", "end", "label", "confidence", "entity_id")
    return s.select("doc_id", rewrite.replacement(F.col("text"), one).alias("r")).select("doc_id", "r.start", "r.end", "r.replacement").where("replacement like '[%'")


REDACT_SQL = f"""{REPS_SQL}, p AS (SELECT r.doc_id, r."start" AS a, r."end" AS b, id, coalesce(lag(r."end") OVER (PARTITION BY r.doc_id ORDER BY r."start"), 0) AS pa FROM r),
g AS (SELECT p.doc_id, string_agg(substring(d.text, (pa + 1)::BIGINT, (a - pa)::BIGINT) || '[' || id || ']', '' ORDER BY a) AS body, max(b) AS last, count(*) AS n, count(DISTINCT id) AS ids FROM p JOIN documents d USING (doc_id) GROUP BY p.doc_id)
SELECT d.doc_id, CASE WHEN g.doc_id IS NULL THEN d.text ELSE body || substring(d.text, (last + 1)::BIGINT) END AS redacted_text, coalesce(n, 0)::INTEGER AS n_redactions, coalesce(ids, 0)::INTEGER AS n_entities FROM documents d LEFT JOIN g USING (doc_id)"""


@query("e11_apply_replacements", REDACT_SQL)
def e11_apply(spark, sf_dir):
    return rewrite.redact_text(docs(spark, sf_dir), _numbered(spark, sf_dir))


def _segments(spark, sf_dir):
    s = _numbered(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "label", "confidence", "entity_id"))).alias("spans"))
    d = docs(spark, sf_dir).join(s, "doc_id")
    reps = rewrite.build_replacements(F.col("text"), F.col("spans"))
    return d.select("doc_id", "text", let_all(rewrite.edit_segments, text=F.col("text"), replacements=reps).alias("segments"))


@query("e12_edit_segments", f"SELECT doc_id, count(*) AS n_deletes, string_agg(text, '|' ORDER BY \"start\") AS deleted FROM ({EMAILS_SQL}) GROUP BY doc_id")
def e12_segments(spark, sf_dir):
    gone = F.filter("segments", lambda s: s["kind"] == "delete")
    return _segments(spark, sf_dir).select("doc_id", F.size(gone).cast("long").alias("n_deletes"), F.array_join(F.transform(gone, lambda s: s["text"]), "|").alias("deleted"))


@query("e13_reject_edits", f"SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM ({EMAILS_SQL}))")
def e13_reject(spark, sf_dir):
    return _segments(spark, sf_dir).select("doc_id", rewrite.reject_edits(F.col("segments")).alias("text"))


query("e13_accept_edits")(lambda spark, sf_dir: _segments(spark, sf_dir).select("doc_id", rewrite.accept_edits(F.col("segments")).alias("text")))


# --- J: joins -----------------------------------------------------------------------------
@query("j3_overlap_join", f"{WITH_B}, n AS (SELECT * FROM b WHERE label = 'NUMBER'), o AS (SELECT * FROM b WHERE label <> 'NUMBER') SELECT n.doc_id, n.\"start\", n.\"end\", o.\"start\" AS b_start, o.\"end\" AS b_end, o.label AS b_label FROM n JOIN o ON n.doc_id = o.doc_id AND n.\"start\" < o.\"end\" AND n.\"end\" > o.\"start\"")
def j3_overlaps(spark, sf_dir):
    a, b = (base_spans(spark, sf_dir, kinds).select("doc_id", "start", "end", "label") for kinds in (BASE[3:], BASE[:3]))
    return consistency.overlap_join(a.drop("label"), b)


AGAIN_SQL = "'id' || CAST(doc_id AS STRING) || '@x.example first, xid' || CAST(doc_id AS STRING) || '@x.example, then id' || CAST(doc_id AS STRING) || '@x.example again'"


@query("j4_consistency_exact", "WITH d AS (SELECT doc_id, length(coalesce(text, '')) + 1 AS n, 'id' || CAST(doc_id AS STRING) || '@x.example' AS term FROM documents) SELECT doc_id, (n + 2 * length(term) + 16)::INTEGER AS \"start\", (n + 3 * length(term) + 16)::INTEGER AS \"end\", term AS text FROM d")
def j4_exact(spark, sf_dir):
    """Each text is followed by an address three times: as an entity, as a part of
    another word, and once more; the search is over the whole text."""
    d = docs(spark, sf_dir).withColumn("text", F.concat("text", F.lit("\n"), F.expr(AGAIN_SQL)))
    spans = F.transform(scan.matches(F.col("text"), r"id[0-9]+@x\.example(?= first)"), lambda m: scan.span(m["start"], m["end"], "EMAIL", m["text"], 0.98, "rule"))
    found = let_all(consistency.exact_occurrences, spans=F.col("spans"), text=F.col("text"), terms=consistency.candidates(F.col("spans")))
    return d.withColumn("spans", spans).select("doc_id", F.inline(found)).select("doc_id", "start", "end", "text")


@query("j5_consistency_fuzzy")
def j5_fuzzy(spark, sf_dir):
    s = _packed(spark, sf_dir, _orgs(spark, sf_dir))
    found = let_all(consistency.fuzzy_occurrences, spans=F.col("spans"), text=F.col("text"), terms=consistency.candidates(F.col("spans")))
    return s.select("doc_id", F.inline(found))


@query("j6_candidate_budget", f"""{WITH_B}, t AS (SELECT DISTINCT doc_id, text AS term FROM b), w AS (SELECT *, row_number() OVER o AS n, sum(length(term)) OVER o AS used FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY length(term) DESC, term ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT doc_id, term FROM w WHERE n <= 3 AND (used <= 40 OR n = 1)""")
def j6_budget(spark, sf_dir):
    return consistency.within_budget(base_spans(spark, sf_dir).select("doc_id", F.col("text").alias("term")).distinct(), 3, 40)


@query("j8_fail_closed", "WITH c AS (SELECT DISTINCT doc_id FROM documents WHERE length(text) > 4000 AND doc_id % 7 = 0) SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM c)")
def j8_closed(spark, sf_dir):
    chunks = reshape.make_chunks(docs(spark, sf_dir))
    results = chunks.select("doc_id", "chunk_no", (~((F.col("chunk_no") == 1) & (F.col("doc_id") % 7 == 0))).alias("ok"))
    return model.fail_closed(docs(spark, sf_dir), chunks, results)[0].select("doc_id")


# --- metadata: a snapshot of documents' own columns ---------------------------------------
def _snapshot(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.select("doc_id", F.explode(F.create_map(F.lit("author"), F.col("source"), F.lit("title"), F.col("lang"), F.lit("revision"), (F.col("n_chars") % 60).cast("string"), F.lit("custom"), F.lit("x"))).alias("field", "value"))


SNAP_SQL = "SELECT doc_id, unnest(['author', 'title', 'revision', 'custom']) AS field, unnest([source, lang, (n_chars % 60)::VARCHAR, 'x']) AS value FROM documents"


@query("j9_diff_snapshots", f"""WITH s AS ({SNAP_SQL}) SELECT doc_id, field, value AS before, CASE WHEN field IN ('author', 'revision') THEN '' ELSE value END AS after, CASE WHEN field IN ('author', 'revision') THEN 'cleaned' ELSE 'preserved' END AS status FROM s""")
def j9_diff(spark, sf_dir):
    snap, policy = _snapshot(spark, sf_dir), metadata.build_policy(spark, "balanced")
    return metadata.diff_snapshots(snap, metadata.scrub_columns(snap, policy), policy)


@query("a12_diff_summary", "SELECT doc_id, 2::BIGINT AS cleaned, 2::BIGINT AS preserved, 0::BIGINT AS unchanged, 0::BIGINT AS observed FROM documents")
def a12_summary(spark, sf_dir):
    snap, policy = _snapshot(spark, sf_dir), metadata.build_policy(spark, "balanced")
    return metadata.diff_summary(metadata.diff_snapshots(snap, metadata.scrub_columns(snap, policy), policy))


query("q4_scrub_columns", f"WITH s AS ({SNAP_SQL}) SELECT doc_id, field, CASE WHEN field IN ('author', 'title', 'revision') THEN '' ELSE value END AS value FROM s")(lambda spark, sf_dir: metadata.scrub_columns(_snapshot(spark, sf_dir), metadata.build_policy(spark, "maximum")))
query("q5_metadata_report", f"WITH s AS ({SNAP_SQL}) SELECT doc_id, field, value AS before, value AS after, 'observed' AS status FROM s")(lambda spark, sf_dir: metadata.metadata_report(_snapshot(spark, sf_dir)))


# every check of the list is met by some orders and missed by others; for both engines
SNAPSHOT_FIELDS = {
    "author": "CASE o_orderkey % 3 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Bo' ELSE ' ' END",
    "last_modified_by": "CASE o_orderkey % 4 WHEN 0 THEN 'ANN' WHEN 1 THEN 'Cy' ELSE 'Di' END",
    "revision": "CAST(o_orderkey % 60 AS STRING)",
    "totaltime": "CASE WHEN o_orderkey % 11 = 0 THEN 'none' ELSE CAST(o_orderkey % 7 AS STRING) END",
    "application": "CASE o_orderkey % 6 WHEN 0 THEN 'LibreOffice 7' WHEN 1 THEN 'Microsoft Word' WHEN 2 THEN 'Apache POI' ELSE '' END",
    "appversion": "CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 4 = 1 THEN '1.2' ELSE '16.0' END",
}


@query("a13_metadata_findings", f"""WITH o AS (SELECT o_orderkey AS doc_id, o_orderdate::TIMESTAMP AS created, o_orderdate::TIMESTAMP + (CASE WHEN o_orderkey % 5 = 0 THEN INTERVAL (-1) DAY ELSE INTERVAL 1 DAY END) AS modified,
{', '.join(f"{sql} AS {name}" for name, sql in SNAPSHOT_FIELDS.items())}, CASE WHEN o_orderkey % 5 = 0 THEN 'Cy' ELSE 'ann' END AS content FROM orders),
n AS (SELECT *, lower(trim(author)) AS a, lower(trim(last_modified_by)) AS l, lower(content) AS c, try_cast(revision AS INT) AS rev, try_cast(totaltime AS INT) AS mins FROM o),
m AS (SELECT *, a <> '' AND a <> c AS other FROM n)
SELECT doc_id, 'Timestamp anomaly' AS title, 'medium' AS severity FROM o WHERE modified < created UNION ALL SELECT doc_id, 'Print before modification', 'info' FROM o WHERE created < modified - INTERVAL 5 MINUTE
UNION ALL SELECT doc_id, 'Future timestamp detected', 'high' FROM (SELECT doc_id, unnest([created, modified, created]) AS t FROM o) WHERE t > TIMESTAMP '1998-01-01 00:00:00' + INTERVAL 1 DAY
UNION ALL SELECT doc_id, 'Possible revision/edit time mismatch', 'high' FROM m WHERE rev >= 20 AND (mins <= 1 OR mins / rev::DOUBLE < 0.1 OR (rev >= 50 AND mins < 5))
UNION ALL SELECT doc_id, 'Author mismatch', 'medium' FROM m WHERE other UNION ALL SELECT doc_id, 'Last Modified By mismatch', 'medium' FROM m WHERE l <> c AND NOT other
UNION ALL SELECT doc_id, 'Automated authoring software', 'info' FROM m WHERE application IN ('LibreOffice 7', 'Apache POI')
UNION ALL SELECT doc_id, 'Suspicious application version', 'low' FROM m WHERE application = 'Microsoft Word' AND appversion = '1.2'""")
def a13_findings(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    moved = at + F.when(F.col("o_orderkey") % 5 == 0, F.expr("interval -1 day")).otherwise(F.expr("interval 1 day"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    fields = {"created": text(at), "modified": text(moved), "last_printed": text(at)} | {name: F.expr(sql) for name, sql in SNAPSHOT_FIELDS.items()}
    snap = o.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.create_map(*(x for name, c in fields.items() for x in (F.lit(name), c)))).alias("field", "value"))
    # the author of the first change counts; a comment only where nothing was changed
    event = lambda kind, author, date: F.struct(F.lit(kind).alias("kind"), F.when((F.col("o_orderkey") % 5 != 0) | F.lit(kind == "comment"), author).alias("author"), F.lit(f"{date}T00:00:00").alias("date"))
    made = F.array(event("comment", "Cy", "1990-01-01"), event("change", "Zed", "1996-01-01"), event("change", "ann", "1995-01-01"))
    events = o.select(F.col("o_orderkey").alias("doc_id"), F.explode(made).alias("e")).select("doc_id", "e.*")
    return metadata.metadata_findings(snap, "1998-01-01 00:00:00", events).select("doc_id", "title", "severity")


# --- W, A, U: merging, scores, reports ------------------------------------------------------
ISLANDS_SQL = f"""{WITH_B}, m AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m)"""


@query("w1_island_bounds", f"{ISLANDS_SQL} SELECT doc_id, min(\"start\") AS \"start\", max(\"end\") AS \"end\", count(*) AS n_spans FROM i GROUP BY doc_id, island")
def w1_islands(spark, sf_dir):
    return merge.island_bounds(base_spans(spark, sf_dir))


@query("w1_merge_overlaps", f"{ISLANDS_SQL}, u AS (SELECT doc_id, min(\"start\") AS a, max(\"end\") AS z FROM i GROUP BY doc_id, island) SELECT u.doc_id, a AS \"start\", z AS \"end\", substring(d.text, (a + 1)::BIGINT, (z - a)::BIGINT) AS text FROM u JOIN documents d USING (doc_id)")
def w1_merge(spark, sf_dir):
    return merge.merge_overlaps(base_spans(spark, sf_dir), docs(spark, sf_dir)).select("doc_id", "start", "end", "text")


@query("w4_cluster_entities")
def w4_clusters(spark, sf_dir):
    return entities.cluster_entities(_orgs(spark, sf_dir)).select("doc_id", "start", "text", "entity_id", F.round("confidence", 6).alias("confidence"))


@query("w5_top_n_per_label", f"{WITH_B} SELECT doc_id, \"start\", label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id, \"start\", \"end\") AS n FROM b) WHERE n <= 100")
def w5_top(spark, sf_dir):
    return report.top_n_per_label(base_spans(spark, sf_dir)).select("doc_id", "start", "label")


@query("w6_remove_overlaps_greedy", f"""WITH RECURSIVE b AS ({BASE_SQL}), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end" DESC, label, text, confidence, source) AS i FROM b),
f AS (SELECT doc_id, i, "start", "end", label, text, confidence, source, i AS place, false AS over FROM o WHERE i = 1
UNION ALL SELECT o.doc_id, o.i, CASE WHEN keep THEN f."start" ELSE o."start" END, CASE WHEN keep THEN f."end" ELSE o."end" END, CASE WHEN keep THEN f.label ELSE o.label END, CASE WHEN keep THEN f.text ELSE o.text END,
  CASE WHEN keep THEN f.confidence ELSE o.confidence END, CASE WHEN keep THEN f.source ELSE o.source END, CASE WHEN clash THEN f.place ELSE o.i END, false
  FROM f, LATERAL (SELECT o.*, (o."start" < f."end" AND o."end" > f."start") AS clash, (o."start" < f."end" AND o."end" > f."start") AND NOT (o.confidence > f.confidence OR o."end" - o."start" > f."end" - f."start") AS keep FROM o WHERE o.doc_id = f.doc_id AND o.i = f.i + 1) o)
SELECT doc_id, "start", "end", label, text, confidence, source FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, place ORDER BY i DESC) = 1""")
def w6_greedy(spark, sf_dir):
    return _packed(spark, sf_dir, base_spans(spark, sf_dir)).select("doc_id", F.inline(merge.remove_overlaps_greedy(F.col("spans"))))


@query("w7_rank_findings", "SELECT doc_id, severity, position, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 WHEN 'info' THEN 3 ELSE 99 END::INTEGER AS rank FROM (SELECT doc_id, ['info', 'high', 'low', 'medium', 'odd'][doc_id % 5 + 1] AS severity, doc_id AS position FROM documents)")
def w7_rank(spark, sf_dir):
    kinds = F.array(*(F.lit(x) for x in ("info", "high", "low", "medium", "odd")))
    return report.rank_findings(docs(spark, sf_dir).select("doc_id", F.get(kinds, (F.col("doc_id") % 5).cast("int")).alias("severity"), F.col("doc_id").alias("position")))


@query("w9_order_spans", f"{WITH_B} SELECT doc_id, \"start\", \"end\", label, text, row_number() OVER (PARTITION BY doc_id ORDER BY \"start\", \"end\", label, text) AS place FROM b")
def w9_order(spark, sf_dir):
    ordered = report.order_spans(base_spans(spark, sf_dir)).select("doc_id", "start", "end", "label", "text", F.monotonically_increasing_id().alias("_row"))
    return ordered.withColumn("place", F.col("_row") - F.min("_row").over(Window.partitionBy("doc_id")) + 1).drop("_row")


@query("w10_doc_parties")
def w10_parties(spark, sf_dir):
    d = docs(spark, sf_dir)
    return model.doc_parties(d, _orgs(spark, sf_dir))


@query("w11_party_aliases")
def w11_aliases(spark, sf_dir):
    d = docs(spark, sf_dir)
    return model.party_aliases(d, model.doc_parties(d, _orgs(spark, sf_dir)).select("doc_id", "party"))


@query("a1_audit_summary", f"{WITH_B} SELECT doc_id, count(*) AS n_spans, count(*) AS n_rule, 0::BIGINT AS n_model, count(DISTINCT label) AS n_labels FROM b GROUP BY doc_id")
def a1_summary(spark, sf_dir):
    return report.audit_summary(base_spans(spark, sf_dir))


@query("a2_label_counts", f"{WITH_B} SELECT label, count(*) AS n_spans, count(*) FILTER (confidence >= 0.9) AS high, count(*) FILTER (confidence >= 0.7 AND confidence < 0.9) AS medium, count(*) FILTER (confidence < 0.7) AS low FROM b GROUP BY label")
def a2_labels(spark, sf_dir):
    return report.label_counts(base_spans(spark, sf_dir))


@query("a3_suppression_summary", f"{WITH_B}, s AS (SELECT CASE WHEN length(text) < 8 THEN 'short' ELSE 'long' END AS reason, label FROM b) SELECT coalesce(reason, 'ALL') AS reason, coalesce(label, 'ALL') AS label, count(*) AS n FROM s GROUP BY ROLLUP (reason, label)")
def a3_suppressed(spark, sf_dir):
    return report.suppression_summary(base_spans(spark, sf_dir).withColumn("reason", F.when(F.length("text") < 8, "short").otherwise("long")))


def _gold_pred(spark, sf_dir):
    return base_spans(spark, sf_dir, BASE[:3]), base_spans(spark, sf_dir).where("doc_id % 3 != 0")


# gold entities and predictions of a document are the same rows, but for numbers, which are predicted only,
# and every third document, which has no predictions: each gold entity finds itself or its like
MATCHES_SQL = f"""{WITH_B}, c AS (SELECT label, count(*) FILTER (label <> 'NUMBER' AND doc_id % 3 <> 0) AS tp, count(*) FILTER (label = 'NUMBER' AND doc_id % 3 <> 0) AS fp, count(*) FILTER (label <> 'NUMBER' AND doc_id % 3 = 0) AS fn FROM b WHERE label <> 'NUMBER' OR doc_id % 3 <> 0 GROUP BY label),
a AS (SELECT * FROM c UNION ALL SELECT 'OVERALL', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT FROM c),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 1 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 1 END AS recall FROM a),
s AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r) SELECT """


@query("a4_score_matches", MATCHES_SQL + "* FROM s")
def a4_matches(spark, sf_dir):
    gold, pred = _gold_pred(spark, sf_dir)
    return score.score_matches(gold.withColumn("at", F.col("start")), pred.withColumn("at", F.col("start")))


query("q6_evaluate", MATCHES_SQL + "*, precision >= 0.85 AND recall >= 0.85 AS passed FROM s")(lambda spark, sf_dir: score.evaluate(*(x.withColumn("at", F.col("start")) for x in _gold_pred(spark, sf_dir))))


@query("a5_score_sets", f"""{WITH_B}, g AS (SELECT DISTINCT doc_id, text, label FROM b WHERE label <> 'NUMBER'), p AS (SELECT DISTINCT doc_id, text, label FROM b WHERE doc_id % 3 <> 0),
c AS (SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, count(*) FILTER (g.doc_id IS NOT NULL AND p.doc_id IS NOT NULL) AS tp, count(*) FILTER (g.doc_id IS NULL) AS fp, count(*) FILTER (p.doc_id IS NULL) AS fn FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.text = p.text AND g.label = p.label GROUP BY 1)
SELECT doc_id, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall FROM c""")
def a5_sets(spark, sf_dir):
    return score.score_sets(*_gold_pred(spark, sf_dir), by=("doc_id",)).drop("f1")


@query("a6_confidence_threshold", f"{WITH_B}, c AS (SELECT doc_id, label, (length(text) % 10 / 10.0)::DOUBLE AS k FROM b) SELECT doc_id, label, round(CASE WHEN count(*) < 5 THEN 0.7 ELSE quantile_cont(k, 0.25) END, 6) AS threshold FROM c GROUP BY doc_id, label")
def a6_threshold(spark, sf_dir):
    b = base_spans(spark, sf_dir).withColumn("confidence", F.length("text") % 10 / 10.0)
    return model.confidence_threshold(b).withColumn("threshold", F.round("threshold", 6))


TOK_SQL = "SELECT doc_id, unnest(regexp_extract_all(lower(%s), '[A-Za-z0-9]+')) AS token FROM documents"


@query("a7_score_tokens", f"""WITH g AS (SELECT doc_id, token, count(*) AS g FROM ({TOK_SQL % 'text'}) GROUP BY 1, 2), p AS (SELECT doc_id, token, count(*) AS p FROM ({TOK_SQL % 'left(text, 1500)'}) GROUP BY 1, 2),
b AS (SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, coalesce(g, 0) AS g, coalesce(p, 0) AS p FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.token = p.token)
SELECT doc_id, sum(greatest(g - p, 0))::BIGINT AS missed, sum(greatest(p - g, 0))::BIGINT AS extra, sum(g)::BIGINT AS gold_tokens, sum(p)::BIGINT AS pred_tokens FROM b GROUP BY doc_id""")
def a7_tokens(spark, sf_dir):
    d = docs(spark, sf_dir)
    return score.score_tokens(d, d.withColumn("text", F.substring("text", 1, 1500))).select("doc_id", "missed", "extra", "gold_tokens", "pred_tokens")


@query("a8_jaccard", """WITH s AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[A-Za-z0-9]+')) AS t FROM benchmark), p AS (SELECT a.item_id AS a, b.item_id AS b, a.t AS x, b.t AS y FROM s a JOIN s b ON b.item_id = a.item_id + 1)
SELECT a AS item_id, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE, 6) AS score FROM p""")
def a8_jaccard(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", score.token_set(F.col("text")).alias("t"))
    pairs = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u")), "item_id")
    return pairs.select("item_id", F.round(score.jaccard(F.col("t"), F.col("u")), 6).alias("score"))


@query("a8_best_match", """WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[A-Za-z0-9]+')) AS t FROM documents), c AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[A-Za-z0-9]+')) AS u FROM benchmark),
p AS (SELECT doc_id, item_id, len(list_intersect(t, u)) AS n, len(t) AS a, len(u) AS b FROM d, c), s AS (SELECT doc_id, item_id, n / (a + b - n)::DOUBLE AS score FROM p WHERE n > 0)
SELECT doc_id, item_id AS candidate_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) = 1""")
def a8_best(spark, sf_dir):
    d = docs(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("candidate_id"), "text")
    return score.best_match(d, items).withColumn("score", F.round("score", 6))


def _runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("run_id"), F.col("user_id").alias("doc_id"), F.concat(F.lit("p"), F.col("event_id") % 4).alias("phase"), (F.col("event_id") % 100).cast("double").alias("seconds"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"))


RUNS_SQL = "SELECT event_type AS run_id, user_id AS doc_id, 'p' || (event_id % 4) AS phase, (event_id % 100)::DOUBLE AS seconds, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status FROM events"
RUN_SPANS_SQL = "SELECT event_type AS run_id, user_id AS doc_id, (event_id % 50)::INTEGER AS \"start\", (event_id % 50 + 5)::INTEGER AS \"end\", 'X' AS label FROM events"


def _matrix(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    spans = e.select(F.col("event_type").alias("run_id"), F.col("user_id").alias("doc_id"), (F.col("event_id") % 50).cast("int").alias("start"), (F.col("event_id") % 50 + 5).cast("int").alias("end"), F.lit("X").alias("label"))
    ids = [r[0] for r in e.groupBy("event_type").count().select("event_type").orderBy("event_type").limit(2).collect()]
    return score.matrix_report(_runs(spark, sf_dir), spans, ids[0], ids[-1])


MATRIX_SQL = f"""WITH r AS ({RUNS_SQL}), s AS (SELECT DISTINCT * FROM ({RUN_SPANS_SQL})), i AS (SELECT DISTINCT run_id FROM r ORDER BY 1 LIMIT 2), top AS (SELECT doc_id, "start", "end" FROM s WHERE run_id = (SELECT min(run_id) FROM i)), low AS (SELECT doc_id, "start", "end" FROM s WHERE run_id = (SELECT max(run_id) FROM i)),
m AS (SELECT run_id, (SELECT count(*) FROM top) - count(*) FILTER ((doc_id, "start", "end") IN (SELECT (doc_id, "start", "end") FROM top)) AS missed, count(*) FILTER ((doc_id, "start", "end") NOT IN (SELECT (doc_id, "start", "end") FROM low)) AS extra FROM s GROUP BY run_id),
t AS (SELECT run_id, sum(seconds) AS total_seconds, bool_or(status <> 'ok') AS failed FROM r GROUP BY run_id)"""


@query("a9_matrix_report", f"{MATRIX_SQL} SELECT run_id, missed, extra, total_seconds, failed FROM m JOIN t USING (run_id)")
def a9_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir).drop("avg_seconds")


@query("w8_rank_runs", f"{MATRIX_SQL} SELECT run_id, CASE WHEN failed THEN 'unranked' ELSE (row_number() OVER (PARTITION BY failed ORDER BY missed, extra, total_seconds, run_id))::VARCHAR END AS rank FROM m JOIN t USING (run_id)")
def w8_ranks(spark, sf_dir):
    return score.rank_runs(_matrix(spark, sf_dir)).select("run_id", F.coalesce(F.col("rank").cast("string"), F.lit("unranked")).alias("rank"))


@query("a10_eta", f"WITH r AS ({RUNS_SQL}), d AS (SELECT run_id, count(*) AS n, sum(seconds) AS s, sum(greatest(doc_id, 0))::DOUBLE AS z FROM r WHERE phase = 'p0' GROUP BY 1), l AS (SELECT run_id, sum(greatest(doc_id, 0))::DOUBLE AS left_ FROM r WHERE phase = 'p1' GROUP BY 1) SELECT run_id, round(CASE WHEN coalesce(left_, 0) <= 0 THEN 0 WHEN n >= 2 AND s > 0 AND z > 0 THEN left_ / (z / s) END, 4) AS eta_seconds FROM d LEFT JOIN l USING (run_id)")
def a10_eta(spark, sf_dir):
    r = _runs(spark, sf_dir).withColumn("size", F.col("doc_id"))
    return report.eta(r.where("phase = 'p0'"), r.where("phase = 'p1'"), "run_id").withColumn("eta_seconds", F.round("eta_seconds", 4))


@query("a11_phase_breakdown", f"WITH r AS ({RUNS_SQL}), s AS (SELECT run_id, phase, sum(seconds) AS seconds FROM r GROUP BY 1, 2) SELECT run_id, phase, seconds, round(CASE WHEN sum(seconds) OVER (PARTITION BY run_id) > 0 THEN 100 * seconds / sum(seconds) OVER (PARTITION BY run_id) ELSE 0 END, 6) AS percent, row_number() OVER (PARTITION BY run_id ORDER BY seconds DESC, phase) = 1 AS bottleneck FROM s")
def a11_phases(spark, sf_dir):
    return report.phase_breakdown(_runs(spark, sf_dir)).withColumn("percent", F.round("percent", 6))


@query("a14_compare_runs", f"{WITH_B}, r AS (SELECT doc_id, count(*) AS n FROM b WHERE label <> 'NUMBER' GROUP BY 1), m AS (SELECT doc_id, count(*) AS n FROM b WHERE label IN ('NUMBER', 'EMAIL') GROUP BY 1) SELECT coalesce(r.doc_id, m.doc_id) AS doc_id, coalesce(r.n, 0) AS n_rules, coalesce(m.n, 0) AS n_model, coalesce(m.n, 0) - coalesce(r.n, 0) AS difference, CASE WHEN coalesce(m.n, 0) > coalesce(r.n, 0) THEN 'model_found_more' WHEN coalesce(m.n, 0) < coalesce(r.n, 0) THEN 'rules_found_more' ELSE 'equal' END AS status FROM r FULL JOIN m ON r.doc_id = m.doc_id")
def a14_compare(spark, sf_dir):
    return report.compare_runs(base_spans(spark, sf_dir, BASE[:3]), base_spans(spark, sf_dir, BASE[:1] + BASE[3:]))


@query("u1_u2_dedupe_spans", f"{WITH_B} SELECT DISTINCT doc_id, \"start\", \"end\", label FROM b")
def u2_dedupe(spark, sf_dir):
    b = base_spans(spark, sf_dir)
    return score.dedupe_spans(score.union_spans(b, b.where("label = 'EMAIL'"))).select("doc_id", "start", "end", "label")


@query("u3_span_diff", f"{WITH_B} SELECT doc_id, \"start\", \"end\", label FROM b WHERE label = 'NUMBER'")
def u3_diff(spark, sf_dir):
    b = base_spans(spark, sf_dir)
    return score.span_diff(b, b.where("label != 'NUMBER'"))


@query("u3_span_common", f"{WITH_B} SELECT doc_id, \"start\", \"end\", label FROM b WHERE label = 'IP'")
def u3_common(spark, sf_dir):
    b = base_spans(spark, sf_dir)
    return score.span_common(b, b.where("label = 'IP'"))


# --- Q: pipelines ----------------------------------------------------------------------------
OUT = ("doc_id", "redacted_text", "n_redactions", "n_entities")


@query("q1_redact_rules")
def q1_redact(spark, sf_dir):
    return pipeline.redact(docs(spark, sf_dir)).select(*OUT)


@query("q2_redact_with_model")
def q2_redact(spark, sf_dir):
    d = docs(spark, sf_dir)
    spans = scan.scan_regex(d, "NAME", r"\b[A-Z][a-z]{7,} [A-Z][a-z]{7,}\b", 0.9, "llm")
    return pipeline.redact(d, "rules_override", model_spans=spans).select(*OUT)


def _addresses_as_names(batch):
    """A stand-in for a model: the addresses of a chunk as a JSON response. What a
    chunk cuts off at its start the chunk before holds whole."""
    def entities(text, chunk_no):
        return [{"text": m.group(), "type": "PERSON"} for m in re.finditer(R.EMAIL, text) if m.start() or not chunk_no]

    return batch[["doc_id", "chunk_no"]].assign(response=[json.dumps({"entities": entities(t, n)}) for t, n in zip(batch["text"], batch["chunk_no"], strict=True)])


def _early_letters_skip(batch):
    """A stand-in for a validator: a sure SKIP for keys that begin with a to m."""
    return batch[["key"]].assign(classification=["SKIP" if "a" <= k[0] <= "m" else "REDACT" for k in batch["key"]], decision_confidence=0.99)


@query("q2_model_spans", f"""SELECT doc_id, "start", "end", 'NAME' AS label, text, 0.7::DOUBLE AS confidence, true AS validated, 'keep' AS validation_result FROM ({EMAILS_SQL}) WHERE NOT lower(text)[1] BETWEEN 'a' AND 'm'""")
def q2_chain(spark, sf_dir):
    found = model_chain.model_spans(docs(spark, sf_dir), _addresses_as_names, _early_letters_skip)
    return found.spans.select("doc_id", "start", "end", "label", "text", "confidence", "validated", "validation_result")


@query("q3_redact_constrained")
def q3_redact(spark, sf_dir):
    d = docs(spark, sf_dir)
    skip = scan.scan_regex(d, "LOC", R.COUNTY, 0.82).select("doc_id", "start", "end", "label", F.lit(False).alias("keep"))
    return pipeline.redact(d, "constrained_overrides", decisions=skip).select(*OUT)


def minimal_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship slice in expressions only: identifiers found, merged, numbered
    and replaced on the document's own row."""
    d = docs(spark, sf_dir)
    found = d.withColumn("spans", scan.scan_arrays(F.col("text"), ["EMAIL", "PHONE", "IP", "CARD", "URL", "ACCOUNT", "NUMBER"]))
    found = found.withColumn("spans", let_all(merge.merge_spans, spans=F.col("spans"), text=F.col("text")).cast("array<" + pipeline.SPANS[6:-1] + ">"))
    return pipeline.rewrite(pipeline.identify(found)).select("doc_id", "n_redactions", "n_entities", "redacted_text")


query("q0_redact_identifiers")(minimal_redaction)
