"""Labelled pattern scans with code-point offsets, in expressions only.

Matches and the gaps between them come from the same pattern, so a match starts
where the gaps and matches before it end: offsets count code points whatever the
text holds. Every rule is one array on the document's row, so a text is read
once for all rules; the long form is one ``inline``.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from redactory.functions.let import in_blocks, let, let_all
from redactory.functions.text import scan_normalize
from redactory.operators.dictionary import find_own_terms, find_terms
from redactory.operators.lexicon import Lexicon
from redactory.plans import rules as R
from redactory.plans.rules import Rule
from redactory.schemas import SPANS

_PLACES = "array<struct<start:int,end:int,text:string>>"


PAIRS = "array<struct<gap:int,m:string>>"
#: Set around matches: a character for private use.
MARK = "\uf8f1"


def gaps_and_matches(text: Column, pattern: Column) -> Column:
    """array<struct(gap, m)>: the length of the gap before each match, and the match."""
    pair = lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m"))
    none = F.array().cast(PAIRS)

    def cut(marked):
        parts = F.split(marked, MARK, -1)
        return let(parts, lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 3, F.lit(2)), lambda i: pair(F.get(p, i), F.get(p, i + 1))))

    def twice(found):
        return F.when(F.size(found) > 0, F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, pair)).otherwise(none)

    once = let(F.regexp_replace(text, pattern, F.lit(f"{MARK}$0{MARK}")), lambda marked: F.when(F.octet_length(marked) > F.octet_length(text), cut(marked)).otherwise(none))
    return F.when(text.contains(MARK), let(F.regexp_extract_all(text, pattern, F.lit(0)), twice)).otherwise(once)


def matches(text: Column, pattern: str | Column) -> Column:
    """array<struct(start, end, text)> of all leftmost matches, in order. The
    pattern runs once over a text: it marks the matches, and the marks part them from
    the gaps. A text that holds the mark itself is read twice."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    empty = F.array().cast(_PLACES)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_PLACES}>").alias("out"))

    def step(acc, x):
        first = acc["at"] + x["gap"]
        last = first + F.length(x["m"])
        return F.struct(last.alias("at"), F.concat(acc["out"], F.array(F.struct(first.alias("start"), last.alias("end"), x["m"].alias("text")))).alias("out"))

    def block(acc, part):
        made = F.aggregate(part, F.struct(acc["at"].alias("at"), empty.alias("out")), step)
        return let(made, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def placed(pairs):
        return F.aggregate(in_blocks(pairs), begin, block, lambda acc: F.flatten(acc["out"]))

    def of(text, pattern):
        return let(gaps_and_matches(text, pattern), lambda pairs: F.when(F.size(pairs) > 0, placed(pairs)).otherwise(empty))

    return F.when(text.isNull(), empty).otherwise(let_all(of, text=text, pattern=pattern))


def between(text: Column, start: Column, end: Column) -> Column:
    """The part of ``text`` from ``start`` to ``end``, both clamped to it."""
    start = F.greatest(start, F.lit(0))
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def span(start: Column, end: Column, label: Column | str, text: Column, confidence: Column | float, source: str) -> Column:
    label = F.lit(label) if isinstance(label, str) else label
    confidence = F.lit(confidence) if isinstance(confidence, float) else confidence
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), label.alias("label"), text.alias("text"), confidence.cast("double").alias("confidence"), F.lit(source).alias("source"))


def _enabled(label: str, labels: Iterable[str] | None) -> bool:
    return labels is None or label.upper() in {x.strip().upper() for x in labels}


# --- context tests -----------------------------------------------------------
def account_context(text: Column, start: Column, end: Column) -> Column:
    """an account keyword up to 120 characters before, or a currency code after."""
    return between(text, start - 120, start).rlike(R.ACCOUNT_CONTEXT) | between(text, end, end + 20).rlike(R.CURRENCY_AFTER)


def phone_context(text: Column, start: Column, end: Column) -> Column:
    """a phone keyword up to 60 characters before or 30 after."""
    return between(text, start - 60, start).rlike(R.PHONE_CONTEXT) | between(text, end, end + 30).rlike(R.PHONE_CONTEXT)


def ssn_label_before(text: Column, start: Column) -> Column:
    """A social-security label right before, within 40 characters."""
    return between(text, start - 40, start).rlike(R.SSN_BEFORE)


def rule_spans(text: Column, rule: Rule, labels: Iterable[str] | None = None, scan: Column | None = None) -> Column:
    """The spans of one rule over a text, context decisions included. ``scan``: the
    text folded for scanning, if it is at hand."""
    if scan is None:
        return let(scan_normalize(text), lambda folded: rule_spans(text, rule, labels, folded))
    labels = None if labels is None else list(labels)

    def one(m: Column) -> Column:
        start, end, label, confidence = m["start"], m["end"], F.lit(rule.label), F.lit(rule.confidence)
        if rule.label == "URL":
            end = start + F.length(F.regexp_replace(m["text"], R.URL_TAIL, ""))
        if rule.label == "PHONE":
            bare = m["text"].rlike(r"^(?U)\d+$") & ~phone_context(scan, start, end)
            label, confidence = F.when(bare, "NUMBER").otherwise(label), F.when(bare, 0.70).otherwise(confidence)
        if rule.label == "ACCOUNT" and _enabled("SSN", labels):
            bare = F.regexp_replace(m["text"], "[ \\t–—−-]+$", "")
            ssn = bare.rlike(r"^(?U)\d{9}$") & ssn_label_before(scan, start)
            label, confidence = F.when(ssn, "SSN").otherwise(label), F.when(ssn, 0.93).otherwise(confidence)
            end = F.when(ssn, start + F.length(bare)).otherwise(end)
        if rule.label == "ORG":
            tail = F.regexp_extract(between(text, end, end + 64), R.ORG_TAIL_SCAN, 0)
            end = end + F.length(tail)
        return span(start, end, label, between(text, start, end), confidence, rule.source)

    def keep(m: Column) -> Column:
        test = F.lit(True)
        if rule.validator is not None:
            test = rule.validator(m["text"])
        if rule.label == "PHONE":
            if _enabled("ACCOUNT", labels):
                test = test & ~account_context(scan, m["start"], m["end"])
            if not _enabled("NUMBER", labels):
                test = test & ~(m["text"].rlike(r"^(?U)\d+$") & ~phone_context(scan, m["start"], m["end"]))
        return test

    found = F.transform(F.filter(matches(scan, rule.led or rule.pattern), keep), one)
    return found if rule.needs is None else F.when(scan.rlike(rule.needs), found).otherwise(F.array().cast(SPANS))


def defined_name_spans(text: Column, scan: Column | None = None) -> Column:
    """Both spans of ``Full Name ("Last")`` where the last word is the term."""
    scan = scan_normalize(text) if scan is None else scan
    edge = lambda c: F.regexp_replace(c, r"^[.'\-]+|[.'\-]+$", "")

    def two(m):
        full, short = F.regexp_extract(m["text"], R.DEFINED_NAME, 1), F.regexp_extract(m["text"], R.DEFINED_NAME, 2)
        first = m["start"] + F.length(full)
        # the term follows its opening quote, behind the name
        after = F.regexp_extract(F.substring(m["text"], F.length(full) + 1, F.length(m["text"])), "^\\s*\\(\\s*[\"“”]", 0)
        at = first + F.length(after)
        same = F.lower(edge(F.element_at(F.split(full, r"\s+"), -1))) == F.lower(edge(short))
        spans = F.array(
            span(m["start"], first, "NAME", between(text, m["start"], first), 0.90, "rule_defined_term"),
            span(at, at + F.length(short), "NAME", between(text, at, at + F.length(short)), 0.88, "rule_defined_term"),
        )
        return F.when(same, spans).otherwise(F.array().cast(SPANS))

    return F.flatten(F.transform(matches(scan, R.DEFINED_NAME), two))


def signature_spans(text: Column, scan: Column | None = None) -> Column:
    """Person names on ``Name:`` lines, set apart by two blanks or more."""
    scan = scan_normalize(text) if scan is None else scan

    def line(m):
        content = F.regexp_extract(m["text"], R.SIGNATURE_LINE, 1)
        lead = F.length(F.regexp_extract(m["text"], r"(?im)^(?:^|\n)?\s*Name:\s*", 0))
        base = m["start"] + lead

        def name(p):
            return span(base + p["start"], base + p["end"], "NAME", between(text, base + p["start"], base + p["end"]), 0.95, "rule_signature")

        return F.transform(F.filter(matches(content, r"\S+(?:\s\S+)*"), lambda p: p["text"].rlike(R.PERSON)), name)

    return F.flatten(F.transform(matches(scan, R.SIGNATURE_LINE), line))


def scan_arrays(text: Column, labels: Iterable[str] | None = None, rules: Iterable[Rule] = R.RULES) -> Column:
    """R22 in array form, before names of organisations are tidied: the spans of
    all enabled rules. Legal in a stream: no join, no shuffle, no state."""
    labels = None if labels is None else list(labels)

    def all_of(scan):
        parts = [rule_spans(text, r, labels, scan) for r in rules if _enabled(r.label, labels)]
        parts.append(defined_name_spans(text, scan))
        if _enabled(R.SIGNATURE, labels):
            parts.append(signature_spans(text, scan))
        return F.flatten(F.array(*parts))

    return let(scan_normalize(text), all_of)


def scan_long(docs: DataFrame, labels=None, rules=R.RULES) -> DataFrame:
    """R22 as one row a span, organisations as matched."""
    found = docs.select("doc_id", scan_arrays(F.col("text"), labels, rules).alias("spans"))
    return found.select("doc_id", F.inline("spans"))


def scan_rules(docs: DataFrame, labels=None, rules=R.RULES, exclusions: str | None = None) -> DataFrame:
    """(doc_id, start, end, label, text, confidence, source) of every rule.

    ``labels``: None for all rules, else only these; the defined-name rule always
    runs. Names of organisations are tidied, and places and organisations that are
    excluded phrases go, on the document's own row: a text is read once."""
    from redactory.plans.pipeline import detect

    found = detect(docs.select("doc_id", "text"), Lexicon.read(docs.sparkSession, exclusions), labels, rules, floor=0.0)
    return found.select("doc_id", F.inline("spans"))


def scan_regex(docs: DataFrame, label: str, pattern: str, confidence: float, source: str = "rule") -> DataFrame:
    """R0 as a table, for a pattern of one's own."""
    spans = F.transform(matches(F.col("text"), pattern), lambda m: span(m["start"], m["end"], label, m["text"], float(confidence), source))
    return docs.select("doc_id", F.inline(spans))


# --- terms and gazetteers ------------------------------------------------------
# fixed values: words that are not searched in other case when they stand alone
CASE_STOPS = ("may", "june", "july", "march", "april", "august", "september", "october", "november", "december", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "will", "shall", "must")


def scan_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Every place of (doc_id, term, label) in its document; with terms that
    have no doc_id, in all documents.

    A plain term is searched at word boundaries; failing that, for names, without
    case if it is long enough; other terms, and plain ones outside names that were
    not found, as substrings."""
    key = ["doc_id"] if "doc_id" in terms.columns else []
    terms = terms.withColumn("term", F.trim("term")).where("term != ''").select(*key, "term", "label").distinct()
    return find_own_terms(docs, terms, frozenset(CASE_STOPS)) if key else find_terms(docs, terms, frozenset(CASE_STOPS))


# fixed values: lists of the built-in extractor, with the lower bound of its confidence
FIRST_NAMES = "John|Jane|James|Mary|Robert|Michael|William|David|Richard|Joseph|Thomas|Charles|Christopher|Daniel|Matthew|Mark|Paul|Steven|Peter|Jerry|Lisa|Sarah|Jennifer|Jessica|Amy|Michelle|Kimberly|Emily|Ashley|Melissa|Mikael|Erik|Eriksson|Peterson|Johnson|Smith|Brown|Davis|Wilson|Anderson|Thompson|Martinez|Robinson|Clark|Lewis|Lee|Walker|Hall|Allen|King|Wright|Scott|Green|Baker|Adams|Nelson|Carter|Mitchell|Roberts|Turner|Phillips|Campbell|Parker|Evans|Edwards|Collins"
TITLES = r"Mr\.|Ms\.|Mrs\.|Dr\.|Prof\.|Judge|Attorney|Director|Officer|President|CEO|CFO|CTO|Chairman|Secretary|Treasurer"
COMPANY_ENDINGS = r"Inc\.?|LLC|Corp\.?|Corporation|Ltd\.?|Limited|LP|LLP|Co\.?|Company|Group|Holdings|Enterprises|Solutions|Services|Technologies|Systems|International|Global|Worldwide|Industries|Ventures|Capital|Partners|Associates|Consulting|Management|Bank|Trust|Financial|Insurance|Realty|Properties|Development|Manufacturing|Distribution|Logistics|Healthcare|Medical|Pharmaceutical|Biotech|Energy|Resources|Retail|Marketing|Media|Entertainment|Communications|Telecom|Software|Digital|Interactive|Networks|Securities|Investments|Advisors|Law Firm|LLP|PC|PA"
KNOWN_COMPANIES = r"Smartfrog|Acme|Apple|Google|Microsoft|Amazon|Facebook|Tesla|Oracle|IBM|Intel|Cisco|Adobe|Salesforce|Netflix|Twitter|Uber|Airbnb|Spotify|PayPal|Square|Stripe|Zoom|Slack|Dropbox|Box|DocuSign|Workday|ServiceNow|Snowflake|Databricks|Palantir|SpaceX|Boeing|Lockheed|Northrop|Raytheon|General\s+(?:Electric|Motors|Dynamics)|Bank\s+of\s+America|Wells\s+Fargo|JPMorgan|Goldman\s+Sachs|Morgan\s+Stanley|Citigroup|Barclays|Deutsche\s+Bank|Credit\s+Suisse|UBS|HSBC|BNP\s+Paribas|Societe\s+Generale|State\s+Street|BlackRock|Vanguard|Fidelity|Charles\s+Schwab"
BODIES = "Company|Corporation|Firm|Entity|Organization|Institution|Agency|Department|Division|Bureau|Office|Committee|Commission|Board|Council|Authority|Administration"
COUNTRIES = r"United\s+States|USA|US|America|Canada|Mexico|United\s+Kingdom|UK|England|Scotland|Wales|Ireland|France|Germany|Spain|Italy|Netherlands|Belgium|Switzerland|Austria|Sweden|Norway|Denmark|Finland|Poland|Russia|China|Japan|Korea|India|Australia|Brazil|Argentina"
CITIES = r"New\s+York\s+City|Los\s+Angeles|Chicago|Houston|Phoenix|Philadelphia|San\s+Antonio|San\s+Diego|Dallas|San\s+Jose|Austin|Jacksonville|Fort\s+Worth|Columbus|San\s+Francisco|Charlotte|Indianapolis|Seattle|Denver|Washington\s+DC|Boston|El\s+Paso|Detroit|Nashville|Portland|Memphis|Oklahoma\s+City|Las\s+Vegas|Louisville|Baltimore|Milwaukee|Albuquerque|Tucson|Fresno|Mesa|Sacramento|Atlanta|Kansas\s+City|Colorado\s+Springs|Miami|Raleigh|Omaha|Long\s+Beach|Virginia\s+Beach|Oakland|Minneapolis|Tulsa|Arlington|Tampa|New\s+Orleans"
WRITTEN_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_STATES = R.STATE_NAMES.replace(" ", r"\s+").replace(r"|District\s+of\s+Columbia", "")


def by_prefix(words: str) -> str:
    """The same alternatives in the same order of preference, those that begin alike
    with their common characters read once. Only plain characters are shared; two
    words change places only if their first characters tell them apart."""

    def tree(tails: list[str]) -> str:
        parts: list[tuple[str, list[str]]] = []
        movable = 0  # what comes before here may be empty or no plain character, so nothing passes it
        for tail in tails:
            head = tail[0] if tail and (tail[0].isalpha() or tail[0] == " ") and tail[1:2] not in ("?", "*", "+") else ""
            same = next((rest for h, rest in parts[movable:] if head and h.lower() == head.lower()), None)
            if same is not None:
                same.append(tail[1:])
            else:
                parts.append((head, [tail[1:] if head else tail]))
                movable = movable if head else len(parts)
        made = [head + (tree(rest) if len(rest) > 1 else rest[0]) if head else rest[0] for head, rest in parts]
        return made[0] if len(made) == 1 else f"(?:{'|'.join(made)})"

    outer: list[str] = []  # a bar within brackets parts no words
    for part in words.split("|"):
        if outer and outer[-1].count("(") > outer[-1].count(")"):
            outer[-1] += "|" + part
        else:
            outer.append(part)
    return tree(outer)


_ENDING = by_prefix(COMPANY_ENDINGS)
_COMPANY = rf"(?i)\b[A-Z][a-zA-Z\s&]+(?:\s+(?:{COMPANY_ENDINGS}))\b"
_PAIR = r"(?i)\b[A-Z][a-z]+\s+(?:[A-Z]\.\s+)?[A-Z][a-z]+\b"
GAZETTEER = (
    ("NAME", rf"(?i)\b{by_prefix(FIRST_NAMES)}\b", 0.85),
    ("NAME", rf"(?i)\b{by_prefix(TITLES)}\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?", 0.85),
    ("NAME", _PAIR, 0.85),
    ("ORG", _COMPANY, 0.80),
    ("ORG", rf"(?i)\b{by_prefix(KNOWN_COMPANIES)}\b", 0.80),
    ("ORG", rf"(?i)\b(?:the\s+)?{by_prefix(BODIES)}\b", 0.80),
    ("LOC", rf"(?i)\b{by_prefix(_STATES)}\b", 0.90),
    ("LOC", rf"(?i)\b{by_prefix(COUNTRIES)}\b", 0.90),
    ("LOC", rf"(?i)\b{by_prefix(CITIES)}\b", 0.90),
    ("DATE", rf"(?i)\b(?:{WRITTEN_MONTHS})\s+\d{{1,2}},?\s+\d{{4}}\b", 0.92),
    ("DATE", rf"(?i)\b\d{{1,2}}\s+(?:{WRITTEN_MONTHS})\s+\d{{4}}\b", 0.92),
)
#: Pattern -> (pattern that is run, what a whole match of it is like). A clause in which
#: a company fails at the first word has none: it is passed over as one more match,
#: which goes again, instead of being read to its end from each word.
PASSING = {_COMPANY: (rf"(?i)\b[A-Z][a-zA-Z\s&]+\s{_ENDING}\b|\b[A-Z][a-zA-Z\s&]*+[^a-zA-Z\s&]?", rf"(?i)\s{_ENDING}$", rf"(?i)^[A-Z][a-zA-Z\s&]+\s{_ENDING}$")}
#: What a text must hold for a list to match in it: a word of any of the lists, which is
#: looked for once for all of them, or a company's ending.
_LISTED = rf"(?i)\b{by_prefix('|'.join((FIRST_NAMES, TITLES, KNOWN_COMPANIES, BODIES, _STATES, COUNTRIES, CITIES, WRITTEN_MONTHS)))}"
_ENDED = rf"(?i)\s{_ENDING}\b"
NEEDS = {p: _ENDED if p == _COMPANY else _LISTED for _, p, _ in GAZETTEER if p != _PAIR}
#: Characters from the end of a company's match that hold its ending.
_TAIL = max(map(len, COMPANY_ENDINGS.split("|"))) + 1
# fixed values
DEFINED_BODIES = ("the company", "the corporation", "the firm", "the entity")


def scan_gazetteer(docs: DataFrame, lists=GAZETTEER) -> DataFrame:
    """The built-in extractor: (label, pattern, confidence) lists, overlaps
    resolved greedily within a document."""
    def part(text, needed, number, label, pattern, confidence):
        run, tail, whole = PASSING.get(pattern, (pattern, None, None))
        body = lambda m: (F.length(m) <= max(map(len, DEFINED_BODIES))) & F.lower(m).isin(*DEFINED_BODIES)

        def sure(m):  # null: no entity
            c = F.lit(confidence)
            if label == "ORG":  # a defined term counts only if written as one
                c = F.when(~body(m), c).when(m.rlike("^[A-Z]") | m.contains("Company"), 0.75)
            # most that is passed over shows by its end
            return c if tail is None else F.when(F.substring(m, -_TAIL, _TAIL).rlike(tail) & m.rlike(whole), c)

        item = lambda p: F.struct(F.lit(number).alias("k"), F.lit(label).alias("label"), p["gap"].alias("gap"), F.length(p["m"]).alias("len"), p["m"].alias("text"), sure(p["m"]).cast("double").alias("confidence"))
        found = gaps_and_matches(text, F.lit(run))
        return F.transform(found if pattern not in NEEDS else F.when(needed[NEEDS[pattern]], found).otherwise(F.array().cast(PAIRS)), item)

    def all_of(text, listed, ended):
        return F.flatten(F.array(*(part(text, {_LISTED: listed, _ENDED: ended}, i, *x) for i, x in enumerate(lists))))

    text = F.col("text")
    found = docs.select("doc_id", let_all(all_of, text=text, listed=text.rlike(_LISTED), ended=text.rlike(_ENDED)).alias("m"))
    kept = resolved_places(F.col("m.k"), F.col("m.gap"), F.col("m.len"), F.col("m.confidence"))
    spans = F.transform("kept", lambda p: let(F.get("m", p["i"]), lambda m: span(p["start"], p["end"], m["label"], m["text"], m["confidence"], "gazetteer")))
    return found.withColumn("kept", kept).select("doc_id", F.inline(spans))


@F.arrow_udf(ArrayType(StructType([StructField(c, IntegerType()) for c in ("i", "start", "end")])))
def resolved_places(list_no: pa.Array, gap: pa.Array, length: pa.Array, confidence: pa.Array) -> pa.Array:
    """For each document's matches, list after list: number and place of those that
    W6 keeps. A match without a confidence only moves those behind it in its list."""
    flat = lambda a: a.flatten().to_numpy(zero_copy_only=False)
    sizes = np.array([n or 0 for n in pc.list_value_length(list_no).to_pylist()], dtype=np.int64)
    k, long, sure = flat(list_no), flat(length).astype(np.int64), flat(confidence).astype(float)
    ends = np.cumsum(flat(gap).astype(np.int64) + long)
    row = np.repeat(np.arange(len(sizes)), sizes)
    # the first of each document's each list begins at its own gap
    first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (row[1:] != row[:-1])]) if len(k) else np.zeros(0, np.int64)
    before = np.r_[0, ends[:-1]][first] if len(k) else ends
    ends = ends - np.repeat(before, np.diff(np.r_[first, len(k)]))
    starts, number = ends - long, np.arange(len(k)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    real = np.flatnonzero(~np.isnan(sure))
    order = real[np.lexsort((number[real], -long[real], starts[real], row[real]))]
    kept: list[int] = []
    last_row, last_start, last_end, last_sure = -1, 0, 0, 0.0
    for at, r, a, z, c in zip(order.tolist(), row[order].tolist(), starts[order].tolist(), ends[order].tolist(), sure[order].tolist(), strict=True):
        if r != last_row or not (a < last_end and z > last_start):
            kept.append(at)
        elif c > last_sure or z - a > last_end - last_start:
            kept[-1] = at
        else:
            continue
        last_row, last_start, last_end, last_sure = r, a, z, c
    at = np.array(kept, dtype=np.int64)
    offsets = np.r_[0, np.cumsum(np.bincount(row[at], minlength=len(sizes)))].astype(np.int32)
    fields = [pa.array(x[at].astype(np.int32)) for x in (number, starts, ends)]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["i", "start", "end"]))
