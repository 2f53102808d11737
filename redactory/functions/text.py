"""Scalar expressions over text: folds, keys, checks and small estimators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from redactory.functions.let import let, let_all

# --- fixed values -----------------------------------------------------------
APOSTROPHES = "‘’‛ʼ＇"
DASHES = "‐‑‒–—−"
ASCII_FORMS = {
    "\xa0": " ", "‘": "'", "’": "'", "‚": ",", "“": '"', "”": '"', "„": '"', "–": "-",
    "—": "--", "…": "...", "·": "*", "•": "*", "©": "(c)", "®": "(R)", "™": "(TM)",
    "°": " deg", "¼": "1/4", "½": "1/2", "¾": "3/4", "×": "x", "÷": "/", "′": "'",
    "″": '"', "«": "<<", "»": ">>",
}
DETERMINERS = ("the", "a", "an", "this", "that", "such", "each", "any", "certain", "both", "all", "these", "those", "every", "either", "neither")
LEGAL_SUFFIXES = ("inc", "inc.", "llc", "l.l.c.", "corp", "corp.", "co", "co.", "lp", "l.p.", "llp", "l.l.p.", "pllc", "gmbh", "s.a.", "s.a", "sa", "ltd", "ltd.")
ACRONYM_STOP_WORDS = ("and", "of", "the", "for", "a", "an", "&")
ACRONYM_SUFFIXES = ("inc", "inc.", "llc", "l.l.c.", "corp", "corp.", "co", "co.", "ltd", "ltd.", "lp", "l.p.", "llp", "l.l.p.", "pllc", "gmbh", "sa", "s.a", "s.a.", "bv", "b.v", "b.v.", "nv", "n.v", "plc", "p.l.c", "p.l.c.")
LABEL_NAMES = {
    "NAME": ("NAME", "PERSON", "HUMAN", "INDIVIDUAL"),
    "ORG": ("ORG", "ORGANIZATION", "COMPANY", "INSTITUTION", "BUSINESS"),
    "BRAND": ("BRAND", "PRODUCT", "SERVICE"),
    "LOC": ("LOC", "LOCATION", "GPE", "PLACE", "ADDRESS"),
    "MONEY": ("MONEY", "CURRENCY"),
    "NUMBER": ("NUMBER", "QUANTITY", "COUNT", "AMOUNT"),
    "DATE": ("DATE",),
}
LABEL_RANKS = {3: ("EMAIL", "PHONE", "SSN", "CARD", "ACCOUNT", "SWIFT", "URL", "IP", "DOCID"), 2: ("NAME", "ORG", "BRAND", "LOC"), 1: ("MONEY", "NUMBER", "DATE", "PERCENT")}
DOC_TYPES = (
    ("shareholder_consent", ("shareholder", "consent")),
    ("purchase_agreement", ("purchase agreement",)),
    ("employment_agreement", ("employment agreement",)),
)
LOW_CONFIDENCE = 0.88
AGREEMENT_BONUS = 0.07
CONTEXT_CHARS = {"ORG": 150, "NAME": 80, "LOC": 200, "DATE": 60, "MONEY": 60}


def scan_normalize(c: Column) -> Column:
    """Apostrophes and dashes to ASCII, one character for one."""
    return F.translate(c, APOSTROPHES + DASHES, "'" * len(APOSTROPHES) + "-" * len(DASHES))


def ascii_fold(c: Column) -> Column:
    """Typographic characters to ASCII; changes lengths, so never before offsets."""
    return reduce(lambda a, kv: F.replace(a, F.lit(kv[0]), F.lit(kv[1])), ASCII_FORMS.items(), c)


def fold_quotes(c: Column) -> Column:
    """Curly single quotes to straight ones."""
    return F.translate(c, "‘’", "''")


def strip_determiner(c: Column) -> Column:
    """Drop one leading determiner."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), rf"^(?i:{'|'.join(DETERMINERS)})\s+", "")


def exclusion_key(c: Column) -> Column:
    """The key under which a phrase is looked up among excluded terms."""
    c = F.lower(F.regexp_replace(strip_determiner(c), r"^\s+|\s+$", ""))
    c = F.regexp_replace(c, "['’]s\\s*$|['’]\\s*$", "")
    return F.regexp_replace(F.regexp_replace(c, "[.,;:!?\"']+$", ""), r"\s+", " ")


def singular_keys(key: Column) -> Column:
    """A key and its singular, if its ending allows one. The key is computed once."""

    def keys(key: Column) -> Column:
        singular = (
            F.when(key.rlike(r"\(s\)\s*$"), F.trim(F.regexp_replace(key, r"\(s\)\s*$", "")))
            .when(key.endswith("ies") & (F.length(key) > 3), F.concat(F.substring(key, F.lit(1), F.length(key) - 3), F.lit("y")))
            .when(key.endswith("s") & (F.length(key) > 1), F.rtrim(F.substring(key, F.lit(1), F.length(key) - 1)))
        )
        return F.filter(F.array(key, singular), lambda x: x.isNotNull() & (x != ""))

    return let(key, keys)


def cluster_key(c: Column) -> Column:
    """The form in which mentions of one entity are compared."""
    tails = F.array(*(F.lit(" " + suffix) for suffix in LEGAL_SUFFIXES))
    cut = lambda acc, tail: F.when(F.endswith(acc, tail), F.substring(acc, F.lit(1), F.length(acc) - F.length(tail))).otherwise(acc)
    c = F.aggregate(tails, F.replace(F.lower(c), F.lit("&"), F.lit("and")), cut)
    return F.regexp_replace(F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}\s]", "")), " {2,}", " ")


def org_key(c: Column) -> Column:
    """An organisation name without possessive, punctuation and case."""
    c = F.regexp_replace(F.regexp_replace(c, r"(?U)['’]s\b", ""), r"(?U)[^\w\s]", " ")
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def org_tokens(c: Column) -> Column:
    """Alphanumeric tokens of two characters or more."""
    return F.filter(F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda t: F.length(t) >= 2)


def luhn_ok(c: Column) -> Column:
    """13 to 19 digits with a right Luhn checksum."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def org_acronym(tokens: Column) -> Column:
    """First letters, without stop words (but a capital A) and legal suffixes."""
    norm = lambda t: F.regexp_replace(F.lower(t), r"\.+$", "")
    keep = lambda t: (norm(t) != "") & (~norm(t).isin(*ACRONYM_STOP_WORDS) | ((norm(t) == "a") & t.startswith("A"))) & ~norm(t).isin(*ACRONYM_SUFFIXES)
    return F.array_join(F.transform(F.filter(tokens, keep), lambda t: F.upper(F.substring(norm(t), 1, 1))), "")


def _lookup(pairs: list[tuple[str, object]]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs for x in pair))


def canonical_label(c: Column) -> Column:
    """An extractor's label in ours; null if unknown."""
    return _lookup([(alias, label) for label, names in LABEL_NAMES.items() for alias in names])[F.upper(F.trim(c))]


def label_rank(c: Column) -> Column:
    """X11: 3 for identifiers, 2 for names, 1 for amounts and dates, else 0."""
    return F.coalesce(_lookup([(label, rank) for rank, labels in LABEL_RANKS.items() for label in labels])[c], F.lit(0))


def combine_confidence(base: Column, agreements=0, boost=0.0, penalty=0.0) -> Column:
    """Base + 0.07 for each agreement + boost - penalty, within [0, 1]."""
    agreements, boost, penalty = (x if isinstance(x, Column) else F.lit(x) for x in (agreements, boost, penalty))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + agreements * AGREEMENT_BONUS + boost - penalty))


def is_low_confidence(c: Column) -> Column:
    return c < LOW_CONFIDENCE


def confidence_band(c: Column) -> Column:
    """X13"""
    return F.when(c >= 0.9, "high").when(c >= 0.7, "medium").otherwise("low")


def doc_type(text: Column) -> Column:
    """A document's kind, from its first 1,000 characters."""
    head = F.lower(F.substring(text, 1, 1000))
    kind = None
    for name, words in DOC_TYPES:
        test = reduce(lambda a, b: a & b, (head.contains(w) for w in words))
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    return kind.otherwise("legal_document")


def content_hash(c: Column) -> Column:
    """X19"""
    return F.sha2(c, 256)


def bounded_value(c: Column, limit: int = 20_000) -> Column:
    """struct(value, preview, truncated, original_chars, limit_chars); 0: no limit."""
    over = (F.length(c) > limit) if limit > 0 else F.lit(False)
    return F.struct(
        F.when(~over, c).alias("value"),
        F.when(over, F.substring(c, 1, max(limit, 1))).alias("preview"),
        over.alias("truncated"),
        F.when(over, F.length(c)).alias("original_chars"),
        F.when(over, F.lit(limit)).alias("limit_chars"),
    )


def context_snippet(text: Column, start: Column, end: Column, label: Column) -> Column:
    """The text around a span, on one line."""
    reach = F.coalesce(_lookup(list(CONTEXT_CHARS.items()))[label], F.lit(100))
    lo, hi = F.greatest(F.lit(0), start - reach), F.least(F.length(text), end + reach)
    return F.trim(F.replace(F.substring(text, lo + 1, hi - lo), F.lit("\n"), F.lit(" ")))


MODES = {"enhanced": "rules_override", "llm": "rules_override"}


def normalize_mode(mode: str | None) -> str:
    """A mode name, lower-cased, with its aliases resolved."""
    name = (mode or "").strip().lower().replace("-", "_").replace(" ", "_")
    return MODES.get(name, name)


def normalize_confidence(c: Column) -> Column:
    """Above 1 a percentage; not a number: 0.95; within [0, 1]."""
    x = c.try_cast("double")
    x = F.coalesce(F.when(F.isnan(x), None).otherwise(x), F.lit(0.95))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(x > 1, x / 100).otherwise(x)))


# --- X17: effort estimates ---------------------------------------------------
# fixed values
LEGAL_TERMS = ("whereas", "party", "agreement", "contract", "shareholder", "corporation")
WORD_STEPS = ((500, 0.6), (2000, 1.0), (5000, 1.4))
#: phase, base seconds, share that grows with complexity
PHASES = (
    ("preflight", 2.5, 0.1),
    ("rule_detection", 4.0, 0.2),
    ("document_analysis", 3.0, 0.15),
    ("llm_extraction", 22.5, 1.0),
    ("validation", 7.5, 0.3),
    ("merging", 2.5, 0.1),
    ("track_changes", 4.0, 0.2),
)
# fixed values
TITLE_WORDS = r"(?i)\b(?:agreement|amendment|consent|resolution|statement|minutes|bylaws|charter|policy|plan)\b"
COMPANY_HINTS = r"(?i)\b(?:inc\.?|corp\.?|co\.?|ltd\.?|llc|l\.l\.c\.|llp|l\.l\.p\.|lp|l\.p\.|plc|gmbh|ag|s\.a\.|s\.r\.l\.)\b"


def looks_like_title(c: Column) -> Column:
    """A document-type word, no company form, two words or more."""
    words = F.filter(F.split(c, r"\s+"), lambda w: F.regexp_replace(w, r"^[,.;:()\[\]{}]+|[,.;:()\[\]{}]+$", "") != "")
    return F.coalesce(c.rlike(TITLE_WORDS) & ~c.rlike(COMPANY_HINTS) & (F.size(words) >= 2), F.lit(False))


def complexity_score(text: Column, terms=LEGAL_TERMS) -> Column:
    """A step by word count, raised by legal terms and capitalised words. The
    words and the lower-cased text are made once."""

    def of_words(words: Column, low: Column) -> Column:
        n = F.size(words)
        base = reduce(lambda c, step: c.when(n < step[0], step[1]), WORD_STEPS[1:], F.when(n < WORD_STEPS[0][0], WORD_STEPS[0][1])).otherwise(2.0)
        legal = sum((low.contains(t).cast("int") for t in terms), F.lit(0)) / float(len(terms))
        capital = F.size(F.filter(words, lambda w: w.rlike("^[A-Z]") & (F.length(w) > 2))) / F.greatest(n, F.lit(1))
        return F.greatest(F.lit(0.3), F.least(F.lit(3.0), base * (1 + legal * 0.3 + capital * 0.2)))

    return let_all(of_words, words=F.filter(F.split(text, r"\s+"), lambda w: w != ""), low=F.lower(text))


def phase_seconds(base: Column, factor: Column, score: Column) -> Column:
    """Seconds of a phase at a complexity score."""
    return base + base * factor * (score - 1.0)
