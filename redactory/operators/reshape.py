"""Span reshaping within one document: array in, array out, expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactory.functions.let import let, let_all
from redactory.functions.text import fold_quotes, org_acronym
from redactory.operators.scan import between, matches
from redactory.plans import rules as R
from redactory.schemas import SPANS

NUMERIC_LABELS = ("PHONE", "ACCOUNT", "CARD", "SSN", "NUMBER", "IP")
WORD = r"\p{L}\p{N}\-'’_"
NUMERIC = r"\p{Nd}+\-().,/"
REACH = 1024
MAX_ORG_CHARS, SUFFIX_SLACK = 60, 30
# fixed values of the county filter
COUNTY_WORDS = ("county", "parish", "borough")
COUNTY_GENERIC = ("the", "this", "that", "such", "any", "each", "aforementioned", "foregoing", "said", "a", "an")
COUNTY_OFFICES = ("court", "clerk", "jail", "probation", "board", "commission", "department", "office")


def _moved(s: Column, text: Column, start: Column, end: Column) -> Column:
    return s.withField("start", start.cast("int")).withField("end", end.cast("int")).withField("text", between(text, start, end))


def _grown(text: Column, at: Column, chars: str, left: bool) -> Column:
    """Characters of a class next to ``at``; a window first, all only if it is full."""
    if left:
        near = F.length(F.regexp_extract(between(text, at - REACH, at), f"[{chars}]*$", 0))
        return F.when(near < REACH, near).otherwise(F.length(F.regexp_extract(between(text, F.lit(0), at), f"[{chars}]*$", 0)))
    near = F.length(F.regexp_extract(between(text, at, at + REACH), f"^[{chars}]*", 0))
    return F.when(near < REACH, near).otherwise(F.length(F.regexp_extract(between(text, at, F.length(text)), f"^[{chars}]*", 0)))


def snap_to_tokens(spans: Column, text: Column) -> Column:
    """Grow both ends over word characters (numeric ones for numeric labels),
    then trim what is not alphanumeric; organisations and brands keep a last full
    stop, and an apostrophe stays before an s."""

    def trimmed(s, start, end, body):
        lead = F.length(F.regexp_extract(body, r"^[^\p{L}\p{N}]*", 0))
        genitive = F.lower(between(text, end, end + 1)) == "s"
        marks = F.when(s["label"].isin("ORG", "BRAND"), F.regexp_extract(body, r"[^\p{L}\p{N}.]*$", 0)).otherwise(F.regexp_extract(body, r"[^\p{L}\p{N}]*$", 0))
        held = F.when(genitive & body.rlike("['’]$"), F.lit("")).otherwise(marks)
        return let_all(lambda first, last: F.when((first == s["start"]) & (last == s["end"]), s).otherwise(_moved(s, text, first, last)), first=start + lead, last=F.greatest(end - F.length(held), start + lead))

    def one(s):
        numeric = s["label"].isin(*NUMERIC_LABELS)
        start = s["start"] - F.when(numeric, _grown(text, s["start"], NUMERIC, True)).otherwise(_grown(text, s["start"], WORD, True))
        end = s["end"] + F.when(numeric, _grown(text, s["end"], NUMERIC, False)).otherwise(_grown(text, s["end"], WORD, False))
        return let_all(lambda start, end: let(between(text, start, end), lambda body: trimmed(s, start, end, body)), start=start, end=end)

    return F.transform(spans, one)


def _on(spans: Column, label: str, change) -> Column:
    return F.transform(spans, lambda s: F.when(s["label"] == label, change(s)).otherwise(s))


def trim_jurisdiction(spans: Column) -> Column:
    """ORG spans lose a trailing jurisdiction clause; one that is nothing else goes."""

    def one(s):
        kept = F.regexp_replace(s["text"], R.JURISDICTION_TAIL, "")
        kept = F.when(kept == s["text"], kept).otherwise(F.regexp_replace(kept, "[ ,;]+$", ""))
        return s.withField("text", kept).withField("end", (s["start"] + F.length(kept)).cast("int"))

    return F.filter(_on(spans, "ORG", one), lambda s: (s["label"] != "ORG") | (s["text"] != ""))


def extend_org_suffix(spans: Column, text: Column) -> Column:
    """E5: a legal form right behind an ORG span belongs to it."""
    return _on(spans, "ORG", lambda s: _moved(s, text, s["start"], s["end"] + F.length(F.regexp_extract(between(text, s["end"], s["end"] + 64), R.ORG_TAIL, 0))))


# the rule's form; a place with a character that begins no form is left at once
ENDING_FORM = "(?i)(?=[ABCFGHILNPRST])" + R.ORG_FORM_AT_END.replace("(?i:", "(?:").removeprefix("(?i)")


def drop_overlong_orgs(spans: Column, max_chars: int = MAX_ORG_CHARS) -> Column:
    """overlong or multi-line ORG spans go, unless a legal form ends them."""

    def keep(s):
        flat = F.replace(s["text"], F.lit("\r"), F.lit("\n"))
        breaks = F.length(flat) - F.length(F.replace(flat, F.lit("\n"), F.lit("")))
        formed = F.trim(F.regexp_replace(flat, r"^\s+|\s+$", "")).rlike(ENDING_FORM) & (breaks <= 1)
        short = F.length(s["text"]) <= max_chars
        return (s["label"] != "ORG") | F.when(short, (breaks == 0) | formed).otherwise(formed & (F.length(flat) <= max_chars + SUFFIX_SLACK))

    return F.filter(spans, keep)


def drop_generic_counties(spans: Column) -> Column:
    """a county without a name, or an office of one, is no place."""

    def keep(s):
        clean = F.regexp_replace(s["text"], r"^\s+|\s+$", "")
        low = F.transform(F.regexp_extract_all(clean, F.lit("[A-Za-z'’-]+"), F.lit(0)), lambda t: F.lower(t))
        proper = F.array_except(low, F.array(*(F.lit(w) for w in (*COUNTY_WORDS, *COUNTY_GENERIC, "of"))))
        office = F.element_at(low, -1).isin(*COUNTY_OFFICES) & F.element_at(low, 1).isin(*COUNTY_WORDS)
        applies = s["label"].isin("ORG", "LOC") & (F.length(clean) <= 80) & F.lower(clean).rlike("county|parish|borough") & ~clean.rlike(r"(?U)\d") & (F.size(low) > 0)
        return ~applies | ((F.size(proper) > 0) & ~office)

    return F.filter(spans, lambda s: F.coalesce(keep(s), F.lit(True)))


def extend_addresses(spans: Column, text: Column, max_line: int = 240) -> Column:
    """A LOC span on a line with an address takes the line if the longest
    address touching it covers 60 % of a line of at most ``max_line`` characters,
    else that address; not if an ORG span lies on the line outside it."""
    def placed(s, orgs, lo, hi, line, touching):
        best = F.element_at(F.sort_array(F.transform(touching, lambda m: F.struct((m["start"] - m["end"]).alias("k"), m["start"].alias("a"), m["end"].alias("b")))), 1)
        blocked = F.exists(orgs, lambda o: (o["end"] > lo) & (o["start"] < hi) & ((o["start"] < s["start"]) | (o["end"] > s["end"])))

        def choose(best):
            whole = ((best["b"] - best["a"]) / F.greatest(F.length(line), F.lit(1)) >= 0.6) & (F.length(line) <= max_line)
            part = _moved(s, text, lo + best["a"], lo + best["b"]).withField("source", F.lit("rule_extended_address"))
            return F.when(whole, _moved(s, text, lo, hi)).otherwise(part)

        return F.when((F.size(touching) == 0) | blocked, s).otherwise(let(best, choose))

    def one(s, orgs):
        before = F.regexp_extract(between(text, F.lit(0), s["start"]), r"[^\n]*$", 0)
        after = F.regexp_extract(between(text, s["end"], F.length(text)), r"^[^\n]*", 0)

        def on_line(lo, hi):
            rel_start, rel_end = s["start"] - lo, s["end"] - lo

            def of(line):
                touching = F.filter(matches(line, R.ADDRESS), lambda m: (m["start"] <= rel_end) & (m["end"] >= rel_start))
                return let(touching, lambda t: placed(s, orgs, lo, hi, line, t))

            return let(between(text, lo, hi), of)

        return let_all(on_line, lo=s["start"] - F.length(before), hi=s["end"] + F.length(after))

    # the address pattern runs only where a document has a LOC span
    some = F.exists(spans, lambda s: s["label"] == "LOC")
    orgs = F.filter(spans, lambda s: s["label"] == "ORG")
    return F.when(some, let(orgs, lambda o: _on(spans, "LOC", lambda s: one(s, o)))).otherwise(spans)


# --- E7: defined-term aliases ---------------------------------------------------
_PAREN = r"\([^)]{1,100}\)"
_LEADING = r"(?i)^\s*(?:,)?\s*\(\s*(?:(?:the|a|an)\s+)?([^)]+?)\s*\)"
_QUOTED = "[\"“”']([^\"“”']+)[\"“”']"
_TOKEN = r"[A-Za-z0-9]+(?:['’\-][A-Za-z0-9]+)*"
_EDGES = "\\s\"'“”‘’"


def _alias_candidates(window: Column, label: Column) -> Column:
    """array<struct(start, end, text)>: texts in parentheses behind a span."""
    head = F.regexp_extract(window, _LEADING, 0)
    inner = F.regexp_extract(window, _LEADING, 1)
    lead = F.length(F.regexp_extract(head, r"(?i)^\s*(?:,)?\s*\(\s*(?:(?:the|a|an)\s+)?", 0))
    first = F.when(head != "", F.array(F.struct(lead.alias("start"), (lead + F.length(inner)).alias("end"), inner.alias("text"))))

    def paren(m):
        body = F.substring(m["text"], F.lit(2), F.length(m["text"]) - 2)
        quoted = F.transform(matches(body, _QUOTED), lambda q: F.struct((m["start"] + 2 + q["start"]).alias("start"), (m["start"] + q["end"]).alias("end"), F.substring(q["text"], F.lit(2), F.length(q["text"]) - 2).alias("text")))
        bare = F.array(F.struct((m["start"] + 1).alias("start"), (m["end"] - 1).alias("end"), body.alias("text")))
        return F.when(F.size(quoted) > 0, quoted).otherwise(bare)

    more = F.when(label == "ORG", F.flatten(F.transform(matches(window, _PAREN), paren)))
    empty = F.array().cast("array<struct<start:int,end:int,text:string>>")
    return F.concat(F.coalesce(first.cast("array<struct<start:int,end:int,text:string>>"), empty), F.coalesce(more.cast("array<struct<start:int,end:int,text:string>>"), empty))


def alias_fits(alias: Column, entity: Column, label: Column) -> Column:
    """Whether an alias can stand for an entity: its tokens are the entity's
    (initials allowed for names), or it is the acronym of an organisation."""
    plain = lambda c: F.regexp_replace(fold_quotes(c), r"'s\b", "")
    cut = lambda c: F.regexp_extract_all(plain(c), F.lit(_TOKEN), F.lit(0))
    low = lambda ts: F.transform(ts, lambda t: F.lower(t))
    mine, theirs = low(cut(alias)), low(cut(entity))
    long_ = F.exists(mine, lambda t: F.length(t) >= 2)
    subset = F.forall(mine, lambda t: F.array_contains(theirs, t))
    initials = F.forall(mine, lambda t: F.when(F.length(t) == 1, F.exists(theirs, lambda e: e.startswith(t))).otherwise(F.array_contains(theirs, t)))
    letters = F.regexp_replace(F.upper(plain(alias)), "[^A-Z]", "")
    acronym = F.length(letters).between(2, 6) & (letters == org_acronym(cut(entity)))
    fits = F.when(label == "NAME", long_ & initials).when(label == "ORG", acronym | (long_ & subset)).otherwise(F.lit(False))
    return (F.size(mine) > 0) & (F.size(theirs) > 0) & fits


def alias_spans(spans: Column, text: Column, lookahead: int = 120) -> Column:
    """The aliases that E7 adds, before the excluded-phrase test of names."""

    def of(s):
        window = between(text, s["end"], s["end"] + lookahead)
        none = F.array().cast(SPANS)
        near = let(window, lambda w: F.when(w.contains("("), found(s, w)).otherwise(none))
        return F.when(s["label"].isin("NAME", "ORG"), near).otherwise(none)

    def found(s, window):
        def tidy(c):
            lead = F.regexp_extract(c["text"], rf"(?i)^[{_EDGES}]*(?:(?:the|a|an) )?\s*", 0)
            rest = F.regexp_replace(F.substring(c["text"], F.length(lead) + 1, F.length(c["text"])), f"[{_EDGES}]+$", "")
            start = s["end"] + c["start"] + F.length(lead)
            return F.struct(start.cast("int").alias("start"), (start + F.length(rest)).cast("int").alias("end"), s["label"].alias("label"), fold_quotes(rest).alias("text"), F.coalesce(s["confidence"], F.lit(0.7)).alias("confidence"), F.lit("defined_term").alias("source"))

        def good(a):
            free = ~F.exists(spans, lambda o: (a["start"] < o["end"]) & (a["end"] > o["start"]))
            return (a["text"] != "") & ~a["text"].rlike(r"[\n\r]") & (F.length(a["text"]) <= 60) & alias_fits(a["text"], s["text"], s["label"]) & free

        return F.filter(F.transform(_alias_candidates(window, s["label"]), tidy), good).cast(SPANS)

    made = F.flatten(F.transform(spans, of)).cast(SPANS)
    # one span for each (start, end, label): the first made
    def once(out, a):
        seen = F.exists(out, lambda o: (o["start"] == a["start"]) & (o["end"] == a["end"]) & (o["label"] == a["label"]))
        return F.when(seen, out).otherwise(F.concat(out, F.array(a)))

    return F.aggregate(made, F.array().cast(SPANS), once)


# --- chunks -------------------------------------------------------------------
def make_chunks(docs: DataFrame, max_chars: int = 2500, overlap: int = 200, threshold: int = 4000) -> DataFrame:
    """(doc_id, chunk_no, start, end, text); a text up to ``threshold`` is one
    chunk, else windows step max_chars - overlap and the last ends with the text."""
    if max_chars <= 0:
        raise ValueError("max_chars must be positive")
    overlap = min(max(0, overlap), max_chars - 1)
    n, step = F.length("text"), max_chars - overlap
    starts = F.when(n <= threshold, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step)))
    cut = docs.select("doc_id", "text", F.posexplode(starts).alias("chunk_no", "start"))
    end = F.when(n <= threshold, n).otherwise(F.least(F.col("start") + max_chars, n))
    return cut.select("doc_id", "chunk_no", "start", end.alias("end"), between(F.col("text"), F.col("start"), end).alias("text"))


def rebase_chunk_spans(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk offsets to document offsets; new entities start at confidence 0.7
    and are to be redacted."""
    at = chunks.select("doc_id", "chunk_no", F.col("start").alias("_base"))
    out = entities.join(at, ["doc_id", "chunk_no"])
    confidence = F.coalesce("confidence", F.lit(0.7)) if "confidence" in entities.columns else F.lit(0.7)
    needs = F.coalesce("needs_redaction", F.lit(True)) if "needs_redaction" in entities.columns else F.lit(True)
    return out.select("doc_id", "chunk_no", (F.col("start") + F.col("_base")).alias("start"), (F.col("end") + F.col("_base")).alias("end"), "label", "text", confidence.alias("confidence"), needs.alias("needs_redaction"))
