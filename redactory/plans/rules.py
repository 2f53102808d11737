"""The rule table: labelled patterns in Java syntax, confidences, validators.

Fixed values. Patterns that rely on Unicode classes start with ``(?U)``;
look-arounds and atomic groups are Java's own. ``Rule`` is also the extension
point: append rules of your own to ``RULES``' copy and pass it to the scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

from redactory.functions.text import luhn_ok


@dataclass(frozen=True)
class Rule:
    """A labelled pattern; ``validator`` maps the matched text to a boolean. A text
    without a match of ``needs``, a cheap pattern, cannot match and is not scanned.
    ``led`` is the pattern in the form that is run: the same matches, but a place is
    left at once if no alternative begins with its character."""

    label: str
    pattern: str
    confidence: float
    validator: Callable[[Column], Column] | None = None
    source: str = "rule"
    needs: str | None = None
    led: str | None = None


def led_by(flags: str, *groups: tuple[str, tuple[str, ...]]) -> str:
    """Alternatives dealt by the characters they begin with. Those that can begin at
    the same place keep their order, so the first that matches is the same."""
    return flags + "|".join(f"(?=[{lead}])(?:{'|'.join(alternatives)})" for lead, alternatives in groups)


# --- fixed values: patterns ---------------------------------------------------
DASH = r"\-–—−"
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = (
    rf"(?U)(?:(?<!\d)(?:\+?\s?\d{{1,3}}[\s.{DASH}]?)?(?:\(\d{{3}}\)|\d{{3}})[\s.{DASH}]?\d{{3}}[\s.{DASH}]?\d{{4}}(?!\d)"
    rf"|(?<!\d)\+\s?\d{{1,3}}(?:[\s().{DASH}]?\d){{7,12}}(?!\d))"
)
SSN = rf"(?U)\b\d{{3}}[{DASH}]\d{{2}}[{DASH}]\d{{4}}\b"
CURRENCY = r"(?:USD|EUR|GBP|CAD|AUD|JPY|CHF|\$|£|€|¥)"
CURRENCY_WORDS = r"(?:dollars?|euros?|pounds?|yen|yuan)"
MAGNITUDES = r"(?:thousand|million|billion|trillion)"
NUMBER_WORDS = (
    "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|"
    "thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand"
)
MONEY_PARTS = (
    rf"{CURRENCY}\s*\[?\d[\d,]*(?:\.\d{{1,2}})?\]?\s*{MAGNITUDES}\b(?:\s*{CURRENCY_WORDS})?",
    rf"\b\d{{1,3}}(?:[\s.,]\d{{3}})*(?:[.,]\d{{1,2}})?\s*{MAGNITUDES}\s*{CURRENCY_WORDS}\b",
    rf"{CURRENCY}\s*\[?\d{{1,3}}(?:[\s.,]\d{{3}})*(?:[.,]\d{{1,2}})?\]?",
    r"\$\s*\[?\d[\d,]*(?:\.\d{1,2})?\]?",
    r"€\s*\[?\d{1,3}(?:\.\d{3})*(?:,\d{1,2})?\]?",
    r"£\s*\[?\d[\d,]*(?:\.\d{1,2})?\]?",
    rf"\b(?:(?:{NUMBER_WORDS}|million|billion|and)(?:\s+|-)){{1,10}}{CURRENCY_WORDS}\b",
)
MONEY = "(?i)" + "|".join(MONEY_PARTS)
MONEY_LED = led_by("(?i)", ("$£€¥", (*MONEY_PARTS[:1], *MONEY_PARTS[2:6])), (r"\d", MONEY_PARTS[1:2]), ("uegcaj", MONEY_PARTS[:3:2]), ("otfsenhmba", MONEY_PARTS[6:]))
MONEY_NEEDS = r"[$£€¥]|(?=[UuEeGgCcAaJj])(?i:usd|eur|gbp|cad|aud|jpy|chf)\s*\[?\d|(?=[DdEePpYy])(?i:dollar|euro|pound|yen|yuan)"
PERCENT = (
    r"(?i)\(?\d+(?:\.\d+)?\s*%\)?"
    r"|\[\d+(?:\.\d+)?\]\s*%"
    rf"|\b(?:(?:{NUMBER_WORDS}|hundredth|hundredths|thousandth|thousandths|tenth|tenths|"
    r"half|quarter|third|thirds|fourth|fourths|fifth|fifths|and|of|one)(?:\s+|-)){1,10}percent(?:age)?\b"
)
ACCOUNT = rf"(?U)(?<!\d)(?:\d[ {DASH}]?){{8,20}}(?!\d)"
SWIFT = r"\b(?=[A-Z0-9]{8}(?:[A-Z0-9]{3})?\b)(?=[A-Z0-9]*\d)[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b"
CARD = rf"(?U)(?<!\d)(?:\d[ {DASH}]?){{13,19}}(?!\d)"
URL = r"(?i)(?:https?|ftp|sftp)://[^\s<>()]+|mailto:[^\s<>()]+|www\.[^\s<>()]+\.[a-z]{2,}[^\s<>()]*|(?<!@)(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}[^\s<>()]*"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
IPV4 = rf"\b(?:{OCTET}\.){{3}}{OCTET}\b"
HEX4 = r"[A-Fa-f0-9]{1,4}"
IPV6 = (
    rf"\b(?:(?:{HEX4}:){{7}}{HEX4}|(?:{HEX4}:){{1,7}}:|:(?:{HEX4}:){{1,7}}|(?:{HEX4}:){{1,6}}:{HEX4}|(?:{HEX4}:){{1,5}}(?::{HEX4}){{1,2}}"
    rf"|(?:{HEX4}:){{1,4}}(?::{HEX4}){{1,3}}|(?:{HEX4}:){{1,3}}(?::{HEX4}){{1,4}}|(?:{HEX4}:){{1,2}}(?::{HEX4}){{1,5}}|{HEX4}:(?::{HEX4}){{1,6}}"
    rf"|:(?::{HEX4}){{1,7}}|(?:{HEX4}:){{1,4}}:(?:\d{{1,3}}\.){{3}}\d{{1,3}})\b"
)
HEX = "[A-Fa-f0-9]"
DOCID_PARTS = (
    rf"(?:(?:DocuSign|Docusign)\s+Envelope\s+ID:\s*{HEX}{{8}}\s*-\s*{HEX}{{4}}\s*-\s*{HEX}{{4}}\s*-\s*{HEX}{{4}}\s*-\s*{HEX}{{12}})",
    r"(?:(?:Document|Doc|File|Envelope|Agreement|Contract|Transaction|Reference|Ref|Case|Matter|Deal|Project)\s*(?:ID|Id|No\.?|Number|#|Ref|Reference)?:\s*[A-Za-z0-9][-A-Za-z0-9_.]{4,40})",
    rf"(?:(?<![A-Za-z0-9]){HEX}{{8}}-{HEX}{{4}}-{HEX}{{4}}-{HEX}{{4}}-{HEX}{{12}}(?![A-Za-z0-9]))",
    r"(?:(?<![A-Za-z0-9])\d{7,12}(?:\s*[vV]\.?\s*\d{1,3}|\.\d{1,3})(?![A-Za-z0-9]))",
    r"(?:\b(?:DOC|ENV|AGR|REF|CASE|MATTER|DEAL|FILE|PROJ|TXN|DMS|ND)(?:[-:_#][A-Za-z0-9]{4,40}|(?=[A-Za-z0-9]*\d)[A-Za-z0-9]{4,20})\b)",
)
DOCID = "(?i)" + "|".join(DOCID_PARTS)
DOCID_LED = led_by("(?i)", ("dfeactrmp", DOCID_PARTS[:2]), (r"a-f\d", DOCID_PARTS[2:4]), ("dearcmfptn", DOCID_PARTS[4:]))
MONTHS = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
BULLETS = "•●○■□"
GAP = rf"(?:(?:_{{1,}}|[{BULLETS}]+|[ \t]{{2,}})|\[\s*[_{BULLETS}]*\s*\])"
# the underscore form of a placeholder year is the literal text "_(2, 4)", kept as found
GAP_YEAR = rf"(?:_(?:2, 4)|[{BULLETS}]{{2,4}}|\[\s*[_{BULLETS}]*\s*\]|[ \t]{{2,}})"
SEP = rf"[./{DASH}]"
DATE_PLAIN = (
    rf"\b\d{{1,2}}[/{DASH}]\d{{1,2}}[/{DASH}]\d{{2,4}}\b",
    rf"\b\d{{4}}[/{DASH}]\d{{1,2}}[/{DASH}]\d{{1,2}}\b",
    r"\b\d{1,2}[.]\d{1,2}[.]\d{2,4}\b",
    rf"\b\d{{1,2}}\s*[./{DASH}]\s*\d{{1,2}}\s*[./{DASH}]\s*\d{{2,4}}\b",
    rf"\b\d{{4}}[{DASH}]\d{{2}}[{DASH}]\d{{2}}\b",
    r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:?\d{2})?\b",
    rf"\b{MONTHS}\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,\s*|\s+)\d{{2,4}}\b",
    rf"\b\d{{1,2}}(?:st|nd|rd|th)?\s+{MONTHS}(?:,\s*|\s+)\d{{2,4}}\b",
    rf"\b{MONTHS}(?:\s+|\s*,\s*)\d{{4}}\b",
)
DATE_GAPS = (
    rf"\b{MONTHS}\s+{GAP}(?:\s*,\s*|\s+)\d{{4}}\b",
    rf"\b__+[/{DASH}]__+[/{DASH}]\d{{2,4}}\b",
    rf"\b\d{{1,2}}[/{DASH}]__+[/{DASH}]\d{{2,4}}\b",
    rf"(?<!\w){GAP}\s*{SEP}\s*(?:\d{{1,2}}|{GAP})\s*{SEP}\s*(?:\d{{2,4}}|{GAP_YEAR})(?!\w)",
    rf"(?<!\w)\d{{1,2}}\s*{SEP}\s*{GAP}\s*{SEP}\s*(?:\d{{2,4}}|{GAP_YEAR})(?!\w)",
    rf"(?<!\w)\d{{1,2}}\s*{SEP}\s*\d{{1,2}}\s*{SEP}\s*{GAP_YEAR}(?!\w)",
    rf"(?<!\w)\d{{2,4}}\s*{SEP}\s*{GAP}\s*{SEP}\s*(?:\d{{1,2}}|{GAP})(?!\w)",
    rf"(?<!\w)\d{{2,4}}\s*{SEP}\s*\d{{1,2}}\s*{SEP}\s*{GAP}(?!\w)",
    rf"(?<!\w){GAP_YEAR}\s*{SEP}\s*(?:\d{{1,2}}|{GAP})\s*{SEP}\s*(?:\d{{1,2}}|{GAP})(?!\w)",
    rf"\b(?:the\s+)?\d{{1,2}}(?:st|nd|rd|th)?\s+day\s+of\s+{MONTHS},?\s*\d{{4}}\b",
)
DATE = "(?iU)" + "|".join(DATE_PLAIN + DATE_GAPS)
DATE_LED = led_by(
    "(?iU)",
    (r"\d", (*DATE_PLAIN[:6], DATE_PLAIN[7], DATE_GAPS[2], *DATE_GAPS[4:8], DATE_GAPS[9])),
    ("jfmasond", (DATE_PLAIN[6], DATE_PLAIN[8], DATE_GAPS[0])),
    (rf"_{BULLETS}\[ \t", (DATE_GAPS[1], DATE_GAPS[3], DATE_GAPS[8])),
    ("t", DATE_GAPS[9:]),
)
BRACKET_NUMBER = r"(?U)(?<![$€£¥])\[(?:\d{1,3}(?:,\d{3})*|\d+)(?:\.\d+)?\]"
LEGAL_FORMS = (
    r"(?i:Incorporated|Corporation|Company|Limited)|(?i:Inc)\.?|(?i:Corp)\.?|(?i:Co)\.?|(?i:Ltd)\.?"
    r"|(?i:Limited\s+Liability\s+Company)|L\.L\.C\.|LLC|L\.C\.|LC|(?i:Limited\s+Liability\s+Partnership)|L\.L\.P\.|LLP"
    r"|(?i:Limited\s+Partnership)|L\.P\.|LP|(?i:General\s+Partnership)|G\.P\.|GP|(?i:Professional\s+Corporation)|P\.C\.|PC"
    r"|(?i:Professional\s+Association)|P\.A\.|PA|(?i:Federal\s+Savings\s+Bank)|FSB|(?i:National\s+Association)|N\.A\."
    r"|(?i:National\s+Bank|Bank)|(?i:Trust\s+Company)|Capital|Holdings|Group|Fund|(?i:Statutory\s+Trust|Business\s+Trust)|REIT|Trust"
    r"|(?i:Foundation|Association|Society|Institute)|GmbH|AG|S\.A\.S\.|S\.A\.|S\.R\.L\.|Sp\.\s+z\s+o\.o\.|B\.V\.|N\.V\.|(?i:PLC|p\.l\.c\.)"
)
# a word is followed by blanks that are no part of it, so it ends in one place only: atomic
# words and blanks match the same and never try a number digit by digit, or "The" twice
ORG = (
    r"(?U)\b(?=[A-Z])(?>(?:[A-Z][\w'&.-]++|\d++[A-Za-z0-9'&.-]*+|(?i:and|of|the|for|a|an|&|de|la)),?[^\S\n]++){1,10}?"
    rf"(?:{LEGAL_FORMS})(?!\w)"
)
STATE_CODES = (
    r"A[LKSZRAEP]|C[AOT]|D[EC]|F[LM]|G[AU]|HI|I[ADLN]|K[SY]|LA|M[ADEHINOPST]|N[CDEHJMVY]|O[HKR]|P[ARW]|RI|S[CD]|T[NX]|UT|V[AIT]|W[AIVY]"
)
STATE_NAMES = (
    "Alabama|Alaska|Arizona|Arkansas|California|Colorado|Connecticut|Delaware|Florida|Georgia|Hawaii|Idaho|Illinois|Indiana|Iowa|Kansas|"
    "Kentucky|Louisiana|Maine|Maryland|Massachusetts|Michigan|Minnesota|Mississippi|Missouri|Montana|Nebraska|Nevada|New Hampshire|New Jersey|"
    "New Mexico|New York|North Carolina|North Dakota|Ohio|Oklahoma|Oregon|Pennsylvania|Rhode Island|South Carolina|South Dakota|Tennessee|"
    "Texas|Utah|Vermont|Virginia|Washington|West Virginia|Wisconsin|Wyoming|District of Columbia"
)
STREETS = (
    "Street|St|Road|Rd|Avenue|Ave|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl|Terrace|Ter|Way|Parkway|Pkwy|Circle|Cir|Loop|Crescent|Cres|"
    "Square|Sq|Alley|Aly|Plaza|Plz|Highway|Hwy|Freeway|Fwy|Expressway|Expy|Turnpike|Tpke|Causeway|Cswy|Trail|Trl|Path|Walk|Row|Mews|Close|Cl|"
    "Gardens|Gdns|Esplanade|Esp|Promenade|Prom|Quay|Wharf|Embankment|Emb|Mall|Via|Route|Rte|Byway|Bywy|Spur|Cutoff|Crossing|Xing|Trace|Trce|"
    "Apartment|Apt|Suite|Ste|Unit|Building|Bldg|Floor|Fl"
)
UNITS = "Apt|Apartment|Suite|Ste|Unit|Floor|Fl|Bldg|Building|#"
BARE_STREETS = (
    "Broadway|The Strand|The Mall|The Bowery|The High Line|Wall|Canal|Fleet|Piccadilly|Lombard|Hollywood|Sunset|Market|Mission|Valencia|"
    "Causeway|Esplanade|Promenade|Boardwalk|Embankment|Walk|Way|Via Appia|Via del Corso|Beacon|Liberty|Union|Central|Victory|Heritage|"
    "King['’]s Way|Queen['’]s Walk|Champs[-\\s](?:Elysees|Élysées)"
)
_STATES = rf"(?:{STATE_CODES}|{STATE_NAMES.replace(' ', r'\s+')})"
_UNIT = rf"(?:(?:(?:{UNITS})\.?\s*\S+|\S+\s*(?:{UNITS})\.?)\s*,?\s*)?"
_PLACE = rf"{_UNIT}(?:[A-Za-z\s]+,?\s+)?{_STATES}\s+\d{{5}}(?:-\d{{4}})?"
ADDRESS = (
    rf"(?>\b\d+\s+[A-Z0-9][a-zA-Z0-9\s.]+\b(?:{STREETS})\.?,?\s+{_PLACE})"
    rf"|(?>\b\d+\s+(?:{BARE_STREETS})\b,?\s+{_PLACE})"
    r"|(?i:\bP\.?O\.?\s+Box\s+\d+(?:,\s*[A-Za-z\s]+)?\b)"
    r"|(?i:(?:Address|Residing at|Location):\s+(?:[^\n,]+(?:,[^\n,]+)+))"
)
_PROPER = r"[A-Z][A-Za-z'’-]{1,30}"
COUNTY = rf"(?i)(?:{_PROPER}\s+){{0,2}}{_PROPER}\s+(?:County|Parish|Borough)|(?:County|Parish|Borough)\s+of\s+(?:{_PROPER}\s+){{0,2}}{_PROPER}"
# a word ends where no character of it follows, so it is read in one way; within a word
# whose beginning led nowhere nothing else begins, unless the word is too long
_WORD = r"[A-Z][A-Za-z'’-]{1,30}+"
_UNITS_OF_LAND = "(?:County|Parish|Borough)"
COUNTY_LED = (
    rf"(?i)(?=[A-Z])(?:(?:\G|(?<![A-Z])|(?=[A-Z'’-]{{31}}))(?:{_WORD}\s++){{0,2}}{_WORD}\s++{_UNITS_OF_LAND}"
    rf"|(?=[CPB]){_UNITS_OF_LAND}\s+of\s+(?:{_WORD}\s++){{0,2}}{_WORD})"
)
DEFINED_NAME = r"([A-Z][A-Za-z'\-\.]+(?:\s+[A-Z][A-Za-z'\-\.]+){1,2})\s*\(\s*[\"“”]([A-Z][A-Za-z'\-\.]+)[\"”]\s*\)"
SIGNATURE_LINE = r"(?im)(?:^|\n)\s*Name:\s*([^\n]+?)\s*(?:\n|$)"
PERSON = r"^[A-Z][a-z]+(?:\s+(?:[A-Z][a-z]+|[A-Z]\.?))?\s+[A-Z][a-z]+$"
ACCOUNT_CONTEXT = r"(?i)\b(?:account\s+(?:number|no\.?|#)|acct\s+(?:number|no\.?|#)|iban|routing|aba|swift|bic|sort\s+code)\b"
PHONE_CONTEXT = r"(?i)\b(?:phone|tel|telephone|mobile|cell|fax|call|ph\.?)\b"
CURRENCY_AFTER = r"^\s*\(?[A-Z]{3}(?:\b|/)"
SSN_BEFORE = r"(?i)(?:SSN|SS#|S\.S\.N\.?|Social\s+Security(?:\s+Number)?)\s*(?:(?:#|No\.?|Number)\s*)?(?:(?:is|was)\s*)?:?\s*$"
_JURISDICTIONS = rf"(?:{STATE_NAMES.replace(' ', r'[^\S\n]+')}|D\.C\.)"
JURISDICTION = rf"(?i)^{_JURISDICTIONS}$"
JURISDICTION_TAIL = (
    rf"(?i)(?:,[^\S\n]*)?(?:a|an)[^\S\n]+{_JURISDICTIONS}[^\S\n]+(?:limited[^\S\n]+liability[^\S\n]+company|limited[^\S\n]+liability[^\S\n]+partnership"
    r"|limited[^\S\n]+partnership|general[^\S\n]+partnership|corporation|inc\.?|company|llc|l\.l\.c\.|l\.c\.|lc|llp|l\.l\.p\.|lp|l\.p\.|plc|p\.l\.c\."
    r"|statutory[^\S\n]+trust|business[^\S\n]+trust)[^\S\n]*$"
)
SENTENCE_END = r"(?<!\b(?:[A-Z]|Mr|Mrs|Ms|Dr|St|Jr|Sr|Inc|Ltd))\.\s+[A-Z]"
DOTTED_FORMS = r"(?:L\.L\.C\.|L\.L\.P\.|L\.P\.|G\.P\.|P\.C\.|P\.A\.|N\.A\.|S\.A\.S\.|S\.A\.|B\.V\.|N\.V\.|p\.l\.c\.)"
ORG_FORM_ANYWHERE = (
    r"(?i)\b(?:inc\.?|corp\.?|co\.?|ltd\.?|llc|l\.l\.c\.|llp|l\.l\.p\.|lp|l\.p\.|pllc|plc|p\.l\.c\.|gmbh|s\.a\.s\.|s\.a\.|s\.r\.l\.|b\.v\.|n\.v\.|"
    r"reit|trust|bank|foundation|association|society|institute)\b"
    r"|\b(?:incorporated|corporation|company|limited|limited\s+liability\s+company|limited\s+liability\s+partnership|limited\s+partnership|"
    r"general\s+partnership|professional\s+corporation|professional\s+association|federal\s+savings\s+bank|national\s+association|national\s+bank|"
    r"trust\s+company|statutory\s+trust|business\s+trust)\b|\b(?:capital|holdings|group|fund|management|ventures|partners)\b"
)
ORG_FORM_AT_END = rf"(?i)(?:{LEGAL_FORMS})\s*$"
ORG_FORM_WORDS = frozenset({
    "inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "liability", "llc", "l", "c", "llp", "lp", "pllc", "plc",
    "partnership", "general", "professional", "association", "bank", "trust", "capital", "holdings", "group", "fund", "management", "ventures",
    "partners", "statutory", "business", "foundation", "society", "institute", "national", "federal", "savings",
})
ORG_TAIL_SCAN = (
    r"^(?:[^\S\n]|,)+(?:(?i)inc\.?|corp\.?|co\.?|ltd\.?|llc|l\.l\.c\.|llp|l\.l\.p\.|lp|l\.p\.|pllc|plc|p\.l\.c\.|gmbh|s\.a\.s\.|s\.a\.|s\.r\.l\.|b\.v\.|n\.v\.?)"
    r"\.?(?=$|[\s,;:\)\]\}])"
)
ORG_TAIL = (
    r"^[\s,]+(?:(?i)inc\.?|corp\.?|co\.?|ltd\.?|llc|l\.l\.c\.|llp|l\.l\.p\.|lp|l\.p\.|pllc|plc|p\.l\.c\.|gmbh|ag|s\.a\.?|b\.v\.?|n\.v\.?)"
    r"\.?(?=$|[\s,;:\)\]\}])"
)
URL_TAIL = r"[.,;:!?)\]}>\\\"']+$"

RULES: tuple[Rule, ...] = (
    Rule("EMAIL", EMAIL, 0.98, needs=r"@"),
    Rule("PHONE", PHONE, 0.96, needs=r"(?U)\d", led=led_by("(?U)", (r"+\s\d(", (PHONE[4:],)))),
    Rule("SSN", SSN, 0.99, needs=r"(?U)\d[\-–—−]\d", led=led_by("(?U)", (r"\d", (SSN[4:],)))),
    Rule("MONEY", MONEY, 0.90, needs=MONEY_NEEDS, led=MONEY_LED),
    Rule("PERCENT", PERCENT, 0.90, needs=r"%|(?=[Pp])(?i:percent)"),
    Rule("NUMBER", BRACKET_NUMBER, 0.70, needs=r"\["),
    Rule("DATE", DATE, 0.88, needs=rf"(?U)[\d_{BULLETS}\[]|[ \t]{{2}}", led=DATE_LED),
    Rule("ACCOUNT", ACCOUNT, 0.80, needs=r"(?U)\d", led=led_by("(?U)", (r"\d", (ACCOUNT[4:],)))),
    Rule("SWIFT", SWIFT, 0.92, needs=r"[0-9]", led=led_by("", ("A-Z", (SWIFT,)))),
    Rule("CARD", CARD, 0.92, luhn_ok, needs=r"(?U)\d", led=led_by("(?U)", (r"\d", (CARD[4:],)))),
    Rule("URL", URL, 0.90, needs=r"[.:][^\s<>()]"),
    Rule("IP", IPV4, 0.90, needs=r"[0-9]"),
    Rule("IP", IPV6, 0.90, needs=r":"),
    Rule("DOCID", DOCID, 0.95, needs=r"[0-9]|[-:_#]\s*[A-Za-z]", led=DOCID_LED),
    Rule("ORG", ORG, 0.75, needs=r"[A-Z]", led=led_by("(?U)", ("A-Z", (ORG[4:],)))),
    Rule("LOC", ADDRESS, 0.85, needs=r"(?i)[0-9]|address|residing at|location"),
    Rule("LOC", COUNTY, 0.82, needs=r"(?=[CcPpBb])(?i:county|parish|borough)", led=COUNTY_LED),
)
SIGNATURE = "SIGNATURE"
