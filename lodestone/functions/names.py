"""Business name normalisation.

``program`` gives the steps in order: outer noise, web domains, recognition errors, credentials, leading
affixes and legal forms, trade symbols, the legal form.  ``normalized`` runs them on a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.functions.dialect import Dialect, Layer, Program, apply

# Legal forms in the order in which they are tried, with their canonical name.
LEGAL_FORMS = [
    (r"\b(pvt\.?\s*ltd\.?|private\s*limited|pvt\.?\s*limited|private\s*ltd\.?)\b", "private limited"),
    (r"\b(public\s*limited|pub\.?\s*ltd\.?)\b", "public limited"),
    (r"\b(limited\s*liability\s*company|l\.?l\.?c\.?)\b", "llc"),
    (r"\b(incorporated|inc\.?)\b", "inc"),
    (r"\b(corporation|corp\.?)\b", "corporation"),
    (r"\b(limited\s*liability\s*partnership|l\.?l\.?p\.?)\b", "llp"),
    (r"\b(professional\s*llc|p\.?l\.?l\.?c\.?)\b", "pllc"),
    (r"\b(limited\s*partnership|l\.?p\.?)\b", "lp"),
    (r"\b(professional\s*corporation|p\.?c\.?)\b", "pc"),
    (r"\b(limited|ltd\.?)\b", "limited"),
    (r"\b(company|co\.?)\b", "company"),
    (r"\b(s\.?a\.?r\.?l\.?|societe\s*a\s*responsabilite\s*limitee)\b", "sarl"),
    (r"\b(s\.?a\.?s\.?u\.?)\b", "sasu"),
    (r"\b(s\.?a\.?s\.?)\b", "sas"),
    (r"\b(s\.?a\.?)\b", "sa"),
    (r"\b(s\.?c\.?i\.?|societe\s*civile\s*immobiliere)\b", "sci"),
    (r"\b(e\.?u\.?r\.?l\.?)\b", "eurl"),
    (r"\b(s\.?n\.?c\.?)\b", "snc"),
]

# Affixes at the start of a name, in order; None names no legal form.
LEADING_AFFIXES = [
    (r"^(?:m\/s\.?|messrs\.?|shri|shree|smt\.?)\s+", None),
    (r"^(?:pvt\.?\s*ltd\.?|private\s*limited|pvt\.?|private)\s+", "private limited"),
    (r"^(?:llc|limited\s*liability\s*company)\s+", "llc"),
    (r"^(?:inc\.?|incorporated)\s+", "inc"),
    (r"^(?:corp\.?|corporation)\s+", "corporation"),
    (r"^(?:ltd\.?|limited)\s+", "limited"),
    (r"^(?:sarl)\s+", "sarl"),
    (r"^(?:sas|sasu)\s+", "sas"),
    (r"^(?:sci)\s+", "sci"),
    (r"^(?:sa)\s+", "sa"),
]

# Trade symbols and short forms, in order.
TRADE_SYMBOLS = [
    (r"&", " and "),
    (r"@", " at "),
    (r"\+", " plus "),
    (r"\bco\.?\b", "company"),
    (r"\bmfg\.?\b", "manufacturing"),
    (r"\bintl\.?\b", "international"),
    (r"\bdept\.?\b", "department"),
    (r"\btech\.?\b", "technology"),
    (r"\bsvc\.?\b|\bsvcs\.?\b", "services"),
    (r"\bassn\.?\b", "association"),
    (r"\bctr\.?\b", "center"),
    (r"\bdba\b|\bd\/b\/a\b", "dba"),
]

# Credentials after a name, in order.
CREDENTIALS = [
    (r"\b(d\.?m\.?d\.?)\b", "DMD"),
    (r"\b(m\.?d\.?)\b", "MD"),
    (r"\b(d\.?o\.?)\b", "DO"),
    (r"\b(d\.?d\.?s\.?)\b", "DDS"),
    (r"\b(p\.?l\.?l\.?c\.?)\b", "PLLC"),
    (r"\b(l\.?p\.?)\b", "LP"),
    (r"\b(c\.?p\.?a\.?)\b", "CPA"),
    (r"\b(esq\.?|esquire)\b", "ESQ"),
    (r"\b(p\.?c\.?)\b", "PC"),
    (r"\b(d\.?c\.?)\b", "DC"),
    (r"\b(o\.?d\.?)\b", "OD"),
    (r"\b(d\.?v\.?m\.?)\b", "DVM"),
]

# Letters that recognition mistakes, as whole-word corrections.
RECOGNITION = [
    (r"\bl([nstvd][a-z]{2,})\b", r"i\1"),
    (r"\blnc\b", "inc"),
    (r"\b1td\b", "ltd"),
    (r"\bc0\b", "co"),
]

# Fixed value: a web address; its first group is the name before the top-level domain.
DOMAIN = r"(?:https?://)?(?:www\.)?([a-zA-Z0-9_\-\.]+)\.(?:com|org|net|in|co\.in|co|io|ai|biz|info|us)\b(?:/[^\s]*)?"

NOISE = r"[\s<>\-+#*/\\]+"
MISSING = ("nan", "none", "null")
OUTPUTS = ["norm_name", "norm_name_no_legal", "legal_type", "credential", "name_tokens"]


def clean(d: Dialect, x: str, fold: bool = True) -> str:
    """Outer spaces and noise signs off, accents folded, apostrophes dropped, spaces collapsed; missing is empty."""
    s = d.replace_all(f"coalesce({x}, '')", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    s = f"CASE WHEN {d.within(f'lower({s})', MISSING)} THEN '' ELSE {d.fold_accents(s) if fold else s} END"
    s = d.replace_all(d.replace_all(s, f"^{NOISE}", ""), f"{NOISE}$", "")
    return d.trim(d.replace_all(d.replace_all(s, "['’`]", ""), r"[ \t]+", " "))


def words(d: Dialect, x: str) -> str:
    """Signs between words to one space."""
    return d.trim(d.replace_all(d.replace_all(x, r"[,.\-/()]+", " "), r"\s+", " "))


def without_domain_parts(d: Dialect, x: str) -> str:
    """Of parts between bars, those that are no web address, if there are any."""
    parts = d.filter(d.map(d.split(x, r"\|"), d.trim("x")), f"NOT {d.has('x', '(?i)' + DOMAIN)}")
    return f"CASE WHEN {d.has(x, '[|]')} AND {d.size(parts)} > 0 THEN {d.join(parts, ' ')} ELSE {x} END"


def domain_words(d: Dialect, x: str) -> str:
    """The words of the first web address, as far as signs part them; null without one."""
    body = d.replace_first(d.find(x, "(?i)" + DOMAIN, 1), r"(?i)^www\.", "")
    return d.join(d.filter(d.split(body, r"[._\-]+"), "x <> ''"), " ")


def with_domain_words(d: Dialect, x: str, found: str) -> str:
    return f"CASE WHEN {found} IS NULL THEN {x} ELSE {d.replace_dynamic(x, d.text('(?i)' + DOMAIN), found)} END"


def credentials(start: str, prefix: str = "_cred") -> tuple[Program, str, str]:
    """A layer a rule, each of which takes its first hit off; then the text and the first code found."""

    def off(x: str, pattern: str) -> Callable[[Dialect], str]:
        return lambda d: d.replace_first(x, "(?i)" + pattern, " ")

    layers: Program = []
    names = [start]
    for k, (pattern, _) in enumerate(CREDENTIALS):
        layers.append({f"{prefix}{k}": off(names[-1], pattern)})
        names.append(f"{prefix}{k}")
    found = "coalesce(" + ", ".join(f"CASE WHEN {a} <> {b} THEN '{code}' END" for a, b, (_, code) in zip(names, names[1:], CREDENTIALS)) + ")"
    return layers, names[-1], found


def first_rule(d: Dialect, x: str, rules: list[tuple[str, str | None]], by: str) -> tuple[str, str]:
    """For the first rule that hits: the text with its first hit replaced, and the rule's name."""
    hits = [(d.has(x, "(?i)" + p), p, name) for p, name in rules]
    text_ = d.cases(((c, d.replace_first(x, "(?i)" + p, by)) for c, p, _ in hits), x)
    return text_, d.cases((c, "CAST(NULL AS VARCHAR(20))" if n is None else d.text(n)) for c, _, n in hits)


def _in_front(rules: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return [(rf"^{p}\s+", n) for p, n in rules]


def _lambda(kind: str, x: str, rules: list, by: str) -> Callable[[Dialect], str]:
    return lambda d: first_rule(d, x, rules, by)[0 if kind == "text" else 1]


def after_cleaning(start: str, prefix: str = "_") -> Program:
    """From a cleaned name without web address to the outputs."""
    p = prefix
    cred, last, code = credentials(f"{p}ocr", f"{p}cred")
    layers: Program = [{f"{p}ocr": lambda d: d.replaces(start, RECOGNITION)}, *cred]
    layers += [
        {f"{p}bare": lambda d: words(d, last), "credential": lambda d: code},
        {f"{p}affix": _lambda("text", f"{p}bare", LEADING_AFFIXES, ""), f"{p}legal0": _lambda("name", f"{p}bare", LEADING_AFFIXES, "")},
        {f"{p}front": _lambda("text", f"{p}affix", _in_front(LEGAL_FORMS), ""), f"{p}legal1": _lambda("name", f"{p}affix", _in_front(LEGAL_FORMS), "")},
        {f"{p}trade": lambda d: d.replaces(f"{p}front", TRADE_SYMBOLS)},
        {f"{p}core": _lambda("text", f"{p}trade", LEGAL_FORMS, " "), f"{p}legal2": _lambda("name", f"{p}trade", LEGAL_FORMS, " ")},
        {
            "legal_type": lambda d: f"coalesce({p}legal2, {p}legal1, {p}legal0)",
            "norm_name_no_legal": lambda d: d.trim(d.replace_all(d.replace_all(f"lower({words(d, f'{p}core')})", r"[^\p{L}\p{N}_\s]", " "), r"\s+", " ")),
        },
        {"norm_name": lambda d: d.trim("concat(norm_name_no_legal, CASE WHEN legal_type IS NULL THEN '' ELSE concat(' ', legal_type) END)")},
        {"name_tokens": lambda d: d.find_all("norm_name", r"\b([a-zA-Z0-9]+)\b", 1)},
    ]
    return layers


def program(name: str = "business_name", prefix: str = "_") -> Program:
    """All steps, web addresses cut into words at their signs only."""
    p = prefix
    return [
        {f"{p}clean": lambda d: clean(d, name)},
        {f"{p}parts": lambda d: without_domain_parts(d, f"{p}clean")},
        {f"{p}domain": lambda d: domain_words(d, f"{p}parts")},
        {f"{p}named": lambda d: with_domain_words(d, f"{p}parts", f"{p}domain")},
        *after_cleaning(f"{p}named", p),
    ]


def normalized(df: DataFrame, name: str = "business_name", *, costs: dict[str, float] | None = None, keep_marks: bool = False) -> DataFrame:
    """``df`` with ``OUTPUTS``; its columns of those names give way.

    ``costs`` (see ``text.word_costs``) lets glued web names be cut into words.  Names beyond Latin are folded in
    Python; ``keep_marks`` leaves their vowel signs and only composes them.
    """
    df = df.drop(*OUTPUTS)
    own = df.columns
    return apply(df.withColumn("_in", prepared(F.col(name), costs, keep_marks)), program("_in")).select(*own, *OUTPUTS)


def prepared(name: Column, costs: dict[str, float] | None = None, keep_marks: bool = False) -> Column:
    """What of a name's normalisation needs Python; it goes before the rule layers."""
    folded = name if keep_marks else text.fold_accents(name)
    return folded if costs is None else text.hyphenated(folded, costs, DOMAIN)
