"""Text helpers that Spark lacks: accent folding beyond Latin, transliteration, word segmentation, Metaphone."""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _latin() -> dict[str, str]:
    """Accented Latin letters with the one letter that is left without their marks."""
    out = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if unicodedata.category(c) != "Mn")
        if len(bare) == 1 and bare != chr(code):
            out[chr(code)] = bare
    return out


LATIN = _latin()
#: Texts of these characters alone are folded by the table, without Python.
PLAIN = r"^[\x00-\x7F\u00A1-\u00A7\u00AB\u00B0-\u00B1\u00B6\u00BF-\u024F\u1E00-\u1EFF\u2010-\u2023\u2030-\u203B]*$"


def without_marks(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if unicodedata.category(c) != "Mn")


@F.pandas_udf(T.StringType())
def _fold_udf(s: pd.Series) -> pd.Series:
    return s.map(without_marks, na_action="ignore")


def fold_accents(c: Column) -> Column:
    """Compatibility decomposition without combining marks; only texts beyond Latin reach Python."""
    plain = F.translate(c, "".join(LATIN), "".join(LATIN.values()))
    return F.coalesce(_fold_udf(F.when(~c.rlike(PLAIN), c)), plain)


# Letters that don't decompose.
_SINGLE = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "Þ": "Th", "ð": "d", "ı": "i", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "..."}


# Letters of other alphabets with their customary Latin letters, in the order of the alphabets.
LETTERS = {
    "а": "a", "б": "b", "в": "v", "г": "g", "ґ": "g", "д": "d", "ђ": "dj", "е": "e", "є": "ie", "ж": "zh", "з": "z", "и": "i", "і": "i", "ј": "j", "к": "k", "л": "l",
    "љ": "lj", "м": "m", "н": "n", "њ": "nj", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "ћ": "c", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "џ": "dz",
    "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "iu", "я": "ia",
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p",
    "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
    "א": "a", "ב": "b", "ג": "g", "ד": "d", "ה": "h", "ו": "v", "ז": "z", "ח": "kh", "ט": "t", "י": "y", "כ": "k", "ך": "k", "ל": "l", "מ": "m", "ם": "m", "נ": "n",
    "ן": "n", "ס": "s", "ע": "", "פ": "p", "ף": "p", "צ": "ts", "ץ": "ts", "ק": "q", "ר": "r", "ש": "sh", "ת": "t",
    "ا": "a", "ب": "b", "پ": "p", "ة": "h", "ت": "t", "ث": "th", "ج": "j", "چ": "ch", "ح": "h", "خ": "kh", "د": "d", "ذ": "dh", "ر": "r", "ز": "z", "ژ": "zh", "س": "s",
    "ش": "sh", "ص": "s", "ض": "d", "ط": "t", "ظ": "z", "ع": "", "غ": "gh", "ف": "f", "ق": "q", "ک": "k", "ك": "k", "گ": "g", "ل": "l", "م": "m", "ن": "n", "ه": "h",
    "و": "w", "ى": "a", "ي": "y", "ی": "y", "ء": "",
}
# The sounds of Korean syllables' first, middle and last parts, in the order of Unicode.
HANGUL = (
    ["g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj", "ch", "k", "t", "p", "h"],
    ["a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "wo", "we", "wi", "yu", "eu", "ui", "i"],
    ["", "k", "k", "k", "n", "n", "n", "t", "l", "k", "m", "l", "l", "l", "p", "l", "m", "p", "p", "t", "t", "ng", "t", "t", "k", "t", "p", "t"],
)


@lru_cache(maxsize=65536)
def _sound(c: str) -> tuple[str, str]:
    """What a character stands for, by the tables or from its Unicode name: (kind, Latin letters)."""
    if c in _SINGLE:
        return "plain", _SINGLE[c]
    if "가" <= c <= "힣":
        rest, last = divmod(ord(c) - ord("가"), len(HANGUL[2]))
        first, middle = divmod(rest, len(HANGUL[1]))
        return "plain", HANGUL[0][first] + HANGUL[1][middle] + HANGUL[2][last]
    bare = without_marks(c)
    for x in (c, bare):
        if x.lower() in LETTERS:
            sound = LETTERS[x.lower()]
            return "plain", sound if x == x.lower() else sound.capitalize()
    name = unicodedata.name(c, "")
    if name.startswith("CJK "):
        return "plain", f" u{ord(c):x} "
    if " VOWEL SIGN " in name:
        return "sign", name.rpartition(" VOWEL SIGN ")[2].split()[-1].lower()
    if name.endswith((" VIRAMA", " SIGN NUKTA")):
        return ("virama" if name.endswith("VIRAMA") else "plain"), ""
    if name.endswith((" SIGN ANUSVARA", " TIPPI")):
        return "plain", "n"
    if " DIGIT " in name:
        return "plain", str(unicodedata.digit(c, ""))
    if " LETTER " in name:
        last = name.rpartition(" LETTER ")[2].split(" WITH ")[0].split()[-1].lower()
        if len(name.split()) and name.split()[0] in _ABUGIDAS:
            return ("consonant", last[:-1]) if len(last) > 1 and last[-1] == "a" and last != "aa" else ("plain", last)
        return "plain", last.upper() if " CAPITAL " in name else last
    return "plain", ""


_ABUGIDAS = {"DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM", "SINHALA"}


def transliterate(s: str) -> str:
    """ASCII for any text: marks are dropped, letters of other scripts read by their Unicode names.

    In scripts of South Asia a consonant carries an ``a`` unless a vowel sign or a virama follows.  Cyrillic, Greek, Hebrew
    and Arabic letters and Korean syllables have tables; short vowels that aren't written aren't guessed.  A Chinese
    character, whose reading no rule gives, is a word of its own that names its code: equal names stay equal.
    """
    if s.isascii():
        return s
    out, pending = [], False
    for c in unicodedata.normalize("NFKC", s):
        if c.isascii():
            kind, sound = "plain", c
        else:
            bare = without_marks(c)
            kind, sound = ("plain", bare) if bare and bare.isascii() else _sound(c)
        if pending and kind not in ("sign", "virama"):
            out.append("a")
        pending = kind == "consonant"
        out.append(sound)
    return "".join([*out, "a"] if pending else out)


@F.pandas_udf(T.StringType())
def _transliterate_udf(s: pd.Series) -> pd.Series:
    return s.map(transliterate, na_action="ignore")


def transliterated(c: Column) -> Column:
    """``transliterate``; ASCII texts don't reach Python."""
    return F.coalesce(_transliterate_udf(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def word_costs(df: DataFrame, text_col: str, most: int = 50_000) -> dict[str, float]:
    """Costs (negative log frequency) of the ``most`` commonest words: the bound on what is broadcast.

    A word counts only where it stands by itself: parts of web addresses don't.
    """
    words = df.select(F.explode(F.split(F.lower(F.regexp_replace(F.col(text_col), r"(?i)\S*(?:www\.|://|\.(?:com|org|net|in|co|io|ai|biz|info|us)\b)\S*", " ")), r"[^a-z0-9]+")).alias("w")).filter(F.length("w") > 1)
    rows = words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(most).collect()
    total = sum(r["count"] for r in rows) or 1
    return {r["w"]: math.log(total / r["count"]) for r in rows}


def segment(s: str, costs: dict[str, float], longest: int = 24) -> str:
    """The cheapest cut of a glued string into known words; what no word covers stays in one piece."""
    low, dear = s.lower(), max(costs.values(), default=1.0) + 5
    best = [(0.0, 0)]
    for i in range(1, len(low) + 1):
        best.append(min((best[j][0] + costs.get(low[j:i], dear if i - j == 1 else float("inf")), j) for j in range(max(0, i - longest), i)))
    parts: list[str] = []
    unknown, end = False, len(low)
    while end:
        start = best[end][1]
        strange = low[start:end] not in costs
        if strange and unknown:
            parts[-1] = s[start:end] + parts[-1]
        else:
            parts.append(s[start:end])
        unknown, end = strange, start
    return " ".join(reversed(parts))


def hyphenated(c: Column, costs: dict[str, float], pattern: str) -> Column:
    """The text with hyphens between the words of its web addresses; ``pattern``'s first group is the name in an address.

    Only texts with an address reach Python.
    """
    sent, of = costs, re.compile(pattern, re.IGNORECASE)

    def address(m: re.Match) -> str:
        a, b = m.start(1) - m.start(), m.end(1) - m.start()
        body = re.sub(r"[^._\-]+", lambda w: segment(w[0], sent).replace(" ", "-") if w[0].lower() != "www" else w[0], m[1])
        return m[0][:a] + body + m[0][b:]

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: of.sub(address, t), na_action="ignore")

    return F.coalesce(run(F.when(c.rlike(f"(?i){pattern}"), c)), c)


def metaphone(word: str) -> str:
    """Lawrence Philips' Metaphone of the letters of a word."""
    w = "".join(c for c in transliterate(word).upper() if "A" <= c <= "Z")
    if not w:
        return ""
    for head, by in (("KN", "N"), ("GN", "N"), ("PN", "N"), ("AE", "E"), ("WR", "R"), ("WH", "W"), ("X", "S")):
        if w.startswith(head):
            w = by + w[len(head) :]
            break
    vowels, soft, out = "AEIOU", "EIY", []
    for i, c in enumerate(w):
        before, after, later = w[i - 1 : i] if i else "", w[i + 1 : i + 2], w[i + 2 : i + 3]
        if c == before and c != "C":
            continue
        if c in vowels:
            code = c if i == 0 else ""
        elif c == "B":
            code = "" if before == "M" and not after else "B"
        elif c == "C":
            if after and after in soft:
                code = "" if before == "S" else "X" if after == "I" and later == "A" else "S"
            elif after == "H":
                code = "K" if before == "S" else "X"
            else:
                code = "K"
        elif c == "D":
            code = "J" if after == "G" and later and later in soft else "T"
        elif c == "G":
            if after == "H":
                code = "K" if not later or later not in vowels and i == 0 else "" if later not in vowels else "K"
                code = "" if i and (not later or later not in vowels) else code
            elif after == "N" and (not later or w[i + 1 :] == "NED"):
                code = ""
            elif after and after in soft and before != "G":
                code = "" if before == "D" else "J"
            else:
                code = "" if before == "D" and after and after in soft else "K"
        elif c == "H":
            code = "H" if after and after in vowels and (not before or before not in "CSPTG") else ""
        elif c == "K":
            code = "" if before == "C" else "K"
        elif c == "P":
            code = "F" if after == "H" else "P"
        elif c == "Q":
            code = "K"
        elif c == "S":
            code = "X" if after == "H" or after == "I" and later and later in "OA" else "S"
        elif c == "T":
            code = "X" if after == "I" and later and later in "OA" else "0" if after == "H" else "" if after == "C" and later == "H" else "T"
        elif c == "V":
            code = "F"
        elif c in "WY":
            code = c if after and after in vowels else ""
        elif c == "X":
            code = "KS"
        elif c == "Z":
            code = "S"
        else:
            code = c
        out.append(code)
    return "".join(out)


@F.pandas_udf(T.StringType())
def _metaphone_udf(s: pd.Series) -> pd.Series:
    return s.map(metaphone, na_action="ignore")


def metaphones(c: Column) -> Column:
    return _metaphone_udf(c)
