"""Column expressions for text: whitespace, casing, regular expressions.

Everything here is a plain expression over built-in Spark functions, so it stays inside the JVM
and can be pushed around by Catalyst.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# The characters Python's str.isspace() accepts (Spark's trim() only knows U+0020).
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# A letter that has case, and the two ways a text can break title casing: a capital in the middle
# of a word, or a word that starts with a small letter.
_CASED = r"\p{Lu}\p{Ll}\p{Lt}"
NOT_TITLE = rf"[{_CASED}][\p{{Lu}}\p{{Lt}}]|(^|[^{_CASED}])\p{{Ll}}"

# E-mail shape shared by profiling, rule checks and cleaning.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"

# Texts that stand for "no value" in business data.
PLACEHOLDERS = ["", "NULL", "NONE", "NA", "N/A", "NAN", "BLANK", "-", "--", "---"]

# Small words and acronyms of the title-case styles.
SMALL_WORDS = [
    "a", "an", "and", "as", "at", "but", "by", "en", "for", "from", "how", "if", "in", "neither",
    "nor", "of", "on", "onto", "or", "per", "so", "than", "that", "the", "to", "until", "up",
    "upon", "v", "v.", "via", "vs", "vs.", "when", "with", "without", "yet",
]
ACRONYMS = [
    "II", "III", "IV", "VI", "VII", "VIII", "IX", "XI", "XII", "ID", "TV", "OK", "AI", "ML",
    "API", "URL", "HTTP", "HTTPS", "SQL", "JSON", "XML", "HTML", "CSS", "UI", "UX", "CEO", "CTO",
    "CFO", "COO", "CMO", "VP", "SVP", "EVP", "MD", "JD", "MBA", "BA", "BS", "MA", "MS", "RN",
    "CPA", "IBM", "AWS", "GCP",
]

# The named pattern library.
PATTERNS = {
    "Email": EMAIL,
    "Phone (US)": r"^\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}$",
    "URL": r"^https?://(?:[-\w.]|(?:%[\da-fA-F]{2}))+",
    "IP Address": r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$",
    "ZIP Code": r"^\d{5}(-\d{4})?$",
    "Credit Card": r"^\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}$",
    "Date (MM/DD/YYYY)": r"^(0[1-9]|1[0-2])/(0[1-9]|[12][0-9]|3[01])/\d{4}$",
    "Only Letters": r"^[A-Za-z]+$",
    "Only Numbers": r"^\d+$",
    "Alphanumeric": r"^[A-Za-z0-9]+$",
    "HTML Tags": r"<[^>]+>",
    "Whitespace": r"\s+",
}


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def is_placeholder(c: Column) -> Column:
    """True for NULL and for texts such as ``N/A`` that mean "no value" (D22)."""
    return F.coalesce(F.upper(strip(c.cast("string"))).isin(PLACEHOLDERS), F.lit(True))


def collapse_spaces(c: Column) -> Column:
    """Single spaces between words, none at the edges."""
    return strip(F.regexp_replace(c, f"[{SPACE_CLASS}]+", " "))


def is_upper(c: Column) -> Column:
    return (c == F.upper(c)) & (c != F.lower(c))


def is_lower(c: Column) -> Column:
    return (c == F.lower(c)) & (c != F.upper(c))


def is_title(c: Column) -> Column:
    return c.rlike(r"[\p{Lu}\p{Lt}]") & ~c.rlike(NOT_TITLE)


def title(c: Column) -> Column:
    """Title case where every run of letters starts a word (``O'Neil Mary-Jane``), unlike initcap."""
    runs = F.regexp_extract_all(c, F.lit(rf"([{_CASED}]+|[^{_CASED}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, capitalize), "")


def capitalize(c: Column) -> Column:
    """First character upper case, the rest lower case (ß becomes Ss)."""
    first = F.upper(F.substring(c, 1, 1))
    return F.concat(F.substring(first, 1, 1), F.lower(F.substring(first, 2, 9)), F.lower(F.substring(c, 2, 2147483647)))


def styled_title(c: Column, style: str = "apa") -> Column:
    """Title case by style: ``apa``, ``chicago``, ``sentence`` or anything else (capitalise all).

    Words are cut at whitespace and rejoined by single spaces; the parts of a hyphenated word are
    treated one by one. Acronyms, and words of 2-5 capitals, stay in capitals; the first and the
    last word are always capitalised.
    """
    words = F.split(collapse_spaces(c), " ")
    last = F.size(words) - 1

    def part(p: Column, i: Column) -> Column:
        up, low = F.upper(p), F.lower(p)
        keep_caps = up.isin(ACRONYMS) | (is_upper(p) & F.length(p).between(2, 5))
        edge = (i == 0) | (i == last)
        if style == "apa":
            inner = F.when(low.isin(SMALL_WORDS), low).otherwise(capitalize(p))
        elif style == "chicago":
            inner = F.when(low.isin(SMALL_WORDS) & (F.length(p) < 4), low).otherwise(capitalize(p))
        elif style == "sentence":
            inner = low
        else:
            inner = capitalize(p)
        return F.when(keep_caps, up).when(edge, capitalize(p)).otherwise(inner)

    def word(w: Column, i: Column) -> Column:
        return F.array_join(F.transform(F.split(w, "-"), lambda p: part(p, i)), "-")

    return F.when(is_blank(c), c).otherwise(F.array_join(F.transform(words, word), " "))


def java_regex(pattern: str) -> str:
    """Rewrite a Python ``re`` pattern for Java: named groups, and Unicode-aware classes."""
    out = re.sub(r"\(\?P<", "(?<", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", out)
    if re.search(r"\\[wWdDsSbB]", out):
        out = "(?U)" + out
    return out


def java_replacement(text: str) -> str:
    """Rewrite a Python replacement text (``\\1``, ``\\g<name>``) for Java."""
    out = text.replace("$", r"\$")
    out = re.sub(r"\\g<(\d+)>", r"$\1", out)
    out = re.sub(r"\\g<(\w+)>", r"${\1}", out)
    return re.sub(r"\\([1-9]\d?)", r"$\1", out)


def matches(c: Column, pattern: str) -> Column:
    """The pattern matches from the start of the text (it need not reach the end)."""
    return c.rlike("^(?:" + java_regex(pattern) + ")")


def contains(c: Column, pattern: str) -> Column:
    """The pattern matches anywhere in the text."""
    return c.rlike(java_regex(pattern))


def compact_key(c: Column, limit: int = 256) -> Column:
    """A text for grouping: itself when short, its SHA-256 when longer than ``limit`` bytes.

    Shuffles of long texts then carry 64 characters per row. Two different texts share a key only
    if SHA-256 collides.
    """
    return F.when(F.octet_length(c) > limit, F.concat(F.lit("\x00sha256:"), F.sha2(c, 256))).otherwise(c)
