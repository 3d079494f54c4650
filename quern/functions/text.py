"""Scalar text functions as Column expressions (JVM side, inside whole-stage code generation)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Code points of the search normalisation (Java and RE2 escapes).
ZERO_WIDTH = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}\x{FEFF}]"
QURANIC_MARKS = r"[\x{06DD}\x{06DE}\x{06E9}\x{FD3E}\x{FD3F}]"
DIACRITICS = r"[\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}\x{0640}]"
FOLD_FROM, FOLD_TO = "آأإٱىةؤئ", "اااايهوي"
DIGITS_FROM = "".join(chr(0x660 + i) for i in range(10)) + "".join(chr(0x6F0 + i) for i in range(10))
DIGITS_TO = "0123456789" * 2
# All that the search normalisation removes or replaces.
FOLDED = r"[\x{0600}-\x{06FF}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}\x{FEFF}\x{FD3E}\x{FD3F}]"
ARABIC_SCRIPT = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"
ARABIC_BLOCK = r"[\x{0600}-\x{06FF}]"
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SENTENCE_END = r"(?<=[.\x{061F}!\x{061B}\x{06D4}:\x{060C}])\s+"


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition, which no built-in function offers; text that is composed already passes unchanged."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def let(value: Column, f) -> Column:
    """f(value) with value computed once for a row, also where f uses it in a lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def sub(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def squeeze(c: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(sub(c, SPACE + "+", " "))


def ascii_only(c: Column) -> Column:
    return F.length(c) == F.octet_length(c)


def trimmed(c: Column) -> Column:
    """No white space at the ends, line breaks and tabs included; a text without is not searched for it."""
    ends = F.concat(F.left(c, F.lit(1)), F.right(c, F.lit(1)))
    return F.when(ends.rlike(SPACE), sub(c, f"^{SPACE}+|{SPACE}+$")).otherwise(c)


def normalize_arabic(c: Column, composed: bool = False) -> Column:
    """Search form of a text; idempotent, '' for null. composed: the input is known to be in NFC."""
    c = F.coalesce(c, F.lit(""))
    if not composed:
        # Python gets only what may change: ASCII is composed.
        c = F.coalesce(nfc(F.when(~ascii_only(c), c)), c)
    folded = sub(sub(sub(c, ZERO_WIDTH), QURANIC_MARKS, " "), DIACRITICS)
    folded = F.translate(F.translate(folded, FOLD_FROM, FOLD_TO), DIGITS_FROM, DIGITS_TO)
    return squeeze(F.when(ascii_only(c), c).when(c.rlike(FOLDED), folded).otherwise(c))


def has_arabic(c: Column) -> Column:
    return F.coalesce(c.rlike(ARABIC_SCRIPT), F.lit(False))


def normalize_query(c: Column) -> Column:
    c = sub(nfc(F.coalesce(c, F.lit(""))), ZERO_WIDTH)
    return F.when(has_arabic(c), normalize_arabic(c)).otherwise(squeeze(c))


def words(c: Column) -> Column:
    """Words for linkage: all but letters, digits and _ of the search form separates."""
    return F.filter(F.split(sub(c, r"[^\p{L}\p{N}_]+", " "), " "), lambda w: w != "")


def quote_words(c: Column) -> Column:
    """Words for quotes: lower case, other characters deleted (not turned to spaces), one space between."""
    return squeeze(sub(F.lower(c), r"[^\p{L}\p{N}\s]", ""))


def database_words(c: Column) -> Column:
    """As ``quote_words``, but a space at either end stays: what the database's own expression compares."""
    return sub(sub(F.lower(c), r"[^\p{L}\p{N}\s]"), r"\s+", " ")


def iso_time(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def trigrams(c: Column) -> Column:
    """Distinct trigrams of each word padded with two spaces before and one after."""
    padded = F.transform(F.filter(F.split(sub(F.lower(c), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != ""), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two arrays of distinct members; 0 when both are empty."""
    both = F.size(F.array_intersect(a, b))
    return both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1))


def similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def stub_tokens(c: Column) -> Column:
    """Distinct tokens of [a-z0-9] longer than two characters."""
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) > 2))


def estimate_tokens(c: Column) -> Column:
    arabic = F.when(ascii_only(c), F.lit(0)).otherwise(F.length(c) - F.length(sub(c, ARABIC_BLOCK)))
    return (F.lit(0.35) * arabic + F.lit(0.25) * (F.length(c) - arabic)).cast("int") + 1


def sentences(c: Column) -> Column:
    """Split after sentence marks (Latin and Arabic, not the ASCII question mark) before white space."""
    return F.split(c, SENTENCE_END)


def effective_ref(chunk_ref: Column, document_ref: Column) -> Column:
    """The chunk's own reference where it has one: the empty string means none."""
    return F.coalesce(F.nullif(chunk_ref, F.lit("")), document_ref)


def chapter_level(chunk_ref: Column) -> Column:
    return (chunk_ref != "") & (F.instr(chunk_ref, ":") == 0)


def passage(document_text: Column, content: Column, marker: str = "\n\nArabic:\n") -> Column:
    at = F.instr(content, marker)
    return F.coalesce(document_text, F.when(at > 0, content.substr(at + len(marker), F.length(content))).otherwise(content))


def markers(c: Column) -> Column:
    """Distinct numbers in [n] marks."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int")))


def stem(c: Column) -> Column:
    """Audit stemmer: a few suffixes, doubled last letters and a last e."""
    return sub(sub(sub(sub(c, "(ies)$", "y"), "(ing|ed|es|s)$"), "(.)\\1$", "$1"), "e$")
