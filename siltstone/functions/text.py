"""Text functions: query normalization, whitespace, trigrams, snippets, Unicode forms and UTF-8 truncation."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.errors import EngineError

MIN_QUERY, MAX_QUERY = 3, 256


def normalize_query(query: str) -> str:
    """Unicode white space collapsed and trimmed; 3 to 256 code points, no control characters."""
    q = " ".join(query.split())
    if not q:
        raise EngineError("search_query_empty")
    if len(q) < MIN_QUERY:
        raise EngineError("search_query_too_short")
    if len(q) > MAX_QUERY:
        raise EngineError("search_query_too_long")
    if any(unicodedata.category(c) == "Cc" for c in q):
        raise EngineError("search_query_invalid")
    return q


def normalize_extension(extension: str) -> str:
    """Trimmed, one leading dot removed, ASCII lower case, 1 to 16 of a-z and 0-9."""
    e = extension.strip().removeprefix(".").lower()
    if not re.fullmatch("[a-z0-9]{1,16}", e):
        raise EngineError("search_extension_invalid")
    return e


def collapse_whitespace(c: Column) -> Column:
    """Runs of Unicode white space become one space, then both ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def trigrams(c: Column) -> Column:
    """The distinct lower-case trigrams of a text; none for texts of under three characters."""
    # characters as an array bound once: substrings of a text are found by counting characters from its start
    chars = F.transform(F.array(F.split(F.lower(c), "")), lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - 3), lambda i: F.concat(F.get(x, i), F.get(x, i + 1), F.get(x, i + 2))))
    return F.when(F.char_length(F.lower(c)) >= 3, F.array_distinct(F.get(chars, F.lit(0)))).otherwise(F.array().cast("array<string>"))


def occurrences(text: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of a phrase, case-insensitively."""
    low = F.lower(text)
    return ((F.char_length(low) - F.char_length(F.replace(low, F.lit(phrase.lower()), F.lit("")))) / len(phrase.lower())).cast("long")


def snippet(text: Column, phrase: str, before: int = 24, after: int = 40) -> Column:
    """Bounded text around the first hit, the hit in square brackets."""
    at, n = F.locate(phrase.lower(), F.lower(text)), len(phrase)
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.concat(F.substring(text, start, at - start), F.lit("["), F.substring(text, at, F.lit(n)), F.lit("]"), F.substring(text, at + n, F.lit(after))))


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode normalization form C, which Spark has no function for."""
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def version_component(s: pd.Series) -> pd.Series:
    """NFC, lower case, NFC again."""
    return s.map(lambda x: unicodedata.normalize("NFC", unicodedata.normalize("NFC", x).lower()), na_action="ignore")


@F.pandas_udf(T.StringType())
def evaluation_text(s: pd.Series) -> pd.Series:
    """NFC with white space collapsed: the form in which recognized text is compared."""
    return s.map(lambda x: " ".join(unicodedata.normalize("NFC", x).split()), na_action="ignore")


def cut_utf8(text: str, limit: int) -> str:
    """The longest prefix of at most so many UTF-8 bytes that ends between characters."""
    return text.encode()[:limit].decode("utf-8", "ignore")


def truncate_utf8(c: Column, limit: int) -> Column:
    """Column form of :func:`cut_utf8`; short texts never leave the JVM's representation."""

    @F.pandas_udf(T.StringType())
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda x: cut_utf8(x, limit), na_action="ignore")

    return cut(c)


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def identifier_valid(c: Column) -> Column:
    """1 to 128 of letters, digits, dot, underscore and hyphen."""
    return c.rlike(r"^[A-Za-z0-9._-]{1,128}\z")


def sha256_valid(c: Column) -> Column:
    return c.rlike(r"^[0-9a-f]{64}\z")


def char_error_edits(expected: Column, recognized: Column) -> Column:
    """Levenshtein distance in code points."""
    return F.levenshtein(expected, recognized).cast("long")


def token_error_edits(expected: Column, recognized: Column) -> Column:
    """Levenshtein distance in white-space tokens: each distinct token of the pair stands for one character
    beyond the basic plane, of which there are a million."""
    words = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    a, b = words(expected), words(recognized)
    known = F.array_distinct(F.concat(a, b))
    coded = lambda ws: F.array_join(F.transform(ws, lambda x: F.decode(F.unhex(F.lpad(F.hex(F.lit(0x10000) + F.array_position(known, x)), 8, "0")), "UTF-32")), "")
    return F.levenshtein(coded(a), coded(b)).cast("long")
