"""Text normalisation and content fingerprints."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: the characters Python treats as whitespace ---
_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000"
    + "".join(map(chr, range(0x2000, 0x200B)))
)
_ASCII_ONLY = "^[\\x00-\\x7F]*$"


@F.pandas_udf(T.StringType())
def _compatibility_form(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(T.StringType())
def _folded_address(values: pd.Series) -> pd.Series:
    return values.map(
        lambda v: unicodedata.normalize("NFKC", v).strip().casefold(), na_action="ignore"
    )


@F.pandas_udf(T.StringType())
def _casefold(values: pd.Series) -> pd.Series:
    return values.map(str.casefold, na_action="ignore")


def _native_if_ascii(column: Column, native: Column, unicode_udf) -> Column:
    """ASCII values stay in the JVM; only the others carry text to Python."""
    plain = column.rlike(_ASCII_ONLY)
    return F.when(plain, native).otherwise(unicode_udf(F.when(~plain, column)))


def strip(column: Column) -> Column:
    return F.btrim(column, F.lit(_SPACE))


def nfkc(column: Column) -> Column:
    return _native_if_ascii(column, column, _compatibility_form)


def casefold(column: Column) -> Column:
    return _native_if_ascii(column, F.lower(column), _casefold)


def canonical_address(column: Column) -> Column:
    """Compatibility form, trimmed, case-folded."""
    return _native_if_ascii(column, F.lower(strip(column)), _folded_address)


def canonical_text(column: Column) -> Column:
    """Compatibility form, LF line ends, no trailing blanks per line, outer trim; case kept."""
    text = F.regexp_replace(nfkc(column), "\r\n?", "\n")
    # the look-behind keeps long runs of blanks linear
    text = F.regexp_replace(text, "(?<![ \\t])[ \\t]++(?=\\n|\\z)", "")
    return strip(text)


def digits(column: Column) -> Column:
    """Only the digits (of any script); nothing left means unknown."""
    return F.nullif(F.regexp_replace(column, "(?U)\\D", ""), F.lit(""))


def email_fingerprint(sender: Column, subject: Column, body: Column) -> Column:
    mark = F.lit("\x00")
    payload = F.concat(
        F.lit("email:v1"), mark, canonical_address(sender), mark, canonical_text(subject), mark,
        canonical_text(body),
    )
    return F.sha2(payload, 256)


def audio_fingerprint(content: Column) -> Column:
    return F.sha2(F.concat(F.encode(F.lit("audio-bytes:v1\x00"), "UTF-8"), content), 256)


def strip_nul(json_text: Column) -> Column:
    """Drop escaped U+0000 from JSON text; an escaped backslash before ``u0000`` stays."""
    return F.regexp_replace(json_text, r"(?<!\\)((?:\\\\)*)((?:\\u0000)+)", "$1")


def icontains(column: Column, needle: str | Column) -> Column:
    """Case-insensitive contains; a NULL column never matches."""
    wanted = F.lit(needle) if isinstance(needle, str) else needle
    return F.coalesce(F.contains(F.upper(column), F.upper(wanted)), F.lit(False))


def nth_occurrence(haystack: Column, needle: Column, occurrence: Column) -> Column:
    """0-based code-point offset of the n-th match; matches may overlap; NULL when absent.

    A value of NULL means the search has ended, so the fold never wraps to the start. A request
    for more matches than the text has characters is answered without searching.
    """
    possible = occurrence.between(1, F.char_length(haystack))
    found = F.aggregate(
        F.sequence(F.lit(1), F.when(possible, occurrence).otherwise(F.lit(1)).cast("int")),
        F.lit(0),
        lambda at, _: F.nullif(
            F.call_function("locate", needle, haystack, at + F.lit(1)), F.lit(0)
        ),
    )
    return F.when(possible, found - 1)
