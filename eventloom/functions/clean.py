"""Cleaning and normalising of single values.  Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient_double(x: Column) -> Column:
    """A number, or null where the text is none; NaN counts as null."""
    value = x.try_cast("double")
    return F.when(~F.isnan(value), value)


def lenient_date(x: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """A date by one fixed pattern, or null."""
    return F.try_to_date(x.cast("string"), pattern) if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(x.cast("string"), F.lit(pattern)))


def finite(x: Column) -> Column:
    """Whether a number is neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def pad_code(x: Column, width: int = 4) -> Column:
    """Zeros on the left up to width, after a sign if there is one; longer texts stay whole."""
    signed = x.rlike("^[+-]")
    body, sign = F.when(signed, F.substring(x, 2, 1 << 20)).otherwise(x), F.when(signed, F.substring(x, 1, 1)).otherwise(F.lit(""))
    room = F.when(signed, width - 1).otherwise(width)
    return F.concat(sign, F.when(F.length(body) < room, F.lpad(body, width, "0").substr(F.lit(1) + width - room, F.lit(width))).otherwise(body))


def trimmed(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"^[\s　]+", ""), r"[\s　]+$", "")


def securities_code(x: Column) -> Column:
    """A listed code from a five-digit securities code: '.0' and one trailing zero go, then four digits ('13010.0' is '1301')."""
    text = F.regexp_replace(trimmed(x.cast("string")), r"\.0$", "")
    return pad_code(F.regexp_replace(text, "0$", ""))


def lookup_code(x: Column) -> Column:
    """A code for lookups: blanks and -_. go, then all trailing zeros, then four digits; so '7200' and '0072' are one."""
    text = F.translate(trimmed(x.cast("string")), "　 -_.", "")
    return pad_code(F.regexp_replace(text, "0+$", ""))


def first_four_digits(x: Column) -> Column:
    """The first run of four digits, or null."""
    return F.regexp_substr(x.cast("string"), F.lit(r"\d{4}"))


def posix_path(x: Column, prefix: str, replacement: str) -> Column:
    """A path with one prefix replaced and slashes in place of backslashes."""
    return F.replace(F.replace(x, F.lit(prefix), F.lit(replacement)), F.lit("\\"), F.lit("/"))
