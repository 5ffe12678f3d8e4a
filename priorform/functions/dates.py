"""Dates and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from priorform.functions.rates import col


def day_number(ts: Column | str) -> Column:
    """Days since 1970-01-01 of a date or date-time; the ordering key of every day frame."""
    return F.unix_date(F.to_date(col(ts)))


def season(ts: Column | str) -> Column:
    """Calendar year of a date or date-time."""
    return F.year(F.to_date(col(ts)))


def season_text(ts: Column | str) -> Column:
    """Year as text: what precedes the first dash."""
    return F.substring_index(F.to_date(col(ts)).cast("string"), "-", 1)


def first_words(text: Column | str, n: int = 2) -> Column:
    """The first ``n`` space-separated words."""
    return F.substring_index(col(text), " ", n)


def exponent_text(x: Column | str, digits: int = 6) -> Column:
    """Scientific notation as text, for report output."""
    return F.format_string(f"%.{digits}e", col(x).cast("double"))
