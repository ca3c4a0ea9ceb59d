"""Dates as texts, and ids, of columns; no function depends on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values of the format
DAYS = ("Thu", "Fri", "Sat", "Sun", "Mon", "Tue", "Wed")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _two(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def _parts(seconds: Column) -> tuple[Column, Column, Column]:
    """(days since 1970, date, time of day as text)."""
    days = F.floor(seconds / 86400).cast("int")
    rest = F.pmod(seconds, F.lit(86400))
    clock = F.concat_ws(":", _two(F.floor(rest / 3600)), _two(F.floor(rest / 60) % 60), _two(rest % 60))
    return days, F.date_add(F.lit("1970-01-01").cast("date"), days), clock


def iso8601(seconds: Column) -> Column:
    """2024-01-07T00:00:00Z of whole seconds since 1970; null of null."""
    _, date, clock = _parts(seconds)
    return F.concat(date.cast("string"), F.lit("T"), clock, F.lit("Z"))


def http_date(seconds: Column) -> Column:
    """Sun, 07 Jan 2024 00:00:00 GMT of whole seconds since 1970; null of null."""
    days, date, clock = _parts(seconds)
    name = F.get(F.array(*map(F.lit, DAYS)), F.pmod(days, F.lit(7)))
    month = F.get(F.array(*map(F.lit, MONTHS)), F.month(date) - 1)
    return F.concat(name, F.lit(", "), _two(F.day(date)), F.lit(" "), month, F.lit(" "), F.lpad(F.year(date).cast("string"), 4, "0"), F.lit(" "), clock, F.lit(" GMT"))


def fresh_id(salt: str, number: Column) -> Column:
    """32 hex digits for each number; the same again when a lost task is run again, unlike uuid()."""
    return F.md5(F.concat_ws("-", F.lit(salt), number.cast("string")).cast("binary"))
