"""Dates and times in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats, tried in this order; single letters also take unpadded numbers.
FORMATS = ("y-M-d H:m:s", "y-M-d H:m", "y-M-d", "y/M/d H:m:s", "y/M/d")


def parse_datetime(c: Column) -> Column:
    """timestamp_ntz of the first format that fits, then of ISO text; null otherwise."""
    t = F.trim(c)
    slash, colon = t.contains("/"), t.contains(":")
    # a format that cannot fit is not tried: failing is slow
    parsed = [F.when((slash if "/" in f else ~slash) & (colon if ":" in f else ~colon), F.try_to_timestamp(t, F.lit(f))) for f in FORMATS]
    return F.when(t != "", F.coalesce(*parsed, t.try_cast("timestamp"))).cast("timestamp_ntz")


def day_delta(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a.cast("date"), b.cast("date")))


def compact_date(c: Column) -> Column:
    """Eight digits as a date text; other texts unchanged."""
    d = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(d) == 8, F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))).otherwise(c)


def extract_date(c: Column) -> Column:
    """The first whole 20YY-MM-DD or 20YY/MM/DD, with dashes; else the empty text."""
    return F.replace(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?U)\b(20[0-9]{2}[-/][0-9]{2}[-/][0-9]{2})\b", 1), F.lit("/"), F.lit("-"))


# Dates with times in lines of text, with and without a year.
FULL = r"(20[0-9]{2})[-/年.]([0-9]{1,2})[-/月.]([0-9]{1,2})日?\s*([0-9]{1,2})[:：]([0-9]{2})(?:[:：]([0-9]{2}))?"
PARTIAL = r"([0-9]{1,2})[-/月.]([0-9]{1,2})日?\s*([0-9]{1,2})[:：]([0-9]{2})(?:[:：]([0-9]{2}))?"


def extract_datetime(line: Column, year: Column) -> Column:
    """A full date and time, else month and day with the year given; zero-padded, or the empty text."""

    def part(pattern: str, group: int) -> Column:
        g = F.regexp_extract(line, pattern, group)
        return F.lpad(F.when(g == "", "00").otherwise(g), 2, "0")

    def clock(pattern: str, first: int) -> Column:
        return F.concat_ws(":", *[part(pattern, first + i) for i in range(3)])

    full = F.concat(F.concat_ws("-", F.regexp_extract(line, FULL, 1), part(FULL, 2), part(FULL, 3)), F.lit(" "), clock(FULL, 4))
    partial = F.concat(F.concat_ws("-", year.cast("string"), part(PARTIAL, 1), part(PARTIAL, 2)), F.lit(" "), clock(PARTIAL, 3))
    return F.when(line.rlike(FULL), full).when(line.rlike(PARTIAL), partial).otherwise("")


def ledger_date(c: Column) -> Column:
    """The first ten characters if they are a date."""
    t = F.substring(c, 1, 10)
    return F.when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), t.try_cast("date"))
