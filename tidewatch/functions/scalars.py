"""Scalar rules on columns: text, names, codes, counts, dates, ages, bands, hashes and rings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the columns as text, by name, in compact JSON."""
    return F.sha2(F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in sorted(columns)))), 256)


def collapsed(text: Column, limit: int | None = None) -> Column:
    """White space collapsed and trimmed, empty as null; cut to a length for a column that holds no more."""
    x = F.trim(F.regexp_replace(text, r"\s+", " "))
    x = x if limit is None else F.left(x, F.lit(limit))
    return F.when(x != "", x)


#: Letters with marks and their plain ones.
MARKED, PLAIN = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "AAAAAACEEEEIIIINOOOOOUUUUY"


def place_name(raw: Column) -> Column:
    """Upper case without marks, parentheses and punctuation, blanks collapsed."""
    x = F.regexp_replace(F.translate(F.upper(raw), MARKED, PLAIN), r"\([^)]*\)", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, "[^A-Z0-9 ]", " "), " +", " "))


def place_kind(name: Column) -> Column:
    return F.when(name.endswith(" TOWN COUNCIL"), "town_council").when(name.endswith(" MUNICIPALITY"), "municipality").when(name.endswith(" DIVISION"), "division").otherwise("subcounty")


def code_parts(code: Column) -> Column:
    """A code padded to six digits and its prefixes of region, district, county and subcounty."""
    x = F.lpad(code, 6, "0")
    return F.struct(x.alias("code"), *(F.substring(x, 1, n).alias(k) for k, n in (("region", 1), ("district", 3), ("county", 4), ("subcounty", 6))))


def option(raw: Column) -> Column:
    """Case and dashes folded."""
    return F.trim(F.lower(F.translate(raw, "‐‑‒–—", "-----")))


def test_method(raw: Column) -> Column:
    x = option(raw)
    return F.when(x.contains("rdt"), "rdt").when(x.contains("microscopy") | x.endswith(" bs"), "microscopy")


def strict_count(raw: Column) -> Column:
    """A whole number of zero or more, else null."""
    x = F.trim(raw)
    return F.when(x.rlike(r"^[0-9]{1,18}(\.0*)?$"), F.regexp_extract(x, "^[0-9]{1,18}", 0).cast("bigint"))


def local_day(ts: Column, zone: str = "Africa/Kampala") -> Column:
    """The calendar day of a moment in a zone."""
    return F.from_utc_timestamp(ts.cast("timestamp"), zone).cast("date")


def age_days(value: Column, unit: Column) -> Column:
    return F.when(unit == "years", value * 365).when(unit == "months", value * 30).when(unit == "days", value)


def age_group(days: Column) -> Column:
    return F.when(days < 5 * 365, "under_5").when(days < 15 * 365, "5_to_14").when(days.isNotNull(), "15_and_over")


def ring_area(points: Column) -> Column:
    """The signed area of a closed ring, an array of x, y, by the shoelace rule; null below four points."""
    turns = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points) - 1), lambda a, b: a.x * b.y - b.x * a.y)
    closed = (F.size(points) >= 4) & (F.element_at(points, 1) == F.element_at(points, -1))
    return F.when(closed, F.aggregate(turns, F.lit(0.0), lambda s, t: s + t) / 2)


def csv_safe(text: Column) -> Column:
    """Text that no spreadsheet takes for a formula."""
    return F.regexp_replace(text, r"^([=+\-@\t\r])", "'$1")


def test_outcome(raw: Column) -> Column:
    """positive, negative, not_recorded for a blank, unmapped for anything else."""
    x = option(F.coalesce(raw, F.lit("")))
    return F.when(x == "", "not_recorded").when(x.isin("positive", "negative"), x).otherwise("unmapped")
