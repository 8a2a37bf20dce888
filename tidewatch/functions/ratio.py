"""Values with their status: blank is not zero, and no denominator means no value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AVAILABLE, NO_DENOMINATOR, NO_DATA = "available", "unavailable_no_denominator", "unavailable_insufficient_data"


def ratio(numerator: Column, denominator: Column, places: int = 6) -> Column:
    """The quotient, half-even, or null without a numerator or a positive denominator."""
    return F.when(denominator > 0, F.bround(numerator.cast("double") / F.nullif(denominator, F.lit(0)).cast("double"), places))


def ratio_status(numerator: Column, denominator: Column) -> Column:
    return F.when((denominator > 0) & numerator.isNotNull(), AVAILABLE).otherwise(NO_DENOMINATOR)


def count_status(total: Column) -> Column:
    return F.when(total.isNull(), NO_DATA).otherwise(AVAILABLE)


def blank_sum(value: Column) -> Column:
    """The sum of reported cells; null if all are blank. A reported 0 counts."""
    return F.sum(value)


def blanks(value: Column) -> Column:
    return F.count_if(value.isNull())


def distinct_where(condition: Column, key: Column) -> Column:
    """Distinct keys among rows that meet the condition."""
    return F.count_distinct(F.when(condition, key))


SQL_RATIO = "CASE WHEN ({d}) > 0 THEN round_even(CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE), {p}) END"
SQL_STATUS = "CASE WHEN ({d}) > 0 AND ({n}) IS NOT NULL THEN 'available' ELSE 'unavailable_no_denominator' END"


def sql_ratio(n: str, d: str, places: int = 6) -> str:
    return SQL_RATIO.format(n=n, d=d, p=places)


def sql_status(n: str, d: str) -> str:
    return SQL_STATUS.format(n=n, d=d)
