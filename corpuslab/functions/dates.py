"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_FIRST = "d-M-yyyy"


def parse_day_first(value: Column, lenient: bool = False) -> Column:
    """``dd-mm-yyyy`` text as a date; with ``lenient`` a malformed value becomes null."""
    if lenient:
        return F.try_to_date(value, DAY_FIRST)
    return F.to_date(value, DAY_FIRST)


def year_quarter(date: Column) -> Column:
    """Label such as ``2021-Q3``."""
    return F.concat(F.year(date).cast("string"), F.lit("-Q"), F.quarter(date).cast("string"))


def quarter_starts(first: Column, last: Column, include_partial: bool = False) -> Column:
    """First days of the quarters between two dates.

    A quarter that is not over at ``last`` is left out unless ``include_partial`` is set. The
    result is an empty array if no quarter is left.
    """
    lowest = F.trunc(first, "quarter")
    if include_partial:
        highest = F.trunc(last, "quarter")
    else:
        highest = F.add_months(F.trunc(F.date_add(last, 1), "quarter"), -3)
    return F.when(
        highest >= lowest, F.sequence(lowest, highest, F.expr("interval 3 months"))
    ).otherwise(F.array().cast("array<date>"))


def whole_months(first: Column, last: Column) -> Column:
    """Number of whole calendar months from ``first`` to ``last``."""
    months = (F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first)
    return F.when(F.add_months(first, months) > last, months - 1).otherwise(months)
