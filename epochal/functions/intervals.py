"""Closed date intervals as Column expressions (O041, O113-O115, O121, O122).

A null end is open; a null start or the type "unknown" never matches. All functions are built-ins only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FAR = "9999-12-31"


def upper(end: Column) -> Column:
    return F.coalesce(end, F.lit(FAR).cast("date"))


def contains(start: Column, end: Column, day: Column) -> Column:
    return F.coalesce((start <= day) & (day <= upper(end)), F.lit(False))


def overlaps(start: Column, end: Column, q_start: Column, q_end: Column) -> Column:
    return F.coalesce((start <= upper(q_end)) & (q_start <= upper(end)), F.lit(False))


def covers(start: Column, end: Column, q_start: Column, q_end: Column) -> Column:
    return F.coalesce((start <= q_start) & (upper(end) >= q_end), F.lit(False))


def years_between(earlier: Column, later: Column) -> Column:
    return F.greatest(F.datediff(later, earlier) / F.lit(365.25), F.lit(0.0))


def before_score(end: Column, day: Column) -> Column:
    """1 / (1 + years since the end); 0 if it has not ended before the day."""
    return F.when(end < day, 1.0 / (1.0 + years_between(end, day))).otherwise(0.0)


def after_score(start: Column, day: Column) -> Column:
    return F.when(start > day, 1.0 / (1.0 + years_between(day, start))).otherwise(0.0)


def near_miss(gap_days: Column) -> Column:
    return F.coalesce(0.25 * F.exp(-gap_days / F.lit(365.0)), F.lit(0.0))


def rendered(start: Column, end: Column) -> Column:
    """English text of an interval."""
    day = lambda d: F.date_format(d, "MMMM d, yyyy")
    return (
        F.when(start.isNull(), F.lit("unknown time"))
        .when(end.isNull(), F.concat(F.lit("since "), day(start)))
        .when(start == end, day(start))
        .otherwise(F.concat(F.lit("from "), day(start), F.lit(" to "), day(end)))
    )


def make_interval(start: Column, end: Column, granularity: str = "day") -> Column:
    kind = F.when(start.isNull(), "unknown").when(end.isNull(), "open").when(start == end, "point").otherwise("closed")
    return F.struct(kind.alias("type"), start.alias("start"), end.alias("end"), F.lit(granularity).alias("granularity"))


def lenient_date(text: Column) -> Column:
    """ISO date of a text, else null."""
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
