"""Dates and temporal operators in question and claim texts (O110, O112, O116-O120)."""

from __future__ import annotations

import calendar
import datetime as dt
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, IntegerType, StringType, StructField, StructType

MONTHS = "January February March April May June July August September October November December".split()
_M = "|".join(MONTHS)
DATE = rf"\b(?:{_M})\s+\d{{1,2}},\s+\d{{4}}\b"

#: Fixed values: (marker, operator), the first marker found decides.
MARKERS = (
    ("immediately before", "previous"),
    ("previous", "previous"),
    ("immediately after", "next"),
    ("most recently expired", "expired"),
    ("expired", "expired"),
    ("between", "between"),
    ("during", "during"),
    (" before ", "before"),
    (" after ", "after"),
    ("first recorded", "first"),
    ("latest recorded", "latest"),
    ("effective on", "effective"),
    ("as of", "as_of"),
    ("currently", "current"),
    ("current", "current"),
    ("latest", "latest"),
    ("last", "last"),
)


def parse_intent(question: Column) -> Column:
    """struct<operator, query_start, query_end, confidence> of an English question, by built-ins only (O118).

    The date of an evidence snapshot is not part of the question.
    """
    text = F.regexp_replace(question, rf"(?i)\busing\s+the\s+evidence\s+snapshot\s+dated\s+{DATE}\s*,?\s*", "")
    low = F.lower(text)
    found = F.regexp_extract_all(text, F.lit(f"(?i){DATE}"), F.lit(0))
    days = F.transform(found, lambda d: F.try_to_date(F.initcap(F.regexp_replace(d, "\\s+", " ")), "MMMM d, yyyy"))
    op = F.lit("unknown")
    for marker, name in reversed(MARKERS):
        here = F.when(low.contains("current"), "current").otherwise(name) if marker == "as of" else F.lit(name)
        op = F.when(low.contains(marker), here).otherwise(op)
    n = F.size(days)
    op = F.when((op == "unknown") & (n > 0) & text.rlike(f"(?i)\\bon\\s+{DATE}"), "as_of").otherwise(op)
    sure = F.when(op.isin("during", "between") & (n < 2), "medium").when(op != "unknown", "high").when(n > 0, "medium").otherwise("low")
    start = F.get(days, F.lit(0))
    return F.struct(op.alias("operator"), start.alias("query_start"), F.coalesce(F.get(days, F.lit(1)), start).alias("query_end"), sure.alias("confidence"))


_MENTION = StructType([StructField("at", IntegerType()), StructField("lower", DateType()), StructField("upper", DateType()), StructField("granularity", StringType())])
_FORMS = (
    ("day", re.compile(r"\b(?P<y>\d{4})-(?P<m>\d{2})-(?P<d>\d{2})\b")),
    ("day", re.compile(rf"\b(?P<n>{_M})\s+(?P<d>\d{{1,2}}),?\s+(?P<y>\d{{4}})\b", re.I)),
    ("day", re.compile(rf"\b(?P<d>\d{{1,2}})\s+(?P<n>{_M})\s+(?P<y>\d{{4}})\b", re.I)),
    ("month", re.compile(rf"\b(?P<n>{_M})\s+(?P<y>\d{{4}})\b", re.I)),
    ("year", re.compile(r"\b(?P<y>1[5-9]\d{2}|20\d{2})\b")),
)


def mentions(text: str | None) -> list[dict]:
    """Date mentions in text order. Finer forms come first and keep their place, also where the date does not exist."""
    taken: list[tuple[int, int]] = []
    out = []
    for kind, form in _FORMS:
        for m in form.finditer(text or ""):
            if any(a < m.end() and m.start() < b for a, b in taken):
                continue
            taken.append(m.span())
            g = m.groupdict()
            year = int(g["y"])
            month = MONTHS.index(g["n"].capitalize()) + 1 if g.get("n") else int(g.get("m") or 1)
            try:
                low = dt.date(year, month, int(g.get("d") or 1))
            except ValueError:
                continue
            high = low if kind == "day" else dt.date(year, month, calendar.monthrange(year, month)[1]) if kind == "month" else dt.date(year, 12, 31)
            out.append({"at": m.start(), "lower": low, "upper": high, "granularity": kind})
    return sorted(out, key=lambda x: x["at"])


@F.pandas_udf(ArrayType(_MENTION))
def date_mentions(text: pd.Series) -> pd.Series:
    """array<struct<at, lower, upper, granularity>> (O116). Overlap suppression between forms needs a loop: Arrow batches."""
    return text.map(mentions)


#: Question phrase of each operator; {a} and {b} are the query's dates.
PHRASES = {
    "current": "What is current on {a}",
    "as_of": "What held as of {a}",
    "effective": "What was effective on {a}",
    "during": "What held during {a} to {b}",
    "between": "What held between {a} and {b}",
    "previous": "What was the previous state on {a}",
    "next": "What came immediately after {a}",
    "latest": "What was the latest state on {a}",
    "last": "What came last by {a}",
    "first": "What was first recorded",
    "before": "What ended before {a}",
    "expired": "What most recently expired by {a}",
    "after": "What began after {a}",
}


def question_text(operator: Column, start: Column, end: Column, about: Column) -> Column:
    """English question of a program (O110)."""
    day = lambda d: F.date_format(d, "MMMM d, yyyy")
    out = F.lit(None).cast("string")
    for name, phrase in PHRASES.items():
        a, _, rest = phrase.partition("{a}")
        b, _, tail = rest.partition("{b}")
        parts = [F.lit(a)] + ([day(start), F.lit(b)] if "{a}" in phrase else []) + ([day(end), F.lit(tail)] if "{b}" in phrase else [])
        out = F.when(operator == name, F.concat(*parts, F.lit(" for "), about, F.lit("?"))).otherwise(out)
    return out


def inline_handles(text: Column) -> Column:
    """Citation handles [E1], [E2, E3] of a text in order, distinct (O112)."""
    groups = F.regexp_extract_all(text, F.lit("\\[(E[0-9]+(?:\\s*,\\s*E[0-9]+)*)\\]"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.split(g, "\\s*,\\s*"))))


def strip_handles(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s*\\[E[0-9]+(?:\\s*,\\s*E[0-9]+)*\\]", ""))


def merge_handles(text: Column, handles: Column) -> Column:
    """The text without inline handles, then all of the handles once."""
    return F.when(F.size(handles) == 0, strip_handles(text)).otherwise(F.concat(strip_handles(text), F.lit(" ["), F.array_join(handles, ", "), F.lit("]")))


def source_date(year: Column, month: Column, day: Column, precision: Column, end: bool = False) -> Column:
    """A date of precision 9 (year), 10 (month) or 11 (day); the last day of the period for an end (O120)."""
    m = F.when(precision >= 10, month).otherwise(F.lit(12 if end else 1))
    first = F.make_date(year, m, F.when(precision >= 11, day).otherwise(F.lit(1)))
    return F.when(precision >= 11, first).when(precision >= 9, F.last_day(first) if end else first)
