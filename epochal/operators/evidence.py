"""Evidence operators: compatibility by operator (O156), assessment (O158), ordinal winners (O159), lists and spans of evidence.

Nothing is collected: windows are over the evidence of one question, everything else is a projection or a grouped aggregate.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from epochal.functions.intervals import after_score, before_score, near_miss

UNKNOWN, DEFAULT = 0.15, 0.5


def compatibility(rows: DataFrame, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Add ``compatibility`` to rows (qid, fact_id, operator, start, end, q_start, q_end); the peers of a fact are its question's rows.

    by: columns that tell questions apart; with what the rows are partitioned by among them, nothing is shuffled. All places come from
    running counts over one order, the latest fact first: one sort.

    A null q_start is a question without a date: only relative operators then tell facts apart. A null start is an unknown interval.
    """
    op, known, day = F.col("operator"), F.col("start").isNotNull(), F.col("q_start")
    dated = day.isNotNull()
    of = Window.partitionBy(*by)
    latest_first = of.orderBy(F.col("start").desc(), F.col("fact_id").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    eligible = known & F.coalesce(~dated | (F.col("start") <= day), F.lit(False))
    count = lambda flag, w: F.sum(flag.cast("int")).over(w)
    late, every = count(known, latest_first), count(known, of)
    recency = lambda flag, place: F.when(flag, F.greatest(F.lit(0.2), 1.0 - 0.25 * (place - 1))).otherwise(F.lit(0.0))  # noqa: E731  as relative_recency
    ordinal = lambda n: F.when(every < n, F.lit(0.4)).when(known & (late == n), F.lit(1.0)).otherwise(F.lit(0.25))  # noqa: E731  as relative_ordinal
    latest, first = recency(eligible, count(eligible, latest_first)), recency(known, every - late + 1)
    overlap = (F.col("start") <= F.col("q_end")) & (F.coalesce("end", F.lit("9999-12-31").cast("date")) >= day)
    contains = (F.col("start") <= day) & (F.coalesce("end", F.lit("9999-12-31").cast("date")) >= day)
    score = (
        F.when(~known, F.lit(UNKNOWN))
        .when(op.isin("during", "between") & dated & F.col("q_end").isNotNull(), overlap.cast("double"))
        .when(op.isin("current", "as_of", "effective") & dated, contains.cast("double"))
        .when(op.isin("previous", "before", "expired") & dated, F.coalesce(before_score(F.col("end"), day), F.lit(0.0)))
        .when(op.isin("next", "after") & dated, after_score(F.col("start"), day))
        .when(op.isin("latest", "last") | ((op == "current") & ~dated), latest)
        .when(op == "first", first)
        .when(op == "previous", ordinal(2))
        .when(op == "next", ordinal(1))
        .otherwise(F.lit(DEFAULT))
    )
    return rows.withColumn("compatibility", score)


def winners(rows: DataFrame, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Add ``selected``: whether the row is one of its question's ordinal winners (ties all win); null for other operators (O159)."""
    op, of = F.col("operator"), Window.partitionBy(*by)
    early = F.when(F.col("start") <= F.col("q_end"), F.col("start"))
    ended = F.when(F.col("end") < F.col("q_start"), F.col("end"))
    late = F.when(F.col("start") > F.col("q_end"), F.col("start"))
    wins = (
        F.when(op == "first", F.col("start") == F.min("start").over(of))
        .when(op.isin("latest", "last"), early == F.max(early).over(of))
        .when(op.isin("before", "expired", "previous"), ended == F.max(ended).over(of))
        .when(op.isin("after", "next"), late == F.min(late).over(of))
    )
    ordinal = op.isin("first", "latest", "last", "before", "expired", "previous", "after", "next")
    return rows.withColumn("selected", F.when(ordinal, F.coalesce(wins, F.lit(False))))


def assessed(rows: DataFrame, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Add exact, near, compatibility and status of every fact as evidence for its question (O158)."""
    w = winners(rows, by)
    op, s, e, a, b = (F.col(c) for c in ("operator", "start", "end", "q_start", "q_end"))
    last = F.coalesce(e, F.lit("9999-12-31").cast("date"))
    meets = (s <= b) & (last >= a)
    covered = (F.datediff(F.least(last, b), F.greatest(s, a)) + 1) / (F.datediff(b, a) + 1)
    share = F.when(~meets, F.lit(0.0)).when(op == "between", F.lit(1.0)).when(op == "during", covered).otherwise(((s <= a) & (last >= b)).cast("double"))
    exact = F.when(F.col("selected").isNotNull(), F.col("selected").cast("double")).otherwise((share == 1.0).cast("double"))
    apart = F.when(e < a, F.datediff(a, e)).when(s > b, F.datediff(s, b)).otherwise(0)
    gap = F.when(op.isin("before", "expired", "previous"), F.abs(F.datediff(a, e))).when(op == "first", 0).otherwise(F.abs(F.datediff(s, b)))
    near = F.when(F.col("selected").isNull(), F.when(meets, F.lit(0.0)).otherwise(near_miss(apart))).otherwise(F.when(exact == 1, F.lit(0.0)).otherwise(near_miss(gap)))
    known = s.isNotNull()
    status = F.when(~known, "unknown_valid_time").when(exact == 1, "valid").when(e < a, "stale").when(s > b, "future_invalid").otherwise("temporally_ambiguous")
    best = F.greatest(F.when(F.col("selected").isNull(), share).otherwise(exact), near)
    return w.withColumns({"exact": F.when(known, exact), "near": F.when(known, near), "compatibility": F.when(known, best), "status": status})


def evidence_union(rows: DataFrame, key: str, item: str, text: str, order: list[str]) -> DataFrame:
    """One row for each item of a key: its first text in order, and whether other texts are given for it (O087, O274)."""
    return rows.groupBy(key, item).agg(F.min_by(text, F.struct(*order)).alias(text), (F.min(text) != F.max(text)).alias("conflict"))


def claims_once(claims: DataFrame, by: list[str], first: str) -> DataFrame:
    """Claims that are equal in ``by`` (nulls equal nulls) once, with the smallest ``first`` (O090)."""
    return claims.groupBy(*by).agg(F.min(first).alias(first))


def overlapping(spans: Column, start: Column, end: Column) -> Column:
    """The spans (start, end, ...) that share a character with [start, end) (O042)."""
    return F.filter(spans, lambda s: (s["start"] < end) & (s["end"] > start))


def json_ids(json: Column, keys: tuple[str, ...]) -> Column:
    """Sorted distinct string values under the keys, at any depth of a JSON text (O138). Escapes in values are kept as written."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(json, F.lit(f'"(?:{"|".join(keys)})"\\s*:\\s*"((?:[^"\\\\]|\\\\.)*)"'), F.lit(1))))


@F.pandas_udf(StringType())
def _decomposed(x: pd.Series) -> pd.Series:
    return x.str.casefold().str.normalize("NFKD")


def folded(x: Column) -> Column:
    """Tokens of letters a-z and digits, without case and accents (O096). The only Python is the Unicode decomposition, by Arrow batch."""
    return F.regexp_extract_all(F.regexp_replace(_decomposed(x), "\\p{Mn}+", ""), F.lit("[a-z0-9]+"), F.lit(0))


def irrelevant(facts: DataFrame, used: DataFrame, group: str, item: str) -> DataFrame:
    """The smallest visible fact of each group that is not used (O047)."""
    return facts.join(used, [group, item], "left_anti").groupBy(group).agg(F.min(item).alias(item))


def path_valid(nodes: Column, edges: Column) -> Column:
    """Edges follow each other, and the node list is that of the edges (O176). edges: array of (source, target)."""
    linked = F.forall(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.element_at(edges, i)["target"] == F.element_at(edges, i + 1)["source"])
    walked = F.concat(F.array(F.element_at(edges, 1)["source"]), F.transform(edges, lambda e: e["target"]))
    return F.when(F.size(edges) == 0, F.size(nodes) <= 1).otherwise((F.when(F.size(edges) > 1, linked).otherwise(F.lit(True))) & (nodes == walked))
