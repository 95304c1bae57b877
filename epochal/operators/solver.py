"""Temporal operators over facts (O023-O025, O040, O070-O072, O092, O143-O155, O163-O165)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epochal.functions.intervals import contains, covers, overlaps, upper

POINT = ("current", "as_of", "effective")


def matching(facts: DataFrame, programs: DataFrame) -> DataFrame:
    """Programs joined to the visible facts they ask about (O023, O024).

    Programs with a context join on (relation, context); a null context or object is a wildcard, and such programs join on
    the relation only.
    """
    (bound, _), (free, _) = _matched(facts, programs)
    return bound.unionByName(free)


def _matched(facts: DataFrame, programs: DataFrame) -> list[tuple[DataFrame, tuple[str, ...]]]:
    """As matching, for programs with a context and for those without: rows, and columns that tell programs apart.

    The first are partitioned by the join as windows over these columns need it; a union would lose that.
    """
    f = facts.withColumnRenamed("snapshot_rank", "fact_rank").withColumnRenamed("relation", "f_relation").withColumnRenamed("context_id", "f_context")
    same = F.col("relation") == F.col("f_relation")
    bound = programs.where("context_id IS NOT NULL").join(f, same & (F.col("context_id") == F.col("f_context")))
    free = programs.where("context_id IS NULL").join(f, same).withColumn("context_id", F.col("f_context"))
    seen = (F.col("fact_rank") <= F.col("snapshot_rank")) & (F.col("object_id").isNull() | (F.col("object_id") == F.col("answer_id")))
    return [(x.where(seen).drop("f_relation", "fact_rank", "f_context"), by) for x, by in ((bound, ("relation", "context_id", "qid")), (free, ("qid",)))]


def solve(facts: DataFrame, programs: DataFrame) -> DataFrame:
    """Rows (qid, operator, context_id, fact_id, answer_id, start, end) that answer each program (O143).

    Two windows over the partitioning of the join: no shuffle but the join's, unless programs name no context. Ties of the latest or
    earliest bound are kept.
    """
    bound, free = (_chosen(m, by).where("__chosen").select("qid", "operator", "context_id", "fact_id", "answer_id", "start", "end") for m, by in _matched(facts, programs))
    return bound.unionByName(free)


def _chosen(m: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Adds ``__chosen``: whether the fact answers its program."""
    q, start, end, op = F.col("q_start"), F.col("start"), F.col("end"), F.col("operator")
    w = Window.partitionBy(*by)
    now = contains(start, end, q)
    bounded = now & end.isNotNull()
    least = lambda flag: F.min(F.when(flag, F.col("answer_id"))).over(w)
    most = lambda flag: F.max(F.when(flag, F.col("answer_id"))).over(w)
    m = m.select(  # whether there is no answer, one, or more: by the least and the most of them
        "*", (least(now) == most(now)).alias("one_now"), F.min(F.when(now, start)).over(w).alias("now_start"),
        (least(bounded) == most(bounded)).alias("one_bounded"), F.max(F.when(bounded, end)).over(w).alias("now_end"),
    )
    after_now = F.when(F.col("one_bounded").isNull(), start > q).otherwise(F.col("one_bounded") & (start > F.col("now_end")))
    candidate = (
        F.when(op.isin(*POINT), now)
        .when(op == "during", covers(start, end, q, F.col("q_end")))
        .when(op == "between", overlaps(start, end, q, F.col("q_end")))
        .when(op == "previous", F.col("one_now") & (end < F.col("now_start")))
        .when(op == "next", after_now)
        .when(op.isin("latest", "last"), start <= q)
        .when(op == "first", start.isNotNull())
        .when(op.isin("before", "expired"), end < q)
        .when(op == "after", start > q)
        .otherwise(False)
    )
    m = m.withColumn("__c", F.coalesce(candidate, F.lit(False)))
    of = lambda x: F.when(F.col("__c"), x)
    keep = (
        F.when(op.isin("previous", "before", "expired"), end == F.max(of(end)).over(w))
        .when(op.isin("latest", "last"), start == F.max(of(start)).over(w))
        .when(op.isin("next", "after", "first"), start == F.min(of(start)).over(w))
        .otherwise(True)
    )
    return m.withColumn("__chosen", F.col("__c") & keep).drop("__c", "one_now", "now_start", "one_bounded", "now_end")


def answers(solved: DataFrame) -> DataFrame:
    """One row per answered program: sorted distinct answers and the evidence."""
    return solved.groupBy("qid", "operator").agg(
        F.array_sort(F.collect_set("answer_id")).alias("answers"), F.array_sort(F.collect_set("fact_id")).alias("evidence")
    )


def time_status(facts: DataFrame, programs: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """Status of every visible fact of a program, relative to its operator (O154). selected: (qid, fact_id) answers."""
    m = matching(facts, programs)
    if selected is None:
        return _status(m, F.lit(False), "valid")
    m = m.join(selected.select("qid", "fact_id").distinct().withColumn("__chosen", F.lit(True)), ["qid", "fact_id"], "left")
    return _status(m, F.coalesce(F.col("__chosen"), F.lit(False)), "temporally_ambiguous")


def solved_status(facts: DataFrame, programs: DataFrame) -> DataFrame:
    """time_status with the answers of ``solve``, which windows over the one join mark; nothing is joined again."""
    of_fact = lambda by: F.max("__chosen").over(Window.partitionBy(*by, "fact_id"))
    bound, free = (_status(_chosen(m, by).withColumn("__chosen", of_fact(by)), F.col("__chosen"), "temporally_ambiguous").drop("__chosen") for m, by in _matched(facts, programs))
    return bound.unionByName(free)


def _status(m: DataFrame, chosen: Column, over: str) -> DataFrame:
    op, q, start, end = F.col("operator"), F.col("q_start"), F.col("start"), F.col("end")
    q_end = F.coalesce("q_end", "q_start")
    late = F.when(start > q, "future_invalid").otherwise("stale")
    return m.withColumn(
        "status",
        F.when(F.col("time_type") == "unknown", "unknown_valid_time")
        .when(chosen, "valid")
        .when(op.isin("during", "between") & overlaps(start, end, q, F.col("q_end")), F.lit(over))
        .when(op.isin(*POINT) & contains(start, end, q), "valid")
        .when(op.isin("first", "next", "after", "latest", "last"), late)
        .when(op.isin("previous", "before", "expired"), F.when(end < q, "stale").otherwise("future_invalid"))
        .when(end < q, "stale")
        .when(start > q_end, "future_invalid")
        .otherwise("temporally_ambiguous"),
    )


def path_status(edges: Column, q_start: Column, q_end: Column, sequence: bool = False) -> Column:
    """Coherence of an array of edges struct<start,end,time_type> (O155)."""
    unknown = F.exists(edges, lambda e: (e["time_type"] == "unknown") | e["start"].isNull())
    touches = F.exists(edges, lambda e: overlaps(e["start"], e["end"], q_start, q_end))
    if sequence:
        pairs = F.zip_with(edges, F.slice(edges, 2, F.greatest(F.size(edges) - 1, F.lit(0))), lambda a, b: b["start"] >= F.coalesce(a["end"], a["start"]))
        ordered = F.forall(pairs, lambda x: F.coalesce(x, F.lit(True)))
        fine = F.when(~ordered, "wrong_order").when(q_start.isNotNull() & ~touches, "incoherent_query_time").otherwise("coherent_sequence")
    else:
        low = F.array_max(F.transform(edges, lambda e: e["start"]))
        high = F.array_min(F.transform(edges, lambda e: upper(e["end"])))
        fine = (
            F.when(low > high, "incoherent_empty_intersection")
            .when(q_start.isNotNull() & ~overlaps(low, high, q_start, q_end), "incoherent_query_time")
            .otherwise("coherent_shared_interval")
        )
    return F.when(F.size(edges) == 0, "not_applicable").when(unknown, "unknown_edge_time").otherwise(fine)


def snapshot_delta(facts: DataFrame) -> DataFrame:
    """Facts of each context that the second snapshot adds to the first, and the answers it is new for (O092)."""
    view = lambda r: F.collect_set(F.when(F.col("snapshot_rank") <= r, F.col("fact_id")))
    g = facts.groupBy("context_id").agg(view(0).alias("s0"), view(1).alias("s1"))
    return g.select("context_id", F.size(F.array_except("s1", "s0")).alias("added"), F.size(F.array_except("s0", "s1")).alias("removed"), F.size("s1").alias("n_s1"))


def adjacent_pairs(facts: DataFrame) -> DataFrame:
    """Consecutive facts of a context, by (start, fact_id) (O040, O072)."""
    w = Window.partitionBy("context_id").orderBy("start", "fact_id")
    nxt = F.lead(F.struct("fact_id", "start", "answer_id")).over(w)
    pairs = facts.where("start IS NOT NULL").withColumn("n", nxt).where("n IS NOT NULL")
    return pairs.select(
        "context_id", "fact_id", F.col("n.fact_id").alias("next_fact_id"), F.datediff("n.start", "start").alias("gap_days"),
        (F.col("n.answer_id") != F.col("answer_id")).alias("answer_changed"), (F.col("n.start") <= upper(F.col("end"))).alias("still_valid"),
    )


def unique_probes(facts: DataFrame) -> DataFrame:
    """The latest start of each context at which exactly one fact holds (O164).

    Starts and ends become +1 and -1 events whose running sum counts the facts in force: no self-join.
    """
    f = facts.where("start IS NOT NULL")
    ups = f.select("context_id", F.col("start").alias("day"), F.lit(1).alias("step"))
    downs = f.where("end IS NOT NULL").select("context_id", F.date_add("end", 1).alias("day"), F.lit(-1).alias("step"))
    w = Window.partitionBy("context_id").orderBy("day").rangeBetween(Window.unboundedPreceding, 0)
    held = ups.unionByName(downs).withColumn("active", F.sum("step").over(w)).where("active = 1 AND step = 1")
    return held.groupBy("context_id").agg(F.max("day").alias("probe"))


def as_of_join(left: DataFrame, right: DataFrame, key: str, at: str, start: str) -> DataFrame:
    """For each left row the right row of the key with the largest start not after it. One shuffle by the key, no range join.

    left: key, at and other columns; right: key, start and other columns, distinct names.
    """
    names = [c for c in right.columns if c != key]
    l = left.select("*", F.col(at).alias("__t"), F.lit(1).alias("__side"), *(F.lit(None).cast(right.schema[c].dataType).alias(c) for c in names))
    r = right.select(*(F.col(c) if c == key else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns), F.col(start).alias("__t"), F.lit(0).alias("__side"), *names)
    w = Window.partitionBy(key).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    packed = F.last(F.when(F.col("__side") == 0, F.struct(*names)), ignorenulls=True).over(w)
    both = l.unionByName(r).withColumn("__m", packed).where("__side = 1")
    return both.select(*left.columns, *(F.col(f"__m.{c}").alias(c) for c in names))
