"""Queries of the temporal operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epochal.functions import intervals as I
from epochal.operators import solver as S
from epochal.sources.views import FACTS_EVENTS_SQL, FACTS_ORDERS_SQL, OPERATORS, PROGRAMS_SQL, facts_events, facts_orders, programs, table

_SOLVE_SQL = f"""WITH {FACTS_ORDERS_SQL}, {PROGRAMS_SQL},
m AS (SELECT p.qid, p.operator, p.context_id, p.q_start, p.q_end, f.fact_id, f.answer_id, f."start", f."end", f.time_type,
  coalesce(f."start" <= q_start AND q_start <= coalesce(f."end", DATE '9999-12-31'), FALSE) AS now
  FROM programs p JOIN facts f ON f.relation = p.relation AND f.context_id = p.context_id AND f.snapshot_rank <= p.snapshot_rank),
a AS (SELECT qid, count(DISTINCT answer_id) FILTER (WHERE now) AS n_now, min("start") FILTER (WHERE now) AS now_start,
  count(DISTINCT answer_id) FILTER (WHERE now AND "end" IS NOT NULL) AS n_bounded, max("end") FILTER (WHERE now AND "end" IS NOT NULL) AS now_end FROM m GROUP BY qid),
c AS (SELECT m.* FROM m JOIN a USING (qid) WHERE coalesce(CASE
  WHEN operator IN ('current', 'as_of', 'effective') THEN now
  WHEN operator = 'during' THEN "start" <= q_start AND coalesce("end", DATE '9999-12-31') >= q_end
  WHEN operator = 'between' THEN "start" <= q_end AND coalesce("end", DATE '9999-12-31') >= q_start
  WHEN operator = 'previous' THEN n_now = 1 AND "end" < now_start
  WHEN operator = 'next' THEN CASE WHEN n_bounded = 0 THEN "start" > q_start ELSE n_bounded = 1 AND "start" > now_end END
  WHEN operator IN ('latest', 'last') THEN "start" <= q_start
  WHEN operator = 'first' THEN "start" IS NOT NULL
  WHEN operator IN ('before', 'expired') THEN "end" < q_start
  WHEN operator = 'after' THEN "start" > q_start ELSE FALSE END, FALSE)),
s AS (SELECT qid, operator, context_id, fact_id, answer_id, "start", "end" FROM (SELECT *, CASE
  WHEN operator IN ('previous', 'before', 'expired') THEN rank() OVER (PARTITION BY qid ORDER BY "end" DESC)
  WHEN operator IN ('latest', 'last') THEN rank() OVER (PARTITION BY qid ORDER BY "start" DESC)
  WHEN operator IN ('next', 'after', 'first') THEN rank() OVER (PARTITION BY qid ORDER BY "start") ELSE 1 END AS r FROM c) WHERE r = 1)
"""


def _one(op: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return S.solve(facts_orders(spark, sf_dir), programs(spark, sf_dir, (op,))).select("context_id", "fact_id", "answer_id")

    return query


def solver_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    solved = S.solve(facts_orders(spark, sf_dir), programs(spark, sf_dir))
    return S.answers(solved).select("qid", "operator", F.array_join("answers", ",").alias("answers"), F.array_join("evidence", ",").alias("evidence"))


def time_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, p = facts_orders(spark, sf_dir), programs(spark, sf_dir)
    return S.solved_status(f, p).groupBy("operator", "status").agg(F.count("*").alias("n"))


def current_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.lit("2024-01-15").cast("date")
    return facts_events(spark, sf_dir).where(I.contains(F.col("start"), F.col("end"), day)).select("context_id", "fact_id", "answer_id")


def snapshot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.snapshot_delta(facts_orders(spark, sf_dir))


def update_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.adjacent_pairs(facts_orders(spark, sf_dir))


def unique_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.unique_probes(facts_orders(spark, sf_dir))


def path_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths: the first three facts of each context by fact_id."""
    edge = F.struct("fact_id", "start", "end", "time_type")
    first = F.row_number().over(Window.partitionBy("context_id").orderBy("fact_id"))  # three rows a context leave a task
    p = facts_orders(spark, sf_dir).withColumn("i", first).where("i <= 3").groupBy("context_id").agg(F.array_sort(F.collect_list(edge)).alias("e"))
    q = (F.lit("1998-06-15").cast("date"), F.lit("1998-09-15").cast("date"))
    return p.select("context_id", S.path_status(F.col("e"), *q).alias("shared"), S.path_status(F.col("e"), *q, sequence=True).alias("sequence"))


def alternate_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers under a wrong operator that share nothing with the right ones (O163): latest asked in place of before."""
    f = facts_orders(spark, sf_dir)
    right = S.answers(S.solve(f, programs(spark, sf_dir, ("before",)))).select(F.substring_index("qid", ":", -1).cast("long").alias("context_id"), F.col("answers").alias("gold"))
    wrong = S.answers(S.solve(f, programs(spark, sf_dir, ("latest",)))).select(F.substring_index("qid", ":", -1).cast("long").alias("context_id"), F.col("answers").alias("wrong"))
    both = right.join(wrong, "context_id").where(~F.arrays_overlap("gold", "wrong"))
    return both.select("context_id", F.array_join("gold", ",").alias("gold"), F.array_join("wrong", ",").alias("wrong"))


def context_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence by status for each as_of program, two of each at most, smallest ids first (O162)."""
    f, p = facts_orders(spark, sf_dir), programs(spark, sf_dir, ("as_of",))
    place = F.row_number().over(Window.partitionBy("qid", "status").orderBy("fact_id"))
    two = F.collect_list(F.when(F.col("place") <= 2, F.col("fact_id")))
    return S.time_status(f, p).withColumn("place", place).groupBy("qid", "status").agg(F.array_join(F.array_sort(two), ",").alias("evidence"), F.count("*").alias("n"))


def as_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item with its customer's order in force at the ship date: as-of join on the customer."""
    o = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("ship"))
    keyed = lines.join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    starts = o.groupBy("o_custkey", F.to_date("o_orderdate").alias("order_day")).agg(F.max("o_orderkey").alias("order_in_force"))
    return S.as_of_join(keyed, starts, "o_custkey", "ship", "order_day").select("l_orderkey", "l_linenumber", "order_day", "order_in_force")


def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of facts of a context that overlap with different answers (O041): equi key first, then the interval condition."""
    f = facts_orders(spark, sf_dir).where("start IS NOT NULL").select("context_id", "fact_id", "answer_id", "start", "end")
    a, b = f.alias("a"), f.alias("b")
    on = (F.col("a.context_id") == F.col("b.context_id")) & (F.col("a.fact_id") < F.col("b.fact_id")) & (F.col("a.answer_id") != F.col("b.answer_id"))
    hit = a.join(b, on & I.overlaps(F.col("a.start"), F.col("a.end"), F.col("b.start"), F.col("b.end")))
    return hit.select(F.col("a.context_id").alias("context_id"), F.col("a.fact_id").alias("fact_a"), F.col("b.fact_id").alias("fact_b"))


def interval_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts_orders(spark, sf_dir)
    day = F.lit("1998-06-15").cast("date")
    return f.select(
        "fact_id", I.rendered(F.col("start"), F.col("end")).alias("text"), F.round(I.before_score(F.col("end"), day), 6).alias("before_score"),
        F.round(I.after_score(F.col("start"), day), 6).alias("after_score"), F.round(I.near_miss(F.abs(F.datediff("start", day))), 6).alias("near_miss"),
    )


QUERIES = {
    **{f"solve_{op}": _one(op) for op in OPERATORS if op != "update_stability"},
    "solver_union": solver_union,
    "time_status": time_status,
    "current_events": current_events,
    "snapshot_delta": snapshot_delta,
    "update_pairs": update_pairs,
    "unique_probe": unique_probe,
    "path_coherence": path_coherence,
    "alternate_operator": alternate_operator,
    "context_packs": context_packs,
    "as_of_orders": as_of_orders,
    "interval_overlap": interval_overlap,
    "interval_text": interval_text,
}

_STATUS_SQL = """CASE WHEN m.time_type = 'unknown' THEN 'unknown_valid_time'
  {chosen}
  WHEN operator IN ('during', 'between') AND coalesce(m."start" <= q_end AND coalesce(m."end", DATE '9999-12-31') >= q_start, FALSE) THEN '{over}'
  WHEN operator IN ('current', 'as_of', 'effective') AND now THEN 'valid'
  WHEN operator IN ('first', 'next', 'after', 'latest', 'last') THEN CASE WHEN m."start" > q_start THEN 'future_invalid' ELSE 'stale' END
  WHEN operator IN ('previous', 'before', 'expired') THEN CASE WHEN m."end" < q_start THEN 'stale' ELSE 'future_invalid' END
  WHEN m."end" < q_start THEN 'stale' WHEN m."start" > q_end THEN 'future_invalid' ELSE 'temporally_ambiguous' END"""

_DAY = lambda c: f"strftime({c}, '%B %-d, %Y')"
SQL = {
    **{f"solve_{op}": _SOLVE_SQL + f"SELECT context_id, fact_id, answer_id FROM s WHERE operator = '{op}'" for op in OPERATORS if op != "update_stability"},
    "solver_union": _SOLVE_SQL + "SELECT qid, operator, array_to_string(list_sort(list(DISTINCT answer_id)), ',') AS answers, array_to_string(list_sort(list(DISTINCT fact_id)), ',') AS evidence FROM s GROUP BY qid, operator",
    "time_status": _SOLVE_SQL + f"SELECT m.operator, {_STATUS_SQL.format(chosen='''WHEN s.fact_id IS NOT NULL THEN 'valid' ''', over='temporally_ambiguous').replace('operator IN', 'm.operator IN')} AS status, count(*) AS n FROM m LEFT JOIN s ON m.qid = s.qid AND m.fact_id = s.fact_id GROUP BY 1, 2",
    "current_events": f"""WITH {FACTS_EVENTS_SQL} SELECT context_id, fact_id, answer_id FROM fe WHERE "start" <= DATE '2024-01-15' AND DATE '2024-01-15' <= coalesce("end", DATE '9999-12-31')""",
    "snapshot_delta": f"WITH {FACTS_ORDERS_SQL} SELECT context_id, CAST(count(*) FILTER (WHERE snapshot_rank = 1) AS INT) AS added, 0 AS removed, CAST(count(*) AS INT) AS n_s1 FROM facts GROUP BY context_id",
    "update_pairs": f"""WITH {FACTS_ORDERS_SQL}, n AS (SELECT *, lead(fact_id) OVER w AS nf, lead("start") OVER w AS ns, lead(answer_id) OVER w AS na FROM facts WHERE "start" IS NOT NULL WINDOW w AS (PARTITION BY context_id ORDER BY "start", fact_id))
SELECT context_id, fact_id, nf AS next_fact_id, CAST(ns - "start" AS INT) AS gap_days, na <> answer_id AS answer_changed, ns <= coalesce("end", DATE '9999-12-31') AS still_valid FROM n WHERE nf IS NOT NULL""",
    "unique_probe": f"""WITH {FACTS_ORDERS_SQL}, p AS (SELECT a.context_id, a."start" AS day, count(*) AS n FROM (SELECT DISTINCT context_id, "start" FROM facts WHERE "start" IS NOT NULL) a
  JOIN facts b ON a.context_id = b.context_id AND b."start" <= a."start" AND a."start" <= coalesce(b."end", DATE '9999-12-31') GROUP BY ALL)
SELECT context_id, max(day) AS probe FROM p WHERE n = 1 GROUP BY context_id""",
    "path_coherence": f"""WITH {FACTS_ORDERS_SQL}, e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY fact_id) AS i FROM facts) WHERE i <= 3),
l AS (SELECT *, lag(coalesce("end", "start")) OVER (PARTITION BY context_id ORDER BY i) AS last_end FROM e),
g AS (SELECT context_id, bool_or("start" IS NULL) AS unknown, max("start") AS lo, min(coalesce("end", DATE '9999-12-31')) AS hi, bool_or(coalesce("start" < last_end, FALSE)) AS wrong,
  bool_or(coalesce("start" <= DATE '1998-09-15' AND coalesce("end", DATE '9999-12-31') >= DATE '1998-06-15', FALSE)) AS touch FROM l GROUP BY context_id)
SELECT context_id, CASE WHEN unknown THEN 'unknown_edge_time' WHEN lo > hi THEN 'incoherent_empty_intersection' WHEN NOT (lo <= DATE '1998-09-15' AND hi >= DATE '1998-06-15') THEN 'incoherent_query_time' ELSE 'coherent_shared_interval' END AS shared,
  CASE WHEN unknown THEN 'unknown_edge_time' WHEN wrong THEN 'wrong_order' WHEN NOT touch THEN 'incoherent_query_time' ELSE 'coherent_sequence' END AS sequence FROM g""",
    "alternate_operator": _SOLVE_SQL + """, g AS (SELECT context_id, operator, list_sort(list(DISTINCT answer_id)) AS l FROM s WHERE operator IN ('before', 'latest') GROUP BY ALL)
SELECT a.context_id, array_to_string(a.l, ',') AS gold, array_to_string(b.l, ',') AS wrong FROM g a JOIN g b USING (context_id) WHERE a.operator = 'before' AND b.operator = 'latest' AND NOT list_has_any(a.l, b.l)""",
    "context_packs": _SOLVE_SQL + f", t AS (SELECT m.qid, m.fact_id, {_STATUS_SQL.format(chosen='', over='valid')} AS status FROM m WHERE operator = 'as_of') SELECT qid, status, array_to_string(list_sort(list(fact_id))[1:2], ',') AS evidence, count(*) AS n FROM t GROUP BY qid, status",
    "as_of_orders": """WITH k AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS order_day, max(o_orderkey) AS order_in_force FROM orders GROUP BY ALL),
l AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS ship, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, order_day, order_in_force FROM l ASOF LEFT JOIN k ON l.o_custkey = k.o_custkey AND l.ship >= k.order_day""",
    "interval_overlap": f"""WITH {FACTS_ORDERS_SQL} SELECT a.context_id, a.fact_id AS fact_a, b.fact_id AS fact_b FROM facts a JOIN facts b ON a.context_id = b.context_id AND a.fact_id < b.fact_id AND a.answer_id <> b.answer_id
AND a."start" <= coalesce(b."end", DATE '9999-12-31') AND b."start" <= coalesce(a."end", DATE '9999-12-31')""",
    "interval_text": f"""WITH {FACTS_ORDERS_SQL} SELECT fact_id, CASE WHEN "start" IS NULL THEN 'unknown time' WHEN "end" IS NULL THEN 'since ' || {_DAY('"start"')} WHEN "start" = "end" THEN {_DAY('"start"')} ELSE 'from ' || {_DAY('"start"')} || ' to ' || {_DAY('"end"')} END AS text,
round(CASE WHEN "end" < DATE '1998-06-15' THEN 1.0::DOUBLE / (1.0::DOUBLE + (DATE '1998-06-15' - "end")::DOUBLE / 365.25::DOUBLE) ELSE 0.0::DOUBLE END, 6) AS before_score,
round(CASE WHEN "start" > DATE '1998-06-15' THEN 1.0::DOUBLE / (1.0::DOUBLE + ("start" - DATE '1998-06-15')::DOUBLE / 365.25::DOUBLE) ELSE 0.0::DOUBLE END, 6) AS after_score,
round(coalesce(0.25::DOUBLE * exp(-abs("start" - DATE '1998-06-15')::DOUBLE / 365.0::DOUBLE), 0.0::DOUBLE), 6) AS near_miss FROM facts""",
}
