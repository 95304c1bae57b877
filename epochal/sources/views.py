"""Temporal views over the driver tables, and their SQL twins for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fact per order: overlaps, ties, open ends and unknown intervals all occur.

    fact_id, context_id, relation, answer_id, start, end (null: open), time_type, snapshot_rank (0 before 1999, else 1).
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.to_date("o_orderdate").alias("d"))
    unknown, opened = F.col("o_orderkey") % 23 == 0, F.col("o_orderkey") % 17 == 0
    return o.select(
        F.concat(F.lit("o_"), F.col("o_orderkey").cast("string")).alias("fact_id"),
        F.col("o_custkey").alias("context_id"),
        F.lit("order_state").alias("relation"),
        F.col("o_orderpriority").alias("answer_id"),
        F.when(~unknown, F.col("d")).alias("start"),
        F.when(~unknown & ~opened, F.date_add("d", (F.col("o_orderkey") % 90).cast("int"))).alias("end"),
        F.when(unknown, "unknown").when(opened, "open").otherwise("closed").alias("time_type"),
        F.when(F.col("d") < F.lit("1999-01-01").cast("date"), 0).otherwise(1).alias("snapshot_rank"),
    )


FACTS_ORDERS_SQL = """facts AS (
  SELECT 'o_' || CAST(o_orderkey AS VARCHAR) AS fact_id, o_custkey AS context_id, 'order_state' AS relation, o_orderpriority AS answer_id,
    CASE WHEN o_orderkey % 23 <> 0 THEN CAST(o_orderdate AS DATE) END AS "start",
    CASE WHEN o_orderkey % 23 <> 0 AND o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INT) END AS "end",
    CASE WHEN o_orderkey % 23 = 0 THEN 'unknown' WHEN o_orderkey % 17 = 0 THEN 'open' ELSE 'closed' END AS time_type,
    CASE WHEN CAST(o_orderdate AS DATE) < DATE '1999-01-01' THEN 0 ELSE 1 END AS snapshot_rank
  FROM orders)"""


def facts_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each user: the last event of a day holds until the day before the next one (open at the end)."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", F.to_date("ts").alias("start"))
    last = Window.partitionBy("user_id", "start").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    e = e.withColumn("r", F.row_number().over(last)).where("r = 1")
    after = F.lead("start").over(Window.partitionBy("user_id").orderBy("start"))
    return e.select(
        F.concat(F.lit("f_"), F.col("event_id").cast("string")).alias("fact_id"),
        F.col("user_id").alias("context_id"),
        F.col("event_type").alias("answer_id"),
        "start",
        F.date_sub(after, 1).alias("end"),
    )


FACTS_EVENTS_SQL = """fe AS (
  SELECT 'f_' || CAST(event_id AS VARCHAR) AS fact_id, user_id AS context_id, event_type AS answer_id, d AS "start",
    lead(d) OVER (PARTITION BY user_id ORDER BY d) - 1 AS "end"
  FROM (SELECT *, CAST(ts AS DATE) AS d, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS r FROM events)
  WHERE r = 1)"""

OPERATORS = ("current", "as_of", "effective", "during", "between", "previous", "next", "latest", "last", "first", "before", "expired", "after", "update_stability")


def programs(spark: SparkSession, sf_dir: str, operators=OPERATORS) -> DataFrame:
    """One question program for each customer and operator, asked at 1998-06-15 to 1998-09-15 of the latest snapshot.

    Size estimates leave out what an explode adds, so a broadcast chosen by them brings all programs to the driver: joins shuffle them.
    """
    c = table(spark, sf_dir, "customer").where("c_custkey IS NOT NULL").select(F.col("c_custkey").alias("context_id"))
    return c.select(
        "context_id",
        F.explode(F.array(*map(F.lit, operators))).alias("operator"),
        F.lit("order_state").alias("relation"),
        F.lit(None).cast("string").alias("object_id"),
        F.lit("1998-06-15").cast("date").alias("q_start"),
        F.lit("1998-09-15").cast("date").alias("q_end"),
        F.lit(1).alias("snapshot_rank"),
    ).withColumn("qid", F.concat_ws(":", "operator", F.col("context_id").cast("string"))).hint("merge")


PROGRAMS_SQL = f"""programs AS (
  SELECT c_custkey AS context_id, op AS operator, 'order_state' AS relation, DATE '1998-06-15' AS q_start, DATE '1998-09-15' AS q_end, 1 AS snapshot_rank,
    op || ':' || CAST(c_custkey AS VARCHAR) AS qid
  FROM customer, (SELECT unnest([{', '.join(f"'{o}'" for o in OPERATORS)}]) AS op))"""
