"""Mixing sources to target weights: hierarchical budgeting over a domain, language, source tree. DataFrame functions only.

A node's budget is divided among its children by weight; a child that holds fewer tokens (times the epochs allowed) than its
share takes what it has, and the shortage goes to its siblings by weight. Only if a whole subtree is short does the parent's
level see it. As a subtree's capacity is the sum of its leaves', one water filling per level, from the root down, does this:
children sorted by capacity / weight, running sums give every candidate level, and the largest is the true one.

A leaf takes whole epochs of its documents while its quota lasts, then the token prefix of one more epoch in seeded order:
every document before which fewer tokens stand than remain. The prefix's end is found without ordering a leaf in one task:
token sums of key buckets pre-aggregate, and only the bucket in which the quota ends is ordered row by row. The documents
themselves are then filtered by key in their own scan: texts are not shuffled.

Null levels are nodes of their own. Null and empty texts hold no tokens and come with the key order like others. Rows that
share an id share a key and are taken together. Weight 0 takes nothing. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epochal.llm._spark import cut, free, small, table
from epochal.llm.sharding import seeded_key

LEVELS = ("domain", "language", "source_name")
KEY_DIGITS, BUCKET_DIGITS = 14, 3  # 4096 key buckets a leaf
_EPS = 1e-6


def _weight(level: Column, weights: dict[str, float] | None) -> Column:
    if not weights:
        return F.lit(1.0)
    return F.coalesce(F.create_map(*(F.lit(x) for k, v in weights.items() for x in (k, float(v))))[level], F.lit(1.0))


def water_fill(nodes: DataFrame, parent: list[str], budget: Column) -> DataFrame:
    """Add ``quota``: the node's part of its parent's ``budget``. nodes: parent columns, weight > 0, capacity."""
    group = Window.partitionBy(*parent)
    order = group.orderBy(F.col("capacity") / F.col("weight"), "__node")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = budget - F.coalesce(F.sum("capacity").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return (
        nodes.withColumn("__level", left / weight_left)
        .withColumn("quota", F.least("capacity", F.greatest(F.max("__level").over(group), F.lit(0.0)) * F.col("weight")))
        .drop("__level")
    )


def leaf_quotas(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], budget: Column, max_epochs: int) -> DataFrame:
    """Whole epochs and remaining tokens of each leaf. leaves: one row per leaf with its levels and ``tokens``."""
    tree = leaves.withColumn("capacity", F.col("tokens") * float(max_epochs)).withColumn("__budget", budget)
    for depth, level in enumerate(levels):
        above, own = list(levels[:depth]), list(levels[: depth + 1])
        nodes = tree.groupBy(*own).agg(F.sum("capacity").alias("capacity"), F.first("__budget").alias("__budget"))
        nodes = nodes.withColumn("weight", _weight(F.col(level), weights.get(level))).where("weight > 0")
        nodes = water_fill(nodes.withColumn("__node", F.col(level)), above, F.col("__budget"))
        tree = tree.drop("__budget").join(nodes.select(*own, F.col("quota").alias("__budget")), own)
    quota = F.floor(F.col("__budget") + _EPS)
    epochs = F.when(F.col("tokens") > 0, F.least(F.lit(max_epochs), F.expr("quota div tokens"))).otherwise(0).cast("int")
    return tree.withColumn("quota", quota).withColumn("epochs", epochs).select(
        *levels, "tokens", "quota", "epochs",
        F.when(F.col("epochs") < max_epochs, F.col("quota") - F.col("epochs") * F.col("tokens")).otherwise(F.lit(0)).cast("long").alias("rest"),
    )


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, float]] | None = None, budget: float = 1.0, max_epochs: int = 4, id_col: str = "doc_id", text: str = "text", seed: str = "mix") -> DataFrame:
    """The mixture: a document's row once for each epoch that takes it, with ``__epoch`` (from 0) added (or replaced).

    ``levels``: name and expression of each level, root first. ``budget``: tokens wanted as a part of those there are.
    ``weights``: level -> node -> weight; 1 where not given.
    """
    names = list(levels)
    node = {k: F.coalesce(F.concat(F.lit("="), v.cast("string")), F.lit("null")) for k, v in levels.items()}
    doc = F.col(f"`{id_col}`")
    tokens = F.regexp_count(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    marked = {k: {f"={n}": w for n, w in v.items()} for k, v in (weights or {}).items()}
    slim = cut(docs.select(doc.alias("id"), tokens.alias("tokens"), *(v.alias(k) for k, v in node.items())))
    leaves = cut(slim.groupBy(*names).agg(F.sum("tokens").alias("tokens")))
    wanted = F.lit(float(budget)) * leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("double")).scalar()
    quotas = cut(leaf_quotas(leaves, names, marked, wanted, max_epochs))

    def key(i: Column, epochs: Column) -> Column:
        return seeded_key(seed, F.concat(epochs.cast("string"), F.lit(":"), F.coalesce(i.cast("string"), F.lit(""))), KEY_DIGITS)

    cutting = slim.join(small(quotas.where("rest > 0").drop("tokens", "quota")), names)
    cutting = cutting.select(*names, "rest", "tokens", key(F.col("id"), F.col("epochs")).alias("key"))
    bucket = F.shiftright("key", 4 * (KEY_DIGITS - BUCKET_DIGITS))
    sums = cutting.groupBy(*names, bucket.alias("bucket")).agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"))
    up_to = Window.partitionBy(*names).orderBy("bucket")
    edge = sums.withColumn("before", F.coalesce(F.sum("t").over(up_to.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    edge = edge.where("before < rest").groupBy(*names).agg(F.max_by(F.struct("bucket", "before"), "bucket").alias("edge"))
    near = cutting.join(small(cut(edge)), names).where(bucket == F.col("edge.bucket"))
    in_edge = Window.partitionBy(*names).orderBy("key").rangeBetween(Window.unboundedPreceding, -1)
    last = (
        near.withColumn("before", F.col("edge.before") + F.coalesce(F.sum("tokens").over(in_edge), F.lit(0)))
        .where("before < rest")
        .groupBy(*names)
        .agg(F.max("key").alias("last_key"))
    )
    plan = small(cut(quotas.join(last, names, "left").select(*names, "epochs", "last_key")))
    rest = [c for c in docs.columns if c.lower() != "__epoch"]
    epochs, last, copies, *own = free(docs.columns, "__epochs", "__last", "__copies", *(f"__{k}" for k in names))
    taken = docs.select(*(F.col(f"`{c}`") for c in rest), *(v.alias(o) for o, v in zip(own, node.values(), strict=True)))
    plan = plan.select(*(F.col(k).alias(o) for k, o in zip(names, own, strict=True)), F.col("epochs").alias(epochs), F.col("last_key").alias(last))
    taken = taken.join(plan, own)
    times = F.col(epochs) + F.coalesce(key(doc, F.col(epochs)) <= F.col(last), F.lit(False)).cast("int")
    taken = taken.withColumn(copies, times).where(F.col(copies) > 0)
    taken = taken.withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col(copies) - 1)))
    return taken.select(*(F.col(f"`{c}`") for c in rest), "__epoch")


def corpus_levels() -> dict[str, Column]:
    """The tree of the documents table. It has no domain column: sources src0 to src9, src10 to src19, ... form a domain each."""
    number = F.regexp_extract(F.col("source"), "([0-9]+)$", 1)
    domain = F.concat(F.lit("d"), F.coalesce(F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) AS bigint) div 10").cast("string"), F.lit("")))
    return {"domain": F.when(number != "", domain), "language": F.col("lang"), "source_name": F.col("source")}


#: The query's mixture: as many tokens as there are, domains even, English first, up to four epochs.
OP9_WEIGHTS = {"language": {"en": 3.0, "de": 1.0, "fr": 1.0, "es": 1.0}}
OP9_BUDGET, OP9_EPOCHS, OP9_SEED = 1.0, 4, "op9"


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mix(docs, corpus_levels(), OP9_WEIGHTS, OP9_BUDGET, OP9_EPOCHS, seed=OP9_SEED)
    return mixed.select("doc_id", "lang", "source", F.col("__epoch").cast("long").alias("epoch"))


#: The pipeline's mixture: at most one epoch, nine tenths of the tokens; the largest source gives way.
STAGE_BUDGET = 0.9


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, corpus_levels(), {}, STAGE_BUDGET, 1, seed="pipeline").select(*docs.columns)


def _fill_sql(name: str, own: list[str], weight: str, source: str) -> str:
    above = own[:-1]
    part = f"PARTITION BY {', '.join(above)}" if above else ""
    return f"""{name}_n AS (SELECT {', '.join(own)}, sum(capacity) AS capacity, any_value(budget) AS budget, {weight} AS weight FROM {source} GROUP BY {', '.join(own)}),
{name}_l AS (SELECT *, (budget - coalesce(sum(capacity) OVER ({part} ORDER BY capacity / weight, {own[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER ({part} ORDER BY capacity / weight, {own[-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM {name}_n),
{name}_q AS (SELECT *, least(capacity, greatest(max(lev) OVER ({part}), 0) * weight) AS quota FROM {name}_l),
{name} AS (SELECT s.* EXCLUDE (budget), q.quota AS budget FROM {source} s JOIN {name}_q q USING ({', '.join(own)}))"""


_LANG = "CASE language " + " ".join(f"WHEN '={k}' THEN {v}" for k, v in OP9_WEIGHTS["language"].items()) + " ELSE 1.0 END"
OP9_SQL = f"""
WITH docs AS (SELECT doc_id, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens,
  coalesce('=' || CASE WHEN regexp_extract(source, '([0-9]+)$', 1) <> '' THEN 'd' || CAST(CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) // 10 AS VARCHAR) END, 'null') AS domain,
  coalesce('=' || lang, 'null') AS language, coalesce('=' || source, 'null') AS source_name FROM documents),
t0 AS (SELECT domain, language, source_name, sum(tokens) AS tokens, CAST(sum(tokens) * {OP9_EPOCHS} AS DOUBLE) AS capacity,
  {OP9_BUDGET} * (SELECT CAST(sum(tokens) AS DOUBLE) FROM docs) AS budget FROM docs GROUP BY ALL),
{_fill_sql("t1", ["domain"], "1.0", "t0")},
{_fill_sql("t2", ["domain", "language"], _LANG, "t1")},
{_fill_sql("t3", ["domain", "language", "source_name"], "1.0", "t2")},
q AS (SELECT *, CAST(floor(budget + {_EPS}) AS BIGINT) AS quota FROM t3),
e AS (SELECT *, CASE WHEN tokens > 0 THEN least({OP9_EPOCHS}, quota // tokens) ELSE 0 END AS epochs FROM q),
k AS (SELECT d.*, e.epochs, CASE WHEN e.epochs < {OP9_EPOCHS} THEN e.quota - e.epochs * e.tokens ELSE 0 END AS rest,
  md5('{OP9_SEED}:' || CAST(e.epochs AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR))[1:{KEY_DIGITS}] AS key
  FROM docs d JOIN e USING (domain, language, source_name)),
b AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, language, source_name ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT doc_id, lang, source, CAST(unnest(range(CAST(0 AS BIGINT), CAST(epochs + CASE WHEN before < rest THEN 1 ELSE 0 END AS BIGINT))) AS BIGINT) AS epoch FROM b
"""
