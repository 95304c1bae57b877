"""Queries of the question, claim and citation operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochal.functions import temporal_text as Q
from epochal.operators import claims as K
from epochal.sources.views import PROGRAMS_SQL, facts_orders, programs, table


def question_intents(spark, sf_dir):
    """Programs rendered as questions and read back."""
    p = programs(spark, sf_dir).where("operator <> 'update_stability'")
    q = p.withColumn("question", Q.question_text(F.col("operator"), F.col("q_start"), F.col("q_end"), F.concat(F.lit("customer "), F.col("context_id").cast("string"))))
    i = q.withColumn("i", Q.parse_intent(F.col("question")))
    return i.select("qid", "question", F.col("i.operator").alias("parsed"), F.col("i.query_start").alias("day"), F.col("i.query_end").alias("last_day"), F.col("i.confidence").alias("confidence"))


def date_mentions(spark, sf_dir):
    """Mentions in texts made of the orders' dates in three forms. An overlap rule between patterns is no SQL: rows only."""
    f = facts_orders(spark, sf_dir).where("start IS NOT NULL")
    text = F.concat(F.date_format("start", "yyyy-MM-dd"), F.lit(" or "), F.date_format("start", "MMMM d, yyyy"), F.lit(" or "), F.date_format("start", "MMMM yyyy"))
    return f.select("fact_id", F.explode(Q.date_mentions(text)).alias("m")).select("fact_id", "m.at", "m.lower", "m.upper", "m.granularity")


def claim_counts(spark, sf_dir):
    """Claims of assistant turns. The sentence split looks behind, which DuckDB's patterns can't: rows only."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return c.select("conv_id", "turn", F.size(K.decompose(F.col("text"))).alias("claims"))


def _judged(spark, sf_dir):
    """Claims made by hash for each labelled document: two candidate claims and one reference claim."""
    d = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    i = lambda m, a: F.pmod(F.col("doc_id") * a, F.lit(m)).cast("int")
    one = F.struct((F.col("quality") == 1).alias("reference_supported"), F.array(i(3, 5) + 1).alias("retrieved"), F.array(i(2, 7) + 1).alias("cited"))
    two = F.struct((F.col("toxic") == 1).alias("reference_supported"), F.slice(F.array(i(4, 3) + 1), F.lit(1), i(2, 1)).alias("retrieved"), F.slice(F.array(F.lit(1)), F.lit(1), i(2, 3)).alias("cited"))
    ref = F.struct((i(2, 11) == 0).alias("candidate_supported"), F.array(i(4, 9) + 1).alias("retrieved"))
    return d.select("doc_id", F.array(one, two).alias("c"), F.array(ref).alias("r"))


def claim_metrics(spark, sf_dir):
    m = K.claim_metrics(F.col("c"), F.col("r"), F.lit(3), F.lit(2))
    return _judged(spark, sf_dir).select("doc_id", *(F.round(m[k].cast("double"), 6).alias(k) for k in ("precision", "recall", "f1", "context_precision", "faithfulness", "hallucination", "relevant_noise", "citation_precision")))


def citations(spark, sf_dir):
    """Handles merged from texts that cite by line number."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("n"))
    text = F.concat(F.lit("Order "), F.col("l_orderkey").cast("string"), F.lit(" [E"), F.array_join("n", ", E"), F.lit("] shipped [E1]."))
    l = l.select("l_orderkey", text.alias("t"))
    return l.select("l_orderkey", Q.merge_handles(F.col("t"), Q.inline_handles(F.col("t"))).alias("merged"))


def update_adaptation(spark, sf_dir):
    d = table(spark, sf_dir, "labels").select("doc_id", (F.pmod(F.col("doc_id") * 17, F.lit(101)) / 100.0).alias("b"), (F.pmod(F.col("doc_id") * 29, F.lit(101)) / 100.0).alias("a"), (F.col("quality") == 1).alias("c"))
    u = K.update_adaptation(F.col("b"), F.col("a"), F.col("c"))
    return d.select("doc_id", F.round(u["score"], 6).alias("score"), u["pass_50"].alias("pass_50"), u["pass_75"].alias("pass_75"), F.round(K.geometric([F.col("a"), F.col("b")]), 6).alias("geometric"))


_NAMES = "question_intents date_mentions claim_counts claim_metrics citations update_adaptation".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_D = lambda c: f"strftime({c}, '%B %-d, %Y')"
_PHRASE = " ".join(
    f"WHEN '{k}' THEN '" + v.replace("{a}", f"' || {_D('q_start')} || '").replace("{b}", f"' || {_D('q_end')} || '") + "'" for k, v in Q.PHRASES.items()
)
SQL = {
    "question_intents": f"""WITH {PROGRAMS_SQL} SELECT qid, CASE operator {_PHRASE} END || ' for customer ' || CAST(context_id AS VARCHAR) || '?' AS question, operator AS parsed,
CASE WHEN operator = 'first' THEN NULL ELSE q_start END AS day, CASE WHEN operator = 'first' THEN NULL WHEN operator IN ('during', 'between') THEN q_end ELSE q_start END AS last_day, 'high' AS confidence FROM programs WHERE operator <> 'update_stability'""",
    "claim_metrics": """WITH b AS (SELECT doc_id, quality = 1 AS s1, toxic = 1 AS s2, (doc_id * 5) % 3 + 1 AS r1, (doc_id * 7) % 2 + 1 AS c1, CASE WHEN doc_id % 2 = 1 THEN (doc_id * 3) % 4 + 1 END AS r2, CASE WHEN (doc_id * 3) % 2 = 1 THEN 1 END AS c2,
(doc_id * 11) % 2 = 0 AS k, (doc_id * 9) % 4 + 1 AS rr FROM labels), p AS (SELECT *, (s1::INT + s2::INT) / 2.0::DOUBLE AS precision, k::INT::DOUBLE AS recall FROM b)
SELECT doc_id, round(precision, 6) AS precision, recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 6) AS f1, round(CASE WHEN rr <= 3 THEN 1.0::DOUBLE / 3 ELSE 0.0 END, 6) AS context_precision,
round((1 + (r2 IS NOT NULL)::INT) / 2.0::DOUBLE, 6) AS faithfulness, round((NOT s2 AND r2 IS NULL)::INT / 2.0::DOUBLE, 6) AS hallucination,
round(((NOT s1 AND rr <= 3 AND r1 = rr)::INT + coalesce((NOT s2 AND rr <= 3 AND r2 = rr)::INT, 0)) / 2.0::DOUBLE, 6) AS relevant_noise, round((1 + coalesce((c2 <> c1)::INT, 0)) / 2.0::DOUBLE, 6) AS citation_precision FROM p""",
    "citations": """WITH n AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS n FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, 'Order ' || l_orderkey || ' shipped. [' || array_to_string(list_transform(CASE WHEN list_contains(n, 1) THEN n ELSE list_append(n, 1) END, lambda x: 'E' || x), ', ') || ']' AS merged FROM n""",
    "update_adaptation": """WITH d AS (SELECT doc_id, (doc_id * 17 % 101) / 100.0::DOUBLE AS b, (doc_id * 29 % 101) / 100.0::DOUBLE AS a, quality = 1 AS c FROM labels), s AS (SELECT *, CASE WHEN c THEN least(a, b) ELSE least(a, b, 1.0::DOUBLE - abs(a - b)) END AS s, c OR abs(a - b) <= 0.05 AS ok FROM d)
SELECT doc_id, round(s, 6) AS score, s >= 0.5 AND ok AS pass_50, s >= 0.75 AND ok AS pass_75, round(CASE WHEN a <= 0 OR b <= 0 THEN 0.0::DOUBLE ELSE sqrt(a * b) END, 6) AS geometric FROM s""",
}

