"""Queries of text, retrieval and graph operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.functions import text as T
from epochal.operators import retrieval as R
from epochal.operators import solver as S
from epochal.sources.views import FACTS_ORDERS_SQL, facts_orders, programs, table
from epochal.plans.temporal import _SOLVE_SQL, _STATUS_SQL


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn (candidate) with the user turn before it (reference)."""
    c = table(spark, sf_dir, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("candidate"))
    u = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    return a.join(u, ["conv_id", "turn"])


_PAIRS_SQL = """pairs AS (SELECT a.conv_id, a.turn, a.text AS candidate, u.text AS reference FROM conversations a JOIN conversations u
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' AND u.role = 'user')"""


def _norm_sql(x: str) -> str:
    gone = f"regexp_replace(lower({x}), '[!-/:-@\\[-`{{-~]', '', 'g')"
    for _ in range(2):  # articles side by side share a boundary
        gone = f"regexp_replace({gone}, '(^|[^\\p{{L}}\\p{{N}}_])(?:a|an|the)([^\\p{{L}}\\p{{N}}_]|$)', '\\1 \\2', 'g')"
    return f"trim(regexp_replace({gone}, '\\s+', ' ', 'g'))"


def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.answer_scores(F.col("candidate"), F.col("reference"))
    names = ("exact", "precision", "recall", "f1", "rouge2")
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", *(F.round(s[n], 6).alias(n) for n in names))


def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest common subsequence of candidate and reference. SQL has no such fold: rows only, tested by hand-computed cases."""
    s = T.answer_scores(F.col("candidate"), F.col("reference"))
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", F.round(s["rouge_l"], 6).alias("rouge_l"))


def text_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.normalize_answer(t).alias("answer"), T.visible_text(t).alias("visible"), F.size(T.tokens(t)).alias("n_tokens"), T.is_refusal(t).alias("refusal"))


def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.shingles(F.coalesce("text", F.lit("")))).alias("n"))


def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = T.jaccard(F.array_distinct(T.tokens(F.col("candidate"))), F.array_distinct(T.tokens(F.col("reference"))))
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", F.round(j, 6).alias("jaccard"))


def mention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the words of the reference are mentioned in the candidate."""
    score = T.mention_score(T.tokens(F.col("candidate")), T.tokens(F.col("reference")))
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", F.round(score, 6).alias("score"))


def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.stable_id("u", F.col("doc_id"), F.col("lang")).alias("unit"), T.stable_bucket("split", F.col("doc_id"), 1000).alias("bucket"), F.round(T.hash_fraction("s", F.col("doc_id")), 9).alias("fraction"))


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return R.bm25(docs, q).withColumn("score", F.round("score", 6))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k(_bm25(spark, sf_dir), ["qid"], [F.col("score").desc(), F.col("doc_id")], 10)


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors whose id is divisible by 20 ask (the stated query set); all others are ranked."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    s = R.dense_scores(e.select("vec_id", F.col("embedding").alias("v")), q).where("qid <> vec_id")
    return s.withColumn("score", F.round("score", 6))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k(_dense(spark, sf_dir), ["qid"], [F.col("score").desc(), F.col("vec_id")], 10)


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 ranks fused with ranks by number of shared distinct tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(T.tokens(F.coalesce("text", F.lit(""))))).alias("t"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("t"))
    shared = docs.join(q, "t").groupBy("qid", "doc_id").agg(F.count("*").alias("n"))
    second = R.top_k(shared, ["qid"], [F.col("n").desc(), F.col("doc_id")], 80)
    first = R.top_k(_bm25(spark, sf_dir), ["qid"], [F.col("score").desc(), F.col("doc_id")], 80)
    fused = R.reciprocal_rank_fusion([first, second], "doc_id").withColumn("score", F.round("score", 9))
    return R.top_k(fused, ["qid"], [F.col("score").desc(), F.col("doc_id")], 10)


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the query's label are relevant."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    ranked = R.top_k(_dense(spark, sf_dir), ["qid"], [F.col("score").desc(), F.col("vec_id")], 50).join(e, "vec_id")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("wanted"))
    sizes = e.groupBy(F.col("label").alias("wanted")).agg((F.count("*") - 1).alias("n_required"))
    req = asked.join(sizes, "wanted")
    m = R.ranked_metrics(ranked.join(asked, "qid").select("qid", "rank", (F.col("label") == F.col("wanted")).alias("relevant")), req.select("qid", "n_required"))
    return m.select("qid", *(F.round(c, 6).alias(c) for c in m.columns if c != "qid"))


def min_max_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).withColumn("scaled", F.round(R.min_max("score", ["qid"]), 6)).select("qid", "vec_id", "scaled")


def semantic_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 hits, one for each equal text, re-ranked."""
    key = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    ranked = R.top_k(_bm25(spark, sf_dir), ["qid"], [F.col("score").desc(), F.col("doc_id")], 50).join(key, "doc_id")
    return R.dedup_ranked(ranked, "key", 10).select("qid", "doc_id", "rank")


def _temporal_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts_orders(spark, sf_dir).where("start IS NOT NULL")
    cut = F.lit("1998-06-15").cast("date")
    recency = R.relative_recency([F.col("start"), F.col("fact_id")], ["context_id", "relation"], True, F.col("start") <= cut)
    score = F.pmod(F.crc32("fact_id"), F.lit(1000)) / 1000.0
    return f.select(F.col("context_id").alias("qid"), "fact_id", recency.alias("temporal"), score.alias("score"))


def temporal_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.temporal_rerank(_temporal_hits(spark, sf_dir).withColumn("score", F.length("fact_id") / 100.0), 5)
    return out.select("qid", "fact_id", F.round("combined", 6).alias("combined"), "rank")


def relative_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts_orders(spark, sf_dir)
    known = F.col("start").isNotNull()
    order = [F.col("start"), F.col("fact_id")]
    return f.select("fact_id", R.relative_recency(order, ["context_id"], True, known).alias("latest"), R.relative_recency(order, ["context_id"], False, known).alias("first"), R.relative_ordinal(order, ["context_id"], 2, known).alias("second_last"))


def status_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = S.time_status(facts_orders(spark, sf_dir), programs(spark, sf_dir, ("as_of",)))
    ranked = R.top_k(st, ["qid"], [F.col("fact_id")], 10)
    m = R.status_rates(ranked, 5)
    return m.select("qid", *(F.round(c, 6).alias(c) for c in m.columns if c != "qid"))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts as nodes, line items as facts."""
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return l.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"), F.concat_ws("-", "l_suppkey", "l_partkey").alias("fact_id"))


def graph_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "part").where("p_size = 1").select(F.lit("q").alias("qid"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"), F.lit(1.0).alias("score"))
    return R.expand_hops(graph_edges(spark, sf_dir), seeds).withColumn("score", F.round("score", 6))


def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.incidence(graph_edges(spark, sf_dir)).groupBy("node").agg(F.count("*").alias("degree"))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers linked by orders of the same day and priority in the same nation."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    g = o.groupBy("o_orderdate", "o_orderpriority", "c_nationkey").agg(F.min("o_custkey").alias("b"), F.collect_set("o_custkey").alias("all"))
    edges = g.select("b", F.explode("all").alias("a")).where("a <> b")
    return R.connected_components(edges)


QUERIES = {
    "answer_scores": answer_scores, "rouge_l": rouge_l, "text_normal_forms": text_normal_forms, "shingle_counts": shingle_counts, "token_jaccard": token_jaccard,
    "mention_scores": mention_scores, "stable_ids": stable_ids, "bm25_topk": bm25_topk, "dense_topk": dense_topk, "rrf_fusion": rrf_fusion,
    "retrieval_metrics": retrieval_metrics, "min_max_scaled": min_max_scaled, "semantic_dedup": semantic_dedup, "temporal_rerank": temporal_rerank,
    "relative_scores": relative_scores, "status_rates": status_rates, "graph_two_hop": graph_two_hop, "graph_degree": graph_degree, "components": components,
}

_TOK = lambda x: f"regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}]+')"
_BM25_SQL = f"""t AS (SELECT doc_id, {_TOK('text')} AS t FROM documents), c AS (SELECT count(*) AS n, avg(len(t)::DOUBLE) AS mean FROM t),
asked AS (SELECT item_id AS qid, unnest(list_distinct({_TOK('text')})) AS token FROM benchmark),
tf AS (SELECT token, doc_id, count(*)::DOUBLE AS tf, any_value(l)::DOUBLE AS l FROM (SELECT doc_id, len(t) AS l, unnest(t) AS token FROM t) WHERE token IN (SELECT token FROM asked) GROUP BY token, doc_id),
df AS (SELECT token, count(*)::DOUBLE AS df FROM tf GROUP BY token),
bm AS (SELECT qid, doc_id, round(sum(ln(1.0::DOUBLE + (c.n::DOUBLE - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / c.mean))), 6) AS score
  FROM asked JOIN df USING (token) JOIN tf USING (token), c GROUP BY qid, doc_id)"""
_DENSE_SQL = """u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
ds AS (SELECT a.vec_id AS qid, b.vec_id, a.label AS wanted, b.label, round(list_dot_product(a.v, b.v), 6) AS score FROM u a JOIN u b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)"""
_TOP = lambda src, order, k, cols="*": f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order}) AS rank FROM {src}) WHERE rank <= {k}"
_LOG2 = "1.0::DOUBLE / log2(rank + 1.0::DOUBLE)"
_F1 = lambda o, a, b: f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN {o} = 0 THEN 0.0 ELSE 2.0 * ({o} / len({a})) * ({o} / len({b})) / (({o} / len({a})) + ({o} / len({b}))) END"
SQL = {
    "answer_scores": f"""WITH {_PAIRS_SQL}, n AS (SELECT conv_id, turn, {_norm_sql('candidate')} AS c, {_norm_sql('reference')} AS r FROM pairs),
x AS (SELECT *, list_filter(string_split(c, ' '), lambda t: t <> '') AS a, list_filter(string_split(r, ' '), lambda t: t <> '') AS b FROM n),
y AS (SELECT *, CASE WHEN len(a) < 2 THEN [] ELSE list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]) END AS g, CASE WHEN len(b) < 2 THEN [] ELSE list_transform(range(1, len(b)), lambda i: b[i] || ' ' || b[i + 1]) END AS h FROM x),
e AS (SELECT conv_id, turn, 1 AS k, unnest(a) AS t, 1 AS s, 0 AS z FROM y UNION ALL SELECT conv_id, turn, 1, unnest(b), 0, 1 FROM y UNION ALL SELECT conv_id, turn, 2, unnest(g), 1, 0 FROM y UNION ALL SELECT conv_id, turn, 2, unnest(h), 0, 1 FROM y),
o AS (SELECT conv_id, turn, coalesce(sum(m) FILTER (WHERE k = 1), 0)::DOUBLE AS o1, coalesce(sum(m) FILTER (WHERE k = 2), 0)::DOUBLE AS o2 FROM (SELECT conv_id, turn, k, t, least(sum(s), sum(z)) AS m FROM e GROUP BY ALL) GROUP BY ALL)
SELECT conv_id, turn, CASE WHEN c = r THEN 1.0::DOUBLE ELSE 0.0 END AS exact, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0::DOUBLE WHEN len(a) = 0 THEN 0.0 ELSE coalesce(o1, 0) / len(a) END, 6) AS precision,
round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0::DOUBLE WHEN len(b) = 0 THEN 0.0 ELSE coalesce(o1, 0) / len(b) END, 6) AS recall, round(({_F1('coalesce(o1, 0)', 'a', 'b')})::DOUBLE, 6) AS f1, round(CASE WHEN len(a) + len(b) = 0 THEN 1.0::DOUBLE WHEN len(g) = 0 OR len(h) = 0 THEN 0.0 ELSE ({_F1('coalesce(o2, 0)', 'g', 'h')})::DOUBLE END, 6) AS rouge2 FROM y LEFT JOIN o USING (conv_id, turn)""",
    "text_normal_forms": f"""SELECT conv_id, turn, {_norm_sql('text')} AS answer, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS visible, CAST(len({_TOK('text')}) AS INT) AS n_tokens,
regexp_matches(trim(regexp_replace(text, '\\s+', ' ', 'g')), '(?i){'|'.join(T.REFUSALS).replace("'", "''")}') AS refusal FROM conversations""",
    "shingle_counts": """WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents)
SELECT doc_id, CAST(CASE WHEN len(t) = 0 THEN 1 WHEN len(t) < 3 THEN len(list_distinct(t)) ELSE len(list_distinct(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], chr(31))))) END AS INT) AS n FROM t""",
    "token_jaccard": f"""WITH {_PAIRS_SQL}, t AS (SELECT conv_id, turn, list_distinct({_TOK('candidate')}) AS a, list_distinct({_TOK('reference')}) AS b FROM pairs)
SELECT conv_id, turn, round(CASE WHEN len(a) + len(b) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS jaccard FROM t""",
    "mention_scores": f"""WITH {_PAIRS_SQL}, t AS (SELECT conv_id, turn, {_TOK('candidate')} AS a, {_TOK('reference')} AS b FROM pairs),
c AS (SELECT *, list_distinct(list_filter(b, lambda x: x NOT IN ({', '.join(f"'{w}'" for w in T.COMMON)}))) AS k FROM t)
SELECT conv_id, turn, round(CASE WHEN len(b) > 0 AND contains(' ' || array_to_string(a, ' ') || ' ', ' ' || array_to_string(b, ' ') || ' ') THEN 1.0::DOUBLE WHEN len(k) = 0 THEN 0.0 ELSE len(list_intersect(k, a))::DOUBLE / len(k) END, 6) AS score FROM c""",
    "stable_ids": """SELECT doc_id, 'u_' || sha256(CAST(doc_id AS VARCHAR) || chr(31) || lang)[1:24] AS unit, CAST(('0x' || sha256('split:' || CAST(doc_id AS VARCHAR))[1:16])::UBIGINT % 1000 AS BIGINT) AS bucket,
round(('0x' || sha256('s:' || CAST(doc_id AS VARCHAR))[1:12])::UBIGINT::DOUBLE / 281474976710656.0, 9) AS fraction FROM documents""",
    "bm25_topk": f"WITH {_BM25_SQL} " + _TOP("bm", "score DESC, doc_id", 10),
    "dense_topk": f"WITH {_DENSE_SQL} " + _TOP("ds", "score DESC, vec_id", 10, "qid, vec_id, score, rank"),
    "rrf_fusion": f"""WITH {_BM25_SQL}, dt AS (SELECT doc_id, unnest(list_distinct(t)) AS token FROM t), sh AS (SELECT qid, doc_id, count(*) AS n FROM dt JOIN asked USING (token) GROUP BY ALL),
f AS (SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM ({_TOP('bm', 'score DESC, doc_id', 80, 'qid, doc_id, rank')} UNION ALL {_TOP('sh', 'n DESC, doc_id', 80, 'qid, doc_id, rank')}) GROUP BY ALL) """ + _TOP("f", "score DESC, doc_id", 10),
    "retrieval_metrics": f"""WITH {_DENSE_SQL}, r AS ({_TOP('ds', 'score DESC, vec_id', 50)}), n AS (SELECT label AS wanted, count(*) - 1 AS n_required FROM embeddings GROUP BY label),
h AS (SELECT qid, rank, n_required, (label = wanted)::INT::DOUBLE AS rel, sum((label = wanted)::INT::DOUBLE) OVER (PARTITION BY qid ORDER BY rank) AS hits FROM r JOIN n USING (wanted)),
g AS (SELECT qid, n_required, sum(rel) FILTER (WHERE rank <= 10) AS hit, min(rank) FILTER (WHERE rel = 1) AS first, coalesce(sum({_LOG2}) FILTER (WHERE rank <= 10 AND rel = 1), 0) AS dcg,
  coalesce(sum(hits / rank) FILTER (WHERE rank <= 10 AND rel = 1), 0) AS psum, coalesce(sum(rel) FILTER (WHERE rank <= n_required), 0) AS r_hits FROM h GROUP BY ALL)
SELECT qid, round(hit / 10, 6) AS precision, round(hit / n_required, 6) AS recall, (hit > 0)::INT::DOUBLE AS hit_at_k, round(psum / least(n_required, 10), 6) AS average_precision, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr,
round(r_hits / n_required, 6) AS r_precision, round(dcg / (SELECT sum(1.0::DOUBLE / log2(i + 1.0::DOUBLE)) FROM range(1, CAST(least(n_required, 10) + 1 AS BIGINT)) x(i)), 6) AS ndcg FROM g""",
    "min_max_scaled": f"WITH {_DENSE_SQL} SELECT qid, vec_id, round(coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0), 6) AS scaled FROM ds WINDOW w AS (PARTITION BY qid)",
    "semantic_dedup": f"""WITH {_BM25_SQL}, r AS (SELECT x.*, sha256(coalesce(d.text, '')) AS key FROM ({_TOP('bm', 'score DESC, doc_id', 50)}) x JOIN documents d USING (doc_id)),
k AS (SELECT qid, doc_id, rank AS old FROM (SELECT *, row_number() OVER (PARTITION BY qid, key ORDER BY rank) AS i FROM r) WHERE i = 1)
SELECT qid, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY old) AS rank FROM k) WHERE rank <= 10""",
    "temporal_rerank": f"""WITH {FACTS_ORDERS_SQL}, e AS (SELECT context_id AS qid, fact_id, "start" <= DATE '1998-06-15' AS ok, length(fact_id) / 100.0::DOUBLE AS score, row_number() OVER (PARTITION BY context_id, "start" <= DATE '1998-06-15' ORDER BY "start" DESC, fact_id DESC) AS i FROM facts WHERE "start" IS NOT NULL),
h AS (SELECT qid, fact_id, CASE WHEN ok THEN greatest(0.2::DOUBLE, 1.0::DOUBLE - 0.25::DOUBLE * (i - 1)) ELSE 0.0::DOUBLE END AS temporal, score, max(score) OVER (PARTITION BY qid) AS best FROM e),
c AS (SELECT qid, fact_id, 0.55::DOUBLE * (score / best) + 0.45::DOUBLE * temporal AS combined FROM h WHERE temporal > 0) SELECT qid, fact_id, round(combined, 6) AS combined, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY combined DESC, fact_id) AS rank FROM c) WHERE rank <= 5""",
    "relative_scores": f"""WITH {FACTS_ORDERS_SQL}, r AS (SELECT fact_id, "start" IS NOT NULL AS ok, row_number() OVER (PARTITION BY context_id, "start" IS NOT NULL ORDER BY "start" DESC, fact_id DESC) AS d,
  row_number() OVER (PARTITION BY context_id, "start" IS NOT NULL ORDER BY "start", fact_id) AS a, count("start") OVER (PARTITION BY context_id) AS n FROM facts)
SELECT fact_id, CASE WHEN ok THEN greatest(0.2::DOUBLE, 1.0::DOUBLE - 0.25::DOUBLE * (d - 1)) ELSE 0.0::DOUBLE END AS latest, CASE WHEN ok THEN greatest(0.2::DOUBLE, 1.0::DOUBLE - 0.25::DOUBLE * (a - 1)) ELSE 0.0::DOUBLE END AS first,
CASE WHEN n < 2 THEN 0.4::DOUBLE WHEN ok AND d = 2 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS second_last FROM r""",
    "status_rates": _SOLVE_SQL + f", t AS (SELECT m.qid, m.fact_id, {_STATUS_SQL.format(chosen='', over='valid')} AS status, row_number() OVER (PARTITION BY m.qid ORDER BY m.fact_id) AS rank FROM m WHERE operator = 'as_of') SELECT qid, "
    + ", ".join(f"round(avg((status = '{s}')::INT::DOUBLE), 6) AS {s}_rate" for s in ("valid", "stale", "future_invalid", "unknown_valid_time"))
    + " FROM t WHERE rank <= 5 GROUP BY qid",
    "graph_two_hop": """WITH e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e), s0 AS (SELECT 'p' || p_partkey AS node FROM part WHERE p_size = 1),
s1 AS (SELECT DISTINCT b AS node FROM s0 JOIN l ON node = a), s2 AS (SELECT DISTINCT b AS node FROM s1 JOIN l ON node = a),
x AS (SELECT node, 0 AS hop FROM s0 UNION ALL SELECT node, 1 FROM s1 UNION ALL SELECT node, 2 FROM s2) SELECT 'q' AS qid, node, round(pow(0.72::DOUBLE, min(hop)), 6) AS score, min(hop) AS hop FROM x GROUP BY node""",
    "graph_degree": """WITH e AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) SELECT 's' || l_suppkey AS node, count(*) AS degree FROM e GROUP BY l_suppkey UNION ALL SELECT 'p' || l_partkey, count(*) FROM e GROUP BY l_partkey""",
    "components": """WITH RECURSIVE e AS (SELECT DISTINCT min(o_custkey) OVER (PARTITION BY o_orderdate, o_orderpriority, c_nationkey) AS b, o_custkey AS a FROM orders JOIN customer ON c_custkey = o_custkey),
l AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b), r AS (SELECT a AS node, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON r.node = l.a) SELECT node, min(root) AS root FROM r GROUP BY node""",
}
