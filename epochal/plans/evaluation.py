"""Queries of statistics, corpus, agreement and integrity operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.operators import corpus as C
from epochal.operators import statistics as X
from epochal.sources.views import FACTS_ORDERS_SQL, facts_orders, table


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a deterministic score from the id and length, and their language as group."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    j = table(spark, sf_dir, "labels").join(d, "doc_id")
    score = ((F.col("doc_id") * 37 + F.col("n_chars") * 11) % 100) / F.lit(100.0)
    return j.select("doc_id", "lang", "source", "n_chars", F.col("quality").alias("y"), "toxic", score.alias("s"))


_SCORED_SQL = "sc AS (SELECT doc_id, lang, source, n_chars, quality AS y, toxic, ((doc_id * 37 + n_chars * 11) % 100) / 100.0::DOUBLE AS s FROM labels JOIN documents USING (doc_id))"
_RANK = {"no": 0, "partial": 1, "yes": 2}


def _ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three raters for each labelled document, made by hash: unit, rater, label, field."""
    l = table(spark, sf_dir, "labels").select("doc_id", "quality")
    r = l.withColumn("rater", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    k = (F.col("doc_id") * 7 + F.col("rater") * 13 + F.col("quality") * 5) % 10
    label = F.when(k < 5, "yes").when(k < 8, "no").when(k < 9, "partial").otherwise("cannot_judge")
    return r.select(F.col("doc_id").alias("unit"), "rater", label.alias("label"), F.when(F.col("doc_id") % 2 == 0, "answer").otherwise("evidence").alias("field"))


_RATINGS_SQL = """ra AS (SELECT doc_id AS unit, rater, CASE WHEN k < 5 THEN 'yes' WHEN k < 8 THEN 'no' WHEN k < 9 THEN 'partial' ELSE 'cannot_judge' END AS label, CASE WHEN doc_id % 2 = 0 THEN 'answer' ELSE 'evidence' END AS field
  FROM (SELECT doc_id, rater, (doc_id * 7 + rater * 13 + quality * 5) % 10 AS k FROM labels, (SELECT unnest([0, 1, 2]) AS rater)))"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rater 0 as gold and rater 1 as prediction."""
    r = _ratings(spark, sf_dir)
    a = r.where("rater = 0").select("unit", "field", F.col("label").alias("gold"))
    return a.join(r.where("rater = 1").select("unit", F.col("label").alias("predicted")), "unit")


_PAIRS_SQL = _RATINGS_SQL + ", pr AS (SELECT a.unit, a.field, a.label AS gold, b.label AS predicted FROM ra a JOIN ra b ON a.unit = b.unit AND a.rater = 0 AND b.rater = 1)"


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def spearman(spark, sf_dir):
    return _rounded(X.spearman(_scored(spark, sf_dir).withColumn("len", F.col("n_chars").cast("double")), ["lang"], "s", "len"))


def kendall_tau_b(spark, sf_dir):
    return _rounded(X.kendall_tau_b(_scored(spark, sf_dir), ["lang"], "s", "y"))


def auroc_ap(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return _rounded(X.auroc(s, ["lang"], "s", "y").join(X.average_precision(s, ["lang"], "s", "y"), "lang"))


def calibration(spark, sf_dir):
    return _rounded(X.calibration(_scored(spark, sf_dir), ["lang"], "s", "y", "doc_id"))


def aurc(spark, sf_dir):
    return _rounded(X.aurc(_scored(spark, sf_dir), ["lang"], "s", "y"))


def risk_coverage(spark, sf_dir):
    return _rounded(X.risk_coverage(_scored(spark, sf_dir), ["lang"], "s", "y"))


def kappa(spark, sf_dir):
    ranked = _pairs(spark, sf_dir).where("gold <> 'cannot_judge' AND predicted <> 'cannot_judge'")
    return _rounded(X.kappas(ranked, ["field"], "gold", "predicted", _RANK))


def per_class(spark, sf_dir):
    return _rounded(X.per_class(_pairs(spark, sf_dir), ["field"], "gold", "predicted"))


def confusion(spark, sf_dir):
    labels = ["yes", "partial", "no", "cannot_judge"]
    return _pairs(spark, sf_dir).groupBy("gold").pivot("predicted", labels).count().na.fill(0)


def krippendorff_alpha(spark, sf_dir):
    return _rounded(X.krippendorff(_ratings(spark, sf_dir), ["field"], "unit", "label", _RANK))


def wilson_rates(spark, sf_dir):
    g = _scored(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    low, high = X.wilson(F.col("k"), F.col("n"))
    return g.select("source", "n", "k", low.alias("low"), high.alias("high"))


def holm(spark, sf_dir):
    p = _scored(spark, sf_dir).groupBy("lang", "source").agg((F.sum("n_chars") % 1000 / F.lit(10000.0)).alias("p"))
    return _rounded(X.holm(p, ["lang"], "source", "p"))


def mcnemar(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("a", (F.col("s") > 0.5).cast("int")).withColumn("b", (F.col("n_chars") % 2).cast("int"))
    return X.mcnemar_counts(s, ["lang"], "a", "b").select("lang", "left_only", "right_only")


def mcnemar_p(spark, sf_dir):
    """Exact binomial p-values: rows only, the tests hold them against a closed sum."""
    s = _scored(spark, sf_dir).withColumn("a", (F.col("s") > 0.5).cast("int")).withColumn("b", (F.col("n_chars") % 2).cast("int"))
    return X.mcnemar_counts(s, ["lang"], "a", "b")


def percentiles(spark, sf_dir):
    iv = X.percentile_interval("n_chars")
    return _scored(spark, sf_dir).groupBy("lang").agg(F.round(iv[0], 6).alias("low"), F.round(iv[1], 6).alias("high"), X.nearest_rank("n_chars", 0.95).cast("long").alias("p95"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


def cluster_bootstrap(spark, sf_dir):
    """Numpy's seeded draws: rows only."""
    return X.cluster_bootstrap(_scored(spark, sf_dir), ["lang"], "source", "y")


def sign_flip_test(spark, sf_dir):
    return X.sign_flip_test(_scored(spark, sf_dir).withColumn("d", F.col("y") - F.col("s")), ["lang"], "source", "d")


def paired_difference(spark, sf_dir):
    r = _ratings(spark, sf_dir).withColumn("v", F.when(F.col("label") == "yes", 1.0).when(F.col("label") == "partial", 0.5).otherwise(0.0))
    return _rounded(X.paired_difference(r, ["field"], "unit", "rater", "v"))


def label_cube(spark, sf_dir):
    """All four grouping sets of field and rater (O055)."""
    r = _ratings(spark, sf_dir)
    rate = lambda l: F.round(F.avg((F.col("label") == l).cast("double")), 6).alias(f"{l}_rate")
    out = r.cube("field", "rater").agg(F.count("*").alias("n"), rate("yes"), rate("cannot_judge"))
    return out.select(F.coalesce("field", F.lit("all")).alias("field"), F.coalesce(F.col("rater").cast("string"), F.lit("all")).alias("rater"), "n", "yes_rate", "cannot_judge_rate")


def field_performance(spark, sf_dir):
    """Strict, determinate and partial-credit rates (O054)."""
    credit = F.when(F.col("label") == "yes", 1.0).when(F.col("label") == "partial", 0.5).when(F.col("label") == "no", 0.0)
    g = _ratings(spark, sf_dir).groupBy("field", "rater")
    return g.agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == "yes").cast("double")), 4).alias("strict"), F.round(F.avg(credit), 4).alias("credit"), F.count(credit).alias("determinate"))


def macro_means(spark, sf_dir):
    """Mean over languages of the mean over sources (O056)."""
    s = _scored(spark, sf_dir).groupBy("lang", "source").agg(F.avg("y").alias("m")).groupBy("lang").agg(F.avg("m").alias("m"), F.count("*").alias("sources"))
    return s.agg(F.round(F.avg("m"), 6).alias("macro"), F.sum("sources").alias("groups"))


def majority_vote(spark, sf_dir):
    return C.majority(_ratings(spark, sf_dir), "unit", "field", "label")


def peer_agreement(spark, sf_dir):
    return _rounded(C.leave_one_out(_ratings(spark, sf_dir), "unit", "rater", "label"))


def stable_splits(spark, sf_dir):
    return C.stable_splits(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select("doc_id", "bucket", "split", "human_pool")


def quotas(spark, sf_dir):
    w = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("w"))
    return C.proportional_quotas(w, "source", "w", 100)


def round_robin(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return C.round_robin(d, "source", C.stable_order("rr", F.col("doc_id")), 50).select("doc_id", "source", "round")


def one_per_series(spark, sf_dir):
    """The order of smallest hash of each customer (O222)."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return o.groupBy("o_custkey").agg(F.min_by("o_orderkey", C.stable_order("series", F.col("o_orderkey"))).alias("o_orderkey"))


def conflict_quarantine(spark, sf_dir):
    """Texts as content and quality labels as supervision."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content")), "doc_id")
    return C.quarantine(d, "content", "quality", ["doc_id"]).select("doc_id", "verdict")


def exact_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return d.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def oversized_groups(spark, sf_dir):
    return C.oversized_groups(table(spark, sf_dir, "documents"), "source", 40)


def near_dup_pairs(spark, sf_dir):
    return _rounded(C.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")))


def near_dup_members(spark, sf_dir):
    """The documents of each representative in near_dup_pairs."""
    return C.near_duplicate_members(table(spark, sf_dir, "documents").select("doc_id", "text"))


def violations(spark, sf_dir):
    """Integrity rules over orders and line items (O242): foreign keys, uniqueness, interval order, visibility."""
    o, l, c, f = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "customer"), facts_orders(spark, sf_dir)
    return C.violations({
        "line_without_order": l.join(o, l.l_orderkey == o.o_orderkey, "left_anti").select("l_orderkey"),
        "order_without_customer": o.join(c, o.o_custkey == c.c_custkey, "left_anti").select("o_orderkey"),
        "duplicate_fact": f.groupBy("fact_id").count().where("count > 1").select("fact_id"),
        "interval_reversed": f.where("end < start").select("fact_id"),
        "unknown_time": f.where("time_type = 'unknown'").select("fact_id"),
        "customer_without_order": c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey"),
    })


def coverage_counts(spark, sf_dir):
    """Counts by many keys at once (O051)."""
    d = table(spark, sf_dir, "documents").groupingSets([["lang"], ["source"], ["lang", "source"], []], "lang", "source").agg(F.count("*").alias("n"))
    return d.select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("source", F.lit("*")).alias("source"), "n")


def usage_totals(spark, sf_dir):
    """Totals over unique calls (O063): a conversation's turn is a call."""
    c = table(spark, sf_dir, "conversations").dropDuplicates(["conv_id", "turn"])
    return c.groupBy("role").agg(F.count("*").alias("calls"), F.sum(F.char_length("text")).alias("chars"))


_NAMES = """spearman kendall_tau_b auroc_ap calibration aurc risk_coverage kappa per_class confusion krippendorff_alpha wilson_rates holm mcnemar mcnemar_p
percentiles cluster_bootstrap sign_flip_test paired_difference label_cube field_performance macro_means majority_vote peer_agreement stable_splits quotas
round_robin one_per_series conflict_quarantine exact_dedup oversized_groups near_dup_pairs near_dup_members violations coverage_counts usage_totals""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_MID = lambda v: f"rank() OVER (PARTITION BY lang ORDER BY {v}) + (count(*) OVER (PARTITION BY lang, {v}) - 1) / 2.0::DOUBLE"
_BLOCK = """bl AS (SELECT lang, s, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS pos FROM sc GROUP BY ALL), cu AS (SELECT *, sum(n) OVER w AS cum_n, sum(pos) OVER w AS cum_pos FROM bl WINDOW w AS (PARTITION BY lang ORDER BY s DESC))"""
_DIST = "CASE WHEN {a} = {b} THEN 0.0::DOUBLE WHEN {a} = 'cannot_judge' OR {b} = 'cannot_judge' THEN 1.0::DOUBLE ELSE power((CASE {a} WHEN 'no' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END - CASE {b} WHEN 'no' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END) / 2.0::DOUBLE, 2) END"
_PLACE = lambda a: f"CASE {a} WHEN 'no' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END"
_TRI = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
SQL = {
    "spearman": f"WITH {_SCORED_SQL}, r AS (SELECT lang, s, n_chars::DOUBLE AS len, {_MID('s')} AS a, {_MID('n_chars')} AS b FROM sc) SELECT lang, round(CASE WHEN max(s) > min(s) AND max(len) > min(len) THEN corr(a, b) END, 6) AS spearman, round(CASE WHEN max(s) > min(s) AND max(len) > min(len) THEN corr(s, len) END, 6) AS pearson, count(*) AS n FROM r GROUP BY lang",
    "kendall_tau_b": f"""WITH {_SCORED_SQL}, p AS (SELECT a.lang, sum(sign(b.s - a.s) * sign(b.y - a.y)) AS s FROM sc a JOIN sc b ON a.lang = b.lang AND a.doc_id < b.doc_id GROUP BY a.lang),
t AS (SELECT lang, count(*) * (count(*) - 1) / 2.0::DOUBLE AS n0 FROM sc GROUP BY lang), ta AS (SELECT lang, sum(c * (c - 1) / 2.0::DOUBLE) AS v FROM (SELECT lang, s, count(*) AS c FROM sc GROUP BY ALL) GROUP BY lang), tb AS (SELECT lang, sum(c * (c - 1) / 2.0::DOUBLE) AS v FROM (SELECT lang, y, count(*) AS c FROM sc GROUP BY ALL) GROUP BY lang)
SELECT lang, round(coalesce(p.s, 0) / nullif(sqrt((n0 - ta.v) * (n0 - tb.v)), 0), 6) AS tau_b FROM t LEFT JOIN p USING (lang) JOIN ta USING (lang) JOIN tb USING (lang)""",
    "auroc_ap": f"""WITH {_SCORED_SQL}, {_BLOCK}, r AS (SELECT lang, y, {_MID('s')} AS r FROM sc), a AS (SELECT lang, (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auroc FROM r GROUP BY lang),
p AS (SELECT lang, sum(pos * cum_pos / cum_n) / nullif(sum(pos), 0) AS ap FROM cu GROUP BY lang) SELECT lang, round(auroc, 6) AS auroc, round(ap, 6) AS average_precision FROM a JOIN p USING (lang)""",
    "calibration": f"""WITH {_SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY s, doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM sc), b AS (SELECT *, least(10, greatest(1, n // 10)) AS b FROM r),
e AS (SELECT *, (SELECT max(k) FROM range(0, 10) q(k) WHERE k < b AND k * n // b <= i) AS bin, least(floor(s * 10), 9) AS wide FROM b),
x AS (SELECT lang, sum(c / n * gap) AS v FROM (SELECT lang, bin, count(*)::DOUBLE AS c, any_value(n) AS n, abs(avg(s) - avg(y)) AS gap FROM e GROUP BY lang, bin) GROUP BY lang),
w AS (SELECT lang, sum(c / n * gap) AS v FROM (SELECT lang, wide, count(*)::DOUBLE AS c, any_value(n) AS n, abs(avg(s) - avg(y)) AS gap FROM e GROUP BY lang, wide) GROUP BY lang)
SELECT lang, round(avg((s - y) * (s - y)), 6) AS brier, round(avg(abs(s - y)), 6) AS mae, round(any_value(x.v), 6) AS ece_equal_count, round(any_value(w.v), 6) AS ece_equal_width FROM sc JOIN x USING (lang) JOIN w USING (lang) GROUP BY lang""",
    "aurc": f"""WITH {_SCORED_SQL}, {_BLOCK}, k AS (SELECT lang, ((cum_n - n) - (cum_pos - pos) + i * (n - pos) / n) / (cum_n - n + i) AS risk FROM (SELECT *, unnest(range(1, CAST(n + 1 AS BIGINT))) AS i FROM cu)) SELECT lang, round(avg(risk), 6) AS aurc FROM k GROUP BY lang""",
    "risk_coverage": f"""WITH {_SCORED_SQL} SELECT lang, t::DOUBLE AS threshold, round(count(*) FILTER (WHERE s >= t)::DOUBLE / count(*), 6) AS coverage, round(avg(1.0::DOUBLE - y) FILTER (WHERE s >= t), 6) AS risk FROM sc, (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9, 0.95]::DOUBLE[]) AS t) GROUP BY lang, t HAVING count(*) FILTER (WHERE s >= t) > 0""",
    "kappa": f"""WITH {_PAIRS_SQL}, p AS (SELECT * FROM pr WHERE gold <> 'cannot_judge' AND predicted <> 'cannot_judge'), t AS (SELECT field, count(*)::DOUBLE AS n, avg((gold = predicted)::INT)::DOUBLE AS po, sum(power({_PLACE('gold')} - {_PLACE('predicted')}, 2)) AS ws FROM p GROUP BY field),
g AS (SELECT field, gold, count(*)::DOUBLE AS c FROM p GROUP BY ALL), q AS (SELECT field, predicted, count(*)::DOUBLE AS c FROM p GROUP BY ALL),
e AS (SELECT field, sum(g.c * q.c) FILTER (WHERE gold = predicted) AS ch, sum(g.c * q.c * power({_PLACE('gold')} - {_PLACE('predicted')}, 2)) AS we FROM g JOIN q USING (field) GROUP BY field)
SELECT field, round((po - ch / (n * n)) / nullif(1 - ch / (n * n), 0), 6) AS kappa, round(1 - ws * n / nullif(we, 0), 6) AS quadratic_kappa FROM t JOIN e USING (field)""",
    "per_class": f"""WITH {_PAIRS_SQL}, l AS (SELECT DISTINCT field, gold AS label FROM pr UNION SELECT field, predicted FROM pr),
c AS (SELECT field, label, (count(*) FILTER (WHERE gold = label AND predicted = label))::DOUBLE AS tp, (count(*) FILTER (WHERE gold = label))::DOUBLE AS g, (count(*) FILTER (WHERE predicted = label))::DOUBLE AS p FROM l JOIN pr USING (field) GROUP BY ALL)
SELECT field, label, round(coalesce(tp / nullif(p, 0), 0), 6) AS precision, round(coalesce(tp / nullif(g, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(p + g, 0), 0), 6) AS f1, CAST(g AS BIGINT) AS support FROM c""",
    "confusion": f"WITH {_PAIRS_SQL} SELECT gold, " + ", ".join(f"count(*) FILTER (WHERE predicted = '{l}') AS {l}" if l != "no" else "count(*) FILTER (WHERE predicted = 'no') AS \"no\"" for l in ("yes", "partial", "no", "cannot_judge")) + " FROM pr GROUP BY gold",
    "krippendorff_alpha": f"""WITH {_RATINGS_SQL}, m AS (SELECT *, count(*) OVER (PARTITION BY unit) AS m FROM ra), o AS (SELECT a.field, sum({_DIST.format(a='a.label', b='b.label')} / (a.m - 1)) AS v FROM m a JOIN m b ON a.unit = b.unit AND a.rater <> b.rater GROUP BY a.field),
c AS (SELECT field, label, count(*)::DOUBLE AS n FROM ra GROUP BY ALL), e AS (SELECT x.field, sum(x.n * y.n * {_DIST.format(a='x.label', b='y.label')}) AS v FROM c x JOIN c y ON x.field = y.field GROUP BY x.field), t AS (SELECT field, sum(n) AS t FROM c GROUP BY field)
SELECT field, round(1 - (o.v / t) / (e.v / (t * (t - 1))), 6) AS alpha FROM o JOIN e USING (field) JOIN t USING (field)""",
    "wilson_rates": f"""WITH {_SCORED_SQL}, g AS (SELECT source, count(*) AS n, sum(y)::BIGINT AS k, 3.8414588206941236::DOUBLE AS zz FROM sc GROUP BY source), p AS (SELECT *, k / n::DOUBLE AS p, n::DOUBLE AS m FROM g)
SELECT source, n, k, round(greatest(0.0::DOUBLE, (p + zz / (2 * m) - sqrt(zz) * sqrt(p * (1 - p) / m + zz / (4 * m * m))) / (1 + zz / m)), 4) AS low, round(least(1.0::DOUBLE, (p + zz / (2 * m) + sqrt(zz) * sqrt(p * (1 - p) / m + zz / (4 * m * m))) / (1 + zz / m)), 4) AS high FROM p""",
    "holm": f"""WITH {_SCORED_SQL}, p AS (SELECT lang, source, (sum(n_chars) % 1000) / 10000.0::DOUBLE AS p FROM sc GROUP BY ALL), r AS (SELECT *, least(1.0::DOUBLE, p * (count(*) OVER (PARTITION BY lang) - row_number() OVER (PARTITION BY lang ORDER BY p, source) + 1)) AS raw FROM p)
SELECT lang, source, round(p, 6) AS p, round(max(raw) OVER (PARTITION BY lang ORDER BY p, source ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM r""",
    "mcnemar": f"WITH {_SCORED_SQL}, x AS (SELECT lang, (s > 0.5)::INT AS a, n_chars % 2 AS b FROM sc) SELECT lang, count(*) FILTER (WHERE a = 1 AND b = 0) AS left_only, count(*) FILTER (WHERE a = 0 AND b = 1) AS right_only FROM x GROUP BY lang",
    "percentiles": f"WITH {_SCORED_SQL} SELECT lang, round(quantile_cont(n_chars, 0.025), 6) AS low, round(quantile_cont(n_chars, 0.975), 6) AS high, (list_sort(list(n_chars)))[greatest(1, ceil(0.95::DOUBLE * count(*)))::INT] AS p95, min(n_chars) AS least, max(n_chars) AS most FROM sc GROUP BY lang",
    "paired_difference": f"""WITH {_RATINGS_SQL}, v AS (SELECT *, CASE label WHEN 'yes' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.5 ELSE 0.0 END AS v FROM ra) SELECT a.field, a.rater AS "left", b.rater AS "right", count(*) AS n, round(avg(a.v - b.v), 6) AS difference, count(*) FILTER (WHERE a.v > b.v) AS wins, count(*) FILTER (WHERE a.v = b.v) AS ties
FROM v a JOIN v b ON a.unit = b.unit AND a.field = b.field AND a.rater < b.rater GROUP BY ALL""",
    "label_cube": f"WITH {_RATINGS_SQL} SELECT coalesce(field, 'all') AS field, coalesce(CAST(rater AS VARCHAR), 'all') AS rater, count(*) AS n, round(avg((label = 'yes')::INT::DOUBLE), 6) AS yes_rate, round(avg((label = 'cannot_judge')::INT::DOUBLE), 6) AS cannot_judge_rate FROM ra GROUP BY CUBE (field, rater)",
    "field_performance": f"WITH {_RATINGS_SQL}, c AS (SELECT *, CASE label WHEN 'yes' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.5 WHEN 'no' THEN 0.0 END AS c FROM ra) SELECT field, rater, count(*) AS n, round(avg((label = 'yes')::INT::DOUBLE), 4) AS strict, round(avg(c), 4) AS credit, count(c) AS determinate FROM c GROUP BY field, rater",
    "macro_means": f"WITH {_SCORED_SQL}, s AS (SELECT lang, source, avg(y) AS m FROM sc GROUP BY ALL), l AS (SELECT lang, avg(m) AS m, count(*) AS k FROM s GROUP BY lang) SELECT round(avg(m), 6) AS macro, CAST(sum(k) AS BIGINT) AS groups FROM l",
    "majority_vote": f"""WITH {_RATINGS_SQL}, c AS (SELECT unit, field, label, count(*) AS n FROM ra GROUP BY ALL), r AS (SELECT *, max(n) OVER (PARTITION BY unit, field) AS top FROM c)
SELECT unit, field, CASE WHEN count(*) FILTER (WHERE n = top) = 1 THEN max(label) FILTER (WHERE n = top) END AS majority, CAST(sum(n) AS BIGINT) AS votes, count(*) FILTER (WHERE n = top) > 1 AS tie FROM r GROUP BY unit, field""",
    "peer_agreement": f"WITH {_RATINGS_SQL} SELECT a.rater, round(avg((a.label = b.label)::INT::DOUBLE), 6) AS agreement, count(DISTINCT a.unit) AS units FROM ra a JOIN ra b ON a.unit = b.unit AND a.rater <> b.rater GROUP BY a.rater",
    "stable_splits": """WITH b AS (SELECT doc_id, CAST(('0x' || sha256('split:' || CAST(doc_id AS VARCHAR))[1:16])::UBIGINT % 1000 AS BIGINT) AS bucket FROM documents)
SELECT doc_id, bucket, CASE WHEN bucket < 600 THEN 'train' WHEN bucket < 750 THEN 'dev' WHEN bucket < 950 THEN 'test_auto' ELSE 'reserve' END AS split, bucket >= 750 AND bucket < 800 AS human_pool FROM b""",
    "quotas": """WITH w AS (SELECT source, count(*) AS w FROM documents GROUP BY source), e AS (SELECT source, w * 100.0::DOUBLE / sum(w) OVER () AS e FROM w), f AS (SELECT *, floor(e) AS f FROM e),
r AS (SELECT *, row_number() OVER (ORDER BY e - f DESC, source) AS i, 100 - sum(f) OVER () AS rest FROM f) SELECT source, CAST(f + (i <= rest)::INT AS BIGINT) AS quota FROM r""",
    "round_robin": """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('rr:' || CAST(doc_id AS VARCHAR))) AS round FROM documents) SELECT * FROM r ORDER BY round, source LIMIT 50""",
    "one_per_series": "SELECT o_custkey, arg_min(o_orderkey, sha256('series:' || CAST(o_orderkey AS VARCHAR))) AS o_orderkey FROM orders GROUP BY o_custkey",
    "conflict_quarantine": """WITH d AS (SELECT doc_id, quality, sha256(coalesce(text, '')) AS c FROM labels JOIN documents USING (doc_id)) SELECT doc_id, CASE WHEN min(quality) OVER (PARTITION BY c) <> max(quality) OVER (PARTITION BY c) THEN 'conflict'
WHEN row_number() OVER (PARTITION BY c, quality ORDER BY doc_id) > 1 THEN 'duplicate' ELSE 'kept' END AS verdict FROM d""",
    "exact_dedup": "SELECT sha256(coalesce(text, '')) AS h, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "oversized_groups": "SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM (SELECT source, count(*) AS n FROM documents GROUP BY source HAVING count(*) > 40)",
    "near_dup_pairs": f"""WITH t AS (SELECT doc_id, {_TRI} AS t FROM documents), s AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN ['<empty>'] WHEN len(t) < 3 THEN list_distinct(t) ELSE list_distinct(list_transform(range(1, CAST(greatest(len(t), 3) - 1 AS BIGINT)), lambda i: array_to_string(t[i:i + 2], chr(31)))) END AS s FROM t),
u AS (SELECT min(doc_id) AS doc_id, list_sort(s) AS s, len(any_value(s)) AS n FROM s GROUP BY list_sort(s)), e AS (SELECT doc_id, n, unnest(s) AS g FROM u), f AS (SELECT * FROM e WHERE g IN (SELECT g FROM e GROUP BY g HAVING count(*) > 1)),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c FROM f x JOIN f y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL)
SELECT a, b, round(c::DOUBLE / (na + nb - c), 6) AS similarity FROM i WHERE c::DOUBLE / (na + nb - c) >= 0.9""",
    "violations": f"""WITH {FACTS_ORDERS_SQL} SELECT 'line_without_order' AS rule, CAST(l_orderkey AS VARCHAR) AS id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'order_without_customer', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'duplicate_fact', fact_id FROM facts GROUP BY fact_id HAVING count(*) > 1
UNION ALL SELECT 'interval_reversed', fact_id FROM facts WHERE "end" < "start" UNION ALL SELECT 'unknown_time', fact_id FROM facts WHERE time_type = 'unknown' UNION ALL SELECT 'customer_without_order', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
    "coverage_counts": "SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source), ())",
    "usage_totals": "SELECT role, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT DISTINCT ON (conv_id, turn) * FROM conversations) GROUP BY role",
}
