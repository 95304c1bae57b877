"""Guards, audits and small reports over scores, labels and texts. All are projections or grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epochal.functions.text import response_kind

TOLERANCE = 1e-6
#: Weights of the complexity score: an applicable judgement, and a path; evidence and edges count once.
JUDGMENT, PATH = 4, 2
#: Cues of the complexity score (O131).
ORDERING_CUE = "(?i)\\b(first|last|latest|previous|next|before|after|most recently|immediately before)\\b"
INTERVAL_CUE = "(?i)\\b(during|between|throughout|overlap|interval|from .+ (to|through))\\b"
LIST_CUE = "(?i)(\\b(which|what|name|list)\\s+(two|three|four|all|both)\\b|\\bco-directed\\b)"
MIXED_CUE = "(?i)\\b(but|however|although|yet|on the other hand|alternatively)\\b"
#: Signs of text that was decoded wrongly, left in HTML, or never named (O245).
MOJIBAKE, ENTITY, BARE_ID, URL = "Ã[\\x{80}-\\x{BF}]|â€|ï»¿|\\x{FFFD}", "&(#[0-9]+|[a-z]+);", "\\b[PQ][0-9]+\\b", "^https?://"


def complexity(judgments: Column, evidence: Column, paths: Column, edges: Column, question: Column, answer: Column) -> Column:
    """How much a card asks of its reader (O131). evidence: array of (text, time)."""
    texts = F.transform(evidence, lambda e: e["text"])
    words = F.regexp_count(F.concat_ws(" ", question, answer, F.array_join(texts, " ")), F.lit("[A-Za-z0-9]+"))
    plain = F.transform(texts, lambda t: F.trim(F.regexp_replace(F.lower(t), "[ \\t\\n\\x0B\\f\\r]+", " ")))
    revised = F.lower(question).contains("document revision") & (F.size(F.array_distinct(F.array_compact(F.transform(evidence, lambda e: e["time"])))) > 1) & (F.size(F.array_distinct(plain)) > 1)
    return (
        JUDGMENT * judgments + F.size(evidence) + PATH * paths + edges + F.least(F.lit(4), F.floor(words / 120).cast("int"))
        + F.when(question.rlike(ORDERING_CUE), 2).when(question.rlike(INTERVAL_CUE), 1).otherwise(0)
        + F.when(question.rlike(LIST_CUE), 2).when(answer.contains(",") | answer.rlike("(?i)\\band\\b"), 1).otherwise(0)
        + F.when(revised, 2).otherwise(0)
        + F.when(response_kind(answer) == "hybrid", 2).when(answer.rlike(MIXED_CUE), 1).otherwise(0)
    )


def score_range(metric: Column) -> tuple[Column, Column]:
    """Least and largest score of a metric (O031): -1 to 1 for cosine-like ones, else 0 to 1."""
    return F.when(metric.startswith("bertscore_"), F.lit(-1.0)).otherwise(F.lit(0.0)), F.lit(1.0)


def score_fault(metric: Column, score: Column) -> Column:
    """not_finite, out_of_range, or null."""
    low, high = score_range(metric)
    odd = F.isnan(score) | (F.abs(score) == float("inf"))
    return F.when(odd, "not_finite").when((score < low - TOLERANCE) | (score > high + TOLERANCE), "out_of_range")


def unit_score(metric: Column, score: Column) -> Column:
    """The score on 0 to 1; null if it is not finite (O032)."""
    fine = F.when(~F.isnan(score) & (F.abs(score) != float("inf")), score)
    return F.when(metric.startswith("bertscore_"), (fine + 1) / 2).otherwise(fine)


def best_reference(rows: DataFrame, key: str, reference: str, metrics: list[str]) -> DataFrame:
    """For each metric the best score over a key's references and the first reference that has it (O033)."""
    best = [F.max(F.struct(F.col(m).alias("s"), (-F.col(reference)).alias("r"))).alias(m) for m in metrics]
    out = [x for m in metrics for x in (F.col(f"{m}.s").alias(m), (-F.col(f"{m}.r")).alias(f"{m}_reference"))]
    return rows.groupBy(key).agg(*best).select(key, *out)


def leaks(rows: DataFrame, text: Column, tokens: tuple[str, ...]) -> DataFrame:
    """How many texts hold each prohibited token (O030); all counts 0: nothing leaks."""
    found = F.filter(F.array(*map(F.lit, tokens)), lambda t: F.lower(text).contains(t))
    return rows.select(F.explode(found).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def hygiene(text: Column) -> Column:
    """Names of what is wrong with a text (O245)."""
    faults = {"mojibake": MOJIBAKE, "html_entity": ENTITY, "bare_id": BARE_ID, "url_as_name": URL}
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(k)) for k, p in faults.items())))


def binary_summary(rows: DataFrame, by: list[str], score: str, label: str, cut: float = 0.5) -> DataFrame:
    """Accuracy, macro F1, balanced accuracy and Brier score at a threshold, from the counts of one pass (O191)."""
    s, y = F.col(score) >= cut, F.col(label) == 1
    n = lambda c: F.sum(c.cast("double"))
    c = rows.groupBy(*by).agg(F.count("*").alias("n"), n(s & y).alias("tp"), n(s & ~y).alias("fp"), n(~s & y).alias("fn"), n(~s & ~y).alias("tn"), F.avg((F.col(score) - y.cast("double")) ** 2).alias("brier"))
    f1 = lambda t: F.coalesce(2 * F.col(t) / F.nullif(2 * F.col(t) + F.col("fp") + F.col("fn"), F.lit(0.0)), F.lit(0.0))
    part = lambda a, b: F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0.0))
    return c.select(*by, "n", ((F.col("tp") + F.col("tn")) / F.col("n")).alias("accuracy"), ((f1("tp") + f1("tn")) / 2).alias("macro_f1"), ((part("tp", "fn") + part("tn", "fp")) / 2).alias("balanced_accuracy"), "brier")


def correlation_summary(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """n, Pearson correlation and mean difference; null where n < 5 or a side is constant (O196)."""
    c = rows.groupBy(*by).agg(F.count("*").alias("n"), (F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))).alias("r"), F.avg(F.abs(F.col(x) - F.col(y))).alias("mae"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    fine = (F.col("n") >= 5) & (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))
    return c.select(*by, "n", F.when(fine, F.col("r")).alias("pearson"), F.when(F.col("n") >= 5, F.col("mae")).alias("mae"))


def directional_summary(pairs: DataFrame, by: str, better: str, worse: str) -> DataFrame:
    """Of pairs with a known direction: covered, consistent, tied and reversed, and the mean margin (O213)."""
    m = F.col(better) - F.col(worse)
    share = lambda c: F.avg(F.when(m.isNotNull(), c.cast("double")))
    return pairs.groupBy(by).agg(F.count("*").alias("pairs"), F.count(m).alias("scored"), share(m > 0).alias("consistent"), share(m == 0).alias("tied"), share(m < 0).alias("reversed"), F.avg(m).alias("margin"))


def dominance(rows: DataFrame, margin: float = 0.02, least_pairs: int = 30, least_coverage: float = 0.95) -> DataFrame:
    """better, non_inferior, undecided or too_few, from (lower, p_holm, pairs, coverage) of a comparison (O215)."""
    enough = (F.col("pairs") >= least_pairs) & (F.col("coverage") >= least_coverage)
    said = F.when(~enough, "too_few").when((F.col("lower") > 0) & (F.col("p_holm") < 0.05), "better").when(F.col("lower") > -margin, "non_inferior").otherwise("undecided")
    return rows.withColumn("decision", said)


def undeclared(old: DataFrame, new: DataFrame, key: str, declared: str) -> DataFrame:
    """Pairs of rows with changed fields that ``declared`` (an array in new) does not name (O247)."""
    fields = [c for c in old.columns if c != key]
    j = old.join(new.select(key, declared, *(F.col(c).alias(f"new_{c}") for c in fields)), key)
    changed = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"new_{c}")), F.lit(c)) for c in fields)))
    return j.select(key, F.array_except(changed, F.col(declared)).alias("undeclared")).where(F.size("undeclared") > 0)


def unknown_pointers(rows: DataFrame, field: str, pointers: str, shown: str) -> DataFrame:
    """By field: pointers given, and pointers to evidence that was not shown (O286)."""
    return rows.groupBy(field).agg(F.sum(F.size(pointers)).alias("pointers"), F.sum(F.size(F.array_except(pointers, shown))).alias("unknown"))


def readable(label: Column) -> Column:
    """The label unless it is a bare entity id (O290)."""
    return F.when(~label.rlike("^Q[0-9]+$"), label)


def audit_sample(rows: DataFrame, by: str, value: Column, key: Column, per_side: int, hashed: int, order: Column) -> DataFrame:
    """The rows of each group with the highest and lowest values, and those of the smallest hashes (O294)."""
    place = lambda o: F.row_number().over(Window.partitionBy(by).orderBy(o, key))
    why = {"high": (value.desc(), per_side), "low": (value.asc(), per_side), "hash": (order.asc(), hashed)}
    parts = [rows.withColumn("place", place(o)).where(F.col("place") <= n).withColumn("why", F.lit(k)) for k, (o, n) in why.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def stratum(scores: Column, labels: tuple[str, ...]) -> Column:
    """The label of the largest score, the first of equal ones (O233)."""
    return F.element_at(F.array(*map(F.lit, labels)), F.array_position(scores, F.array_max(scores)).cast("int"))


def system_ranking(rows: DataFrame, rate: str, partial: str, name: str) -> DataFrame:
    """Systems by falling rate, then partial credit, then name; nulls last (O081). One row a system: the window is small."""
    w = Window.orderBy(F.col(rate).desc_nulls_last(), F.col(partial).desc_nulls_last(), name)
    return rows.withColumn("rank", F.row_number().over(w))


def stability(a: DataFrame, b: DataFrame, key: str, score: str, by: str) -> DataFrame:
    """Two runs of a judge: rows of both, share of equal scores, mean difference (O285)."""
    j = a.join(b.select(key, F.col(score).alias("again")), key)
    return j.groupBy(by).agg(F.count("*").alias("n"), F.avg((F.col(score) == F.col("again")).cast("double")).alias("equal"), F.avg(F.abs(F.col(score) - F.col("again"))).alias("difference"))


def minutes(first: Column, last: Column) -> Column:
    """Minutes between timestamps; null if the last is not after the first (O255)."""
    gap = (F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 60e6
    return F.when(gap > 0, gap)


def package_hash(rows: DataFrame, by: str, digest: Column) -> DataFrame:
    """Hash of the sorted distinct hashes of a package's files (O319)."""
    return rows.groupBy(by).agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_set(digest))), 256).alias("package"))


def response_decision(support: Column, refusal: Column) -> Column:
    """The least support of the reference claims; of a refusal, one less that; null without claims (O188)."""
    least = F.array_min(support)
    return F.when(refusal, 1 - least).otherwise(least)


def list_ndcg(gains: Column) -> Column:
    """Discounted gain of a list over that of the same gains in their best order; 0 if all are 0 (O187). Arrays of doubles."""
    total = lambda a: F.aggregate(F.transform(a, lambda g, i: g / F.log2(i + F.lit(2.0))), F.lit(0.0), lambda x, y: x + y)
    ideal = total(F.reverse(F.array_sort(gains)))
    return F.when(ideal > 0, total(gains) / ideal).otherwise(F.lit(0.0))


def cleanliness(statuses: Column, bad: tuple[str, ...] = ("stale", "future_invalid", "temporally_ambiguous")) -> Column:
    """1 less the shares of bad statuses in a list; null if it is empty (O187)."""
    return F.when(F.size(statuses) > 0, 1 - F.size(F.filter(statuses, lambda s: s.isin(*bad))) / F.size(statuses))


def evidence_tiers(rows: DataFrame, wins: str, losses: str, macro: str, name: str) -> DataFrame:
    """Metrics by falling wins, then losses, falling macro score and name (O082). One row a metric: the window is small."""
    w = Window.orderBy(F.col(wins).desc(), F.col(losses), F.col(macro).desc(), name)
    return rows.withColumn("tier", F.row_number().over(w))


def update_pair_faults(rows: DataFrame, pair: str, version: str, answer: str, declared: str) -> DataFrame:
    """Pairs without exactly one row of versions 0 and 1 each, or whose answer changes other than declared (O244)."""
    one = lambda v: F.sum((F.col(version) == v).cast("int"))
    g = rows.groupBy(pair).agg(one(0).alias("a"), one(1).alias("b"), (F.min(answer) != F.max(answer)).alias("changed"), F.max(declared).alias("declared"))
    fault = F.when((F.col("a") != 1) | (F.col("b") != 1), "not_a_pair").when(F.col("changed") != F.col("declared"), "undeclared_change")
    return g.select(pair, fault.alias("fault")).where("fault IS NOT NULL")


def scored_once(chunks: DataFrame, claims: DataFrame, group: str, a: str, b: str, score) -> DataFrame:
    """Every (chunk, claim) of a group with its score, which is computed once for each distinct pair of texts (O142)."""
    every = chunks.join(claims, group)
    once = every.select(a, b).distinct().withColumn("score", score(F.col(a), F.col(b)))
    return every.join(once, [a, b])


def alignment_faults(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of two score files that are absent on a side or repeated (O292); none: they can be joined row by row."""
    n = lambda df, c: df.groupBy(key).agg(F.count("*").alias(c))
    j = n(a, "x").join(n(b, "y"), key, "full")
    fault = F.when(F.col("x").isNull() | F.col("y").isNull(), "missing").when((F.col("x") > 1) | (F.col("y") > 1), "repeated")
    return j.select(key, fault.alias("fault")).where("fault IS NOT NULL")


def matrix(rows: DataFrame, names: dict[str, tuple]) -> DataFrame:
    """Each row with every combination of the given settings: an explode for each setting, sized by the settings (O298)."""
    for name, values in names.items():
        rows = rows.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return rows
