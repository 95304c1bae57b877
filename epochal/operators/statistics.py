"""Correlation, ranking, calibration, agreement and resampling statistics (O067, O074-O076, O192-O213).

All take groups by columns and return one row per group, null where a statistic is undefined. Group aggregates only: no pairs
of rows are formed except between distinct values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def mid_rank(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Average rank of ties (O067): a window over the counts of distinct values, joined back to the rows."""
    keys = [*by, value]
    up_to = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    ranks = counts.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), (F.coalesce(F.sum("__n").over(up_to), F.lit(0)) + (F.col("__n") + 1) / F.lit(2.0)).alias(name))
    same = [df[k].eqNullSafe(ranks[f"__k{i}"]) for i, k in enumerate(keys)]
    return df.join(ranks, same).drop(*(f"__k{i}" for i in range(len(keys))))


def guarded_corr(a: str, b: str) -> Column:
    """Pearson; null for under two rows or a constant side (O192)."""
    fine = (F.count("*") > 1) & (F.max(a) > F.min(a)) & (F.max(b) > F.min(b))
    return F.when(fine, F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    r = mid_rank(mid_rank(df, by, a, "__a"), by, b, "__b")
    return r.groupBy(*by).agg(guarded_corr("__a", "__b").alias("spearman"), guarded_corr(a, b).alias("pearson"), F.count("*").alias("n"))


def kendall_tau_b(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """tau-b from counts of distinct value pairs (O193): rows are pre-aggregated, so only distinct pairs are compared."""
    cells = df.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    l, r = cells.alias("l"), cells.alias("r")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by] or [F.lit(True)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    pairs = l.join(r, cond & (F.col("l.a") < F.col("r.a")))
    weight = F.col("l.n") * F.col("r.n")
    signed = pairs.groupBy(*(F.col(f"l.{c}").alias(c) for c in by)).agg(F.sum(weight * F.signum(F.col("r.b") - F.col("l.b"))).alias("s"))
    pairs_of = lambda col, name: cells.groupBy(*by, col).agg(F.sum("n").alias("m")).groupBy(*by).agg(F.sum(F.col("m") * (F.col("m") - 1) / 2).alias(name))
    n = cells.groupBy(*by).agg(F.sum("n").alias("n"))
    out = n.join(pairs_of("a", "ta"), by).join(pairs_of("b", "tb"), by).join(signed, by, "left")
    n0 = F.col("n") * (F.col("n") - 1) / 2
    below = F.sqrt((n0 - F.col("ta")) * (n0 - F.col("tb")))
    return out.select(*by, F.when(below > 0, F.coalesce("s", F.lit(0.0)) / F.nullif(below, F.lit(0.0))).alias("tau_b"))


def auroc(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Mann-Whitney form on mid-ranks; null without both classes (O194, O212)."""
    r = mid_rank(df, by, score, "__r")
    pos = F.sum(F.col(label).cast("double"))
    neg = F.count("*") - pos
    area = (F.sum(F.when(F.col(label) == 1, F.col("__r")).otherwise(0.0)) - pos * (pos + 1) / 2) / F.nullif(pos * neg, F.lit(0.0))
    return r.groupBy(*by).agg(area.alias("auroc"))


def score_blocks(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """One row per distinct score, with sums over all scores at least as high (O074)."""
    g = df.groupBy(*by, F.col(score).alias("score")).agg(F.count("*").cast("double").alias("n"), F.sum(F.col(label).cast("double")).alias("pos"))
    w = Window.partitionBy(*by).orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("cum_n", F.sum("n").over(w)).withColumn("cum_pos", F.sum("pos").over(w))


def average_precision(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Tie-blocked average precision (O195)."""
    total = F.nullif(F.sum("pos"), F.lit(0.0))
    return score_blocks(df, by, score, label).groupBy(*by).agg((F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")) / total).alias("average_precision"))


def aurc(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Area under the risk-coverage curve; rows of a block share its error evenly (O209)."""
    b = score_blocks(df, by, score, label)
    before, err = F.col("cum_n") - F.col("n"), F.col("n") - F.col("pos")
    err_before = before - (F.col("cum_pos") - F.col("pos"))
    risk = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.lit(0.0), lambda s, i: s + (err_before + i * err / F.col("n")) / (before + i))
    return b.groupBy(*by).agg((F.sum(risk) / F.sum("n")).alias("aurc"))


def calibration(df: DataFrame, by: list[str], score: str, label: str, tie: str, bins: int = 10) -> DataFrame:
    """Brier, MAE, ECE over bins of equal counts (rows ordered by score, then tie) and of equal width (O075, O209, O210)."""
    w = Window.partitionBy(*by)
    s, y = F.col(score).cast("double"), F.col(label).cast("double")
    n = F.count("*").over(w)
    b = F.least(F.lit(bins), F.greatest(F.lit(1), F.floor(n / 10)))
    place = F.row_number().over(w.orderBy(score, tie)) - 1
    # bin i holds rows [i n // b, (i + 1) n // b): the bin of a row is the largest i with i n // b <= row
    rows = df.select(*by, s.alias("s"), y.alias("y"), place.alias("row"), n.alias("n"), b.alias("b"))
    rows = rows.withColumn("equal", F.floor(((F.col("row") + 1) * F.col("b") - 1) / F.col("n"))).withColumn("wide", F.least(F.floor(F.col("s") * bins), F.lit(bins - 1)))
    base = rows.groupBy(*by).agg(F.avg((F.col("s") - F.col("y")) * (F.col("s") - F.col("y"))).alias("brier"), F.avg(F.abs(F.col("s") - F.col("y"))).alias("mae"))

    def ece(column: str, name: str) -> DataFrame:
        g = rows.groupBy(*by, column).agg(F.count("*").alias("k"), F.abs(F.avg("s") - F.avg("y")).alias("gap"), F.first("n").alias("n"))
        return g.groupBy(*by).agg(F.sum(F.col("k") / F.col("n") * F.col("gap")).alias(name))

    return base.join(ece("equal", "ece_equal_count"), by).join(ece("wide", "ece_equal_width"), by)


def risk_coverage(df: DataFrame, by: list[str], confidence: str, correct: str, thresholds=(0.5, 0.6, 0.7, 0.8, 0.9, 0.95)) -> DataFrame:
    """Coverage and risk at each threshold (O211): a row is exploded to the thresholds that it passes, and counted."""
    t = F.filter(F.array(*map(F.lit, thresholds)), lambda x: x <= F.col(confidence))
    total = df.groupBy(*by).agg(F.count("*").alias("total"))
    g = df.select(*by, correct, F.explode(t).alias("threshold")).groupBy(*by, "threshold").agg(F.count("*").alias("covered"), F.avg(1.0 - F.col(correct)).alias("risk"))
    return g.join(total, by).select(*by, "threshold", (F.col("covered") / F.col("total")).alias("coverage"), "risk")


def kappas(df: DataFrame, by: list[str], gold: str, predicted: str, rank: dict[str, int] | None = None) -> DataFrame:
    """Cohen's kappa and, with ranks of the labels, the quadratic-weighted one (O206), from confusion counts."""
    c = df.groupBy(*by, F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count("*").cast("double").alias("n"))
    n = c.groupBy(*by).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0.0)).alias("agree"))
    rows, cols = c.groupBy(*by, "g").agg(F.sum("n").alias("rn")), c.groupBy(*by, "p").agg(F.sum("n").alias("cn"))
    place = F.create_map(*(F.lit(x) for kv in (rank or {}).items() for x in kv)) if rank else None
    weight = (lambda a, b: (place[a] - place[b]) * (place[a] - place[b])) if rank else (lambda a, b: F.lit(0.0))
    expected = rows.join(cols, by).groupBy(*by).agg(
        F.sum(F.when(F.col("g") == F.col("p"), F.col("rn") * F.col("cn")).otherwise(0.0)).alias("chance"), F.sum(weight(F.col("g"), F.col("p")) * F.col("rn") * F.col("cn")).alias("w_expected")
    )
    seen = c.groupBy(*by).agg(F.sum(weight(F.col("g"), F.col("p")) * F.col("n")).alias("w_seen"))
    j = n.join(expected, by).join(seen, by)
    po, pe = F.col("agree") / F.col("total"), F.col("chance") / (F.col("total") * F.col("total"))
    out = [F.when(pe < 1, (po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa")]
    if rank:
        out.append(F.when(F.col("w_expected") > 0, 1 - F.col("w_seen") * F.col("total") / F.nullif(F.col("w_expected").cast("double"), F.lit(0.0))).alias("quadratic_kappa"))
    return j.select(*by, *out)


def per_class(df: DataFrame, by: list[str], gold: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of each class; a zero divisor gives 0 (O062, O207)."""
    both = df.select(*by, F.explode(F.array_distinct(F.array(gold, predicted))).alias("label"), F.col(gold).alias("g"), F.col(predicted).alias("p"))
    tp = F.sum(((F.col("g") == F.col("label")) & (F.col("p") == F.col("label"))).cast("double"))
    g, p = F.sum((F.col("g") == F.col("label")).cast("double")), F.sum((F.col("p") == F.col("label")).cast("double"))
    a = both.groupBy(*by, "label").agg(tp.alias("tp"), g.alias("support"), p.alias("n_predicted"))
    over = lambda x, y: F.coalesce(x / F.nullif(y, F.lit(0.0)), F.lit(0.0))
    pr, re = over(F.col("tp"), F.col("n_predicted")), over(F.col("tp"), F.col("support"))
    return a.select(*by, "label", pr.alias("precision"), re.alias("recall"), over(2 * pr * re, pr + re).alias("f1"), F.col("support").cast("long").alias("support"))


def krippendorff(df: DataFrame, by: list[str], unit: str, label: str, rank: dict[str, int]) -> DataFrame:
    """Alpha with distance 0, ((rank difference) / 2)^2 for ranked labels, else 1; units with two labels or more (O130, O208).

    Observed and expected disagreement come from counts of labels per unit and overall: no pairs of raters are formed.
    """
    place = F.create_map(*(F.lit(x) for kv in rank.items() for x in (kv[0], float(kv[1]))))

    def distance(a: Column, b: Column) -> Column:
        d = (place[a] - place[b]) / 2
        return F.when(a == b, 0.0).otherwise(F.coalesce(d * d, F.lit(1.0)))

    per = df.groupBy(*by, unit, F.col(label).alias("l")).agg(F.count("*").cast("double").alias("n"))
    per = per.withColumn("m", F.sum("n").over(Window.partitionBy(*by, unit))).where("m > 1")
    other = per.select(*by, unit, F.col("l").alias("l2"), F.col("n").alias("n2"))
    seen = per.join(other, [*by, unit]).groupBy(*by).agg(F.sum(F.col("n") * F.col("n2") * distance(F.col("l"), F.col("l2")) / (F.col("m") - 1)).alias("seen"))
    counts = per.groupBy(*by, "l").agg(F.sum("n").alias("n"))
    second = counts.select(*by, F.col("l").alias("l2"), F.col("n").alias("n2"))
    expected = counts.join(second, by).groupBy(*by).agg(F.sum(F.col("n") * F.col("n2") * distance(F.col("l"), F.col("l2"))).alias("expected"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    t = F.col("total")
    do, de = F.col("seen") / t, F.col("expected") / (t * (t - 1))
    return seen.join(expected, by).join(total, by).select(*by, F.when(de > 0, 1 - do / F.nullif(de, F.lit(0.0))).when(do == 0, 1.0).alias("alpha"))


def wilson(successes: Column, total: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson interval, clamped, four decimals (O205)."""
    n = total.cast("double")
    p = successes / n
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = (centre - half) / (1 + z * z / n), (centre + half) / (1 + z * z / n)
    return F.round(F.greatest(F.lit(0.0), low), 4), F.round(F.least(F.lit(1.0), high), 4)


def holm(df: DataFrame, by: list[str], name: str, p: str) -> DataFrame:
    """Step-down adjusted p-values (O076, O204)."""
    w = Window.partitionBy(*by).orderBy(p, name)
    m = F.count("*").over(Window.partitionBy(*by))
    raw = F.least(F.lit(1.0), F.col(p) * (m - F.row_number().over(w) + 1))
    return df.withColumn("__raw", raw).withColumn("adjusted", F.max("__raw").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__raw")


def mcnemar_counts(df: DataFrame, by: list[str], left: str, right: str) -> DataFrame:
    """Discordant counts and the exact two-sided binomial p-value (O203): a sum of built-in log-gamma terms is not to be had in
    SQL functions, so the tail is summed by the ratio of neighbouring terms.
    """
    only = lambda a, b: F.sum(((F.col(a) == 1) & (F.col(b) == 0)).cast("long"))
    g = df.groupBy(*by).agg(only(left, right).alias("left_only"), only(right, left).alias("right_only"))
    n, k = F.col("left_only") + F.col("right_only"), F.least("left_only", "right_only")
    terms = F.aggregate(
        F.sequence(F.lit(0), k.cast("int")), F.struct((-n * F.lit(float(np.log(2)))).alias("t"), F.lit(0.0).alias("s")),
        lambda a, i: F.struct((a["t"] + F.log((n - i) / (i + 1.0) + F.lit(1e-300))).alias("t"), (a["s"] + F.exp(a["t"])).alias("s")),
    )["s"]
    return g.select(*by, "left_only", "right_only", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * terms)).alias("p_value"))


def percentile_interval(value: str) -> Column:
    """2.5 and 97.5 percentiles by linear interpolation (O200)."""
    return F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))


def nearest_rank(value: str, q: float) -> Column:
    """ordered[ceil(q n) - 1] (O064), from counts of distinct values, which combine before the shuffle."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")


def cluster_bootstrap(df: DataFrame, by: list[str], cluster: str, value: str, samples: int = 2000, seed: int = 20260813) -> DataFrame:
    """Percentile interval of the mean when clusters are drawn with replacement (O197, O198).

    Rows are summed to one row per cluster before anything is gathered; only these meet in the group's task.
    """
    sums = df.groupBy(*by, cluster).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count(value).cast("double").alias("n"))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(cluster)
        s, n = pdf["s"].to_numpy(), pdf["n"].to_numpy()
        rng = np.random.default_rng(seed)
        means = []
        for _ in range(0, samples, 64):
            w = rng.multinomial(len(s), np.full(len(s), 1 / len(s)), size=64)
            means.append((w @ s) / np.maximum(w @ n, 1e-300))
        low, high = np.percentile(np.concatenate(means)[:samples], [2.5, 97.5])
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "mean": [s.sum() / n.sum()], "low": [low], "high": [high], "clusters": [len(s)]})

    return sums.groupBy(*by).applyInPandas(draw, f"{kinds}, mean double, low double, high double, clusters long")


def sign_flip_test(df: DataFrame, by: list[str], cluster: str, value: str, samples: int = 10_000, seed: int = 20260813) -> DataFrame:
    """Two-sided permutation p-value of a mean difference under sign flips by cluster (O202): all patterns up to 16 clusters."""
    sums = df.groupBy(*by, cluster).agg(F.sum(F.col(value).cast("double")).alias("s"))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values(cluster)["s"].to_numpy()
        seen, k = abs(s.sum()), len(s)
        if k <= 16:
            signs = 1 - 2 * ((np.arange(1 << k)[:, None] >> np.arange(k)) & 1)
            p = float((np.abs(signs @ s) >= seen - 1e-12).mean())
        else:
            rng = np.random.default_rng(seed)
            hits = sum(int((np.abs((1 - 2 * rng.integers(0, 2, (500, k))) @ s) >= seen - 1e-12).sum()) for _ in range(samples // 500))
            p = (hits + 1) / (samples // 500 * 500 + 1)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "p_value": [p], "clusters": [k]})

    return sums.groupBy(*by).applyInPandas(test, f"{kinds}, p_value double, clusters long")


def paired_difference(df: DataFrame, by: list[str], unit: str, system: str, value: str) -> DataFrame:
    """Mean difference, wins and ties of every two systems on the units that both have (O038, O214, O257)."""
    a = df.select(*by, unit, F.col(system).alias("left"), F.col(value).alias("x"))
    b = df.select(*by, unit, F.col(system).alias("right"), F.col(value).alias("y"))
    j = a.join(b, [*by, unit]).where(F.col("left") < F.col("right"))
    return j.groupBy(*by, "left", "right").agg(
        F.count("*").alias("n"), F.avg(F.col("x") - F.col("y")).alias("difference"), F.sum((F.col("x") > F.col("y")).cast("long")).alias("wins"),
        F.sum((F.col("x") == F.col("y")).cast("long")).alias("ties"),
    )
