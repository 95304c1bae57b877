"""URL filters: path-aware allow and block rules, then an empirical-Bayes reputation of hosts. DataFrame functions only.

Labelled page outcomes (1 good, 0 bad) are counted per host, and shrunk through beta-binomial priors along
host -> registered domain (last two labels) -> suffix (last label) -> all. At each level the prior's mean is the parent's
posterior mean, and its weight is fitted by moments from the spread of the nodes of that level. A host is blocked if the
upper bound of its posterior good rate is below ``min_good``: only hosts that are bad beyond doubt go.

Outcomes are counted with map-side partial sums, so a hot host is no hot task; only the host table (one row per host) is
carried further. Its join with the pages is a broadcast up to a checked number of rows, else a shuffled join that adaptive
execution splits where a host is hot.

Null urls and urls without ``://`` have empty host and path; an empty host is a host like any other. A host without outcomes
has the posterior of its nearest ancestor. Repeated rows each count. Without any outcome nothing is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.llm._spark import LOWER, UPPER, cut, free, small, table

#: Fixed values: (verdict, rule), a rule being host and path.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: A host goes if the posterior good rate's mean plus Z standard deviations is below MIN_GOOD.
Z, MIN_GOOD = 1.645, 0.5
_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"


def split_url(url: Column) -> tuple[Column, Column]:
    safe = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(safe, _URL, 1), UPPER, LOWER), F.regexp_extract(safe, _URL, 2)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, r in sorted(rules, key=lambda x: len(x[1])):  # a later, longer rule wins
        h, slash, p = r.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _shrunk(nodes: DataFrame, parent_mean: Column, by: str) -> DataFrame:
    """Posterior of each node (n, k) under Beta(w m, w (1 - m)): m the parent's mean, w fitted by moments over the level."""
    m = nodes.withColumn("m", parent_mean)
    v = F.col("m") * (1 - F.col("m"))
    rate = F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(F.col("m"))
    fit = m.agg(
        (
            F.sum(F.when(F.col("n") > 0, F.col("n") * (rate - F.col("m")) * (rate - F.col("m")) - v))
            / F.sum(F.when(F.col("n") > 1, (F.col("n") - 1) * v))
        ).alias("rho")
    ).select(F.least(F.greatest(F.coalesce("rho", F.lit(0.01)), F.lit(0.001)), F.lit(0.999)).alias("rho"))
    w = 1 / fit.scalar() - 1
    return (
        m.withColumn("w", w)
        .withColumn("mean", (F.col("k") + F.col("w") * F.col("m")) / (F.col("n") + F.col("w")))
        .withColumn("weight", F.col("n") + F.col("w"))
        .drop("m", "w")
    )


def reputation_host(host: Column) -> Column:
    """The host without user info and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def host_reputation(pages: DataFrame, host: str, outcome: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """One row per host: n, k, mean and weight of the posterior good rate, and its upper bound.

    The bound is the normal approximation of the beta posterior's quantile: mean + Z standard deviations.

    ``outcome`` is 1, 0 or null (unlabelled).
    """
    o, labels = F.col(f"`{outcome}`"), F.lit(1)
    for s in sorted(suffixes, key=lambda s: s.count(".")):  # the longest that fits
        labels = F.when((F.col("host") == s) | F.col("host").endswith(f".{s}"), s.count(".") + 1).otherwise(labels)
    hosts = cut(
        pages.groupBy(F.col(f"`{host}`").alias("host"))
        .agg(F.count(o).cast("double").alias("n"), F.coalesce(F.sum(o), F.lit(0)).cast("double").alias("k"))
        .withColumn("labels", labels)
        .withColumn("domain", F.expr("substring_index(host, '.', -labels - 1)"))
        .withColumn("suffix", F.expr("substring_index(host, '.', -labels)"))
        .drop("labels")
    )
    total = hosts.agg(((F.sum("k") + 1) / (F.sum("n") + 2)).alias("m")).select(F.coalesce("m", F.lit(0.5)))
    sums = lambda *by: hosts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = _shrunk(sums("suffix"), total.scalar(), "suffix").select("suffix", F.col("mean").alias("suffix_mean"))
    domains = _shrunk(sums("suffix", "domain").join(suffixes, "suffix"), F.col("suffix_mean"), "domain")
    domains = domains.select("domain", F.col("mean").alias("domain_mean"))
    out = _shrunk(hosts.join(domains, "domain"), F.col("domain_mean"), "host")
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return cut(out.select("host", "n", "k", "mean", "weight", (F.col("mean") + Z * sd).alias("upper")))


def judge_urls(pages: DataFrame, url: str = "url", outcome: str | None = None, rules=RULES, min_good: float = MIN_GOOD, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Add host, path, rule, verdict, good_mean and good_upper to every page.

    ``outcome``: a column of labelled outcomes; None: the pages that the rules decide are the labelled ones (allowed: good,
    blocked: bad). ``suffixes``: public suffixes of several labels (as "co.uk"), below which domains are registered; the default has
    none, so that a suffix is the last label. User info and ports are no part of a reputation's host. Columns of the names added are
    replaced; others pass through.
    """
    mine = {"host", "path", "rule", "verdict", "good_mean", "good_upper"}
    rest = [c for c in pages.columns if c.lower() not in mine]
    h, p = split_url(F.col(f"`{url}`"))
    read = pages.select(*(F.col(f"`{c}`") for c in rest), h.alias("host"), p.alias("path"))
    rule, said = matched_rule(F.col("host"), F.col("path"), rules)
    by_rule, label, key = free(pages.columns, "__said", "__known", "__key")
    read = read.withColumns({"rule": rule, by_rule: said}).withColumn(key, reputation_host(F.col("host")))
    known = F.when(F.col(by_rule) == "allow", 1).when(F.col(by_rule) == "block", 0) if outcome is None else F.col(f"`{outcome}`")
    reputation = host_reputation(read.withColumn(label, known).select(key, label), key, label, suffixes)
    judged = read.join(
        small(reputation.select(F.col("host").alias(key), F.col("mean").alias("good_mean"), F.col("upper").alias("good_upper"))), key, "left"
    )
    own = F.when(F.col("good_upper") < min_good, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        *(F.col(f"`{c}`") for c in rest), "host", "path", "rule", F.coalesce(by_rule, own).alias("verdict"), "good_mean", "good_upper"
    )


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def _fit_sql(name: str, nodes: str, mean: str) -> str:
    return f"""{name}_r AS (
  SELECT least(greatest(coalesce(sum(CASE WHEN n > 0 THEN n * (k / n - {mean}) * (k / n - {mean}) - {mean} * (1 - {mean}) END)
    / sum(CASE WHEN n > 1 THEN (n - 1) * {mean} * (1 - {mean}) END), 0.01), 0.001), 0.999) AS rho FROM {nodes}),
{name}_p AS (SELECT x.*, (k + (1 / rho - 1) * {mean}) / (n + (1 / rho - 1)) AS mean, n + (1 / rho - 1) AS weight FROM {nodes} x, {name}_r)"""


_RULE_SQL = [(v, r, *r.partition("/")) for v, r in sorted(RULES, key=lambda x: -len(x[1]))]
_FITS = [(v, r, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{s}{p}')") for v, r, h, s, p in _RULE_SQL]
OP10_SQL = f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
s AS (SELECT page_id, translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM u),
r AS (SELECT *, CASE {" ".join(f"WHEN {f} THEN '{r}'" for _, r, f in _FITS)} END AS rule,
  CASE {" ".join(f"WHEN {f} THEN '{v}'" for v, _, f in _FITS)} END AS said FROM s),
h AS (SELECT host, split_part(host, '.', -1) AS suffix,
  array_to_string(string_split(host, '.')[-2:], '.') AS domain,
  CAST(count(said) AS DOUBLE) AS n, CAST(coalesce(sum(CASE said WHEN 'allow' THEN 1 WHEN 'block' THEN 0 END), 0) AS DOUBLE) AS k
  FROM (SELECT regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS host, said FROM r) GROUP BY host),
t AS (SELECT coalesce((sum(k) + 1) / (sum(n) + 2), 0.5) AS m FROM h),
s1 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(m) AS m FROM h, t GROUP BY suffix),
{_fit_sql("sx", "s1", "m")},
d1 AS (SELECT h.suffix, h.domain, sum(h.n) AS n, sum(h.k) AS k, any_value(sx_p.mean) AS m FROM h JOIN sx_p USING (suffix) GROUP BY h.suffix, h.domain),
{_fit_sql("dx", "d1", "m")},
h1 AS (SELECT h.host, h.n, h.k, dx_p.mean AS m FROM h JOIN dx_p USING (domain)),
{_fit_sql("hx", "h1", "m")}
SELECT page_id, r.host, path, rule, coalesce(said, CASE WHEN mean + {Z} * sqrt(mean * (1 - mean) / (weight + 1)) < {MIN_GOOD} THEN 'block' ELSE 'allow' END) AS verdict
FROM r JOIN hx_p ON regexp_replace(regexp_replace(r.host, '^.*@', ''), ':[0-9]*$', '') = hx_p.host
"""
