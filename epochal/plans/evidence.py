"""Queries of the evidence and guard operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochal.functions import text as T
from epochal.operators import evidence as E
from epochal.operators import guards as G
from epochal.plans.evaluation import _RATINGS_SQL, _SCORED_SQL, _ratings, _rounded, _scored
from epochal.sources.views import FACTS_ORDERS_SQL, PROGRAMS_SQL, facts_orders, programs, table

#: Answers that the queries of responses deal to conversations; the text of the turn follows every second one.
ANSWERS = (
    "It cannot be determined.", "There is insufficient evidence", "The evidence provided here is not sufficient to answer.", "unknown", "The answer is unknown.",
    "Ada held the office until May 1999, but the end is not stated.", "Ada, who held the office (the evidence is missing).", "No definitive answer exists. Ada held the office from 1990.",
    "The sources do not clearly state it", "Ada and Bob, first and last", "Which two: Ada, Bob?", "It remains unknown however", "The value is 12", "We were unable to answer.",
)


def _dealt(c):
    i = F.pmod(F.col("conv_id") * 3 + F.col("turn"), F.lit(len(ANSWERS))).cast("int")
    said = F.element_at(F.array(*map(F.lit, ANSWERS)), i + 1)
    return F.when(F.pmod(c, F.lit(2)) == 0, F.concat(said, F.lit(" "), F.col("text"))).otherwise(said)


_DEALT_SQL = "CASE WHEN conv_id % 2 = 0 THEN said || ' ' || text ELSE said END"
_ANSWERS_SQL = "[" + ", ".join("'" + a.replace("'", "''") + "'" for a in ANSWERS) + "]"
_CONV_SQL = f"c AS (SELECT conv_id, turn, role, text, ({_ANSWERS_SQL})[(conv_id * 3 + turn) % {len(ANSWERS)} + 1] AS said FROM conversations), a AS (SELECT conv_id, turn, role, text, {_DEALT_SQL} AS answer FROM c)"


def _asked(spark, sf_dir):
    """Facts of each program's context; programs of every fourth context have no date."""
    p = programs(spark, sf_dir)
    p = p.withColumn("q_start", F.when(F.col("context_id") % 4 != 0, F.col("q_start")))
    f = facts_orders(spark, sf_dir).select("context_id", "fact_id", "start", "end")
    return p.select("context_id", "qid", "operator", "q_start", "q_end").join(f, "context_id")


_ASKED_SQL = f"""{FACTS_ORDERS_SQL}, {PROGRAMS_SQL}, k AS (SELECT qid, operator, CASE WHEN p.context_id % 4 <> 0 THEN q_start END AS qs, q_end AS qe, fact_id, "start" AS s, "end" AS e, coalesce("end", DATE '9999-12-31') AS l FROM programs p JOIN facts f ON f.context_id = p.context_id)"""


def compatibility_scores(spark, sf_dir):
    return E.compatibility(_asked(spark, sf_dir), ("context_id", "qid")).select("qid", "fact_id", F.round("compatibility", 6).alias("compatibility"))


def evidence_assessment(spark, sf_dir):
    p = _asked(spark, sf_dir).where("q_start IS NOT NULL")
    return E.assessed(p, ("context_id", "qid")).select("qid", "fact_id", "exact", F.round("near", 6).alias("near"), F.round("compatibility", 6).alias("compatibility"), "status")


def response_kinds(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("answer", _dealt(F.col("conv_id")))
    return c.select("conv_id", "turn", T.is_refusal(F.col("answer")).alias("refusal"), T.response_kind(F.col("answer")).alias("kind"))


def annotation_complexity(spark, sf_dir):
    """Conversations as cards: the first turn asks, an answer is dealt, all turns are evidence."""
    c = table(spark, sf_dir, "conversations").withColumn("answer", _dealt(F.col("conv_id")))
    g = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"), F.min_by("answer", "turn").alias("answer"), F.collect_list(F.struct("text", F.col("turn").alias("time"))).alias("evidence"))
    q = F.concat(F.when(F.col("conv_id") % 3 == 0, "In which document revision? ").when(F.col("conv_id") % 3 == 1, "What was it during 1999? ").otherwise("Name all, latest first: "), F.col("first"))
    score = G.complexity((F.col("conv_id") % 6).cast("int"), F.col("evidence"), (F.col("conv_id") % 3).cast("int"), (F.col("conv_id") % 5).cast("int"), q, F.col("answer"))
    return g.select("conv_id", score.cast("int").alias("complexity"))


def span_overlaps(spark, sf_dir):
    """Windows of 200 characters against two marked spans of each document."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("n"))
    a, b = (F.pmod(F.col("doc_id") * k, F.greatest(F.col("n"), F.lit(1)).cast("long")) for k in (7, 31))
    spans = F.array(F.struct(a.alias("start"), (a + 25).alias("end"), F.lit(False).alias("implicit")), F.struct(b.alias("start"), (b + 40).alias("end"), (F.col("doc_id") % 2 == 0).alias("implicit")))
    w = d.withColumn("spans", spans).withColumn("i", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.col("n") - 1, F.lit(0)) / 200).cast("int"))))
    hit = E.overlapping(F.col("spans"), F.col("i") * 200, F.col("i") * 200 + 200)
    return w.select("doc_id", "i", (F.size(hit) > 0).alias("unsupported"), F.exists(hit, lambda s: s["implicit"]).alias("excluded"))


def folded_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", E.folded(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


def json_id_scan(spark, sf_dir):
    """Ids in nested JSON made of order lines."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(F.concat(F.lit("E"), "l_partkey").alias("entity_id"), F.struct(F.concat(F.lit("S"), "l_suppkey").alias("source_id"), F.col("l_linestatus").alias("note")).alias("from")).alias("x"))
    j = l.groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list("x").alias("facts"))).alias("json"))
    ids = E.json_ids(F.col("json"), ("entity_id", "source_id"))
    return j.select("l_orderkey", F.size(ids).cast("long").alias("n"), F.array_join(ids, ",").alias("ids"))


def evidence_lists(spark, sf_dir):
    """Retrieved lines (to 4) and cited ones (from 3) by supplier; some give another text."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 3).alias("item"), F.concat("l_returnflag", "l_linestatus").alias("text"))
    cited = l.where("l_linenumber >= 3").withColumn("side", F.lit(1))
    return E.evidence_union(l.where("l_linenumber <= 4").withColumn("side", F.lit(0)).unionByName(cited), "l_orderkey", "item", "text", ["side", "l_linenumber", "text"])


def claims_deduped(spark, sf_dir):
    return E.claims_once(facts_orders(spark, sf_dir), ["context_id", "answer_id", "start", "end"], "fact_id")


def irrelevant_facts(spark, sf_dir):
    f = facts_orders(spark, sf_dir)
    used = f.where("start <= DATE'1998-06-15' AND coalesce(end, DATE'9999-12-31') >= DATE'1998-06-15'")
    return E.irrelevant(f, used.select("context_id", "fact_id"), "context_id", "fact_id")


def path_validity(spark, sf_dir):
    """The lines of an order as a path over suppliers; every third one's nodes are in another order."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey"))).alias("x"))
    n = F.transform("x", lambda x: x["l_suppkey"])
    edges = F.transform(F.slice(n, 2, F.size(n)), lambda s, i: F.struct(F.element_at(n, i + 1).alias("source"), s.alias("target")))
    nodes = F.when(F.col("l_orderkey") % 3 == 0, F.reverse(n)).otherwise(n)
    return l.select("l_orderkey", E.path_valid(nodes, edges).alias("valid"))


def score_guards(spark, sf_dir):
    s = _scored(spark, sf_dir).select("doc_id", F.expr("stack(3, 'bertscore_f1', 2 * s - 1.01, 'rouge_l', s * 1.02, 'bleu', CASE WHEN doc_id % 11 = 0 THEN double('NaN') ELSE s END) AS (metric, score)"))
    m, x = F.col("metric"), F.col("score")
    return _rounded(s.groupBy("metric", G.score_fault(m, x).alias("fault")).agg(F.count("*").alias("n"), F.avg(G.unit_score(m, x)).alias("mean")))


def best_references(spark, sf_dir):
    return G.best_reference(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", ["l_discount", "l_tax"])


def gold_filtered(spark, sf_dir):
    """Labels of each unit as a map, without those of rater 2 and without undecidable ones."""
    r = _ratings(spark, sf_dir).groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct(F.col("rater").cast("string"), "label"))).alias("gold"))
    kept = F.map_filter("gold", lambda k, v: (k != "2") & (v != "cannot_judge"))
    return r.select("unit", F.size(kept).cast("long").alias("kept"), F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("raters"))


def metadata_leaks(spark, sf_dir):
    return G.leaks(table(spark, sf_dir, "documents"), F.coalesce("text", F.lit("")), ("the", "http", "license", "@", "gold_answer"))


def text_hygiene(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("t"))
    return p.select(F.explode(G.hygiene(F.col("t"))).alias("fault")).groupBy("fault").agg(F.count("*").alias("n"))


def binary_evaluation(spark, sf_dir):
    return _rounded(G.binary_summary(_scored(spark, sf_dir), ["lang"], "s", "y"))


def correlation_summaries(spark, sf_dir):
    return _rounded(G.correlation_summary(_scored(spark, sf_dir).withColumn("z", F.col("y").cast("double")), ["lang", "source"], "s", "z"))


def _comparison(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_discount")
    a = l.where("l_linenumber = 1").select("l_orderkey", "l_returnflag", F.when(F.col("l_orderkey") % 9 != 0, F.col("l_discount")).alias("better"))
    return a.join(l.where("l_linenumber = 2").select("l_orderkey", F.col("l_discount").alias("worse")), "l_orderkey")


def directional_summaries(spark, sf_dir):
    return _rounded(G.directional_summary(_comparison(spark, sf_dir), "l_returnflag", "better", "worse"))


def dominance_decisions(spark, sf_dir):
    """Flags compared by the mean margin of discounts and a normal lower bound."""
    m = F.col("better") - F.col("worse")
    c = _comparison(spark, sf_dir).groupBy("l_returnflag").agg(F.count("*").alias("pairs"), (F.count(m) / F.count("*")).alias("coverage"), (F.avg(m) - 1.96 * F.stddev(m) / F.sqrt(F.count(m))).alias("lower"))
    return _rounded(G.dominance(c.withColumn("p_holm", F.lit(0.01)), least_coverage=0.85).drop("p_holm"))


def pair_declarations(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_type")
    q = p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.lit("B")).otherwise(F.col("p_brand")).alias("p_brand"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).alias("p_size"), "p_type", F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("p_brand"))).otherwise(F.array(F.lit("p_size"))).alias("declared"))
    return G.undeclared(p, q, "p_partkey", "declared").select("p_partkey", F.array_join("undeclared", ",").alias("undeclared"))


def support_pointers(spark, sf_dir):
    """Pointers of a rating to shown evidence 1 to 4; some point elsewhere."""
    r = _ratings(spark, sf_dir).withColumn("p", F.array(F.pmod("unit", F.lit(6)), F.pmod(F.col("unit") + F.col("rater"), F.lit(4)) + 1))
    return G.unknown_pointers(r.withColumn("shown", F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))), "field", "p", "shown")


def label_lookup(spark, sf_dir):
    """A part's supplemental name if its key is even, else its own label if that is readable."""
    p = table(spark, sf_dir, "part").withColumn("label", F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("Q"), "p_partkey")).otherwise(F.col("p_type")))
    return p.select("p_partkey", F.coalesce(F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")), G.readable(F.col("label"))).alias("label"))


def audit_samples(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    order = F.sha2(F.concat(F.lit("audit:"), F.col("doc_id").cast("string")), 256)
    return G.audit_sample(d, "lang", F.col("n_chars"), F.col("doc_id"), 10, 25, order).select("lang", "why", "place", "doc_id")


def target_strata(spark, sf_dir):
    s = _scored(spark, sf_dir).select(F.array(F.col("s"), F.lit(1.0) - F.col("s"), F.abs(F.col("s") - 0.3)).alias("v"))
    return s.groupBy(G.stratum(F.col("v"), ("supports", "refutes", "neither")).alias("stratum")).agg(F.count("*").alias("n"))


def system_rankings(spark, sf_dir):
    g = _scored(spark, sf_dir).groupBy("source").agg(F.avg((F.col("s") >= 0.5).cast("double")).alias("rate"), F.avg("s").alias("partial"))
    return _rounded(G.system_ranking(_rounded(g), "rate", "partial", "source"))


def judge_stability(spark, sf_dir):
    a = _ratings(spark, sf_dir).withColumn("score", F.when(F.col("label") == "yes", 1.0).when(F.col("label") == "partial", 0.5).otherwise(0.0))
    return _rounded(G.stability(a.where("rater = 0").select("unit", "field", "score"), a.where("rater = 1"), "unit", "score", "field"))


def completion_minutes(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return e.select("user_id", F.round(G.minutes(F.col("a"), F.col("b")), 4).alias("minutes"))


def target_coverage(spark, sf_dir):
    """By field: labels, the raters that have some, and whether all three do."""
    g = _ratings(spark, sf_dir).where("label <> 'cannot_judge' AND (field = 'answer' OR rater <> 2)").groupBy("field").agg(F.count("*").alias("labels"), F.array_sort(F.collect_set("rater")).alias("r"))
    return g.select("field", "labels", F.array_join(F.transform("r", lambda x: x.cast("string")), ",").alias("available"), F.when(F.size("r") == 3, "covered").when(F.size("r") > 0, "diagnostic").otherwise("not_covered").alias("status"))


def package_hashes(spark, sf_dir):
    return G.package_hash(table(spark, sf_dir, "part"), "p_brand", F.sha2(F.concat_ws("|", F.col("p_partkey").cast("string"), "p_type"), 256))


def sensitivity_cohorts(spark, sf_dir):
    """Share of agreeing raters in all units, and without those of flagged sets."""
    r = _ratings(spark, sf_dir)
    j = r.where("rater = 0").select("unit", "label").join(r.where("rater = 1").select("unit", F.col("label").alias("other")), "unit")
    cohort = F.array_compact(F.array(F.lit("all"), F.when(F.col("unit") % 5 != 0, "without_review"), F.when(F.col("unit") % 7 != 0, "without_exclusion")))
    return _rounded(j.withColumn("cohort", F.explode(cohort)).groupBy("cohort").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("other")).cast("double")).alias("agreement")))


def label_conflicts(spark, sf_dir):
    """Units whose raters contradict each other: one says yes and another no."""
    p = _ratings(spark, sf_dir).groupBy("unit").agg(F.max((F.col("label") == "yes").cast("int")).alias("y"), F.max((F.col("label") == "no").cast("int")).alias("n"))
    return p.where("y = 1 AND n = 1").select("unit")


def disagreements(spark, sf_dir):
    """One row for each rater that differs from rater 0, in long form."""
    r = _ratings(spark, sf_dir)
    j = r.where("rater > 0").join(r.where("rater = 0").select("unit", F.col("label").alias("gold")), "unit")
    return j.where("label <> gold").select("unit", "rater", "gold", "label")


def update_behaviour(spark, sf_dir):
    """Two phenomena as columns, by field."""
    r = _ratings(spark, sf_dir).groupBy("field").pivot("rater", [0, 1]).agg(F.avg((F.col("label") == "yes").cast("double")))
    return _rounded(r.select("field", F.col("0").alias("before"), F.col("1").alias("after")))


def coverage_warnings(spark, sf_dir):
    """Order priorities that a customer's orders lack, counted."""
    o = table(spark, sf_dir, "orders")
    have = o.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("have"))
    every = o.agg(F.array_sort(F.collect_set("o_orderpriority")).alias("every"))
    missing = have.select(F.explode(F.array_except(every.scalar(), F.col("have"))).alias("missing"))
    return missing.groupBy("missing").agg(F.count("*").alias("customers"))


def applicable_fields(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("kind", T.response_kind(_dealt(F.col("conv_id"))))
    fields = F.array_compact(F.array(F.lit("response"), F.when(F.col("kind") != "refusal", "answer"), F.when(F.col("kind") != "answer", "refusal"), F.when(F.col("role") == "assistant", "citation")))
    return c.select(F.array_join(fields, ",").alias("fields")).groupBy("fields").agg(F.count("*").alias("n"))


def response_decisions(spark, sf_dir):
    """Ratings of a unit as support of its reference claims; some units are refusals."""
    v = F.when(F.col("label") == "yes", 1.0).when(F.col("label") == "partial", 0.5).when(F.col("label") == "no", 0.0)
    r = _ratings(spark, sf_dir).groupBy("unit").agg(F.collect_list(v).alias("v"))
    return r.select("unit", G.response_decision(F.col("v"), F.col("unit") % 4 == 0).alias("decision"))


def list_quality(spark, sf_dir):
    """Order lines as ranked lists: the discount is the gain, the flag the status."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_discount", "l_returnflag"))).alias("x"))
    gains, flags = F.transform("x", lambda x: x["l_discount"]), F.transform("x", lambda x: x["l_returnflag"])
    return l.select("l_orderkey", F.round(G.list_ndcg(gains), 6).alias("ndcg"), F.round(G.cleanliness(flags, ("R", "A")), 6).alias("cleanliness"))


def evidence_tiers(spark, sf_dir):
    g = _scored(spark, sf_dir).groupBy("source").agg(F.sum((F.col("s") > 0.6).cast("int")).alias("wins"), F.sum((F.col("s") < 0.4).cast("int")).alias("losses"), F.round(F.avg("s"), 6).alias("macro"))
    return G.evidence_tiers(g, "wins", "losses", "macro", "source")


def update_pairs_declared(spark, sf_dir):
    """Lines 1 and 2 of an order as its two versions; the flag is the answer."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("v"), "l_returnflag").where("v < 2").withColumn("d", F.col("l_orderkey") % 3 != 0)
    return G.update_pair_faults(l, "l_orderkey", "v", "l_returnflag", "d")


def pair_layout(spark, sf_dir):
    """Flags and statuses of an order's lines as chunks and claims."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    claims = l.select("l_orderkey", F.col("l_linenumber").alias("claim"), "l_linestatus")
    out = G.scored_once(l.drop("l_linestatus"), claims, "l_orderkey", "l_returnflag", "l_linestatus", lambda a, b: F.levenshtein(a, b))
    return out.groupBy("l_orderkey").agg(F.count("*").alias("pairs"), F.sum("score").alias("score"))


def alignment_faults(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    a = e.where("vec_id % 13 <> 0").unionByName(e.where("vec_id % 29 = 1"))
    return G.alignment_faults(a, e.where("vec_id % 17 <> 0"), "vec_id")


def experiment_matrix(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_name")
    return G.matrix(n, {"model": ("small", "large"), "seed": (11, 12, 13)})


_NAMES = """compatibility_scores evidence_assessment response_kinds annotation_complexity span_overlaps folded_texts json_id_scan evidence_lists claims_deduped irrelevant_facts path_validity
score_guards best_references gold_filtered metadata_leaks text_hygiene binary_evaluation correlation_summaries directional_summaries dominance_decisions pair_declarations support_pointers
label_lookup audit_samples target_strata system_rankings judge_stability completion_minutes target_coverage package_hashes sensitivity_cohorts label_conflicts disagreements update_behaviour
coverage_warnings applicable_fields response_decisions list_quality evidence_tiers update_pairs_declared pair_layout alignment_faults experiment_matrix""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_q = lambda p: p.replace("'", "''")
_CUE = _q("(?i)(?:" + "|".join(T.RESPONSE_CUES) + ")")
_CON = "(?i)\\b(?:but|however|although|yet)\\b"
_STRIP = lambda x: f"regexp_replace({x}, '^[ ,;:-]+|[ ,;:-]+$', '', 'g')"
_WORDS = lambda x: f"len(regexp_extract_all({x}, '[A-Za-z0-9]+'))"
_KIND_SQL = f"""{_CONV_SQL}, t AS (SELECT *, trim(regexp_replace(answer, '\\s+', ' ', 'g')) AS x FROM a), l AS (SELECT *, regexp_extract(x, '(?s)^(.*?){_CUE}', 1) AS lead, string_split(regexp_replace(x, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM t),
k AS (SELECT *, CASE WHEN NOT regexp_matches(x, '{_CUE}') THEN 'answer' WHEN len(list_filter(parts, lambda s: NOT regexp_matches(s, '{_CUE}') AND {_WORDS('s')} >= 4)) > 0
  OR ((contains(lead, '(') OR regexp_matches(lead, '{_CON}')) AND {_WORDS(_STRIP('lead'))} >= 4 AND NOT regexp_matches({_STRIP('lead')}, '(?i)\\b(?:is|was|are|were|does|do)\\s*$'))
  OR (regexp_matches(lead, '{_CON}') AND {_WORDS(_STRIP(f"regexp_extract(lead, '(?s)^(.*?){_CON}', 1)"))} >= 4) THEN 'hybrid' ELSE 'refusal' END AS kind FROM l)"""
_PAIR_SQL = "p AS (SELECT a.l_orderkey, a.l_returnflag, CASE WHEN a.l_orderkey % 9 <> 0 THEN a.l_discount END - b.l_discount AS m FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2)"
_YEARS = lambda a, b: f"greatest(({b} - {a}) / 365.25::DOUBLE, 0)"
SQL = {
    "compatibility_scores": f"""WITH {_ASKED_SQL},
w AS (SELECT *, row_number() OVER (PARTITION BY qid, s IS NOT NULL AND (qs IS NULL OR s <= qs) ORDER BY s DESC, fact_id DESC) AS latest, row_number() OVER (PARTITION BY qid, s IS NOT NULL ORDER BY s, fact_id) AS early,
  row_number() OVER (PARTITION BY qid, s IS NOT NULL ORDER BY s DESC, fact_id DESC) AS late, count(s) OVER (PARTITION BY qid) AS n FROM k)
SELECT qid, fact_id, round(CASE WHEN s IS NULL THEN 0.15::DOUBLE WHEN operator IN ('during', 'between') AND qs IS NOT NULL THEN (s <= qe AND l >= qs)::INT::DOUBLE WHEN operator IN ('current', 'as_of', 'effective') AND qs IS NOT NULL THEN (s <= qs AND l >= qs)::INT::DOUBLE
  WHEN operator IN ('previous', 'before', 'expired') AND qs IS NOT NULL THEN CASE WHEN e < qs THEN 1 / (1 + {_YEARS('e', 'qs')}) ELSE 0 END WHEN operator IN ('next', 'after') AND qs IS NOT NULL THEN CASE WHEN s > qs THEN 1 / (1 + {_YEARS('qs', 's')}) ELSE 0 END
  WHEN operator IN ('latest', 'last') OR (operator = 'current' AND qs IS NULL) THEN CASE WHEN qs IS NULL OR s <= qs THEN greatest(0.2, 1 - 0.25 * (latest - 1)) ELSE 0 END WHEN operator = 'first' THEN greatest(0.2, 1 - 0.25 * (early - 1))
  WHEN operator = 'previous' THEN CASE WHEN n < 2 THEN 0.4 WHEN late = 2 THEN 1 ELSE 0.25 END WHEN operator = 'next' THEN CASE WHEN n < 1 THEN 0.4 WHEN late = 1 THEN 1 ELSE 0.25 END ELSE 0.5 END, 6)::DOUBLE AS compatibility FROM w""",
    "evidence_assessment": f"""WITH {_ASKED_SQL}, o AS (SELECT *, operator IN ('first', 'latest', 'last', 'before', 'expired', 'previous', 'after', 'next') AS ordinal FROM k WHERE qs IS NOT NULL),
w AS (SELECT *, CASE WHEN operator = 'first' THEN s = min(s) OVER q WHEN operator IN ('latest', 'last') THEN s <= qe AND s = max(s) FILTER (WHERE s <= qe) OVER q WHEN operator IN ('before', 'expired', 'previous') THEN e < qs AND e = max(e) FILTER (WHERE e < qs) OVER q
  WHEN ordinal THEN s > qe AND s = min(s) FILTER (WHERE s > qe) OVER q END AS sel, s <= qe AND l >= qs AS meets FROM o WINDOW q AS (PARTITION BY qid)),
c AS (SELECT *, CASE WHEN NOT meets THEN 0.0::DOUBLE WHEN operator = 'between' THEN 1 WHEN operator = 'during' THEN (least(l, qe) - greatest(s, qs) + 1) / (qe - qs + 1)::DOUBLE ELSE (s <= qs AND l >= qe)::INT END AS share,
  CASE WHEN e < qs THEN qs - e WHEN s > qe THEN s - qe ELSE 0 END AS apart, CASE WHEN operator IN ('before', 'expired', 'previous') THEN abs(qs - e) WHEN operator = 'first' THEN 0 ELSE abs(s - qe) END AS gap FROM w),
x AS (SELECT *, CASE WHEN ordinal THEN coalesce(sel, false)::INT::DOUBLE ELSE (share = 1)::INT::DOUBLE END AS exact FROM c),
n AS (SELECT *, CASE WHEN ordinal THEN CASE WHEN exact = 1 THEN 0.0::DOUBLE ELSE coalesce(0.25 * exp(-gap / 365.0::DOUBLE), 0) END WHEN meets THEN 0 ELSE 0.25 * exp(-apart / 365.0::DOUBLE) END AS near FROM x)
SELECT qid, fact_id, CASE WHEN s IS NOT NULL THEN exact END AS exact, CASE WHEN s IS NOT NULL THEN round(near, 6) END AS near, CASE WHEN s IS NOT NULL THEN round(greatest(CASE WHEN ordinal THEN exact ELSE share END, near), 6) END AS compatibility,
CASE WHEN s IS NULL THEN 'unknown_valid_time' WHEN exact = 1 THEN 'valid' WHEN e < qs THEN 'stale' WHEN s > qe THEN 'future_invalid' ELSE 'temporally_ambiguous' END AS status FROM n""",
    "response_kinds": f"WITH {_KIND_SQL} SELECT conv_id, turn, regexp_matches(x, '(?i){_q('|'.join(T.REFUSALS))}') AS refusal, kind FROM k",
    "annotation_complexity": f"""WITH {_KIND_SQL}, f AS (SELECT conv_id, min_by(text, turn) AS first, min_by(answer, turn) AS answer, min_by(kind, turn) AS kind, list(text) AS e, count(DISTINCT turn) AS times, count(DISTINCT trim(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS texts FROM k GROUP BY conv_id),
g AS (SELECT *, CASE conv_id % 3 WHEN 0 THEN 'In which document revision? ' WHEN 1 THEN 'What was it during 1999? ' ELSE 'Name all, latest first: ' END || first AS q FROM f)
SELECT conv_id, CAST(4 * (conv_id % 6) + len(e) + 2 * (conv_id % 3) + conv_id % 5 + least(4, ({_WORDS("concat_ws(' ', q, answer, array_to_string(e, ' '))")}) // 120) + CASE WHEN regexp_matches(q, '{G.ORDERING_CUE}') THEN 2 WHEN regexp_matches(q, '{G.INTERVAL_CUE}') THEN 1 ELSE 0 END
+ CASE WHEN regexp_matches(q, '{G.LIST_CUE}') THEN 2 WHEN contains(answer, ',') OR regexp_matches(answer, '(?i)\\band\\b') THEN 1 ELSE 0 END + CASE WHEN contains(lower(q), 'document revision') AND times > 1 AND texts > 1 THEN 2 ELSE 0 END
+ CASE WHEN kind = 'hybrid' THEN 2 WHEN regexp_matches(answer, '{G.MIXED_CUE}') THEN 1 ELSE 0 END AS INT) AS complexity FROM g""",
    "span_overlaps": """WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents), s AS (SELECT *, (doc_id * 7) % greatest(n, 1) AS a, (doc_id * 31) % greatest(n, 1) AS b, CAST(unnest(range(0, greatest(n - 1, 0) // 200 + 1)) AS INT) AS i FROM d),
h AS (SELECT doc_id, i, a < i * 200 + 200 AND a + 25 > i * 200 AS x, b < i * 200 + 200 AND b + 40 > i * 200 AS y FROM s) SELECT doc_id, i, x OR y AS unsupported, y AND doc_id % 2 = 0 AS excluded FROM h""",
    "folded_texts": "WITH t AS (SELECT doc_id, regexp_extract_all(strip_accents(replace(lower(coalesce(text, '')), 'ß', 'ss')), '[a-z0-9]+') AS t FROM documents) SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM t",
    "json_id_scan": "WITH i AS (SELECT DISTINCT l_orderkey, unnest(['E' || l_partkey, 'S' || l_suppkey]) AS id FROM lineitem) SELECT l_orderkey, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM i GROUP BY l_orderkey",
    "evidence_lists": """WITH l AS (SELECT l_orderkey, l_linenumber AS n, l_suppkey % 3 AS item, l_returnflag || l_linestatus AS text FROM lineitem), u AS (SELECT *, 0 AS side FROM l WHERE n <= 4 UNION ALL SELECT *, 1 FROM l WHERE n >= 3),
o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, item ORDER BY side, n, text) AS r, count(DISTINCT text) OVER (PARTITION BY l_orderkey, item) > 1 AS conflict FROM u) SELECT l_orderkey, item, text, conflict FROM o WHERE r = 1""",
    "claims_deduped": f'WITH {FACTS_ORDERS_SQL} SELECT context_id, answer_id, "start", "end", min(fact_id) AS fact_id FROM facts GROUP BY ALL',
    "irrelevant_facts": f"""WITH {FACTS_ORDERS_SQL} SELECT context_id, min(fact_id) AS fact_id FROM facts WHERE NOT coalesce("start" <= DATE '1998-06-15' AND coalesce("end", DATE '9999-12-31') >= DATE '1998-06-15', false) GROUP BY context_id""",
    "path_validity": "WITH l AS (SELECT l_orderkey, list(l_suppkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS n FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, len(n) = 1 OR l_orderkey % 3 <> 0 OR list_reverse(n) = n AS valid FROM l",
    "score_guards": f"""WITH {_SCORED_SQL}, m AS (SELECT 'bertscore_f1' AS metric, 2 * s - 1.01::DOUBLE AS x, -1.0 AS lo FROM sc UNION ALL SELECT 'rouge_l', s * 1.02::DOUBLE, 0 FROM sc UNION ALL SELECT 'bleu', CASE WHEN doc_id % 11 = 0 THEN 'nan'::DOUBLE ELSE s END, 0 FROM sc)
SELECT metric, CASE WHEN isnan(x) THEN 'not_finite' WHEN x < lo - 1e-6 OR x > 1 + 1e-6 THEN 'out_of_range' END AS fault, count(*) AS n, round(avg(CASE WHEN NOT isnan(x) THEN CASE WHEN metric = 'bertscore_f1' THEN (x + 1) / 2 ELSE x END END), 6) AS mean FROM m GROUP BY 1, 2""",
    "best_references": "SELECT l_orderkey, max(l_discount) AS l_discount, min(l_linenumber) FILTER (WHERE l_discount = d) AS l_discount_reference, max(l_tax) AS l_tax, min(l_linenumber) FILTER (WHERE l_tax = t) AS l_tax_reference FROM (SELECT *, max(l_discount) OVER (PARTITION BY l_orderkey) AS d, max(l_tax) OVER (PARTITION BY l_orderkey) AS t FROM lineitem) GROUP BY l_orderkey",
    "gold_filtered": f"WITH {_RATINGS_SQL} SELECT unit, count(*) FILTER (WHERE rater <> 2 AND label <> 'cannot_judge') AS kept, coalesce(string_agg(CAST(rater AS VARCHAR), ',' ORDER BY rater) FILTER (WHERE rater <> 2 AND label <> 'cannot_judge'), '') AS raters FROM ra GROUP BY unit",
    "metadata_leaks": "SELECT token, count(*) AS n FROM documents, (SELECT unnest(['the', 'http', 'license', '@', 'gold_answer']) AS token) WHERE contains(lower(coalesce(text, '')), token) GROUP BY token",
    "text_hygiene": f"""SELECT fault, count(*) AS n FROM pages, (VALUES ('mojibake', '{G.MOJIBAKE}'), ('html_entity', '{G.ENTITY}'), ('bare_id', '{G.BARE_ID}'), ('url_as_name', '{G.URL}')) p(fault, pattern) WHERE regexp_matches(coalesce(html, ''), pattern) GROUP BY fault""",
    "binary_evaluation": f"""WITH {_SCORED_SQL}, c AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE s >= 0.5 AND y = 1)::DOUBLE AS tp, count(*) FILTER (WHERE s >= 0.5 AND y <> 1)::DOUBLE AS fp, count(*) FILTER (WHERE s < 0.5 AND y = 1)::DOUBLE AS fn, count(*) FILTER (WHERE s < 0.5 AND y <> 1)::DOUBLE AS tn, avg((s - y) * (s - y)) AS brier FROM sc GROUP BY lang)
SELECT lang, n, round((tp + tn) / n, 6) AS accuracy, round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 6) AS macro_f1, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy, round(brier, 6) AS brier FROM c""",
    "correlation_summaries": f"""WITH {_SCORED_SQL}, c AS (SELECT lang, source, count(*) AS n, CASE WHEN min(s) < max(s) AND min(y) < max(y) THEN corr(s, y::DOUBLE) END AS r, avg(abs(s - y)) AS mae FROM sc GROUP BY ALL) SELECT lang, source, n, CASE WHEN n >= 5 THEN round(r, 6) END AS pearson, CASE WHEN n >= 5 THEN round(mae, 6) END AS mae FROM c""",
    "directional_summaries": f"""WITH {_PAIR_SQL} SELECT l_returnflag, count(*) AS pairs, count(m) AS scored, round(avg(CASE WHEN m IS NOT NULL THEN (m > 0)::INT END), 6) AS consistent, round(avg(CASE WHEN m IS NOT NULL THEN (m = 0)::INT END), 6) AS tied, round(avg(CASE WHEN m IS NOT NULL THEN (m < 0)::INT END), 6) AS reversed, round(avg(m), 6) AS margin FROM p GROUP BY l_returnflag""",
    "dominance_decisions": f"""WITH {_PAIR_SQL}, c AS (SELECT l_returnflag, count(*) AS pairs, count(m) / count(*)::DOUBLE AS coverage, avg(m) - 1.96 * stddev(m) / sqrt(count(m)) AS lower FROM p GROUP BY l_returnflag)
SELECT l_returnflag, pairs, round(coverage, 6) AS coverage, round(lower, 6) AS lower, CASE WHEN NOT (pairs >= 30 AND coverage >= 0.85) THEN 'too_few' WHEN lower > 0 THEN 'better' WHEN lower > -0.02 THEN 'non_inferior' ELSE 'undecided' END AS decision FROM c""",
    "pair_declarations": """WITH p AS (SELECT p_partkey, p_partkey % 3 = 0 AS d, p_partkey % 2 = 0 AND p_brand <> 'B' AS b, p_partkey % 5 = 0 AND p_size IS NOT NULL AS s FROM part) SELECT p_partkey, concat_ws(',', CASE WHEN b AND NOT d THEN 'p_brand' END, CASE WHEN s AND d THEN 'p_size' END) AS undeclared FROM p WHERE (b AND NOT d) OR (s AND d)""",
    "support_pointers": f"""WITH {_RATINGS_SQL}, p AS (SELECT field, unit % 6 AS a, (unit + rater) % 4 + 1 AS b FROM ra) SELECT field, 2 * count(*) AS pointers, count(*) FILTER (WHERE a NOT BETWEEN 1 AND 4) AS unknown FROM p GROUP BY field""",
    "label_lookup": """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand WHEN p_partkey % 5 <> 0 AND NOT regexp_matches(p_type, '^Q[0-9]+$') THEN p_type END AS label FROM part""",
    "audit_samples": """WITH d AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS high, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS low, row_number() OVER (PARTITION BY lang ORDER BY sha256('audit:' || doc_id), doc_id) AS hash FROM documents)
SELECT lang, 'high' AS why, high AS place, doc_id FROM d WHERE high <= 10 UNION ALL SELECT lang, 'low', low, doc_id FROM d WHERE low <= 10 UNION ALL SELECT lang, 'hash', hash, doc_id FROM d WHERE hash <= 25""",
    "target_strata": f"WITH {_SCORED_SQL}, v AS (SELECT s AS a, 1.0::DOUBLE - s AS b, abs(s - 0.3::DOUBLE) AS c FROM sc) SELECT CASE WHEN a >= b AND a >= c THEN 'supports' WHEN b >= c THEN 'refutes' ELSE 'neither' END AS stratum, count(*) AS n FROM v GROUP BY 1",
    "system_rankings": f"WITH {_SCORED_SQL}, g AS (SELECT source, round(avg((s >= 0.5)::INT), 6) AS rate, round(avg(s), 6) AS partial FROM sc GROUP BY source) SELECT *, CAST(row_number() OVER (ORDER BY rate DESC NULLS LAST, partial DESC NULLS LAST, source) AS INT) AS rank FROM g",
    "judge_stability": f"""WITH {_RATINGS_SQL}, x AS (SELECT *, CASE label WHEN 'yes' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.5 ELSE 0 END AS v FROM ra) SELECT a.field, count(*) AS n, round(avg((a.v = b.v)::INT), 6) AS equal, round(avg(abs(a.v - b.v)), 6) AS difference FROM x a JOIN x b ON a.unit = b.unit AND a.rater = 0 AND b.rater = 1 GROUP BY a.field""",
    "completion_minutes": "SELECT user_id, round(CASE WHEN max(ts) > min(ts) THEN (epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6 END, 4) AS minutes FROM events GROUP BY user_id",
    "target_coverage": f"WITH {_RATINGS_SQL} SELECT field, count(*) AS labels, string_agg(DISTINCT CAST(rater AS VARCHAR), ',' ORDER BY CAST(rater AS VARCHAR)) AS available, CASE WHEN count(DISTINCT rater) = 3 THEN 'covered' ELSE 'diagnostic' END AS status FROM ra WHERE label <> 'cannot_judge' AND (field = 'answer' OR rater <> 2) GROUP BY field",
    "package_hashes": "WITH h AS (SELECT DISTINCT p_brand, sha256(p_partkey || '|' || p_type) AS h FROM part) SELECT p_brand, sha256(string_agg(h, ',' ORDER BY h)) AS package FROM h GROUP BY p_brand",
    "sensitivity_cohorts": f"""WITH {_RATINGS_SQL}, j AS (SELECT a.unit, a.label = b.label AS same FROM ra a JOIN ra b ON a.unit = b.unit AND a.rater = 0 AND b.rater = 1) SELECT 'all' AS cohort, count(*) AS n, round(avg(same::INT), 6) AS agreement FROM j UNION ALL SELECT 'without_review', count(*), round(avg(same::INT), 6) FROM j WHERE unit % 5 <> 0 UNION ALL SELECT 'without_exclusion', count(*), round(avg(same::INT), 6) FROM j WHERE unit % 7 <> 0""",
    "label_conflicts": f"WITH {_RATINGS_SQL} SELECT unit FROM ra GROUP BY unit HAVING count(*) FILTER (WHERE label = 'yes') > 0 AND count(*) FILTER (WHERE label = 'no') > 0",
    "disagreements": f"WITH {_RATINGS_SQL} SELECT b.unit, b.rater, a.label AS gold, b.label FROM ra a JOIN ra b ON a.unit = b.unit AND a.rater = 0 AND b.rater > 0 AND a.label <> b.label",
    "update_behaviour": f"WITH {_RATINGS_SQL} SELECT field, round(avg((label = 'yes')::INT) FILTER (WHERE rater = 0), 6) AS before, round(avg((label = 'yes')::INT) FILTER (WHERE rater = 1), 6) AS after FROM ra GROUP BY field",
    "coverage_warnings": "WITH c AS (SELECT DISTINCT o_custkey FROM orders), p AS (SELECT DISTINCT o_orderpriority FROM orders) SELECT o_orderpriority AS missing, count(*) AS customers FROM (SELECT * FROM c, p EXCEPT SELECT o_custkey, o_orderpriority FROM orders) GROUP BY 1",
    "applicable_fields": f"WITH {_KIND_SQL} SELECT concat_ws(',', 'response', CASE WHEN kind <> 'refusal' THEN 'answer' END, CASE WHEN kind <> 'answer' THEN 'refusal' END, CASE WHEN role = 'assistant' THEN 'citation' END) AS fields, count(*) AS n FROM k GROUP BY 1",
    "response_decisions": f"WITH {_RATINGS_SQL}, m AS (SELECT unit, min(CASE label WHEN 'yes' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.5 WHEN 'no' THEN 0 END) AS m FROM ra GROUP BY unit) SELECT unit, CASE WHEN unit % 4 = 0 THEN 1 - m ELSE m END AS decision FROM m",
    "list_quality": """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_discount, l_returnflag) AS i, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC) AS j FROM lineitem)
SELECT l_orderkey, round(CASE WHEN sum(l_discount) > 0 THEN sum(l_discount / log2(i + 1)) / sum(l_discount / log2(j + 1)) ELSE 0 END, 6)::DOUBLE AS ndcg, round(1 - avg((l_returnflag IN ('R', 'A'))::INT), 6) AS cleanliness FROM l GROUP BY l_orderkey""",
    "evidence_tiers": f"WITH {_SCORED_SQL}, g AS (SELECT source, CAST(count(*) FILTER (WHERE s > 0.6) AS BIGINT) AS wins, CAST(count(*) FILTER (WHERE s < 0.4) AS BIGINT) AS losses, round(avg(s), 6) AS macro FROM sc GROUP BY source) SELECT *, CAST(row_number() OVER (ORDER BY wins DESC, losses, macro DESC, source) AS INT) AS tier FROM g",
    "update_pairs_declared": """WITH g AS (SELECT l_orderkey, count(*) FILTER (WHERE l_linenumber = 1) AS a, count(*) FILTER (WHERE l_linenumber = 2) AS b, min(l_returnflag) <> max(l_returnflag) AS c FROM lineitem WHERE l_linenumber < 3 GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN a <> 1 OR b <> 1 THEN 'not_a_pair' ELSE 'undeclared_change' END AS fault FROM g WHERE a <> 1 OR b <> 1 OR c <> (l_orderkey % 3 <> 0)""",
    "pair_layout": "SELECT a.l_orderkey, count(*) AS pairs, CAST(sum(levenshtein(a.l_returnflag, b.l_linestatus)) AS BIGINT) AS score FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey GROUP BY a.l_orderkey",
    "alignment_faults": "SELECT vec_id, CASE WHEN vec_id % 13 = 0 AND vec_id % 29 <> 1 OR vec_id % 17 = 0 THEN 'missing' ELSE 'repeated' END AS fault FROM embeddings WHERE NOT (vec_id % 13 = 0 AND vec_id % 29 <> 1 AND vec_id % 17 = 0) AND ((vec_id % 13 = 0 AND vec_id % 29 <> 1) OR vec_id % 17 = 0 OR (vec_id % 13 <> 0 AND vec_id % 29 = 1))",
    "experiment_matrix": "SELECT n_name, model, seed FROM nation, (SELECT unnest(['small', 'large']) AS model), (SELECT unnest([11, 12, 13]) AS seed)",
}
