"""Claim, citation and answer metrics from structured judgements (O100, O125, O136, O160, O165, O180, O182, O185-O188, O190)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from epochal.functions.text import harmonic, is_refusal, sentences


def decompose(text: Column) -> Column:
    """Claims of an answer: its sentences, cut at semicolons and line bullets; a refusal has none (O100).

    Lists joined by commas stay one claim; resolving them takes evidence, which this function does not see.
    """
    parts = F.flatten(F.transform(sentences(text), lambda s: F.split(s, ";\\s+|\\s+[-*]\\s+")))
    clean = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
    return F.when(text.isNull() | is_refusal(text), F.array().cast("array<string>")).otherwise(clean)


def _share(claims: Column, test) -> Column:
    return F.size(F.filter(claims, test)) / F.nullif(F.size(claims).cast("double"), F.lit(0.0))


def claim_metrics(candidate: Column, reference: Column, n_retrieved: Column, n_cited: Column) -> dict[str, Column]:
    """Claim metrics (O180).

    candidate: array<struct<reference_supported boolean, retrieved array<int>, cited array<int>>>; reference:
    array<struct<candidate_supported boolean, retrieved array<int>>>; indices are 1-based.
    """
    has = lambda a: F.size(a) > 0
    relevant = F.filter(F.array_distinct(F.flatten(F.transform(reference, lambda c: c["retrieved"]))), lambda i: (i >= 1) & (i <= n_retrieved))
    cited = F.filter(F.array_distinct(F.flatten(F.transform(candidate, lambda c: c["cited"]))), lambda i: (i >= 1) & (i <= n_cited))
    precision, recall = _share(candidate, lambda c: c["reference_supported"]), _share(reference, lambda c: c["candidate_supported"])
    hallucination = _share(candidate, lambda c: ~c["reference_supported"] & ~has(c["retrieved"]))
    found = F.filter(reference, lambda c: has(c["retrieved"]))
    return {
        "precision": precision,
        "recall": recall,
        "f1": harmonic(precision, recall),
        "claim_recall": _share(reference, lambda c: has(c["retrieved"])),
        "context_precision": F.size(relevant) / F.nullif(n_retrieved.cast("double"), F.lit(0.0)),
        "faithfulness": _share(candidate, lambda c: has(c["retrieved"])),
        "hallucination": hallucination,
        "non_hallucination": 1.0 - hallucination,
        "self_knowledge": _share(candidate, lambda c: c["reference_supported"] & ~has(c["retrieved"])),
        "relevant_noise": _share(candidate, lambda c: ~c["reference_supported"] & F.arrays_overlap(c["retrieved"], relevant)),
        "irrelevant_noise": _share(candidate, lambda c: ~c["reference_supported"] & F.exists(c["retrieved"], lambda i: ~F.array_contains(relevant, i))),
        "context_utilization": _share(found, lambda c: c["candidate_supported"]),
        "citation_completeness": F.when(n_cited > 0, _share(candidate, lambda c: has(c["cited"]))),
        "citation_precision": F.size(cited) / F.nullif(n_cited.cast("double"), F.lit(0.0)),
    }


def citation_targets(citations: Column, evidence: Column) -> Column:
    """Place (from 1) of each cited id, else unresolved:id (O136)."""
    return F.transform(citations, lambda c: F.when(F.array_contains(evidence, c), F.array_position(evidence, c).cast("string")).otherwise(F.concat(F.lit("unresolved:"), c)))


def geometric(parts: list[Column]) -> Column:
    """Complete-case geometric mean: null if one is null, 0 if one is not above 0 (O125, O182)."""
    complete, low = F.lit(True), F.lit(False)
    for p in parts:
        complete, low = complete & p.isNotNull(), low | (p <= 0)
    logs = sum((F.log(F.greatest(p, F.lit(1e-300))) for p in parts[1:]), F.log(F.greatest(parts[0], F.lit(1e-300))))
    return F.when(complete, F.when(low, 0.0).otherwise(F.exp(logs / len(parts))))


def combined_correctness(*parts: Column) -> Column:
    """The least of the parts that apply; null if none does (O185)."""
    return F.array_min(F.filter(F.array(*parts), lambda x: x.isNotNull()))


def update_adaptation(before: Column, after: Column, changed: Column) -> dict[str, Column]:
    """Score and passes of a system across an update (O165): the answer must be right on both sides, and stay where nothing changed."""
    both = F.least(before, after)
    steady = 1.0 - F.abs(after - before)
    score = F.when(changed, both).otherwise(F.least(both, steady))
    close = changed | (F.abs(after - before) <= 0.05)
    return {"score": score, "pass_50": (score >= 0.5) & close, "pass_75": (score >= 0.75) & close}


def hits(predicted: Column, gold: Column) -> tuple[Column, Column]:
    """hits@1 and hits@10 by id set (O190)."""
    at = lambda k: F.arrays_overlap(F.slice(predicted, 1, k), gold).cast("double")
    return at(1), at(10)


def claim_compatibility(c_start: Column, c_end: Column, e_start: Column, e_end: Column) -> Column:
    """1 if the evidence's interval holds all of the claim's, 0 if they are apart, null between or where a bound is unknown (O160)."""
    far = F.lit("9999-12-31").cast("date")
    high, e_high = F.coalesce(c_end, c_start), F.coalesce(e_end, far)
    return F.when((e_start <= c_start) & (high <= e_high), 1.0).when((high < e_start) | (c_start > e_high), 0.0)
