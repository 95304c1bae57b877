"""Text functions as Column expressions (O093-O112, O132-O134). Built-ins only, so they stay inside the projection;
only the overlap counts of token lists run over Arrow batches."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, "\\s+", " "))


def normalize_answer(x: Column) -> Column:
    """Lower case, ASCII punctuation deleted, English articles out, spaces squeezed (O093)."""
    bare = F.translate(F.lower(x), PUNCTUATION, "")
    return squeezed(F.regexp_replace(bare, "(?U)\\b(a|an|the)\\b", " "))


def visible_text(x: Column) -> Column:
    """Lower case; everything but a-z and 0-9 is a space (O094)."""
    return squeezed(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def plain_text(x: Column) -> Column:
    """Markdown marks and leading bullets out (O095)."""
    return squeezed(F.regexp_replace(F.regexp_replace(x, "[`*_#>]", ""), "(?m)^\\s*[-+]\\s+", ""))


def tokens(x: Column) -> Column:
    """Runs of letters and digits, lower case (O097)."""
    return F.regexp_extract_all(F.lower(x), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def answer_tokens(x: Column) -> Column:
    return F.filter(F.split(normalize_answer(x), " "), lambda t: t != "")


def let(value: Column, body) -> Column:
    """Evaluate value once: an expression inside a lambda would be evaluated for every element."""
    return F.transform(F.array(value), body)[0]


def shingles(x: Column, n: int = 3) -> Column:
    """Distinct n-grams of [a-z0-9]+ words; fewer words: the words, none: <empty> (O108)."""

    def of(t: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), "\u001f"))
        short = F.when(F.size(t) == 0, F.array(F.lit("<empty>"))).otherwise(F.array_distinct(t))
        return F.when(F.size(t) < n, short).otherwise(F.array_distinct(grams))

    return let(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0)), of)


def jaccard(a: Column, b: Column) -> Column:
    """Set Jaccard of two arrays; both empty: 1 (O107)."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def sentences(x: Column) -> Column:
    """Split after . ! or ? before a capital or digit (O099)."""
    return F.filter(F.split(squeezed(x), "(?<=[.!?])\\s+(?=[A-Z0-9])"), lambda s: s != "")


#: Patterns that mark an answer as a refusal (O102), letter case aside.
REFUSALS = (
    r"\b(?:cannot|can't|unable to)\s+(?:determine|answer|establish|infer)\b",
    r"\binsufficient\s+(?:evidence|information)\b",
    r"\bnot enough\s+(?:evidence|information)\b",
    r"\b(?:evidence|information)\b.{0,40}\bnot\b.{0,30}\bsufficient\b",
    r"\bno answer is supported\b",
    r"\bthe evidence (?:does not|doesn't) (?:establish|support|determine)\b",
    r"^\s*(?:(?:the\s+)?answer\s+is\s+)?unknown[.!]?\s*$",
    r"\b(?:answer|identity|result|value)\s+(?:is|remains)\s+unknown\b",
    r"\bit\s+(?:is|remains)\s+unknown\b",
)
#: Cues of a response that declines (O103), letter case aside.
RESPONSE_CUES = (
    r"can(?:not|'t)\s+(?:be\s+)?determin(?:e|ed)",
    r"could\s+not\s+(?:be\s+)?determin(?:e|ed)",
    r"unable\s+to\s+(?:answer|determine)",
    r"insufficient(?:\s+\w+){0,3}\s+(?:to\s+)?(?:answer|determine|establish)",
    r"not\s+enough\s+(?:information|evidence)",
    r"no(?:\s+\w+){0,2}\s+(?:information|evidence)(?:\s+(?:is|was))?\s+(?:available|provided|shown|found)",
    r"not(?:\s+\w+){0,3}\s+sufficient\s+to\s+(?:answer|determine|establish)",
    r"no\s+(?:supported\s+)?answer",
    r"not\s+possible\s+to\s+determine",
    r"does\s+not(?:\s+\w+){0,2}\s+(?:provide|state|specify|establish)",
    r"do\s+not(?:\s+\w+){0,2}\s+(?:provide|state|specify|establish)",
    r"not\s+(?:provided|stated|specified|established|available)",
    r"(?:evidence|information)\s+(?:is|was)\s+(?:missing|unavailable)",
    r"unclear(?:\s+\w+){0,6}\s+(?:evidence|information)",
    r"conflicting\s+(?:evidence|claims|information|ages|values)",
    r"conflicts?\s+(?:on|with|about)",
    r"no\s+definitive\s+answer",
)
_CUE = "(?i)(?:" + "|".join(RESPONSE_CUES) + ")"
_CONTRAST = r"(?i)\b(?:but|however|although|yet)\b"


def is_refusal(x: Column) -> Column:
    return squeezed(x).rlike("(?i)" + "|".join(REFUSALS))


def response_kind(x: Column) -> Column:
    """answer, refusal, or hybrid: a cue and, in a sentence of its own or before the cue, four words that assert something (O103)."""
    text, strip = squeezed(x), lambda t: F.regexp_replace(t, "^[ ,;:-]+|[ ,;:-]+$", "")
    enough = lambda t: F.regexp_count(t, F.lit("[A-Za-z0-9]+")) >= 4
    lead = F.regexp_extract(text, f"(?s)^(.*?){_CUE}", 1)
    own = F.exists(F.split(text, "(?<=[.!?])\\s+"), lambda s: ~s.rlike(_CUE) & enough(s))
    aside = (lead.contains("(") | lead.rlike(_CONTRAST)) & enough(strip(lead)) & ~strip(lead).rlike(r"(?i)\b(?:is|was|are|were|does|do)\s*$")
    asserted = lead.rlike(_CONTRAST) & enough(strip(F.regexp_extract(lead, f"(?s)^(.*?){_CONTRAST}", 1)))
    return F.when(~text.rlike(_CUE), "answer").when(own | aside | asserted, "hybrid").otherwise("refusal")


def contains_phrase(text_tokens: Column, phrase_tokens: Column) -> Column:
    """Whether the phrase is a contiguous part of the tokens (O105)."""
    line = lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
    return (F.size(phrase_tokens) > 0) & line(text_tokens).contains(line(phrase_tokens))


#: Words that do not count as a mention (O106).
COMMON = ("a", "an", "and", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with")


def mention_score(text_tokens: Column, label_tokens: Column) -> Column:
    """1 if the label stands in the text as a phrase, else the part of its content tokens that do."""
    content = F.array_distinct(F.filter(label_tokens, lambda t: ~t.isin(*COMMON)))
    part = F.when(F.size(content) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(content, text_tokens)) / F.size(content))
    return F.when(contains_phrase(text_tokens, label_tokens), F.lit(1.0)).otherwise(part)


def protected_spans(x: Column) -> Column:
    """Dates, years, identifiers and runs of capitalised words, which a paraphrase must keep (O104)."""
    return F.array_distinct(
        F.concat(
            F.regexp_extract_all(x, F.lit("\\b[0-9]{4}(?:-[0-9]{2}-[0-9]{2})?\\b"), F.lit(0)),
            F.regexp_extract_all(x, F.lit("\\b[QP][0-9]+\\b"), F.lit(0)),
            F.regexp_extract_all(x, F.lit("\\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\\b"), F.lit(0)),
        )
    )


def missing_spans(source: Column, candidate: Column) -> Column:
    return F.filter(protected_spans(source), lambda s: ~candidate.contains(s))


def multiset_overlap(a: list[str], b: list[str]) -> int:
    return sum((Counter(a) & Counter(b)).values())


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table being the bits of one integer."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        u = row & places.get(y, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


@F.pandas_udf(ArrayType(IntegerType()))
def overlaps(a: pd.Series, b: pd.Series) -> pd.Series:
    """[unigram overlap, bigram overlap, LCS] of two token arrays (O132, O133).

    Arrow batches: a fold over arrays inside an expression costs the square of the text's length in copies.
    """
    two = lambda t: list(zip(t, t[1:], strict=False))
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = list(x if x is not None else ()), list(y if y is not None else ())
        out.append([multiset_overlap(x, y), multiset_overlap(two(x), two(y)), lcs(x, y)])
    return pd.Series(out)


def prf(overlap: Column, n_candidate: Column, n_reference: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of an overlap; both sides empty: all 1."""
    empty = (n_candidate == 0) & (n_reference == 0)
    p = F.when(empty, F.lit(1.0)).when(n_candidate == 0, F.lit(0.0)).otherwise(overlap / n_candidate)
    r = F.when(empty, F.lit(1.0)).when(n_reference == 0, F.lit(0.0)).otherwise(overlap / n_reference)
    return p, r, harmonic(p, r)


def harmonic(a: Column, b: Column) -> Column:
    """Harmonic mean; 0 if the sum is 0 (O125)."""
    return F.when(a + b > 0, 2 * a * b / F.nullif(a + b, F.lit(0.0))).otherwise(F.lit(0.0))


def answer_scores(candidate: Column, reference: Column) -> dict[str, Column]:
    """Exact match, token P, R and F1, ROUGE-1, 2 and L of a candidate answer (O134, O181). Null texts count as empty."""
    candidate, reference = F.coalesce(candidate, F.lit("")), F.coalesce(reference, F.lit(""))
    a, b = answer_tokens(candidate), answer_tokens(reference)
    o = overlaps(a, b)
    p, r, f = prf(o[0], F.size(a), F.size(b))
    two = lambda t: F.greatest(F.size(t) - 1, F.lit(0))
    return {
        "exact": (normalize_answer(candidate) == normalize_answer(reference)).cast("double"), "precision": p, "recall": r, "f1": f, "rouge1": f,
        # texts of one word have no bigrams and score 0, unless both are empty
        "rouge2": F.when((F.size(a) + F.size(b)) == 0, 1.0).when((two(a) == 0) | (two(b) == 0), 0.0).otherwise(prf(o[1], two(a), two(b))[2]), "rouge_l": prf(o[2], F.size(a), F.size(b))[2],
    }


def pedants_normalize(x: Column) -> Column:
    """Lower case, Unicode punctuation and articles out (O098)."""
    return squeezed(F.regexp_replace(F.regexp_replace(F.lower(x), "\\p{P}", ""), "\\b(a|an|the)\\b", " "))


def stable_id(prefix: str, *parts: Column, length: int = 24) -> Column:
    """prefix_ and the head of the parts' sha256 (O111)."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("\u001f", *(p.cast("string") for p in parts)), 256), 1, length))


def stable_bucket(namespace: str, value: Column, modulus: int) -> Column:
    """First 8 bytes of sha256(namespace:value), big-endian, modulo (O123)."""
    h = F.sha2(F.concat(F.lit(f"{namespace}:"), value.cast("string")), 256)
    return (F.conv(F.substring(h, 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(modulus)).cast("long")


def hash_fraction(namespace: str, value: Column) -> Column:
    """First 12 hex digits of the hash over 16**12 (O124)."""
    h = F.sha2(F.concat(F.lit(f"{namespace}:"), value.cast("string")), 256)
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / float(16**12)
