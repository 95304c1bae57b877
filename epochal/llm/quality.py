"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

The text's words, lines and 8-word windows are arrays of one row, so nothing is shuffled and the scan streams. Null and
empty texts have no words: every count is 0 and the base rule rejects them. Rows are never merged: repeated rows are judged
one by one. Extra columns pass through; the operator's own columns replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.llm._spark import free, let, table, words

#: Frequent function words of the corpus languages (en, de, fr, es).
STOP_WORDS = (
    "the of and to in a is that it for on was be as with by this are at from or an "
    "der die das und den von zu mit des ist ein eine nicht sich für auf im dem "
    "de la le les et un une du en que est dans par pour sur pas au "
    "el los las y se no por con su es una lo del"
).split()

#: (measure, lowest allowed, highest allowed): a text with a measure outside is rejected. None: no bound.
THRESHOLDS = (
    ("mean_word_chars", 2.0, 12.0),
    ("symbol_ratio", None, 0.2),
    ("stop_ratio", 0.04, None),
    ("dup_line_ratio", None, 0.5),
)
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8


def _repeat_words(w: Column, window: int) -> Column:
    """Words in windows that are found twice or more in the text, the first included.

    Windows are compared by 64-bit hash. Only a text that repeats a window sorts them: the sorted starts of repeated
    windows p1 < p2 < ... cover window + sum(min(window, p[i+1] - p[i])) words.
    """

    def covered(hashes: Column) -> Column:
        tagged = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(
            tagged,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(
                        F.transform(
                            s,
                            lambda x, j: F.struct(
                                x["i"].alias("i"),
                                (
                                    F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
                                    | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
                                ).alias("twice"),
                            ),
                        ),
                        lambda x: x["twice"],
                    ),
                    lambda x: x["i"],
                )
            ),
        )
        total = F.aggregate(
            starts,
            F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda a, p: F.struct(
                p.alias("last"), (a["n"] + F.least(F.lit(window), p - a["last"]).cast("long")).alias("n")
            ),
        )
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(total["n"])

    hashes = F.transform(
        F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window))
    )
    return F.when(F.size(w) <= window, F.lit(0).cast("long")).otherwise(let(hashes, covered))


def measures(text: Column) -> Column:
    """All counts of a text as one struct."""
    safe = F.coalesce(text, F.lit(""))

    def of(w: Column) -> Column:
        lines = F.filter(F.split(safe, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.char_length(F.regexp_replace(safe, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
            _repeat_words(w, WINDOW).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.rtrim(F.lower(x), F.lit(".,;:!?")).isin(STOP_WORDS))).alias("n_stop"),
        )

    return let(words(text), of)


def quality_rules(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """Add the measures, ``base_failed``, ``failed_rules`` (names, in table order) and ``kept`` to every row.

    One projection; a null text counts as empty. ``thresholds`` is the rule table and may name any measure below.
    """
    mine = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rules", "kept"]
    rest = [c for c in docs.columns if c.lower() not in mine]
    # exploded, not projected: a filter on the verdict would be pushed into a projection and evaluate the measures again
    (own,) = free(docs.columns, "__m")
    m = docs.select(*(F.col(f"`{c}`") for c in rest), F.explode(F.array(measures(F.col(f"`{text}`")))).alias(own))
    n = F.greatest(F.col(f"{own}.n_words"), F.lit(1))
    value = {
        "n_words": F.col(f"{own}.n_words"),
        "mean_word_chars": F.col(f"{own}.word_chars") / n,
        "symbol_ratio": F.col(f"{own}.n_symbols") / n,
        "stop_ratio": F.col(f"{own}.n_stop") / n,
        "dup_line_ratio": F.col(f"{own}.lines.dup") / F.greatest(F.col(f"{own}.lines.n"), F.lit(1)),
        "repeat_ratio": F.col(f"{own}.n_repeat_words") / n,
    }
    failed = F.array_compact(
        F.array(
            *(
                F.when((value[k] < lo if lo is not None else F.lit(False)) | (value[k] > hi if hi is not None else F.lit(False)), F.lit(k))
                for k, lo, hi in thresholds
            )
        )
    )
    base = (F.col(f"{own}.n_words") < MIN_WORDS) | (100 * F.col(f"{own}.n_repeat_words") > REPEAT_PERCENT * F.col(f"{own}.n_words"))
    return m.select(
        *(F.col(f"`{c}`") for c in rest),
        F.col(f"{own}.n_words").alias("n_words"),
        F.col(f"{own}.word_chars").alias("word_chars"),
        F.col(f"{own}.n_symbols").alias("n_symbols"),
        F.col(f"{own}.lines.dup").cast("long").alias("n_dup_lines"),
        F.col(f"{own}.n_repeat_words").alias("n_repeat_words"),
        base.alias("base_failed"),
        failed.alias("failed_rules"),
        (~base & (F.size(failed) == 0)).alias("kept"),
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules(docs).where("kept").select(*docs.columns)


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
OP1_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM t),
m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    len(list_filter(w, lambda x: rtrim(lower(x), '.,;:!?') IN ({_STOP_SQL}))) AS n_stop
  FROM w),
g AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS k
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)),
d AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), {WINDOW}) AS gap
      FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, CAST(sum(least(gap, {WINDOW})) AS BIGINT) AS n FROM d GROUP BY doc_id),
a AS (SELECT m.*, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
        greatest(n_words, 1) AS nn, greatest(len(lines), 1) AS nl
      FROM m LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AND NOT (
    CAST(word_chars AS DOUBLE) / nn < 2.0 OR CAST(word_chars AS DOUBLE) / nn > 12.0
    OR CAST(n_symbols AS DOUBLE) / nn > 0.2 OR CAST(n_stop AS DOUBLE) / nn < 0.04
    OR CAST(n_dup_lines AS DOUBLE) / nl > 0.5) AS kept
FROM a
"""
