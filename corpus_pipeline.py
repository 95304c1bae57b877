"""The corpus pipeline: quality rules, near duplicates, repeated spans, mixture, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. A stage
works on every row that the one before kept. Nulls in any column and clashing extra columns are carried as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from epochal.llm import jaccard, mixing, pieces, quality, spans
from epochal.llm._spark import cut, table

STAGES = [
    ("quality_rules", quality.stage),
    ("near_duplicates", jaccard.stage),
    ("substring_dedup", spans.stage),
    ("mixing", mixing.stage),
    ("sentencepiece", pieces.stage),
]

#: SQL has no merge agenda with a keyed hash: the pipeline is tested against brute-force versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared checkpoint folder before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if i == len(STAGES) - 1 else cut(docs)
    return docs
