"""The corpus pipeline: quality rules, toxicity, line dedup, near-duplicate removal, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import stages
from tessella.llm.base import read, written

STAGES = [
    ("quality_rules", stages.quality),
    ("toxicity", stages.toxic),
    ("line_dedup", stages.dedup_lines),
    ("ngram_jaccard_join", stages.dedup_documents),
    ("packing", stages.pack),
]

#: Expectation maximisation and the trained classifier are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result but the last is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
