"""Pipeline stages: each takes (spark, docs, sf_dir) and returns a DataFrame.

All but packing return the columns of ``documents``; an input with more or
other columns keeps them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import jaccard, lines, packing, rules, toxicity
from tessella.llm.base import free, read
from tessella.llm.queries import vocabulary

#: Documents at or above this probability of toxicity are rejected.
TOXIC = 0.3
#: A line on a larger share of a source's pages is boilerplate. License lines stand on 0.5 to 0.8 %, one-word lines of their own on less.
REPEATED = 0.005


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject what fails the base rules or is of bad quality more likely than not. Rows without text are rejected."""
    return rules.filter_documents(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject toxic documents; the machine is trained on labelled rows among ``docs``.

    Null and empty texts have the score of no terms, which is below the
    threshold unless most labelled documents are toxic; rows without an id are
    scored like all others; repeated rows have equal scores; without labelled
    rows nothing is rejected; columns of any name are kept.
    """
    machine = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    out = free(docs, "__toxicity")
    return toxicity.score(docs, machine, out=out).where(F.col(out) < TOXIC).drop(out)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop boilerplate lines by source; ``n_chars`` follows the text. No document goes, though its text may become empty."""
    out = lines.dedup(docs, ratio=REPEATED, counts=(free(docs, "n_lines"), free(docs, "n_dropped"))).select(*docs.columns)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else out


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of near duplicates the document with the smallest id stays. Rows without an id stay."""
    return jaccard.representatives(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per packed piece.

    Null and empty texts are one id, the end; rows without an id and repeated
    rows are documents of their own; other columns of ``docs`` go, whatever
    their names; an empty table has no pieces.
    """
    return packing.pack(docs, vocabulary()).select(
        "doc_id", "start", F.expr("cast(length(ids) div 4 as long)").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group"
    )
