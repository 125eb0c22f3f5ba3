"""Line dedup by site-relative frequency, in DataFrame operations only.

For every host the pages that contain a line are divided by the host's pages;
lines over the boilerplate ratio are dropped from that host's pages. A host of
L lines a page has at most L / ratio such lines, so they travel as one short
array a host, and documents meet them in a join on the host: broadcast while
the table of arrays is small, by shuffle (with skewed hosts split) beyond.
Texts are not shuffled in the first case.

Defined results: lines are what newlines separate; lines without a word are
never counted nor dropped; a null host counts as the empty host; a null text
stays null and counts as a page; a line repeated within a page counts once;
repeated rows count as pages each. Lines on fewer than ``min_pages`` pages of a
host stay, whatever their share. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.base import written

BLANKS = r"[\x20\x09-\x0D]+"
#: Up to so many flagged lines (of 32 bytes each) the table of hosts is broadcast.
BROADCAST_LINES = 200_000


def _has_word(line: Column) -> Column:
    return F.length(F.regexp_replace(line, BLANKS, "")) > 0


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """(__host, __flagged array of line digests): the lines to drop, by host."""
    pages = docs.select(F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias("__host"), F.col(f"`{text}`").alias("__text"))
    totals = pages.groupBy("__host").agg(F.count("*").alias("__pages"))
    digests = F.array_distinct(F.transform(F.filter(_split(F.col("__text")), _has_word), F.md5))
    seen = pages.select("__host", F.explode(digests).alias("__line")).groupBy("__host", "__line").agg(F.count("*").alias("__n")).where(F.col("__n") >= min_pages)
    over = seen.join(totals, "__host").where(F.col("__n") > ratio * F.col("__pages"))
    return over.groupBy("__host").agg(F.sort_array(F.collect_set("__line")).alias("__flagged"))


def dedup(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.1, min_pages: int = 5, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with the text rebuilt, and lines and dropped lines counted in the columns ``counts`` (replacing columns of these names)."""
    flagged = written(boilerplate(docs, host, text, ratio, min_pages), "lines")
    lines = flagged.agg(F.coalesce(F.sum(F.size("__flagged")), F.lit(0))).first()[0]
    names = [x for x in docs.columns if x not in counts]
    boxed = docs.select(
        F.struct(*[F.col(f"`{x}`") for x in names if x != text]).alias("__row") if len(names) > 1 else F.struct(F.lit(1)).alias("__row"),
        F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias("__host"),
        F.col(f"`{text}`").alias("__text"),
    )
    met = boxed.join(F.broadcast(flagged) if lines <= BROADCAST_LINES else flagged, "__host", "left")
    kept = F.filter(_split(F.col("__text")), lambda x: ~(_has_word(x) & F.array_contains(F.col("__flagged"), F.md5(x))))
    met = met.withColumn("__kept", F.when(F.col("__flagged").isNotNull() & F.col("__text").isNotNull(), kept))
    total = F.when(F.col("__text").isNull(), 0).otherwise(F.size(_split(F.col("__text"))))
    return met.select(
        *[F.when(F.col("__kept").isNull(), F.col("__text")).otherwise(F.array_join("__kept", "\n")).alias(x) if x == text else F.col(f"__row.`{x}`").alias(x) for x in names],
        total.cast("long").alias(counts[0]),
        F.when(F.col("__kept").isNull(), 0).otherwise(total - F.size("__kept")).cast("long").alias(counts[1]),
    )


#: DuckDB twin of ``dedup`` over documents with the default parameters.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
totals AS (SELECT host, count(*) AS pages FROM d GROUP BY host),
exploded AS (SELECT host, unnest(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS line FROM d),
seen AS (SELECT host, line, count(*) AS n FROM exploded GROUP BY host, line HAVING count(*) >= 5),
flagged AS (SELECT s.host, list(s.line) AS bad FROM seen s JOIN totals t USING (host) WHERE s.n > 0.1 * t.pages GROUP BY s.host),
k AS (SELECT d.*, CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(bad, x)) END AS kept FROM d LEFT JOIN flagged USING (host))
SELECT doc_id, array_to_string(kept, chr(10)) AS text, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped FROM k
"""
