"""Quality by importance resampling: hashed n-gram models and Gumbel top-k.

Two generative models, of target text and of raw text, give every hashed
unigram and bigram a probability; a document's log importance weight is the sum
of the log ratios over all its n-grams (times ``temper``, 1 unless another
exponent of the weights is wanted). With Gumbel noise (a function of the key,
so repeatable) added, the ``share`` of all documents with the largest keys is a
sample without replacement in proportion to the weights.

The raw model counts every n-gram of every document. The target is the text of
at most ``max_rows`` labelled good rows (a documented bound). What leaves a
task is one count a bucket. The top-k is exact: the k-th largest key is found
by counting digits, four rounds of at most 65,536 counts, never by a global
sort or by collecting keys.

Defined results: null or empty texts have no n-grams and log weight 0; texts
of any length are counted whole; rows that share a key and a text share a
sample key, and ties at the threshold are all kept; null labels and labels
without a document are no target; without target text all log weights are 0;
columns other than key and text are ignored, whatever their names; an empty
table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tessella.llm.base import map_batches, small_batches, strings

BUCKETS = 1 << 14
CACHE = 300_000


class Hashes(dict):
    """word -> 32-bit hash."""

    def __missing__(self, word: str) -> int:
        h = zlib.crc32(word.encode("utf-8", "replace"))
        if len(self) >= CACHE:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h

    def grams(self, text: str) -> np.ndarray:
        """Buckets of all unigrams and bigrams."""
        words = text.lower().split()
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return np.zeros(0, np.int64)
        both = np.concatenate([h * np.uint64(0x9E3779B97F4A7C15), h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:] * np.uint64(0x165667B19E3779F9)])
        return (both >> np.uint64(64 - 14)).astype(np.int64)


def log_ratios(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, max_rows: int) -> np.ndarray:
    """log(p_target / p_raw) by bucket, with add-one smoothing."""
    good = labels.where(F.col(label) == 1).select(F.col(key).alias("__k")).dropna().distinct()
    good = good.orderBy(F.xxhash64("__k"), "__k").limit(max_rows).withColumn("__t", F.lit(True))
    small_batches(docs.sparkSession)
    marked = docs.select(F.col(key).alias("__k"), F.col(text).alias("__text")).join(F.broadcast(good), "__k", "left").select("__t", "__text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sums = Hashes(), np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for target, value in zip(batch.column("__t").to_pylist(), strings(batch, "__text"), strict=True):
                counts = np.bincount(table.grams(value), minlength=BUCKETS)
                sums[1] += counts
                if target:
                    sums[0] += counts
        at = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0, at]), pa.array(sums[1, at])], ["b", "t", "r"])

    rows = marked.mapInArrow(count, "b long, t long, r long").groupBy("b").agg(F.sum("t").alias("t"), F.sum("r").alias("r")).collect()
    sums = np.zeros((2, BUCKETS))
    for r in rows:
        sums[:, r.b] = r.t, r.r
    if not sums[0].sum():
        return np.zeros(BUCKETS)
    p = (sums + 1) / (sums + 1).sum(1, keepdims=True)
    return np.log(p[0] / p[1])


def gumbel(key: Column, seed: int = 1) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.ln(-F.ln(u))


def digits(value: Column) -> Column:
    """A long that orders exactly as doubles do: the IEEE bits, with the lower ones of negative numbers turned round. No NaN."""
    size = F.abs(value)
    exponent = F.when(size == 0, 0).otherwise(F.greatest(F.floor(F.log2(size)).cast("int"), F.lit(-1022)))
    exponent = exponent + F.when(size >= F.pow(F.lit(2.0), exponent + 1), 1).when((size < F.pow(F.lit(2.0), exponent)) & (exponent > -1022), -1).otherwise(0)
    part = (size / F.pow(F.lit(2.0), exponent) * float(1 << 52)).cast("long") - F.lit(1 << 52)
    bits = F.when(size < 2.0**-1022, 0).otherwise((exponent + 1023).cast("long") * F.lit(1 << 52) + part)
    return F.when(value < 0, -bits).otherwise(bits)


def kth_largest(df: DataFrame, value: str, k: int) -> int | None:
    """The k-th largest of a long column, by four rounds of digit counts: at most 65,536 numbers a round reach the driver."""
    if k <= 0:
        return None
    shifted, prefix = F.col(value).bitwiseXOR(F.lit(-(1 << 63))), 0
    for r in range(4):
        low = 48 - 16 * r
        part = df.where(F.shiftrightunsigned(shifted, low + 16) == prefix) if r else df
        counts = {x.d: x["count"] for x in part.groupBy(F.shiftrightunsigned(shifted, low).bitwiseAND(F.lit(65535)).alias("d")).count().collect()}
        for d in sorted(counts, reverse=True):
            if k <= counts[d]:
                prefix = prefix * 65536 + d
                break
            k -= counts[d]
        else:
            return None
    return prefix - (1 << 63)


def resample(docs: DataFrame, labels: DataFrame, share: float = 0.85, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 20_000, temper: float = 1.0, seed: int = 1) -> DataFrame:
    """(key, n_grams, log_weight, sample_key, kept) for every row; ``kept`` marks the round(share * rows) largest sample keys."""
    from tessella.llm.base import written

    shipped = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels, key, text, label, max_rows))
    kept = docs.select(F.col(key), F.col(text).alias("__text"))

    def make():
        table, ratios = Hashes(), shipped.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, w = [], []
            for value in strings(batch, "__text"):
                g = table.grams(value)
                n.append(len(g))
                w.append(float(ratios[g].sum() * temper))
            return pa.RecordBatch.from_arrays([batch.column(key), pa.array(n, pa.int64()), pa.array(w, pa.float64())], [key, "n_grams", "log_weight"])

        return step

    scored = map_batches(kept, make, StructType([docs.schema[key], StructField("n_grams", LongType()), StructField("log_weight", DoubleType())]))
    scored = written(scored.withColumn("sample_key", F.col("log_weight") + gumbel(F.col(key), seed)).withColumn("__d", digits(F.col("sample_key"))), "weights")
    bound = kth_largest(scored, "__d", round(share * scored.count()))
    return scored.withColumn("kept", F.col("__d") >= bound if bound is not None else F.lit(False)).drop("__d")
