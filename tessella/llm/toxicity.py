"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words without outer punctuation and their prefixes of 3
to 6 characters, hashed into ``DIMS`` buckets; a document is the set of its
terms. A second-order factorization machine,

    logit = w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),

learns weights and pairwise interactions (an insult *with* a group mention).

Training uses at most ``max_rows`` labelled rows, those of smallest key hash;
that bound is the parameter's documented meaning. Class counts of all terms in
these rows are made in Spark; the ``terms`` buckets that differ most between
the classes stay, so that what reaches the driver is bounded by ``max_rows``
short lists. Labels, language, source and id are never inputs of a score.

Defined results: null or empty texts have no terms and score sigmoid(w0);
repeated rows score alike; conflicting labels of a key count as toxic; null
labels are ignored; without any labelled row every score is 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessella.llm.base import map_batches, small_batches, strings

DIMS = 1 << 18
OUTER = ".,;:!?\"'()[]{}*#$%&|<>-_/\\"
CACHE = 300_000


class Terms(dict):
    """word -> the buckets of its terms, among ``wanted`` where that is given."""

    def __init__(self, wanted: dict[int, int] | None = None):
        super().__init__()
        self.wanted = wanted

    def __missing__(self, word: str) -> tuple[int, ...]:
        bare = word.lower().strip(OUTER)
        found: list[int] = []
        if bare:
            for term in [bare, *("^" + bare[:n] for n in range(3, min(6, len(bare)) + 1))]:
                found.append(zlib.crc32(term.encode("utf-8", "replace")) % DIMS)
        if self.wanted is not None:
            found = [self.wanted[x] for x in found if x in self.wanted]
        if len(self) >= CACHE:
            self.clear()
        if len(word) <= 64:
            self[word] = tuple(found)
        return tuple(found)

    def of(self, text: str) -> list[int]:
        out: set[int] = set()
        for found in filter(None, map(self.__getitem__, set(text.split()))):
            out.update(found)
        return sorted(out)


class Machine:
    """A trained factorization machine over the chosen buckets."""

    def __init__(self, buckets: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.buckets, self.w0, self.w, self.v = buckets, w0, w, v

    def logit(self, x: list[int]) -> float:
        if not x:
            return self.w0
        v = self.v[x]
        s = v.sum(0)
        return float(self.w0 + self.w[x].sum() + 0.5 * (s @ s - (v * v).sum()))


def train_machine(rows: list[list[int]], y: np.ndarray, n: int, factors: int = 4, epochs: int = 40, rate: float = 0.1, l2: float = 2e-3, batch: int = 128, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Adagrad on the log loss. rows: indexes below n."""
    rng = np.random.default_rng(seed)
    base = np.log((y.sum() + 1) / (len(y) - y.sum() + 1)) if len(y) else 0.0
    w0, w, v = float(base), np.zeros(n), rng.normal(0, 0.02, (n, factors))
    g0, gw, gv = 1e-6, np.full(n, 1e-6), np.full((n, factors), 1e-6)
    arrays = [np.asarray(r, np.int64) for r in rows]
    for _ in range(epochs):
        order = rng.permutation(len(arrays))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            sizes = np.array([len(arrays[i]) for i in pick])
            flat = np.concatenate([arrays[i] for i in pick]) if sizes.sum() else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(len(pick)), sizes)
            vf = v[flat]
            s = np.zeros((len(pick), factors))
            np.add.at(s, doc, vf)
            q = np.bincount(doc, (vf * vf).sum(1), len(pick))
            z = w0 + np.bincount(doc, w[flat], len(pick)) + 0.5 * ((s * s).sum(1) - q)
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
            used, back = np.unique(flat, return_inverse=True)
            dw = np.bincount(back, d[doc], len(used)) + l2 * w[used] / len(pick)
            dv = np.zeros((len(used), factors))
            np.add.at(dv, back, d[doc][:, None] * (s[doc] - vf))
            dv += 5 * l2 * v[used] / len(pick)
            g0 += d.sum() ** 2
            w0 -= rate * d.sum() / np.sqrt(g0)
            gw[used] += dw * dw
            w[used] -= rate * dw / np.sqrt(gw[used])
            gv[used] += dv * dv
            v[used] -= rate * 0.5 * dv / np.sqrt(gv[used])
    return w0, w, v


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 12_000, terms: int = 2048, min_docs: int = 4) -> Machine:
    """Train on at most ``max_rows`` rows of ``labels`` that ``docs`` has texts for.

    Where an id stands on several texts, the least of them is its text, so that
    repeated ids don't add to what is collected.
    """
    picked = labels.select(F.col(key).alias("__k"), F.col(label).cast("int").alias("__y")).dropna().groupBy("__k").agg(F.max("__y").alias("__y"))
    picked = picked.join(docs.select(F.col(key).alias("__k")), "__k", "left_semi").orderBy(F.xxhash64("__k"), "__k").limit(max_rows)
    small_batches(docs.sparkSession)
    known = docs.select(F.col(key).alias("__k"), F.col(text).alias("__text")).join(F.broadcast(picked), "__k").groupBy("__k", "__y").agg(F.min("__text").alias("__text")).select("__y", "__text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sums = Terms(), np.zeros((2, DIMS + 1), np.int64)
        for batch in batches:
            for y, value in zip(batch.column("__y").to_pylist(), strings(batch, "__text"), strict=True):
                sums[y, table.of(value)] += 1
                sums[y, DIMS] += 1
        at = np.flatnonzero(sums.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0, at]), pa.array(sums[1, at])], ["term", "neg", "pos"])

    counted = known.mapInArrow(count, "term long, neg long, pos long").groupBy("term").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    counted = counted.persist()
    try:
        sizes = counted.where(F.col("term") == DIMS).first()
        if sizes is None or not sizes.pos or not sizes.neg:
            return Machine(np.zeros(0, np.int64), -30.0 if sizes is None or not sizes.pos else 0.0, np.zeros(0), np.zeros((0, 1)))
        share = sizes.pos / (sizes.pos + sizes.neg)
        n = F.col("neg") + F.col("pos")
        z = (F.col("pos") - n * share) / F.sqrt(n * share * (1 - share))
        best = counted.where((F.col("term") != DIMS) & (n >= min_docs)).orderBy(F.desc(F.abs(z)), "term").limit(terms).select("term").collect()
    finally:
        counted.unpersist()
    buckets = np.array(sorted(r.term for r in best), np.int64)
    index = {int(b): i for i, b in enumerate(buckets)}

    def make():
        table = Terms(index)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column("__y"), pa.array([table.of(x) for x in strings(batch, "__text")], pa.list_(pa.int32()))], ["y", "x"])

        return step

    rows = map_batches(known, make, "y int, x array<int>").collect()
    rows.sort(key=lambda r: (r.y, r.x))
    w0, w, v = train_machine([r.x for r in rows], np.array([r.y for r in rows], float), len(buckets))
    return Machine(buckets, w0, w, v)


def score(docs: DataFrame, machine: Machine, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of toxicity of every whole text."""
    names = [x for x in docs.columns if x != out]
    kept = docs.select(*[f"`{x}`" for x in names])
    shipped = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        model = shipped.value
        table = Terms({int(b): i for i, b in enumerate(model.buckets)})

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            z = np.array([model.logit(table.of(x)) for x in strings(batch, text)])
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*batch.schema.names, out])

        return step

    return map_batches(kept, make, StructType([*kept.schema.fields, StructField(out, DoubleType())]))
