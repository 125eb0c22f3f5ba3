"""Connected components of an edge table, by hooking and pointer jumping.

Every node hooks onto its least neighbour if that is smaller than itself; the
trees are flattened by joining labels to the labels of their labels, and the
edges between different trees go on as edges of their labels. Edges never
reach the driver, only whether something is left. Nothing is grouped but by
aggregations that are combined before the shuffle, and the joins on a hot label
have one row a key on the other side, so that a skewed join is split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessella.llm.base import drop, narrowed, sized, small_batches, written

#: Trees halve in depth, and edges lose most of their nodes, in every round.
ROUNDS = 100
#: Edges that one task settles, in some 100 MB.
LOCAL = 500_000


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges in order, and the least of the component of each."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, other = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while (apart := label[one] != label[other]).any():
        one, other = one[apart], other[apart]
        x, y = label[one], label[other]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (higher := label[label] != label).any():
            label[higher] = label[label[higher]]
    return nodes, nodes[label]


def settled(edges: DataFrame) -> DataFrame:
    """The written table (node, label) of at most ``LOCAL`` edges (a, b), by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := list(batches):
            whole = pa.Table.from_batches(held)
            nodes, label = least_labels(*(whole.column(x).to_numpy() for x in "ab"))
            moved = nodes != label
            kind = whole.schema.field("a").type
            yield pa.RecordBatch.from_arrays([pa.array(nodes[moved], kind), pa.array(label[moved], kind)], ["node", "label"])

    small_batches(edges.sparkSession)
    kind = edges.schema["a"].dataType
    return written(edges.select("a", "b").coalesce(1).mapInArrow(run, StructType([StructField(x, kind) for x in ("node", "label")])), "labels")


def roots(parents: DataFrame) -> DataFrame:
    """The written table (node, label) with every label the root of its tree. parents: (node, label < node), one row a node."""
    now = written(parents.select("node", "label"), "labels")
    if now.count() <= LOCAL:
        out = settled(now.select(F.col("node").alias("a"), F.col("label").alias("b")))
        drop(now)
        return out
    for _ in range(ROUNDS):
        above = now.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        after = written(now.join(above.hint("merge"), "label", "left").select("node", F.coalesce("higher", "label").alias("label"), F.col("higher").isNotNull().alias("moved")), "labels")
        drop(now)
        now = after
        if now.where("moved").isEmpty():
            return narrowed(now, "node", "label")
    raise RuntimeError("trees did not flatten")


def relabelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The distinct edges (a < b) between different labels; nodes without a label are their own."""
    left = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    right = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    ends = edges.join(left.hint("merge"), "a", "left").join(right.hint("merge"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    return ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def composed(labels: DataFrame, higher: DataFrame) -> DataFrame:
    """Labels of labels: (node, label) of both, each node with its last label."""
    above = higher.select(F.col("node").alias("label"), F.col("label").alias("__over"))
    return labels.join(sized(above), "label", "left").select("node", F.coalesce("__over", "label").alias("label")).unionByName(higher.select("node", "label"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node but the least of its component, which is the label. Null ends and loops are ignored."""
    ends = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("whole"))
    now = written(ends.where("whole and a <> b").select("a", "b").distinct(), "edges")
    labels = None
    for _ in range(ROUNDS):
        if not (rows := now.count()):
            return labels if labels is not None else now.select(F.col("b").alias("node"), F.col("a").alias("label"))
        if last := rows <= LOCAL:
            hooked = settled(now)
        else:
            hooked = roots(now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")))
            after = written(relabelled(now, hooked), "edges")
        drop(now)
        if labels is None:
            labels = hooked
        else:
            both = written(composed(labels, hooked), "labels")
            drop(labels, hooked)
            labels = both
        if last:
            return labels
        now = after
    raise RuntimeError("components did not settle")
