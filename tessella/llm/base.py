"""What the training-data operators share: table access, cut lineage, Arrow helpers.

Temporary tables go to the folder named by ``spark.checkpoint.dir``, which the
driver and all executors share. Only where that setting is absent (tests on
one machine) a folder of our own is chosen and set.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Rows and bytes of one Arrow batch; with long texts the byte limit decides.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessella-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


#: Where tables of ``written`` lie. What is derived from one by ``drop`` of a column or a filter isn't listed.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def narrowed(df: DataFrame, *names: str) -> DataFrame:
    """Some columns of a table of ``written``; ``drop`` of the result deletes the table."""
    out = df.select(*names)
    if df in _paths:
        _paths[out] = _paths[df]
    return out


#: Rows of a few numbers that may be broadcast; in memory they take some 20 MB.
FEW = 200_000


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` marked to be broadcast by a join if it has few rows, and not to be otherwise.

    Left to itself, the planner goes by the size of compressed files, of which
    repeated values take next to nothing. rows: not more than so many, if known.
    """
    return df.hint("broadcast" if (df.count() if rows is None else rows) <= FEW else "merge")


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it; Spark tells no case apart."""
    taken = {x.lower() for x in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that are read no more; other frames are left alone."""
    for df in tables:
        if (path := _paths.pop(df, None)) is not None:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once a Spark application, so that their workers can import it wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="tessella-"), "tessella.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("tessella", os.path.relpath(full, package)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def small_batches(spark: SparkSession) -> None:
    """Bound what an Arrow batch may hold, so that long texts don't fill a Python worker; make the package known to workers."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with per-task state: ``make()`` runs once a task and returns the batch function."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if (out := step(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]
