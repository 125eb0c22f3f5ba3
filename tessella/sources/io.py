"""Sources and sinks: Parquet, CSV, JSON, ORC, text, pandas and Arrow, tagged reads, snapshots.

Everything reads and writes through Spark, in parallel and with column
pruning and filter push-down; nothing is funnelled through the driver except
``to_pandas`` and its kind, which refuse more rows than they are allowed.
HDF5 and Zarr need libraries that are not here; their calls say so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMATS = ("parquet", "orc", "csv", "json", "text", "avro")
COMPRESSIONS = (None, "none", "snappy", "gzip", "zstd", "lz4", "brotli")


def read(spark: SparkSession, path: str | Sequence[str], kind: str = "parquet", columns: Sequence[str] | None = None, schema: StructType | str | None = None, where: str | None = None, merge_schema: bool = False, **options) -> DataFrame:
    """Read files, folders or globs. ``columns`` and ``where`` reach the scan."""
    reader = spark.read.format(kind).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if merge_schema:
        reader = reader.option("mergeSchema", "true")
    df = reader.load(list(path) if not isinstance(path, str) else path)
    if where:
        df = df.where(where)
    return df.select(*columns) if columns else df


def read_parquet(spark: SparkSession, path, columns=None, **more) -> DataFrame:
    return read(spark, path, "parquet", columns, **more)


def read_csv(spark: SparkSession, path, schema=None, header: bool = True, sep: str = ",", columns=None) -> DataFrame:
    """Without a schema every column is text: types are never guessed by reading the data twice."""
    return read(spark, path, "csv", columns, schema, header=str(header).lower(), sep=sep)


def read_tagged(spark: SparkSession, path, kind: str = "parquet", tag: str = "file", **more) -> DataFrame:
    """With the name of the file that each row came from."""
    return read(spark, path, kind, **more).withColumn(tag, F.input_file_name())


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", compression: str | None = "zstd", partition_by: Sequence[str] = (), files: int | None = None, **options) -> None:
    """mode: error, overwrite, append or ignore."""
    out = df.repartition(files) if files else df
    writer = out.write.format(kind).mode(mode).options(**options)
    if compression:
        writer = writer.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def to_parquet(df: DataFrame, path: str, **more) -> None:
    write(df, path, "parquet", **more)


def to_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True, **more) -> None:
    write(df, path, "csv", compression=more.pop("compression", None), sep=sep, header=str(header).lower(), **more)


def bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, mode: str = "overwrite") -> None:
    """A table whose later joins and groupings on the keys need no shuffle."""
    df.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def datasets(spark: SparkSession, path: str, kind: str = "parquet") -> list[str]:
    """The column names in a file's footer."""
    return read(spark, path, kind).columns


def null_counts(df: DataFrame) -> DataFrame:
    """One row: missing values by column."""
    return df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])


def to_pandas(df: DataFrame, limit: int = 1_000_000):
    """Refuses what has more than ``limit`` rows."""
    out = df.limit(limit + 1).toPandas()
    if len(out) > limit:
        raise MemoryError(f"more than {limit} rows; raise the limit or write the table instead")
    return out


def to_arrow(df: DataFrame, limit: int = 1_000_000):
    out = df.limit(limit + 1).toArrow()
    if out.num_rows > limit:
        raise MemoryError(f"more than {limit} rows; raise the limit or write the table instead")
    return out


def to_list(df: DataFrame, column: str, limit: int = 1_000_000) -> list:
    return to_arrow(df.select(column), limit).column(0).to_pylist()


def to_markdown(df: DataFrame, limit: int = 1000) -> str:
    rows = to_arrow(df, limit).to_pylist()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(str(r[c]) for c in df.columns) + " |" for r in rows])


def from_pandas(spark: SparkSession, pdf) -> DataFrame:
    return spark.createDataFrame(pdf)


def snapshot(spark: SparkSession, path: str, **tables: DataFrame) -> None:
    """Save named tables in one folder."""
    for name, df in tables.items():
        write(df, f"{path}/{name}", mode="overwrite")


def restore(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {name: read(spark, f"{path}/{name}") for name in names}


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the folder in spark.checkpoint.dir."""
    return df.checkpoint(eager=True)


def register(df: DataFrame, name: str) -> DataFrame:
    """Make a table known by name to SQL and to other code of the session."""
    df.createOrReplaceTempView(name)
    return df


def attach(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def unregister(spark: SparkSession, name: str) -> bool:
    return bool(spark.catalog.dropTempView(name))


def is_registered(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def _absent(kind: str):
    def call(*_, **__):
        raise NotImplementedError(f"{kind} needs a library that this installation lacks; use Parquet")

    return call


read_hdf, to_hdf, read_zarr, to_zarr = (_absent(x) for x in ("HDF5", "HDF5", "Zarr", "Zarr"))
