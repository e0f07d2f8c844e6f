"""Shared plumbing: table access, staged tables, lexing of byte strings."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where all run on one machine, and none is named, is it one of ours."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        import tempfile

        where = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Rows of a file of a narrow staged table.
FILE_ROWS = 100_000


def staged(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as Parquet and read it back.

    ``most`` is a bound of the rows of a narrow table; it is then written in as many files as that needs, not in one for
    each partition of a shuffle.
    """
    return staged_at(df, name, most)[0]


def staged_at(df: DataFrame, name: str, most: int | None = None) -> tuple[DataFrame, str]:
    """As ``staged``, with the path, for tables that are dropped once they are no longer read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df if most is None else df.coalesce(max(1, -(-most // FILE_ROWS)))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Drop a staged table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh_prefix(columns: list[str], prefix: str) -> str:
    """A prefix that no column has, whatever its case."""
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = "_" + prefix
    return prefix


def quoted(columns: list[str]) -> list[str]:
    """Column names as expressions, dots and all."""
    return ["`" + c.replace("`", "``") + "`" for c in columns]


#: Bytes of a batch that Python is given, and of the texts that are worked on at once, unless one text is longer.
BATCH_BYTES = 4 << 20
RUN_BYTES = 2 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are bounded by bytes, so that many long texts never meet in one batch."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name).removesuffix("b")
    if now.isdigit() and int(now) > BATCH_BYTES:  # a bound with a unit was set by the user
        conf.set(name, str(BATCH_BYTES))
    return df


def map_rows(df: DataFrame, work) -> DataFrame:
    """``mapInArrow`` with a result of the same columns, whatever their names; ``work`` finds them by place."""
    names = [f"c{i}" for i in range(len(df.columns))]
    schema = StructType([StructField(n, f.dataType) for n, f in zip(names, df.schema, strict=True)])
    return bounded(df).toDF(*names).mapInArrow(work, schema).toDF(*df.columns)


def runs_of(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of rows of a text column, of ``RUN_BYTES`` or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + RUN_BYTES, "right")))
        yield a, b
        a = b


def input_bytes(spark: SparkSession, df: DataFrame, column: str) -> int:
    """Bytes of a text column over all rows (one cheap aggregate)."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def binary(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column as UTF-8 byte strings; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b if b is not None else b"" for b in column.cast(kind).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), for naming and for unbiased minima."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
