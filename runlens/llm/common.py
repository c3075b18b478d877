"""What the operators of this subpackage share: reading documents and Arrow text access."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.session import ship


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`mapInArrow` with the package sent to the executors first."""
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


def free(columns: list[str], *names: str) -> list[str]:
    """Names that no column has, from the given ones; Spark compares names without case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the UTF-8 bytes of `column` pass `limit`; one long text stands alone and whole."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def few(df: DataFrame, rows: int, each: int = 1 << 18) -> DataFrame:
    """df, of at most `rows` rows, with a task and a file for `each` of them: a small table isn't written as hundreds of files."""
    return df.coalesce(max(1, -(-rows // each)))


def release() -> None:
    """Give memory that is free again back to the system; workers live on and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """n numbers that Spark hashes to n different partitions of n, so that each task gets one group.

    Beyond 65,536 groups the plain numbers will do: a task then meets a few groups, as chance has it.
    """
    if n > 1 << 16:
        return list(range(n))
    tried = n * 16
    while True:
        rows = spark.range(tried).select(F.pmod(F.hash("id"), F.lit(n)).alias("p"), "id").groupBy("p").agg(F.min("id").alias("id")).collect()
        if len(rows) == n:
            return [r["id"] for r in sorted(rows, key=lambda r: r["p"])]
        tried *= 4


def keyed(keys: list[int], number: Column) -> Column:
    """The key of a number from 0 to n - 1."""
    if len(keys) > 1 << 16:
        return number.cast("long")
    return F.element_at(F.from_json(F.lit(str(keys)), "array<bigint>"), (number + 1).cast("int"))  # folded to a constant array
