"""Written tables in the folder that every executor and the driver share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from stratavox.sources.tables import fresh_path, hadoop_path

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class tidy_shuffles:
    """Within it, an SQL execution drops its shuffle files as it ends.

    A written table needs none of the shuffles it came from, so disk use is that of
    the largest step and not the sum of all steps.
    """

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self):
        self.before = self.conf.get(_CLEANUP, None)
        self.conf.set(_CLEANUP, "true")

    def __exit__(self, *_):
        if self.before is None:
            self.conf.unset(_CLEANUP)
        else:
            self.conf.set(_CLEANUP, self.before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with tidy_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stratavox_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``materialize`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_stratavox_path", None)
        if path:
            target, fs = hadoop_path(df.sparkSession, path)
            fs.delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return a worker's freed memory to the system: workers outlive their tasks, and idle ones would keep their peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library than glibc


def batchwise(function):
    """For mapInArrow: ``function(batch)`` yields batches; at the end the worker's freed memory goes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from function(batch)
        del batches
        give_back()

    return run


def groupwise(function):
    """For applyInArrow: ``function(table)``, after which the worker's freed memory goes back."""

    def run(t: pa.Table) -> pa.Table:
        out = function(t)
        del t
        give_back()
        return out

    return run
