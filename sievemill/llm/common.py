"""What the operators of this subpackage share: tables, checkpoints, Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import cut, release, shared_folder, with_checkpoints  # noqa: F401  for the modules of this subpackage

#: Records an Arrow batch may hold; bounds a Python worker's memory when texts are long.
BATCH_RECORDS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the records of an Arrow batch to BATCH_RECORDS unless they are lower already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_RECORDS:
        spark.conf.set(key, str(BATCH_RECORDS))


def give_back() -> None:
    """Return freed memory to the system: an idle worker, kept for later tasks, else holds what its largest task needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def let(value, body):
    """body(value) with value computed once, also where lambdas use it for every element."""
    from pyspark.sql import functions as F

    return F.element_at(F.transform(F.array(value), body), 1)
