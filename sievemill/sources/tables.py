"""Tables between the stages of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def with_checkpoints(spark: SparkSession) -> None:
    """Make checkpoint() usable: the session's own folder; a temporary one only where everything is one machine."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sievemill-"))


def shared_folder(spark: SparkSession) -> str:
    with_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/sievemill-{uuid.uuid4().hex}"


#: Files a core that a table written after a shuffle has at most.
FILES_A_CORE = 4


def cut(df: DataFrame, shuffled: bool = False) -> DataFrame:
    """df with its lineage cut: written as a table to the folder of checkpoints that all executors share.

    shuffled: df comes out of a shuffle, whose partitions are written as at most FILES_A_CORE files a
    core, since hundreds of small files cost more than what is in them.
    """
    folder = shared_folder(df.sparkSession)
    if shuffled:
        df = df.coalesce(FILES_A_CORE * df.sparkSession.sparkContext.defaultParallelism)
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out.cut_folder = folder
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by its keys over all cores, for work whose time is far more than its bytes let a scan's few tasks expect."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), FILES_A_CORE * spark.sparkContext.defaultParallelism), *keys)


def release(*tables: DataFrame) -> None:
    """Delete tables of cut() that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
