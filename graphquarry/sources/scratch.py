"""Intermediate tables in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session, as in tests, may do without it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get() if own.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="graphquarry-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/graphquarry/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables; call it when no result that reads them is needed any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/graphquarry")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stash(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back.

    This cuts the lineage, so a lost executor costs a re-read and not a re-run, and the
    statistics of the written files let the optimiser pick join sides by true size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt over all cores if it comes from fewer files than there are cores; else as it is.

    A small table is often one file, and then one task would do all the work on its texts.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *by) if len(df._jdf.inputFiles()) < cores else df


def small(df: DataFrame, most: int) -> DataFrame:
    """``df``, of rows of bounded width, marked for a broadcast if it has ``most`` rows at most; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
