"""The folder that driver and executors share, and lineage cuts in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """Under the checkpoint folder where one is named; else a temporary one, on a local master only."""
    named, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not hasattr(sc, "_lexloom_work"):
        sc._lexloom_work = f"{named}/lexloom-{sc.applicationId}" if named else tempfile.mkdtemp(prefix="lexloom-work")
    return sc._lexloom_work


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table of fewer files than cores dealt to all cores, as a file of one row group is one task; a larger one as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` once, in the checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or work_folder(df.sparkSession))
    return df.checkpoint(eager=True)
