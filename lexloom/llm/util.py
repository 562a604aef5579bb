"""Session helpers: lineage cuts in the shared folder, shipping the package to executors, size-checked broadcasts."""

from __future__ import annotations

import gc
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS, BATCH_BYTES = 8192, "4m"


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches and make this package importable in the workers of any executor."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    sc = spark.sparkContext
    if getattr(sc, "_lexloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="lexloom")) / "lexloom_pkg.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    sc.addPyFile(str(archive))
    sc._lexloom_shipped = True


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` once in the cluster's shared checkpoint folder; a folder of our own only on a local master."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lexloom-checkpoint"))
    return df.checkpoint(eager=True)


def cut_bare(df: DataFrame) -> DataFrame:
    """`cut` for loops: without the constraints that a checkpoint keeps of its plan, which grow with each step and slow planning."""
    rdd, spark = cut(df)._jdf.queryExecution().analyzed().rdd(), df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rdd, df._jdf.schema(), False), spark)


def drop(*frames: DataFrame) -> None:
    """Delete what `cut` wrote for frames that no later job reads."""
    for df in frames:
        at = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if at.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at.get())
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of frames that nothing refers to any more, before the next large shuffle."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """Hint a broadcast only after counting the (materialised, narrow) rows; beyond the bound the plain join stays."""
    return F.broadcast(df) if df.count() <= max_rows else df


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(text) -> "F.Column":
    """Second half of a row's identity, so that rows that share a doc_id but not the text stay apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def squeeze(texts: list[bytes]) -> pa.Array:
    """Texts compressed one by one, for shuffles and checkpoints that carry them."""
    codec = pa.Codec("zstd", compression_level=3)
    return pa.array([len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in texts], pa.binary())


def unsqueeze(column: pa.Array) -> list[bytes]:
    codec = pa.Codec("zstd")
    return [codec.decompress(b[8:], int.from_bytes(b[:8], "little"), asbytes=True) for b in column.to_pylist()]
