"""Versioned tables: a change is written whole beside the old version, then one rename makes it current.

A store is a folder `root`/versions/<n>/<table> of Parquet tables and a pointer file `root`/CURRENT. Readers follow the pointer, so they
see the version before a commit or the one after it, never a mixture; a writer that fails leaves only an unreferenced folder. All paths
go through Hadoop's file systems, so a store may lie wherever Spark reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def current(spark: SparkSession, root: str) -> str | None:
    """Folder of the current version; None before the first commit."""
    fs, at = _fs(spark, f"{root}/CURRENT")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        name = bytes(stream.readAllBytes()).decode().strip()
    finally:
        stream.close()
    return f"{root}/versions/{name}"


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    at = current(spark, root)
    if at is None:
        raise FileNotFoundError(f"{root} holds no version")
    return spark.read.parquet(f"{at}/{table}")


def commit(spark: SparkSession, root: str, tables: dict, partitions: dict[str, str] | None = None) -> str:
    """Write all tables as one new version and make it current; its folder. A table that is left out stays as it is.

    tables: name -> frame, or a function of the new folder that gives one from the tables written before it.
    """
    before = current(spark, root)
    number = int(before.rpartition("/")[2]) + 1 if before else 1
    at = f"{root}/versions/{number}"
    fs, folder = _fs(spark, at)
    fs.delete(folder, True)  # what a writer that failed left there
    kept = [] if before is None else [s.getPath().getName() for s in fs.listStatus(_fs(spark, before)[1])]
    for name, df in {**{k: spark.read.parquet(f"{before}/{k}") for k in kept if k not in tables}, **tables}.items():
        writer = (df(at) if callable(df) else df).write.mode("errorifexists").option("compression", "zstd")
        if partitions and name in partitions:
            writer = writer.partitionBy(partitions[name])
        writer.parquet(f"{at}/{name}")
    _, fresh = _fs(spark, f"{root}/CURRENT.{number}")
    stream = fs.create(fresh, True)
    try:
        stream.write(bytearray(str(number).encode()))
    finally:
        stream.close()
    _, pointer = _fs(spark, f"{root}/CURRENT")
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    array = spark.sparkContext._gateway.new_array(options, 1)
    array[0] = options.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fresh, pointer, array)
    return at


def prune(spark: SparkSession, root: str) -> int:
    """Delete all versions but the current one; how many went."""
    at = current(spark, root)
    fs, folder = _fs(spark, f"{root}/versions")
    gone = [s.getPath() for s in fs.listStatus(folder) if at is None or s.getPath().getName() != at.rpartition("/")[2]]
    for path in gone:
        fs.delete(path, True)
    return len(gone)


def truncate(spark: SparkSession, root: str, *tables: str) -> str:
    """A new version in which the named tables are empty."""
    return commit(spark, root, {t: read(spark, root, t).limit(0) for t in tables})


def migration_difference(snapshot: list[str], here: list[str]) -> list[str]:
    """Migrations that a snapshot has and this checkout lacks, in the snapshot's order: with any, it must not be imported."""
    return [m for m in snapshot if m not in set(here)]
