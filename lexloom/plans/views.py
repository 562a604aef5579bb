"""The driver's tables seen as a document corpus: chunks on a path hierarchy, a citation graph, stated queries."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import index
from lexloom.sources import session, store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str, vectors: bool = True, hashed: bool = False) -> DataFrame:
    """hashed: with text_sha256, found before the join, so that a query that needs no text joins none."""
    d = table(spark, sf_dir, "documents")
    day = lambda n: F.date_add(F.lit("2020-01-01").cast("date"), n.cast("int"))
    d = d.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("c."), "lang", F.lit("."), "source", F.lit(".d"), F.col("doc_id").cast("string")).alias("path"), F.col("source").alias("doc_code"), "text",
        day(F.col("doc_id") % 700).alias("effective"), F.when(F.col("doc_id") % 3 != 0, day(F.col("doc_id") % 700 + 200)).alias("expiration"), F.col("doc_id").alias("start_line"),
    )
    if hashed:
        d = d.withColumn("text_sha256", T.sha256(F.col("text")))
    if not vectors:
        return d
    return d.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id", "left")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text, whole, as a query; its words 3 to 5 are the pattern that it looks for verbatim."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query_text"), F.array_join(F.slice(F.split("text", " "), 3, 3), " ").alias("pattern"))
    return b.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query_vector")), "qid", "left")


def _version(spark: SparkSession, path: str) -> str:
    """Changes with the files of a table: their names, sizes and times."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at))
    return hashlib.sha256(repr(files).encode()).hexdigest()[:16]


def fresh() -> str:
    """A name that no other run uses."""
    return uuid.uuid4().hex


def indexed(spark: SparkSession, sf_dir: str) -> index.Index:
    """The keyword index of the documents: built by the first query of a table version, read by all others."""
    root = f"{session.work_folder(spark)}/index-{_version(spark, f'{sf_dir}/documents.parquet')}"
    return index.Index(spark, root) if store.current(spark, root) else index.build(chunks(spark, sf_dir, False), root)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region / nation / customer as paths r0.n3.c17 with their depth."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    c = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    path = F.concat(F.lit("r"), "n_regionkey", F.lit(".n"), "n_nationkey", F.lit(".c"), "c_custkey")
    leaf = c.select(path.alias("path"), F.col("c_custkey").cast("long").alias("start_line"))
    inner = n.select(F.concat(F.lit("r"), "n_regionkey", F.lit(".n"), "n_nationkey", F.lit(".body")).alias("path"), (-F.col("n_nationkey")).cast("long").alias("start_line"))
    return leaf.unionByName(inner)


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier -> part -> supplier edges of all line items, with a relation by line number."""
    li = table(spark, sf_dir, "lineitem")
    relation = F.element_at(F.array(*map(F.lit, ("REFERENCES", "AMENDS", "SEE_ALSO"))), (F.col("l_linenumber") % 3 + 1).cast("int"))
    supplier, part, returned = F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("p"), "l_partkey"), F.col("l_returnflag") == "R"
    one = li.filter(~returned).select(supplier.alias("source"), part.alias("target"), relation.alias("relation"))
    two = li.filter(returned).select(part.alias("source"), supplier.alias("target"), relation.alias("relation"))
    both = one.unionByName(two).distinct()
    return both.withColumn("edge_id", F.concat_ws(":", "source", "target", "relation")).withColumn("citation", F.concat(F.lit("cites "), F.substring("target", 1, 2)))


def nodes(edges: DataFrame) -> DataFrame:
    """Ends of the edges as chunks: path, doc_code, start_line."""
    ends = edges.select(F.col("source").alias("path")).union(edges.select("target")).distinct()
    return ends.select("path", F.substring("path", 1, 1).alias("doc_code"), F.expr("substring(path, 2)").cast("long").alias("start_line"))
