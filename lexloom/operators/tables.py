"""State changes as frames: the new version of a table is a join of the old one and the change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T


def upsert_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """By path. A given embedding wins; without one the old stays if the text did, else it is null. Both: path, text, embedding."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col("o.path") == F.col("n.path"), "full")
    is_new = F.col("n.path").isNotNull()
    kept = F.coalesce(F.col("n.embedding"), F.when(F.col("o.text") == F.col("n.text"), F.col("o.embedding")))
    return joined.select(F.coalesce("n.path", "o.path").alias("path"), F.when(is_new, F.col("n.text")).otherwise(F.col("o.text")).alias("text"), F.when(is_new, kept).otherwise(F.col("o.embedding")).alias("embedding"))


def purge_stale(chunks: DataFrame, edges: DataFrame, active: DataFrame, doc_code: str) -> tuple[DataFrame, DataFrame]:
    """A document's chunks outside active(path) go, and the edges at them."""
    stale = chunks.filter(F.col("doc_code") == doc_code).join(active.select("path"), "path", "left_anti").select("path")
    left = chunks.join(stale, "path", "left_anti")
    edges = edges.join(stale.withColumnRenamed("path", "source"), "source", "left_anti").join(stale.withColumnRenamed("path", "target"), "target", "left_anti")
    return left, edges


def cached_embeddings(texts: DataFrame, cache: DataFrame, model: str, dim: int) -> DataFrame:
    """texts(text) -> text, text_sha256, embedding (null: not cached)."""
    key = cache.filter((F.col("model") == model) & (F.col("dim") == dim)).select("text_sha256", "embedding")
    return texts.select("text").distinct().withColumn("text_sha256", T.sha256(F.col("text"))).join(key, "text_sha256", "left")


def stored_embeddings(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new rows whose key (model, dim, text_sha256) it lacks; of several new rows for one key any counts."""
    key = ["model", "dim", "text_sha256"]
    return cache.unionByName(new.dropDuplicates(key).join(cache.select(*key), key, "left_anti").select(cache.columns))


def missing_embeddings(chunks: DataFrame) -> DataFrame:
    return chunks.filter("embedding is null").groupBy("doc_code").agg(F.count("*").alias("missing"))


def missing_texts(chunks: DataFrame) -> DataFrame:
    return chunks.filter("embedding is null").select("text").distinct()


def catalog(docs: DataFrame, chunks: DataFrame, on) -> DataFrame:
    """Documents with their number of chunks (0 kept) and whether they are in force on a date."""
    counts = chunks.groupBy("doc_code").agg(F.count("*").alias("n_chunks"))
    joined = docs.join(counts, "doc_code", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    return joined.withColumn("in_force", T.in_force(F.col("effective"), F.col("expiration"), on))


def document_violations(docs: DataFrame) -> DataFrame:
    """Rows that break the table's rules."""
    rule = F.when(F.col("doc_code").isNull(), "doc_code is null").when(F.col("effective").isNull(), "effective is null").when(F.col("expiration") < F.col("effective"), "expires before it takes effect")
    return docs.withColumn("violation", rule).filter("violation is not null")


def upsert_documents(old: DataFrame, new: DataFrame, key: str = "doc_code", kept: tuple[str, ...] = ("id", "created_at")) -> DataFrame:
    """New rows replace old ones by key, all columns but `kept`, which stay as they were. `new` holds a key once."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    is_new, is_old = F.col(f"n.{key}").isNotNull(), F.col(f"o.{key}").isNotNull()
    return joined.select(*[F.when((is_old if c in kept else ~is_new), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in old.columns])


def fill_embeddings(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Null embeddings filled by text; vectors(text, embedding) holds a text once. Others stay."""
    filled = vectors.select("text", F.col("embedding").alias("_new"))
    return chunks.join(filled, "text", "left").withColumn("embedding", F.coalesce("embedding", "_new")).select(chunks.columns)
