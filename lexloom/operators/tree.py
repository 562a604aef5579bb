"""Operators on the path hierarchy. Paths are dot-separated labels; a subtree is matched by whole labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T


def provisions_under(chunks: DataFrame, path: str, limit: int = 50) -> DataFrame:
    """Chunks at or under a path in reading order (start_line, path), with the count before the limit."""
    found = chunks.filter(T.under(F.col("path"), path))
    return found.orderBy("start_line", "path").limit(limit).crossJoin(F.broadcast(found.agg(F.count("*").alias("full_count"))))


def navigate(chunks: DataFrame, path: str, scope: str = "children", limit: int = 50) -> DataFrame:
    """`parent_context` looks one level up; the result carries the requested path."""
    at = path.rpartition(".")[0] if scope == "parent_context" else path
    if not at:
        raise ValueError("a top-level path has no parent context")
    return provisions_under(chunks, at, limit).withColumn("requested", F.lit(path))


def expand_to_leaves(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(query_path) -> query_path, path: the chunk itself where it exists, else all chunks under it.

    Each chunk states its ancestors, so the ancestor join is a hash join.
    """
    each = chunks.select("path", F.explode(T.prefixes(F.col("path"))).alias("query_path"))
    found = each.join(wanted.select("query_path").distinct(), "query_path")
    exact = F.max(F.col("path") == F.col("query_path")).over(Window.partitionBy("query_path"))
    return found.withColumn("_exact", exact).filter(~F.col("_exact") | (F.col("path") == F.col("query_path"))).select("query_path", "path")


def sibling_windows(chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """Chunks whose parent is one of parents(parent), windows in numeric order."""
    number = F.coalesce(F.try_to_number(F.regexp_extract("path", r"\.w_(\d+)$", 1), F.lit("999999999")), F.lit(0)).cast("long")
    with_parent = chunks.withColumn("parent", T.parent_path(F.col("path")))
    return with_parent.join(parents.select("parent").distinct(), "parent", "left_semi").withColumn("window", number).orderBy("parent", "window", "path")


def in_request_order(rows: DataFrame, paths: list[str]) -> DataFrame:
    """Rows of the given paths, duplicates asked once, unknown ones skipped, in the order asked."""
    asked = rows.sparkSession.createDataFrame([(p, k) for k, p in enumerate(dict.fromkeys(paths))], "path string, ordinal long")
    return rows.join(F.broadcast(asked), "path").orderBy("ordinal")


def line_coverage(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Lines that are not in exactly one chunk: doc_code, line, n. docs: doc_code, n_lines; chunks: doc_code, start_line, end_line."""
    lines = docs.select("doc_code", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_lines").cast("long"))).alias("line"))
    held = chunks.select("doc_code", F.explode(F.sequence(F.col("start_line").cast("long"), F.col("end_line").cast("long"))).alias("line")).groupBy("doc_code", "line").agg(F.count("*").alias("held"))
    return lines.join(held, ["doc_code", "line"], "left").select("doc_code", "line", F.coalesce("held", F.lit(0)).alias("n")).filter("n <> 1")


def repeated_paths(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")
