"""Retrieval in batch: BM25 and cosine lists fused by reciprocal rank, verbatim search, the tagged list of both. Every operator takes a
frame of queries (qid first), so that many queries are one job.

chunks: id, path, doc_code, text, effective, expiration, start_line, embedding. Ranks follow unrounded scores and break ties by path.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lexloom.functions import text as T
from lexloom.operators import index as keyword
from lexloom.operators import vectors
from lexloom.operators.index import Index, ranked, widened
from lexloom.operators.models import rerank  # noqa: F401
from lexloom.sources import session

RRF_K, MISSING_RANK = 20, 999
LOW_SIMILARITY, LOW_RERANK = 0.63, -1.0
#: Bounds of the search tool's arguments.
SEARCH_LIMIT = 50
#: Rows of ids that are broadcast at most, after a count.
SENT_IDS = 500_000


def candidate_limit(limit: int) -> int:
    if limit < 1:
        raise ValueError("limit must be positive")
    return max(6 * limit, 120)


def allowed(chunks: DataFrame, on=None, doc_codes: list[str] | None = None, prefix: str | None = None) -> DataFrame:
    """Validity, scope and subtree. No codes: no filter; unknown codes: no rows."""
    if on is not None:
        chunks = chunks.filter(T.in_force(F.col("effective"), F.col("expiration"), on))
    if doc_codes:
        chunks = chunks.filter(F.col("doc_code").isin(doc_codes))
    return chunks.filter(T.under(F.col("path"), prefix)) if prefix else chunks


def without_weak_vectors(queries: DataFrame) -> DataFrame:
    """Queries of two words or more without any diacritic lose their vector: an embedder reads them badly."""
    return queries.withColumn("query_vector", F.when(~T.is_unaccented(F.col("query_text")), F.col("query_vector")))


def hybrid_search(chunks: DataFrame, index: Index, queries: DataFrame, limit: int = 10, rrf_k: int = RRF_K, on=None, doc_codes: list[str] | None = None, prefix: str | None = None) -> DataFrame:
    """qid, id, path, dense_rank, sparse_rank, similarity, phrase_matched, rrf_score, rank. Filters go below the top-k of both branches."""
    if rrf_k < 1:
        raise ValueError("rrf_k must be positive")
    most = candidate_limit(limit)
    near = vectors.nearest(allowed(chunks, on, doc_codes, prefix), queries, most).withColumnRenamed("rank", "dense_rank")
    said = keyword.bm25(index, queries, most, allowed(index.docs, on, doc_codes, prefix)).withColumnRenamed("rank", "sparse_rank").drop("bm25")
    both = near.join(said, ["qid", "id", "path"], "full")
    part = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
    fused = both.select(
        "qid", "id", "path", F.coalesce("dense_rank", F.lit(MISSING_RANK)).cast("long").alias("dense_rank"), F.coalesce("sparse_rank", F.lit(MISSING_RANK)).cast("long").alias("sparse_rank"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.coalesce("phrase_matched", F.lit(False)).alias("phrase_matched"), (part("dense_rank") + part("sparse_rank")).alias("rrf_score"),
    )
    return ranked(fused, limit, F.desc("rrf_score"), F.asc("path"))


def _first(limit: int):
    """A task's first `limit` rows by (distance, nulls last, doc_code, start_line, path) of each query, and how many it saw."""
    import heapq

    def key(r: dict) -> tuple:
        none = lambda x: (x is None, x)
        return r["distance"] is None, r["distance"] or 0.0, *(none(r[c])[:1] if r[c] is None else none(r[c]) for c in ("doc_code", "start_line", "path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        best: dict[int, list[dict]] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            by: dict[int, list[dict]] = {}
            for r in batch.to_pylist():
                by.setdefault(r["qid"], []).append(r)
            for q, rows in by.items():
                seen[q] = seen.get(q, 0) + len(rows)
                best[q] = heapq.nsmallest(limit, best.get(q, []) + rows, key=key)
        if schema is not None:
            rows = [r | {"seen": seen[q] if k == 0 else 0} for q, found in best.items() for k, r in enumerate(found)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema.append(pa.field("seen", pa.int64())))

    return run


def _grepped(found: DataFrame, limit: int) -> DataFrame:
    """found: qid, id, path, doc_code, start_line, distance -> with rank and full_count; one pass over the matches."""
    few = found.mapInArrow(_first(limit), widened(found, "seen", LongType()))
    total = few.withColumn("full_count", F.sum("seen").over(Window.partitionBy("qid"))).drop("seen")  # at most `limit` rows a task and query
    return ranked(total, limit, F.asc_nulls_last("distance"), F.asc("doc_code"), F.asc("start_line"), F.asc("path"))


_MATCH = ("id", "path", "doc_code", "start_line")


def verbatim_grep(chunks: DataFrame, pattern: str, is_regex: bool = False, limit: int = 10, query_vector: list[float] | None = None, on=None, doc_codes: list[str] | None = None, prefix: str | None = None) -> DataFrame:
    """id, path, doc_code, start_line, distance, rank, full_count (matches before the limit).

    Order: distance to the query's vector (nulls last), document, line, path. A chunk without a vector has no distance.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    found = allowed(chunks, on, doc_codes, prefix).filter(T.matches(F.col("text"), pattern, is_regex))
    distance = F.lit(None).cast("double")
    if query_vector:
        distance = F.when(F.col("embedding").isNotNull(), 1 - cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query_vector])))
    return _grepped(found.select(F.lit(0).cast("long").alias("qid"), *_MATCH, distance.alias("distance")), limit).drop("qid")


def grep_each(chunks: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """As `verbatim_grep` for every query(qid, pattern, query_vector), by substring: a stated set, sent in blocks to all chunks once each."""
    texts = session.spread(chunks.select(*_MATCH, "text", "embedding")).select(*_MATCH, F.lower("text").alias("lowered"), "embedding")
    found = None
    for part in keyword.blocks(queries):
        asked = part.filter("pattern <> ''").select("qid", F.lower("pattern").alias("sought"), "query_vector")
        met = texts.join(F.broadcast(asked), F.contains("lowered", F.col("sought")))  # a block of stated queries
        one = met.select("qid", *_MATCH, F.when(F.col("embedding").isNotNull() & F.col("query_vector").isNotNull(), 1 - cosine(F.col("embedding"), F.col("query_vector"))).alias("distance"))
        found = one if found is None else found.unionByName(one)
    return _grepped(found, limit)


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b):
    return _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def chunks_of(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks of the ids(id) of short lists, read once where they lie: ids are counted and sent to all, too many are joined by a shuffle."""
    return chunks.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, "id", "left_semi")


def paths_matching(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(qid, id) of wanted(qid, id, pattern) whose chunk's text holds the pattern, by substring."""
    return wanted.join(chunks.select("id", "text"), "id").filter(F.contains(F.lower("text"), F.lower("pattern"))).select("qid", "id")


def tagged(hybrid: DataFrame, grep: DataFrame, contains: DataFrame) -> DataFrame:
    """qid, id, found_in, rank: hits of both branches, then semantic only, then verbatim only; ranks count on through the three.

    hybrid, grep: qid, id, rank. contains: (qid, id) of hybrid hits whose text holds the query's pattern.
    """
    semantic = hybrid.join(contains.select("qid", "id", F.lit(True).alias("has")), ["qid", "id"], "left").select("qid", "id", F.when(F.col("has"), 0).otherwise(1).alias("bucket"), F.col("rank").alias("own"))
    verbatim = grep.join(hybrid.select("qid", "id"), ["qid", "id"], "left_anti").select("qid", "id", F.lit(2).alias("bucket"), F.col("rank").alias("own"))
    names = F.element_at(F.array(F.lit("both"), F.lit("semantic_only"), F.lit("verbatim_only")), F.col("bucket") + 1)
    order = Window.partitionBy("qid").orderBy("bucket", "own")
    return semantic.unionByName(verbatim).select("qid", "id", names.alias("found_in"), F.row_number().over(order).cast("long").alias("rank"))


def search(chunks: DataFrame, index: Index, queries: DataFrame, docs: DataFrame | None = None, limit: int = 10, **filters) -> DataFrame:
    """The search tool for every query(qid, query_text, query_vector, pattern; no pattern: hybrid only).

    qid, rank, found_in, id, path, doc_code, doc_title, start_line, effective, expiration, text, dense_rank, sparse_rank, similarity,
    phrase_matched, rrf_score, verbatim_total, truncated. At most 2 * limit rows a query. docs: doc_code, title. Queries without
    diacritics have no dense branch.
    """
    if not 1 <= limit <= SEARCH_LIMIT:
        raise ValueError(f"limit is 1 to {SEARCH_LIMIT}")
    queries = without_weak_vectors(queries)
    # Both lists are short (`limit` rows a query) and read several times below: each is computed once, and so are their chunks.
    hybrid = session.cut(hybrid_search(chunks, index, queries, limit, **filters))
    grep = session.cut(grep_each(allowed(chunks, filters.get("on"), filters.get("doc_codes"), filters.get("prefix")), queries, limit))
    shown = session.cut(chunks_of(chunks.select("id", "path", "doc_code", "start_line", "effective", "expiration", "text"), hybrid.select("id").union(grep.select("id")).distinct()))
    has = paths_matching(shown, hybrid.select("qid", "id").join(queries.filter("pattern <> ''").select("qid", "pattern"), "qid"))
    out = tagged(hybrid, grep, has).join(hybrid.drop("path", "rank"), ["qid", "id"], "left")
    out = out.join(grep.groupBy("qid").agg(F.max("full_count").alias("verbatim_total")), "qid", "left").withColumn("verbatim_total", F.coalesce("verbatim_total", F.lit(0)))
    out = out.join(shown, "id")
    out = out.join(docs.select("doc_code", F.col("title").alias("doc_title")), "doc_code", "left") if docs is not None else out.withColumn("doc_title", F.lit(None).cast("string"))
    filled = {"dense_rank": MISSING_RANK, "sparse_rank": MISSING_RANK, "similarity": 0.0, "phrase_matched": False, "rrf_score": 0.0}
    return out.fillna(filled).withColumn("truncated", F.col("verbatim_total") > limit)


def confidence(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Per query: none without a hit or a phrase match, low where the best rerank score or similarity is low, else high."""
    best, rerank_ = F.max("similarity"), F.max("rerank_score") if "rerank_score" in hits.columns else F.lit(None).cast("double")
    label = F.when(~F.bool_or("phrase_matched"), "none").when(rerank_ < LOW_RERANK, "low").when(best == 0, "high").when(best < LOW_SIMILARITY, "low").otherwise("high")
    return queries.select("qid").join(hits.groupBy("qid").agg(label.alias("confidence")), "qid", "left").withColumn("confidence", F.coalesce("confidence", F.lit("none")))


def context_of(contextualized, verbatim, title):
    """What stands before a chunk's own text, without its document's title; an error where the text does not end with it."""
    head = F.substr(contextualized, F.lit(1), F.length(contextualized) - F.length(verbatim) - 1)
    lead = F.concat(F.lit("["), title, F.lit("]"))
    rest = F.when(F.startswith(head, lead), F.ltrim(F.substr(head, F.length(lead) + 1)))
    whole = F.endswith(contextualized, F.concat(F.lit("\n"), verbatim)) & F.startswith(contextualized, lead)
    return F.when(whole, rest).otherwise(F.raise_error(F.lit("a chunk's context does not fit its text")).cast("string"))


def group_ranked(hits: DataFrame) -> DataFrame:
    """Hits of one context together: group_rank by the best hit, members in rank order. hits: qid, context, id, rank."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string"))
    groups = hits.groupBy("qid", "context").agg(F.min("rank").alias("best"), F.array_join(ordered, ",").alias("members"))
    return groups.withColumn("group_rank", F.row_number().over(Window.partitionBy("qid").orderBy("best")).cast("long"))


def any_of(queries: DataFrame) -> DataFrame:
    """qid, said: a query's distinct terms, any of which would do, as one text."""
    return keyword.query_terms(queries).groupBy("qid").agg(F.expr("listagg(term, ' | ') within group (order by term)").alias("said"))


def islands(rows: DataFrame, key: str, order: str, context: str) -> DataFrame:
    """Runs of one context in reading order within each key: key, island, context, first, n."""
    w = Window.partitionBy(key).orderBy(order)
    fresh = F.when(F.lag(context).over(w).eqNullSafe(F.col(context)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    marked = rows.withColumn("_new", fresh).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "island", context).agg(F.min(order).alias("first"), F.count("*").alias("n"))
