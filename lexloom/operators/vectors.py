"""Dense search in matrix blocks: exact over all vectors, or over the lists nearest to a query (inverted lists with measured recall)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lexloom.operators.index import blocks, ranked, widened

#: Rows that centres are fitted on at most, and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 10
_NEAR = "qid long, id long, path string, similarity double"


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row, so that equal vectors get equal values wherever they stand."""
    size = np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum())
    return np.divide((x * q).sum(1), size, out=np.zeros(len(x)), where=size > 0)


def _best(x: np.ndarray, rows: np.ndarray, q: np.ndarray, rough: np.ndarray, paths: list, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (into `rows`) and similarities of the best `limit`, ties by path. `rough`: similarities up to rounding."""
    if len(rough) > limit:
        at = np.flatnonzero(rough >= np.partition(rough, len(rough) - limit)[len(rough) - limit] - 1e-9)
    else:
        at = np.arange(len(rough))
    exact = _cosines(x[rows[at]], q)
    order = sorted(range(len(at)), key=lambda k: (-exact[k], paths[rows[at[k]]]))[:limit]
    return at[order], exact[order]


def _scan(qids: list[int], queries: np.ndarray, limit: int):
    unit = queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, paths = _matrix(batch.column("embedding")), batch.column("path").to_pylist()
            rough = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)) @ unit.T
            qid, at, similarity = [], [], []
            for k, q in enumerate(qids):
                rows, exact = _best(x, np.arange(len(x)), queries[k], rough[:, k], paths, limit)
                qid.append(np.full(len(rows), q))
                at.append(rows)
                similarity.append(exact)
            take = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(qid)), batch.column("id").take(take), batch.column("path").take(take), pa.array(np.concatenate(similarity))], names=["qid", "id", "path", "similarity"])

    return run


def _stated(queries: DataFrame) -> tuple[list[int], np.ndarray]:
    rows = queries.filter("query_vector is not null").select("qid", "query_vector").orderBy("qid").toArrow()  # one block of stated queries
    return rows.column("qid").to_pylist(), _matrix(rows.column("query_vector"))


def nearest(chunks: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """qid, id, path, similarity, rank: exact cosine top-k over all chunks that have a vector; ties by path.

    Queries are a stated set, sent in blocks; vectors pass once a block, and a batch of them gives its own best rows only.
    """
    have = chunks.filter("embedding is not null").select("id", "path", "embedding")
    found = None
    for part in blocks(queries):
        qids, q = _stated(part)
        one = have.mapInArrow(_scan(qids, q, limit), _NEAR) if qids else have.select(F.lit(0).cast("long").alias("qid"), "id", "path", F.lit(0.0).alias("similarity")).limit(0)
        found = one if found is None else found.unionByName(one)
    return ranked(found, limit, F.desc("similarity"), F.asc("path"))


def centres(chunks: DataFrame, lists: int, seed: int = 5) -> np.ndarray:
    """Unit centres by k-means on at most SAMPLE vectors, the least by a hash of the id (fitting only: every vector gets a list)."""
    rows = chunks.filter("embedding is not null").select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    x = _matrix(rows.column("embedding"))
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    c = x[np.random.default_rng(seed).permutation(len(x))[:lists]]
    for _ in range(ROUNDS):
        of = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-300), c)
    return c


def listed(chunks: DataFrame, c: np.ndarray) -> DataFrame:
    """id, path, embedding, list of every chunk that has a vector: to be written partitioned by list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = (_matrix(batch.column("embedding")) @ c.T).argmax(1) if batch.num_rows else np.zeros(0)
            yield batch.append_column("list", pa.array(of.astype(np.int32)))

    have = chunks.filter("embedding is not null").select("id", "path", "embedding")
    return have.mapInArrow(run, widened(have, "list", IntegerType()))


def nearest_in_lists(table: DataFrame, c: np.ndarray, queries: DataFrame, limit: int, probes: int) -> DataFrame:
    """As `nearest`, over the `probes` lists nearest to each query. table: what `listed` gives. A list is compared in batches."""
    found = None
    for part in blocks(queries):
        qids, q = _stated(part)
        if not qids:
            continue
        wanted = np.argsort(-(q @ c.T), axis=1, kind="stable")[:, :probes]
        of_list = {int(k): np.flatnonzero((wanted == k).any(1)) for k in np.unique(wanted)}

        def run(batches: Iterator[pa.RecordBatch], qids=qids, q=q, of_list=of_list) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists, x, paths = batch.column("list").to_numpy(), _matrix(batch.column("embedding")), batch.column("path").to_pylist()
                for k in np.unique(lists).tolist():
                    rows = np.flatnonzero(lists == k)
                    for j in of_list.get(k, ()):
                        at, exact = _best(x, rows, q[j], _cosines(x[rows], q[j]), paths, limit)
                        take = pa.array(rows[at])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), qids[j])), batch.column("id").take(take), batch.column("path").take(take), pa.array(exact)], names=["qid", "id", "path", "similarity"])

        one = table.filter(F.col("list").isin([int(k) for k in of_list])).mapInArrow(run, _NEAR)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = table.select(F.lit(0).cast("long").alias("qid"), "id", "path", F.lit(0.0).alias("similarity")).limit(0)
    return ranked(found, limit, F.desc("similarity"), F.asc("path"))
