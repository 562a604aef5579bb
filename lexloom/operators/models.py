"""Model hooks: an embedder for passages and queries, a reranker for found passages, each with a deterministic default."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from lexloom.functions import text as T
from lexloom.operators.index import ranked, widened

#: Least number of hits that a reranker sees, texts in one call of a model.
POOL, BATCH = 10, 32


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str], is_query: bool) -> np.ndarray:
        """One row of `dim` values a text. Queries may get a prompt that passages do not."""


class Reranker(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        """A score for each (query, passage), larger for a better answer."""


class SyllableEmbedder:
    """Counts of syllables in `dim` buckets by their MD5, to length one: texts that share words are near. Needs no model."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str], is_query: bool) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for k, text in enumerate(texts):
            for word in T.syllables_of(text):
                out[k, int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % self.dim] += 1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def embedded(rows: DataFrame, embedder: Embedder, text: str = "text", name: str = "embedding", is_query: bool = False) -> DataFrame:
    """rows with a vector of each text (null and blank: null). Longest first inside a batch, so that a model pads little."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch[text].fillna("")
            order = sorted((k for k, t in enumerate(texts) if t.strip()), key=lambda k: -len(texts.iloc[k]))
            vectors: list = [None] * len(batch)
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                for k, v in zip(some, embedder.embed([texts.iloc[k] for k in some], is_query)):
                    vectors[k] = v.astype("float32").tolist()
            yield batch.assign(**{name: vectors})

    return rows.mapInPandas(run, widened(rows, name, ArrayType(FloatType())))


def embed_pending(chunks: DataFrame, cache: DataFrame, embedder: Embedder, model: str) -> tuple[DataFrame, DataFrame]:
    """(chunks with every vector, new cache rows): each distinct text without a vector is looked up by hash, the rest embedded once.

    cache: model, dim, text_sha256, embedding. chunks may bring their text_sha256, so that a join before it need not carry texts. Chunks that have a vector keep it; a blank text gets none. Both results are lazy: they
    share the embedding only if the second is written first and given as `cache` again.
    """
    key = cache.filter((F.col("model") == model) & (F.col("dim") == embedder.dim) & F.col("embedding").isNotNull()).select("text_sha256", F.col("embedding").alias("_new"))
    hashed = chunks if "text_sha256" in chunks.columns else chunks.withColumn("text_sha256", T.sha256(F.col("text")))
    # Texts are dealt by their hash once, where equal ones meet and the cache is asked; all else goes by hash.
    missing = hashed.filter("embedding is null and text is not null").select("text", "text_sha256").repartition("text_sha256").distinct()
    new = embedded(missing.join(key, "text_sha256", "left_anti").select("text", "text_sha256"), embedder)
    fresh = new.filter("embedding is not null").select(F.lit(model).alias("model"), F.lit(embedder.dim).alias("dim"), "text_sha256", "embedding")
    vectors = key.unionByName(fresh.select("text_sha256", F.col("embedding").alias("_new")))
    filled = hashed.join(vectors, "text_sha256", "left")
    return filled.withColumn("embedding", F.coalesce("embedding", "_new")).select(chunks.columns), fresh


def lexical_score(query: Column, passage: Column) -> Column:
    """-2 to 2: the share of a query's syllables that the passage has. The default reranker, in the JVM."""
    asked = F.array_distinct(T.syllables(query))
    return 4.0 * F.size(F.array_intersect(asked, T.syllables(passage))) / F.greatest(F.size(asked), F.lit(1)) - 2.0


def rerank(hits: DataFrame, limit: int, scorer: Reranker | None = None) -> DataFrame:
    """hits(qid, query_text, text, rank, …) with rerank_score, the best `limit` of each query's first max(limit, POOL); ties keep their order.

    Queries without diacritics are not reranked: their hits keep their order and have no score.
    """
    pool = hits.filter(F.col("rank") <= max(limit, POOL))
    if scorer is None:
        score = lexical_score(F.col("query_text"), F.col("text"))
    else:

        @F.pandas_udf("double")
        def model(query: pd.Series, text: pd.Series) -> pd.Series:
            pairs = list(zip(query, text))
            distinct = list(dict.fromkeys(pairs))
            known = dict(zip(distinct, scorer.score(distinct)))
            return pd.Series([float(known[p]) for p in pairs])

        score = model("query_text", "text")
    scored = pool.withColumn("rerank_score", F.when(~T.is_unaccented(F.col("query_text")), score)).withColumnRenamed("rank", "_before")
    return ranked(scored, limit, F.desc_nulls_last("rerank_score"), F.asc("_before")).drop("_before")
