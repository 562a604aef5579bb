"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all that the one before it kept; all but the last return the columns of documents. Stages keep rows with null
ids, null texts and repeated rows as their operators define. `n_chars` follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import line_dedup, mil, mixing, near, packing, queries, util


def _with_length(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, gives at least an even chance to be good."""
    model = mil.fit(docs, util.table(spark, sf_dir, "labels").select("doc_id", "quality"))
    boxed = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    return mil.scored(boxed, model).filter("score >= 0.5").select("_row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents or more share stay in the last of these only."""
    return _with_length(line_dedup.keep_lines(docs, min_chars=40, min_docs=5))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash blocks and minimum hashes, verified by five-word shingles at 0.8 or more."""
    return near.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share takes them."""
    return _with_length(mixing.repeated(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 4096."""
    return packing.packed(docs, queries.tokenizer()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", classify),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]

#: SQL can't express a trained classifier, XXH64 or a tokenizer; tests hold run() against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    util.prepare(spark)
    docs = util.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = util.cut(docs)
            util.drop(*[before] * (k > 0))  # the last stage reads only what is left
    return docs
