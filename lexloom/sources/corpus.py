"""Corpus folders, canonical text, case files and snapshots as frames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

from lexloom.sources import store, structure

META = """doc_code string, title string, effective_date date, expiration_date date, amends string, consolidates array<string>, in_force boolean, superseded_by string,
 source_urls array<string>, parts array<string>"""
ANSWER_CASE = "id string, question string, in_scope boolean, topic string, style string, source string, expected array<string>, amounts array<long>, facts array<string>, note string"
RETRIEVAL_CASE = "id string, split string, question string, query string, pattern string, is_regex boolean, temporal_violation_date date, doc_codes array<string>, expected array<string>, note string"


@F.pandas_udf(StringType())
def normalized(lines: pd.Series) -> pd.Series:
    """NFC, without invisible characters, single spaces; null stays null."""
    return lines.map(structure.normalize_line, na_action="ignore")


@F.pandas_udf(StringType())
def _without_contents(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: "\n".join(structure.without_contents(t.split("\n"))), na_action="ignore")


def canonical_text(blocks: DataFrame, key: str = "path") -> DataFrame:
    """Blocks (key, ordinal, kind, text) -> key, raw_text: text and table rows in order, one a line; blanks and contents lists go."""
    lines = blocks.filter("kind in ('text', 'table')").select(key, "ordinal", F.posexplode(F.split("text", "\n")).alias("nth", "text"))
    lines = lines.withColumn("text", normalized("text")).filter("text <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "nth", "text")))
    joined = lines.groupBy(key).agg(F.array_join(F.transform(ordered, lambda b: b["text"]), "\n").alias("raw_text"))
    listed = F.contains(F.lower("raw_text"), F.lit("mục lục"))
    return joined.withColumn("raw_text", F.when(listed, _without_contents("raw_text")).otherwise(F.col("raw_text")))


def meta_problem() -> Column:
    """Why a description is refused; null: it is sound."""
    return (
        F.when(F.col("doc_code").isNull() | (F.col("doc_code") == ""), "doc_code is missing").when(F.col("title").isNull(), "title is missing").when(F.col("effective_date").isNull(), "effective_date is missing")
        .when(F.coalesce(F.size("parts"), F.lit(0)) < 1, "parts is empty").when(~F.coalesce("in_force", F.lit(True)) & F.col("expiration_date").isNull(), "not in force without expiration_date")
        .when(F.col("expiration_date") < F.col("effective_date"), "expires before it takes effect")
    )


def read_meta(spark: SparkSession, folder: str) -> DataFrame:
    """`folder`/*/meta.json, with label (the folder's name) and error. A file that does not parse is an error row too."""
    raw = spark.read.text(f"{folder}/*/meta.json", wholetext=True).withColumn("label", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/meta\.json$", 1))
    parsed = raw.select("label", F.from_json("value", META).alias("m")).select("label", "m.*")
    return parsed.withColumn("in_force", F.coalesce("in_force", F.lit(True))).withColumn("error", meta_problem())


def load_corpus(spark: SparkSession, meta_folder: str, text_folder: str) -> DataFrame:
    """Descriptions with raw_text; a missing text is an error row."""
    texts = spark.read.text(f"{text_folder}/*.txt", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1).alias("label"), F.regexp_replace("value", r"\n+\z", "").alias("raw_text"))
    both = read_meta(spark, meta_folder).join(texts, "label", "left")
    return both.withColumn("error", F.coalesce("error", F.when(F.col("raw_text").isNull(), "no text")))


def document_links(docs: DataFrame, hosts: tuple[str, ...]) -> DataFrame:
    """docs(doc_code, source_urls) -> doc_code, host, url: the first url of each known host or a subdomain of it."""
    urls = docs.select("doc_code", F.posexplode("source_urls").alias("ordinal", "url")).withColumn("at", F.lower(F.try_parse_url("url", F.lit("HOST"))))
    known = F.array(*map(F.lit, hosts))
    under = F.filter(known, lambda h: (F.col("at") == h) | F.endswith(F.col("at"), F.concat(F.lit("."), h)))
    found = urls.withColumn("host", F.try_element_at(under, F.lit(1)))
    return found.filter("host is not null").groupBy("doc_code", "host").agg(F.min_by("url", "ordinal").alias("url"))


def load_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Cases of a JSON lines file. A malformed line or a repeated id stops the job that reads them."""
    return _unique(spark.read.schema(schema).option("mode", "FAILFAST").json(path))


def _unique(rows: DataFrame) -> DataFrame:
    copies = F.count("*").over(Window.partitionBy("id"))
    return rows.withColumn("id", F.when(F.col("id").isNull() | (copies > 1), F.raise_error(F.concat(F.lit("repeated or missing id "), F.coalesce("id", F.lit("null"))))).otherwise(F.col("id")))


def save_cases(cases: DataFrame, root: str) -> str:
    """Cases by id, as the new version of a store: readers see the old file or the new one. Its folder, for `load_cases`."""
    packed = cases.select(F.to_json(F.struct(*cases.columns), {"ignoreNullFields": "false"}).alias("value"), "id").orderBy("id").select("value")
    return f"{store.commit(cases.sparkSession, root, {'cases': packed})}/cases"


def saved_cases(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Cases of a store, as `load_cases` reads them."""
    rows = store.read(spark, root, "cases").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("c")).select("c.*")
    return _unique(rows)


def manifest(docs: DataFrame) -> DataFrame:
    """One line a document: code, title, dates."""
    until = F.when(F.col("expiration").isNull(), "").otherwise(F.concat(F.lit(" to "), F.col("expiration").cast("string")))
    return docs.select("doc_code", F.concat(F.lit("- "), "doc_code", F.lit(": "), "title", F.lit(" (from "), F.col("effective").cast("string"), until, F.lit(")")).alias("line"))


@F.pandas_udf(StringType())
def encode_vector(vectors: pd.Series) -> pd.Series:
    """base64 of little-endian 32-bit floats."""
    import base64

    import numpy as np

    return vectors.map(lambda v: base64.b64encode(np.asarray(v, "<f4").tobytes()).decode(), na_action="ignore")


@F.pandas_udf(ArrayType(FloatType()))
def decode_vector(texts: pd.Series) -> pd.Series:
    import base64

    import numpy as np

    return texts.map(lambda t: np.frombuffer(base64.b64decode(t), "<f4"), na_action="ignore")


FORMAT = 1
_HEADER = "format int, embedding_model string, embedding_dim int, counts map<string,long>, migrations array<string>"


def export_snapshot(tables: dict[str, DataFrame], path: str, model: str, dim: int, migrations: list[str] | None = None) -> None:
    """Writes tables as gzipped JSON lines under `path`/rows, then the header: a snapshot without a header is not complete.

    A column `embedding` (array of floats) is stored as base64; a null one is refused, as is a vector of another length.
    """
    counts, spark = {}, next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        if "embedding" in df.columns:
            if not df.filter(F.col("embedding").isNull() | (F.size("embedding") != dim)).isEmpty():
                raise ValueError(f"{name}: a row has no vector of {dim} values")
            df = df.withColumn("embedding", encode_vector("embedding"))
        df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").option("compression", "gzip").text(f"{path}/rows/table={name}")
        counts[name] = spark.read.text(f"{path}/rows/table={name}").count()
    header = spark.createDataFrame([(FORMAT, model, dim, counts, sorted(migrations or []))], _HEADER)
    header.coalesce(1).write.mode("overwrite").json(f"{path}/header")


def import_snapshot(spark: SparkSession, path: str, schemas: dict[str, str], model: str, dim: int, migrations: list[str] | None = None) -> dict[str, DataFrame]:
    """Tables of a snapshot with stated schemas; another format, model, dimension, schema version or number of rows is refused."""
    header = spark.read.schema(_HEADER).json(f"{path}/header").first()
    if header is None or (header.format, header.embedding_model, header.embedding_dim) != (FORMAT, model, dim):
        raise ValueError(f"snapshot header {header} does not fit format {FORMAT}, {model}, {dim}")
    only_there, only_here = store.migration_difference(header.migrations or [], migrations or []), store.migration_difference(migrations or [], header.migrations or [])
    if only_there or only_here:
        raise ValueError(f"another schema: only the snapshot has {only_there}, only this checkout has {only_here}")
    if missing := set(header.counts) ^ set(schemas):
        raise ValueError(f"tables of the snapshot and those asked for differ: {sorted(missing)}")
    out = {}
    for name, schema in schemas.items():
        lines = spark.read.text(f"{path}/rows/table={name}")
        if (n := lines.count()) != header.counts[name]:
            raise ValueError(f"{name}: {n} rows, {header.counts[name]} expected")
        stored = ", ".join("embedding string" if c.split()[0] == "embedding" else c for c in map(str.strip, schema.split(",")))
        df = lines.select(F.from_json("value", stored, {"mode": "FAILFAST"}).alias("r")).select("r.*")
        out[name] = df.withColumn("embedding", decode_vector("embedding")) if "embedding" in df.columns else df
    return out


def restore(spark: SparkSession, path: str, root: str, schemas: dict[str, str], model: str, dim: int, migrations: list[str] | None = None, replace: bool = False) -> str:
    """Import a snapshot into the store at `root` as one new version, with its embedding cache; a store that has rows needs `replace`."""
    at = store.current(spark, root)
    if at is not None and not replace and any(not store.read(spark, root, t).isEmpty() for t in schemas):
        raise ValueError(f"{root} holds rows; replace them or choose another store")
    tables = import_snapshot(spark, path, schemas, model, dim, migrations)
    cached = {"embedding_cache": embedding_cache(tables["chunks"].withColumnRenamed("verbatim_text", "text"), model, dim)} if "chunks" in tables else {}
    return store.commit(spark, root, tables | cached)


def embedding_cache(chunks: DataFrame, model: str, dim: int) -> DataFrame:
    """The cache rebuilt from chunks: one vector for each distinct text."""
    vectors = chunks.filter("embedding is not null").groupBy(F.sha2("text", 256).alias("text_sha256")).agg(F.first("embedding").alias("embedding"))
    return vectors.select(F.lit(model).alias("model"), F.lit(dim).alias("dim"), "text_sha256", "embedding")
