"""Work that must spread over tasks or stay bounded in one: plans and partitions, besides equal results."""

import datetime
import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from lexloom.operators import citations as C
from lexloom.operators import index, models, retrieve, windows
from lexloom.sources import structure
from tests.core.test_citations import CHANGE, TEXT


def one_file(spark, tmp_path, text, n=400):
    docs = spark.range(n).select(F.concat(F.lit("D"), F.col("id").cast("string")).alias("doc_code"), F.lit("t").alias("title"), F.lit(text).alias("raw_text"), F.lit(None).cast("string").alias("amends"))
    docs.coalesce(1).write.parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


def busy(df) -> int:
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_documents_of_one_file_go_to_all_cores(spark, tmp_path):
    docs = one_file(spark, tmp_path, TEXT + "\n" + CHANGE)
    cores = spark.sparkContext.defaultParallelism
    for made in (C.hints(docs), C.amendments(docs), structure.chunk_documents(docs)):
        assert busy(made) == cores
        assert made.groupBy("doc_code").count().select("count").distinct().count() == 1 and made.select("doc_code").distinct().count() == 400


def test_citations_are_read_once_for_edges(spark, tmp_path):
    docs = one_file(spark, tmp_path, TEXT, 3)
    edges = C.reference_edges(C.hints(docs), structure.chunk_documents(docs))
    want = {(f"d{k}{s}", f"d{k}{t}") for k in range(3) for s, t in {(r.source[2:], r.target[2:]) for r in edges.collect()}}
    assert {(r.source, r.target) for r in edges.collect()} == want and ("d0.a_1.c_1", "d0.a_2.c_1") in want
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2


def test_batches_of_results_are_bounded(spark, monkeypatch):
    """Neither many rows nor one long document make a batch large; no row is lost."""
    monkeypatch.setattr(structure, "ROWS", 7)
    docs = spark.createDataFrame([("a", 50), ("b", 0), (None, 3)], "doc_code string, n int").coalesce(1)
    made = structure.mapped(docs, lambda code, n: ((code, f"x{k}", k) for k in range(n)), "doc_code string, x string, k long")
    sizes = made.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    assert sum(r.n for r in sizes) == 53 and made.filter("doc_code = 'a'").agg(F.sum("k")).first()[0] == 1225


def test_lines_that_open_nothing_are_found_early():
    rng = random.Random(3)
    starts = ["Điều 1. A", "ĐIỀU 2: b", "1. x", "1a. x", "1.2 x", "đ) x", "ab1) x", "II. X", "A. x", "Phụ lục", "PHỤ LỤC I", "Mẫu số 1", "Chương I", "thứ", "“1. x", " 1. x", "- x", "| a |", "abc) x", "ĐA. x", "Mục 1. X"]
    patterns = [structure._APPENDIX, structure._DIVISION, structure._ARTICLE, structure._FORM, structure._DECIMAL, structure._OUTLINE, structure._CLAUSE, structure._POINT]
    for line in starts + ["".join(rng.choice("aĐđA1.) |“") for _ in range(6)) for _ in range(3000)]:
        assert structure._OPENS.match(line) or not any(p.fullmatch(line) for p in patterns), line


def test_windows_fill_their_budget_to_the_last_character():
    """The elision marker has 39 characters; 39 + 2 of them are set aside, with 5 for the line all windows share."""
    first, second, third = ("head\n" + c * (n - 1) for c, n in (("a", 700), ("b", 754), ("c", 100)))
    assert len(windows.ELISION) == 39
    assert windows.merged([first, second, third], 1500, 0) == "\n".join(["head", "a" * 699, "b" * 753, windows.ELISION])
    assert windows.merged([first, second + "b", third], 1500, 0) == "\n".join(["head", "a" * 699, windows.ELISION])


def test_index_counts_in_bounded_shards(spark, tmp_path, monkeypatch):
    """Long texts make more shards, not larger ones; blocks of few bytes, rows equal in path and id, empty and null texts lose no count."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd"]) for _ in range(rng.choice([0, 1, 2, 400]))) for _ in range(60)] + [None]
    day = datetime.date(2020, 1, 1)
    rows = [(k // 2, f"p{k // 2}", "x", t, day, None, k) for k, t in enumerate(texts)]
    c = spark.createDataFrame(rows, "id long, path string, doc_code string, text string, effective date, expiration date, start_line long")
    monkeypatch.setattr(index, "SHARD_BYTES", 1_000)
    monkeypatch.setattr(index, "PACKED", 100)
    built = index.build(c, str(tmp_path / "index"))
    docs = built.docs.select("shard", "pos", "id", "dl").collect()
    assert len({r.shard for r in docs}) > 10 and len({(r.shard, r.pos) for r in docs}) == len(docs) == 61
    assert sorted((r.id, r.dl) for r in docs) == sorted((k // 2, len((t or "").split())) for k, t in enumerate(texts))
    tf, df = Counter(), Counter()
    for t in texts:
        w = (t or "").split()
        own = Counter(w) + Counter(f"{a}_{b}" for a, b in zip(w, w[1:]))
        tf.update(own)
        df.update(dict.fromkeys(own, 1))
    assert {r.term: (r.tf, r.df) for r in built.terms.collect()} == {t: (n, df[t]) for t, n in tf.items()}
    assert built.lists.groupBy("shard", "part", "sub").count().count() > 16 and built.terms.filter(F.col("part") != index.part_of(F.col("term"))).count() == 0


def test_texts_travel_once_to_be_embedded(spark):
    """A cache row without a vector hides a text from the embedder as little as it fills it; texts are dealt once, and not to be filled."""
    rows = [(k, f"text {k % 5}", [1.0, 1.0] if k == 3 else None) for k in range(20)] + [(20, None, None), (21, " ", None)]
    c = spark.createDataFrame(rows, "id long, text string, embedding array<float>").withColumn("text_sha256", F.sha2("text", 256))
    cache = c.filter("text = 'text 1'").select(F.lit("m").alias("model"), F.lit(2).alias("dim"), "text_sha256", F.array(F.lit(7.0), F.lit(7.0)).cast("array<float>").alias("embedding")).limit(1)
    cache = cache.unionByName(c.filter("id = 2").select(F.lit("m").alias("model"), F.lit(2).alias("dim"), "text_sha256", F.lit(None).cast("array<float>").alias("embedding")))
    filled, fresh = models.embed_pending(c, cache, models.SyllableEmbedder(2), "m")
    got = {r.id: r.embedding for r in filled.collect()}
    assert len(got) == 22 and got[3] == [1.0, 1.0] and got[1] == got[16] == [7.0, 7.0] and got[20] is None and got[21] is None and got[2] is not None and got[8] == got[13] is not None
    assert fresh.count() == 4
    plan = filled.select("id", "embedding")._jdf.queryExecution().executedPlan().toString()
    assert sum("hashpartitioning(text#" in line for line in plan.splitlines()) == 0  # texts meet by their hash


def test_shown_chunks_are_read_without_a_shuffle(spark, tmp_path):
    spark.range(1000).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("text")).write.parquet(str(tmp_path / "c"))
    c = spark.read.parquet(str(tmp_path / "c"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = retrieve.chunks_of(c, spark.range(5))
        assert few.count() == 5 and "Exchange hashpartitioning" not in few._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
