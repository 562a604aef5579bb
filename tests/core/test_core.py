"""Micro-cases of the retrieval, tree, graph and table operators."""

import datetime
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import answers, evaluate, graph, index, models, perturb, retrieve, tables, tree, vectors, windows
from lexloom.sources import store


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(x).alias(k) for k, x in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_text(spark):
    t = F.col("t")
    assert one(spark, T.unglue(t), t="chơi3 ab3") == "chơi 3 ab3"
    assert one(spark, T.syllables(t), t="Đèn ĐỎ, Straße œuvre 12") == ["den", "do", "strasse", "oeuvre", "12"]
    assert one(spark, T.terms(T.syllables(t)), t="a b c") == ["a", "b", "c", "a_b", "b_c"]
    assert one(spark, T.terms(T.syllables(t)), t="a") == ["a"]
    assert one(spark, T.terms(T.syllables(t)), t="") == []
    assert one(spark, T.slug(t), t="168/2024/NĐ-CP") == "168_2024_nd_cp"
    assert (one(spark, T.index_label(t), t="đ"), one(spark, T.index_label(t), t="ơ")) == ("dd", "ow")
    assert one(spark, T.is_unaccented(t), t="vuot den do") and not one(spark, T.is_unaccented(t), t="vuot") and not one(spark, T.is_unaccented(t), t="vượt đèn")
    assert one(spark, T.prefixes(t), t="a.b.c") == ["a", "a.b", "a.b.c"]
    assert one(spark, T.parent_path(t), t="a.b.c") == "a.b"
    assert not one(spark, T.under(t, "app_b.i_2"), t="app_b.i_23") and one(spark, T.under(t, "app_b.i_2"), t="app_b.i_2.x")
    for text in ("2020-01-15", "15/01/2020", "15-1-2020", "2020/1/15", "ngày 15 tháng 01 năm 2020"):
        assert one(spark, T.flexible_date(t), t=text) == datetime.date(2020, 1, 15)
    assert one(spark, T.flexible_date(t), t="soon") is None
    assert one(spark, T.raw_slice(t, 2, 9), t="a\nb\nc") == "b\nc"
    with pytest.raises(ValueError):
        T.raw_slice(t, 1, 101)
    day = datetime.date(2024, 1, 1)
    assert not one(spark, T.in_force(F.lit(datetime.date(2020, 1, 1)), F.lit(day), day))
    assert one(spark, T.matches(t, r"\mđèn\M", True), t="vượt ĐÈN đỏ")
    with pytest.raises(ValueError):
        T.java_pattern("[[:blank:]]")


CHUNKS = [(1, "d.a_1", "x", "red light rule", [1.0, 0.0]), (2, "d.a_2", "x", "red car light", [0.0, 1.0]), (3, "d.a_23", "y", "green tree", None)]


def corpus(spark):
    rows = [(*r, datetime.date(2020, 1, 1), datetime.date(2021, 1, 1) if r[0] == 2 else None, r[0]) for r in CHUNKS]
    return spark.createDataFrame(rows, "id long, path string, doc_code string, text string, embedding array<float>, effective date, expiration date, start_line long")


ASKED = "qid long, query_text string, query_vector array<float>"


def test_hybrid(spark, tmp_path):
    c = corpus(spark)
    built = index.build(c, str(tmp_path / "index"))
    q = spark.createDataFrame([(1, "red light", [1.0, 0.1]), (2, "red red light light", None), (3, "green", None)], ASKED)
    hits = {(r.qid, r.id): r for r in retrieve.hybrid_search(c, built, q).collect()}
    assert hits[1, 1].rank == 1 and hits[1, 1].phrase_matched and not hits[1, 2].phrase_matched
    assert hits[1, 1].rrf_score == pytest.approx(2 / 21) and hits[3, 3].dense_rank == 999 and hits[3, 3].phrase_matched
    assert (2, 1) in hits and hits[2, 1].similarity == 0.0
    score = {(r.qid, r.id): r.bm25 for r in index.bm25(built, q.filter("qid < 3").withColumn("query_text", F.when(F.col("qid") == 2, "red red light").otherwise("red light")), 10).collect()}
    assert score[1, 2] == pytest.approx(score[2, 2])  # repeated words do not count
    assert retrieve.allowed(c, on=datetime.date(2021, 1, 1)).count() == 2 and retrieve.allowed(c, doc_codes=["?"]).count() == 0
    assert [r.path for r in retrieve.allowed(c, prefix="d.a_2").collect()] == ["d.a_2"]
    with pytest.raises(ValueError):
        retrieve.hybrid_search(c, built, q, limit=0)
    grep = retrieve.verbatim_grep(c, "LIGHT", limit=1).collect()
    assert [(r.id, r.full_count) for r in grep] == [(1, 2)]
    assert retrieve.hybrid_search(c, built, q.limit(0)).count() == 0 and retrieve.hybrid_search(c, built, q, doc_codes=["?"]).count() == 0
    label = {r.qid: r.confidence for r in retrieve.confidence(q.unionByName(q.withColumn("qid", F.col("qid") + 10)), retrieve.hybrid_search(c, built, q)).collect()}
    assert label[1] == "high" and label[11] == label[12] == label[13] == "none"


def replay(rows, queries, limit=10, k=20):
    """The search by dictionaries and numpy, from its definition: BM25, cosine, reciprocal ranks, ties by path."""
    words = {r["id"]: re.findall("[0-9a-z]+", (r["text"] or "").lower()) for r in rows}
    grams = {i: Counter(w) + Counter(f"{a}_{b}" for a, b in zip(w, w[1:])) for i, w in words.items()}
    avg, df = max(1, sum(map(len, words.values())) / len(words)), Counter(t for g in grams.values() for t in g)
    path = {r["id"]: r["path"] for r in rows}
    out = {}
    for q in queries:
        w = re.findall("[0-9a-z]+", q["query_text"].lower())
        asked = {*w, *(f"{a}_{b}" for a, b in zip(w, w[1:]))}
        idf = {t: math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) for t in asked}
        said = {i: math.fsum(idf[t] * g[t] * 2.2 / (g[t] + 1.2 * (0.25 + 0.75 * len(words[i]) / avg)) for t in asked if t in g) for i, g in grams.items() if asked & set(g)}
        near = {} if q["query_vector"] is None else {r["id"]: float(np.dot(r["embedding"], q["query_vector"]) / np.linalg.norm(r["embedding"]) / np.linalg.norm(q["query_vector"])) for r in rows if r["embedding"] is not None}
        most, score = max(6 * limit, 120), Counter()
        for scores in (said, near):
            for n, i in enumerate(sorted(scores, key=lambda i: (-round(scores[i], 9), path[i]))[:most], 1):
                score[i] += 1 / (k + n)
        out[q["qid"]] = sorted(score, key=lambda i: (-score[i], path[i]))[:limit]
    return out


def test_search_equals_its_replay(spark, tmp_path):
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice(["red", "car", "light", "road", "rule", "sign", "tree", *map(str, range(30))]) for _ in range(n))
    rows = [{"id": i, "path": f"d.a_{i % 97:02}.c_{i}", "doc_code": "d", "text": None if i == 5 else say(rng.randint(0, 40)), "embedding": None if i % 4 == 0 else [float(rng.choice([-1, 1, 2])) for _ in range(4)], "effective": datetime.date(2020, 1, 1), "expiration": None, "start_line": i} for i in range(400)]
    rows += [r | {"id": 1000 + r["id"], "path": r["path"] + "x"} for r in rows[:60]]  # exact copies: ties
    schema = "id long, path string, doc_code string, text string, embedding array<float>, effective date, expiration date, start_line long"
    queries = [{"qid": q, "query_text": say(rng.randint(1, 5)), "query_vector": None if q % 3 == 0 else [1.0, float(q), 0.5, 1.0]} for q in range(25)]
    c, asked = spark.createDataFrame(rows, schema), spark.createDataFrame(queries, ASKED)
    built = index.build(c, str(tmp_path / "index"), shard_rows=40)
    want = replay(rows, queries)

    def found(at):
        got: dict = {q["qid"]: [] for q in queries}
        for r in retrieve.hybrid_search(at[0], at[1], asked).orderBy("qid", "rank").collect():
            got[r.qid].append(r.id)
        return got

    assert found((c, built)) == want
    # some rows change, some go, some come: the refreshed index answers like one built anew
    changed = [r | {"text": say(12)} if r["id"] % 50 == 3 else r for r in rows if r["id"] % 60 != 7] + [rows[0] | {"id": 5000, "path": "d.new", "text": say(9)}]
    ids = {r["id"] for r in rows if r["id"] % 50 == 3 or r["id"] % 60 == 7} | {5000}
    c2 = spark.createDataFrame(changed, schema)
    fresh = index.refresh(built, c2, spark.createDataFrame([(i,) for i in ids], "id long"))
    assert found((c2, fresh)) == replay(changed, queries)
    assert store.prune(spark, str(tmp_path / "index")) == 1


def test_vectors(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(30, 16))[rng.integers(0, 30, 3000)] + 0.3 * rng.normal(size=(3000, 16))).astype(np.float32)
    c = spark.createDataFrame([(i, f"p{i:05}", v.tolist()) for i, v in enumerate(x)] + [(9000, "none", None)], "id long, path string, embedding array<float>")
    q = spark.createDataFrame([(k, (x[37 * k] + 0.1).tolist()) for k in range(60)] + [(99, None)], "qid long, query_vector array<float>")
    exact = {(r.qid, r.rank): r.id for r in vectors.nearest(c, q, 10).collect()}
    y = x.astype(np.float64)
    for k in range(60):
        v = y[37 * k] + np.float32(0.1)
        v = (x[37 * k] + np.float32(0.1)).astype(np.float64)
        best = np.argsort(-(y @ v) / np.linalg.norm(y, axis=1), kind="stable")[:10]
        assert [exact[k, n] for n in range(1, 11)] == best.tolist()
    centres = vectors.centres(c, 30)
    table = vectors.listed(c, centres)
    assert table.count() == 3000  # every vector has a list
    got = {(r.qid, r.id) for r in vectors.nearest_in_lists(table, centres, q, 10, 4).collect()}
    assert len(got & {(k, i) for (k, _), i in exact.items()}) >= 0.9 * 600
    assert vectors.nearest(c, q.filter("qid = 99"), 5).count() == vectors.nearest_in_lists(table, centres, q.limit(0), 5, 2).count() == 0


def test_models(spark):
    c = spark.createDataFrame([(1, "one two", None), (2, "one two", None), (3, "three", [9.0, 9.0]), (4, " ", None), (5, "six", None), (6, None, None)], "id long, text string, embedding array<float>")
    embedder = models.SyllableEmbedder(2)
    cache = spark.createDataFrame([("m", 2, hashlib.sha256(b"six").hexdigest(), [5.0, 5.0]), ("m", 3, hashlib.sha256(b"one two").hexdigest(), [1.0, 1.0])], "model string, dim int, text_sha256 string, embedding array<float>")
    filled, fresh = models.embed_pending(c, cache, embedder, "m")
    got = {r.id: r.embedding for r in filled.collect()}
    assert got[1] == got[2] == pytest.approx(embedder.embed(["one two"], False)[0].tolist()) and got[3] == [9.0, 9.0] and got[5] == [5.0, 5.0] and got[4] is None and got[6] is None
    assert [r.text_sha256 for r in fresh.collect()] == [hashlib.sha256(b"one two").hexdigest()]
    hits = spark.createDataFrame([(1, "đèn đỏ", "x", 1), (1, "đèn đỏ", "đèn đỏ", 2), (1, "đèn đỏ", "đèn", 3), (2, "den do", "x", 1), (2, "den do", "den do", 2)], "qid long, query_text string, text string, rank long")
    assert [(r.qid, r.text, r.rerank_score) for r in models.rerank(hits, 2).orderBy("qid", "rank").collect()] == [(1, "đèn đỏ", 2.0), (1, "đèn", 0.0), (2, "x", None), (2, "den do", None)]

    class Longest:
        def score(self, pairs):
            return [float(len(p)) for _, p in pairs]

    assert [r.text for r in models.rerank(hits.filter("qid = 1"), 1, Longest()).collect()] == ["đèn đỏ"]
    assert T.syllables_of("Điều3 Phạt ÆB ß") == ["dieu", "3", "phat", "aeb", "ss"] == one(spark, T.syllables(F.col("t")), t="Điều3 Phạt ÆB ß")


def test_store(spark, tmp_path):
    root = str(tmp_path / "s")
    assert store.current(spark, root) is None
    store.commit(spark, root, {"a": spark.range(3), "b": spark.range(5)})
    first = store.read(spark, root, "a")
    store.commit(spark, root, {"a": spark.range(7)})
    assert first.count() == 3 and store.read(spark, root, "a").count() == 7 and store.read(spark, root, "b").count() == 5
    store.truncate(spark, root, "b")
    assert store.read(spark, root, "b").count() == 0 and store.prune(spark, root) == 2
    with pytest.raises(Exception):
        store.commit(spark, root, {"a": spark.range(2).select(F.raise_error(F.lit("no")).alias("id"))})
    assert store.read(spark, root, "a").count() == 7  # a writer that fails changes nothing
    assert store.migration_difference(["2", "1", "3"], ["1"]) == ["2", "3"]


def test_text_functions(spark):
    t = F.col("t")
    span = lambda text, sought: (lambda r: r and tuple(r))(one(spark, T.normalized_span(t, F.lit(sought)), t=text))
    assert span("a  b\nc (d) b c", "b c") == (3, 6) and span("x (d)\tE+", " (d) E+ ") == (2, 8) and span("ab", "b a") is None and span("ab", " ") is None
    assert [one(spark, T.path_problem(t), t=x) for x in ("a.b_1", "", "a..b", "a.b-c", "a." + "x" * 256)] == [None, "empty path", "bad label", "bad label", "label too long"]
    with pytest.raises(Exception, match="not a date"):
        one(spark, T.flexible_date(t, strict=True), t="31-31-2020")
    assert one(spark, T.flexible_date(t, strict=True), t=" ") is None
    with pytest.raises(Exception, match="ends before"):
        one(spark, T.raw_slice(t, 3, strict=True), t="a\nb")
    assert one(spark, T.raw_slice(t, 2), t="a\nb\nc") == "b\nc"
    assert one(spark, retrieve.context_of(t, F.lit("own"), F.lit("T")), t="[T] > [x]\nlead\nown") == "> [x]\nlead"
    with pytest.raises(Exception, match="does not fit"):
        one(spark, retrieve.context_of(t, F.lit("own"), F.lit("T")), t="[U] > [x]\nown")


def test_tree(spark):
    c = spark.createDataFrame([("d.a_1.w_10", 9), ("d.a_1.w_2", 5), ("d.a_1.body", 1), ("d.a_2", 20)], "path string, start_line int")
    assert [r.path for r in tree.sibling_windows(c.filter("path like '%w_%'"), spark.createDataFrame([("d.a_1",)], "parent string")).collect()] == ["d.a_1.w_2", "d.a_1.w_10"]
    wanted = spark.createDataFrame([("d.a_2",), ("d.a_1",), ("zz",)], "query_path string")
    assert sorted((r.query_path, r.path[-4:]) for r in tree.expand_to_leaves(c, wanted).collect()) == sorted([("d.a_1", "body"), ("d.a_1", "w_10"), ("d.a_1", ".w_2"), ("d.a_2", ".a_2")])
    assert tree.expand_to_leaves(c, wanted).count() == 4
    assert [r.path for r in tree.in_request_order(c, ["d.a_2", "?", "d.a_1.body", "d.a_2"]).collect()] == ["d.a_2", "d.a_1.body"]


def test_graph(spark):
    e = spark.createDataFrame([("A", "B", "REFERENCES"), ("A", "C", "REFERENCES"), ("B", "C", "REFERENCES"), ("C", "A", "REFERENCES"), ("Z", "A", "CONFLICTS_WITH")], "source string, target string, relation string").withColumn("edge_id", F.concat("source", "target")).withColumn("citation", F.col("target"))
    start = spark.createDataFrame([("A",)], "start string")
    walk = graph.traverse(e, start, "OUTGOING", 2)
    got = {(r["from"], r.to, r.depth) for r in walk.collect()}
    assert [r.depth for r in walk.collect()] == [1, 1, 1, 2]
    assert got == {("A", "B", 1), ("A", "C", 1), ("B", "C", 2), ("A", "Z", 1)}
    nodes = spark.createDataFrame([(x, f"see {x} and B") for x in "ABC"], "path string, text string")
    ok = spark.createDataFrame([("9", "C", "B", "REFERENCES", "B")], "edge_id string, source string, target string, relation string, citation string")
    none = e.select("source", "target", "relation").limit(0)
    table, log, _ = graph.curate(e, nodes, ok, none, "checked")
    assert table.count() == 6 and [r.action for r in log.collect()] == ["ADDED"]
    bad = ok.unionByName(ok.withColumn("citation", F.lit("nowhere")).withColumn("target", F.lit("A")))
    with pytest.raises(ValueError, match="UNGROUNDED"):
        graph.curate(e, nodes, bad, none, "checked")
    with pytest.raises(ValueError):
        graph.curate(e, nodes, ok, none, " ")


def test_upsert(spark):
    schema = "path string, text string, embedding double"
    old = spark.createDataFrame([("p", "same", 1.0), ("q", "old", 2.0), ("r", "left", 3.0)], schema)
    new = spark.createDataFrame([("p", "same", None), ("q", "new", None), ("s", "more", 4.0)], schema)
    assert {r.path: r.embedding for r in tables.upsert_chunks(old, new).collect()} == {"p": 1.0, "q": None, "r": 3.0, "s": 4.0}


def test_grounding(spark):
    missing = evaluate.ungrounded(F.lit("Điều 5: phạt 4.000.000 đồng"), F.lit("Điều 6, 4000000 đồng; điều 5"))
    assert one(spark, missing) == ["a5"]


def test_registry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_amounts_and_grades(spark):
    t = F.col("t")
    for text, want in (("4–6 triệu", [4000000, 6000000]), ("1,2 triệu", [1200000]), ("800 nghìn", [800000]), ("phạt 4.000.000 đồng", [4000000]), ("năm 12", []), ("1500", [1500]), (None, [])):
        assert one(spark, evaluate.amounts_in(t.cast("string")), t=text) == want, text
    assert one(spark, evaluate.plain(t), t="Đường 090 km, 90/80 km") == "duong 90km, 90km/80km"
    for text, want in (("5tr", [5000000]), ("4 đến 6 triệu", [4000000, 6000000]), ("50k", [50000]), ("0,5 triệu", [500000]), ("12 đồng", [12])):
        assert one(spark, evaluate.amounts_in(t), t=text) == want, text
    assert one(spark, evaluate.facts_missing(t, F.array(F.lit("mũ|nón"), F.lit("xe"))), t="đội nón") == ["xe"]
    schema = "in_scope boolean, answer string, cited array<string>, expected array<string>, amounts array<long>, facts array<string>, sources string, style string, ms long, cost double"
    rows = [
        (True, "Điều 5: 2 triệu", ["d.a_5.c_2"], ["d.a_5.c_1"], [2000000], [], "Điều 5", "x", 4, 1.0), (True, "Điều 5", ["d.a_55"], ["d.a_5"], [], [], "Điều 5", "x", 1, None), (False, "không rõ", [], [], [], [], "", "y", 3, None),
        (False, "có", ["d.a_1"], [], [], [], "", "y", 2, None), (False, "Không tìm thấy căn cứ", ["d.a_1"], [], [], [], "", "y", 9, None), (True, "Điều 7", ["d.a_5"], ["d.a_5"], [], ["xe"], "Điều 5", "x", 5, 3.0),
    ]
    graded = evaluate.grade(spark.createDataFrame(rows, schema))
    assert [r.correct for r in graded.collect()] == [True, False, True, False, True, False]
    assert [(r.cite_article, r.cite_exact, r.grounded) for r in graded.filter("in_scope").collect()] == [(True, False, True), (False, False, True), (True, True, False)]
    r = answers.report(graded).first()
    assert (r.n, r.n_in_scope, r.median_ms, r.max_ms, r.cost, r.mean_cost) == (6, 3, 4, 9, 4.0, 2.0) and r.correct == pytest.approx(1 / 3) and r.rightly_refused == pytest.approx(2 / 3) and r.whole == pytest.approx(1 / 2)
    assert [tuple(x) for x in answers.by_style(graded).collect()] == [("x", 3, pytest.approx(1 / 3))]
    cited = F.array(F.lit("p"), F.lit("q"), F.lit("z"))
    assert one(spark, answers.renumbered(t, cited, F.array(F.lit("q"), F.lit("p"))), t="a [#1] b[#2][#3] c [#9] [x]") == "a [#2] b[#1] c  [x]"
    q = spark.createDataFrame([(1, " q? "), (2, "r")], "qid long, query_text string")
    hits = spark.createDataFrame([(1, 2, "d", "d.a_2", None, None, " two "), (1, 1, "d", "d.a_1", "Điều 1", datetime.date(2020, 1, 1), "one")], "qid long, rank long, doc_code string, path string, address string, effective date, text string")
    made = {r.qid: r.prompt for r in answers.prompts(q, hits, "H").collect()}
    assert made[1] == "H\n\n===== ĐIỀU KHOẢN =====\n[#1] d — Điều 1 (hiệu lực 2020-01-01)\none\n\n[#2] d — d.a_2 (hiệu lực ?)\ntwo\n===== HẾT =====\n\nCÂU HỎI: q?" and made[2].count("[#") == 0
    p = evaluate.mcnemar(spark.createDataFrame([(False, True)] * 8 + [(True, False)] * 2 + [(True, True)] * 5, "a boolean, b boolean")).first()
    assert (p.gains, p.losses) == (8, 2) and p.p == pytest.approx(2 * (1 + 10 + 45) / 1024)


def test_curation(spark):
    text = "path string, text string"
    nodes = spark.createDataFrame([("d.a_1", "see  a_2 here"), ("d.a_2.c_1", "x"), ("d.a_2.c_2", "x"), ("d.a_3", "x")], text)
    key = "source string, target string, relation string"
    e = spark.createDataFrame([("1", "d.a_1", "d.a_2.c_1", "REFERENCES", "old"), ("2", "d.a_1", "d.a_3", "REFERENCES", "old"), ("3", "d.a_3", "d.a_2.c_2", "SEE_ALSO", "old")], f"edge_id string, {key}, citation string")
    added = spark.createDataFrame([("d.a_1", "d.a_2", "REFERENCES", "see a_2"), ("d.a_1", "d", "SEE_ALSO", "see")], f"{key}, citation string")
    removed = spark.createDataFrame([("d.a_3", "d.a_2", "SEE_ALSO"), ("d.a_3", "gone", "SEE_ALSO"), ("d.a_3", "d.a_2", "SEE_ALSO")], key)
    got = graph.curate(e, nodes, added, removed, " checked ")
    assert sorted(tuple(r) for r in got.outcome.collect()) == [
        ("added", "d.a_1", "d.a_2.c_1", "SEE_ALSO"), ("added", "d.a_1", "d.a_2.c_2", "REFERENCES"), ("added", "d.a_1", "d.a_2.c_2", "SEE_ALSO"), ("added", "d.a_1", "d.a_3", "SEE_ALSO"),
        ("existing", "d.a_1", "d.a_2.c_1", "REFERENCES"), ("not_found", "d.a_3", "gone", "SEE_ALSO"), ("removed", "d.a_3", "d.a_2.c_2", "SEE_ALSO"),
    ]
    assert got.edges.count() == 6 and {(r.action, r.reason) for r in got.log.collect()} == {("ADDED", "checked"), ("REMOVED", "checked")}
    bad = spark.createDataFrame([("no", "d", "R", "x"), ("d.a_1", "no", "R", "see"), ("d.a_1", "d", "R", "not there"), ("d.a_3", "d.a_3", "R", "x")], f"{key}, citation string")
    assert sorted(r.code for r in graph.violations(nodes, bad).collect()) == ["SELF_REFERENCING_EDGE", "SOURCE_NOT_FOUND", "TARGET_NOT_FOUND", "UNGROUNDED_CITATION_TEXT"]


def test_merged_windows():
    gap, parts = windows.ELISION, [f"cap\n{c * 40}" for c in "abcde"]
    assert windows.merged(parts, 5000) == "\n".join(["cap"] + [c * 40 for c in "abcde"])
    assert windows.merged(["x", " ", ""], 5) == "x" and windows.merged([" "], 5) == ""
    room = 4 + 3 * 41 + len(gap) + 2
    assert windows.merged(parts, room, 2).split("\n") == ["cap", gap, "b" * 40, "c" * 40, "d" * 40, gap]
    assert windows.merged(parts, room, 4).split("\n") == ["cap", gap, "c" * 40, "d" * 40, "e" * 40]
    assert windows.merged(parts, 1, 9).split("\n") == ["cap", gap, "e" * 40]


def test_expand_windows(spark):
    chunks = spark.createDataFrame([("d.a.w_10", "h\nten"), ("d.a.w_2", "h\ntwo"), ("d.a.w_1", None), ("d.b.w_1", "only"), ("d.c", "plain")], "path string, text string")
    hits = chunks.withColumn("rank", F.length("path"))
    got = {r.path: r.text for r in windows.expand_windows(chunks, hits).collect()}
    assert got == {"d.a.w_10": "h\ntwo\nten", "d.a.w_2": "h\ntwo\nten", "d.a.w_1": "h\ntwo\nten", "d.b.w_1": "only", "d.c": "plain"}
    assert windows.expand_windows(chunks, hits.limit(0)).columns == ["path", "text", "rank"]


def test_perturbations(spark):
    t = F.col("t")
    assert one(spark, perturb.no_diacritics(t), t="Vượt đèn Đỏ") == "Vuot den Do"
    assert one(spark, perturb.chat_abbrev(t), t="Không được vậy bao nhiêu") == "ko dc v bn"
    assert one(spark, perturb.truncate(t), t="Cho hỏi, xe máy vượt đèn đỏ thì bị phạt bao nhiêu tiền?") == "xe máy vượt đèn đỏ"
    assert one(spark, perturb.truncate(t), t="đèn đỏ phạt") == "đèn đỏ phạt"
    assert one(spark, perturb.number_reformat(t), t="từ 4.000.000 hoặc 050.000.000 ngày 05 mức 1,2") == "từ 4 triệu hoặc 50 triệu ngày 5 mức 1.2"
    typed = one(spark, perturb.typo(t), t="xe nghiêng đi")
    assert typed != "xe nghiêng đi" and sorted(typed) == sorted("xe nghiêng đi") and typed.split()[0] == "xe"
    assert one(spark, perturb.typo(t), t="a b") == "a b" and one(spark, perturb.typo(t), t="") == ""
    assert one(spark, perturb.noise(t), t="mức phạt?. ").endswith("mức phạt ???")
    rows = spark.createDataFrame([(1, "vượt đèn đỏ nhanh", "formal"), (2, "VƯỢT đèn đỏ nhanh", None), (3, " ", "formal"), (4, "abc def", "teencode")], "ordinal long, query string, base_style string")
    got = perturb.perturbed(rows, 6).collect()
    assert len({r.query.lower() for r in got}) == len(got) and all(r.query != r.base_query for r in got)
    assert {r.style for r in got if r.ordinal == 4} <= {"p_truncate", "p_number_reformat", "p_typo", "p_noise"} and not [r for r in got if r.ordinal == 3]
    assert all(n <= 2 for n in __import__("collections").Counter(r.ordinal for r in perturb.perturbed(rows).collect()).values())
