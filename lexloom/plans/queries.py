"""Registered queries over the driver's tables, one or more an operator. Each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import answers, citations, evaluate, fragments, graph, index, models, perturb, retrieve, tables, tree, vectors, windows
from lexloom.plans import views as v
from lexloom.plans.oracles import ORACLES  # noqa: F401
from lexloom.sources import corpus, session, store, structure

ON = "2021-03-01"


def on_date():
    return F.lit(ON).cast("date")


def _summed(c: str):
    """A vector as one number that all of its values, by place, decide."""
    return F.round(F.aggregate(F.transform(c, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x), 4).alias(c)


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


def syllable_terms(s, d) -> DataFrame:
    return v.indexed(s, d).terms.select("term", "tf", "df")


def corpus_stats(s, d) -> DataFrame:
    return v.indexed(s, d).stats().select("n", _r("avgdl"))


def term_idf(s, d) -> DataFrame:
    return index.term_idf(v.indexed(s, d), index.query_terms(v.asked(s, d))).select("term", "df", _r("idf"))


def bm25_topk(s, d) -> DataFrame:
    return index.bm25(v.indexed(s, d), v.asked(s, d), 10).select("qid", "id", "rank", "phrase_matched", _r("bm25"))


def dense_topk(s, d) -> DataFrame:
    return vectors.nearest(v.chunks(s, d), v.asked(s, d), 20).select("qid", "id", "rank", _r("similarity"))


def dense_in_lists(s, d) -> DataFrame:
    """Share of the exact first ten that inverted lists find, over all queries that have a vector: at least nine in ten."""
    c, asked = v.chunks(s, d), v.asked(s, d)
    centres = vectors.centres(c, 16)
    table = vectors.listed(c, centres)
    near = vectors.nearest_in_lists(table, centres, asked, 10, 12).select("qid", "id")
    exact = vectors.nearest(c, asked, 10).select("qid", "id")
    both = exact.join(near.withColumn("found", F.lit(1)), ["qid", "id"], "left")
    return both.agg((F.avg(F.coalesce("found", F.lit(0))) >= 0.9).alias("recall_reached"), F.count("*").alias("n"))


def _hybrid(s, d, queries=None, **options):
    return retrieve.hybrid_search(v.chunks(s, d), v.indexed(s, d), v.asked(s, d) if queries is None else queries, **options)


def _hits(df: DataFrame) -> DataFrame:
    return df.select("qid", "id", "rank", "dense_rank", "sparse_rank", "phrase_matched", _r("similarity"), _r("rrf_score", 9))


def hybrid_search(s, d) -> DataFrame:
    return _hits(_hybrid(s, d))


def hybrid_search_filtered(s, d) -> DataFrame:
    return _hits(_hybrid(s, d, on=on_date(), doc_codes=["src1", "src2", "src3", "src4"], prefix="c.en"))


def hybrid_without_vectors(s, d) -> DataFrame:
    return _hits(_hybrid(s, d, v.asked(s, d).withColumn("query_vector", F.lit(None).cast("array<float>"))))


def hybrid_unaccented(s, d) -> DataFrame:
    return _hits(_hybrid(s, d, retrieve.without_weak_vectors(v.asked(s, d))))


def scope_unknown(s, d) -> DataFrame:
    return retrieve.allowed(v.chunks(s, d, False), doc_codes=["no such code"]).agg(F.count("*").alias("n"))


def validity_filter(s, d) -> DataFrame:
    return retrieve.allowed(v.chunks(s, d, False), on=on_date()).select("id", F.col("effective").cast("string"), F.col("expiration").cast("string"))


def in_force_catalog(s, d) -> DataFrame:
    docs = v.table(s, d, "supplier").select(F.concat(F.lit("src"), "s_suppkey").alias("doc_code"), F.lit("2020-06-01").cast("date").alias("effective"), F.when(F.col("s_suppkey") % 2 == 0, F.lit(ON).cast("date")).alias("expiration"))
    return tables.catalog(docs, v.chunks(s, d, False), on_date()).select("doc_code", "n_chunks", "in_force")


def grep_substring(s, d) -> DataFrame:
    return retrieve.verbatim_grep(v.chunks(s, d), "The TH", limit=25).select("id", "rank", "full_count", "distance")


def grep_regex(s, d) -> DataFrame:
    c = v.chunks(s, d)
    vector = v.table(s, d, "embeddings").filter("vec_id = 1").select("embedding").first()[0]
    return retrieve.verbatim_grep(c, r"[[:alpha:]]+ation [[:alpha:]]{3}", True, 25, vector, on=on_date()).select("id", "rank", "full_count", _r("distance"))


def grep_each(s, d) -> DataFrame:
    return retrieve.grep_each(v.chunks(s, d), v.asked(s, d)).select("qid", "id", "rank", "full_count", _r("distance"))


def titles(s, d) -> DataFrame:
    return v.chunks(s, d, False).select("doc_code").distinct().withColumn("title", F.concat(F.lit("Title of "), "doc_code"))


def search_tagged(s, d) -> DataFrame:
    out = retrieve.search(v.chunks(s, d), v.indexed(s, d), v.asked(s, d), titles(s, d))
    return out.select("qid", "rank", "found_in", "id", "path", "doc_title", "dense_rank", "sparse_rank", "phrase_matched", _r("similarity"), "verbatim_total", "truncated")


def reranked(s, d) -> DataFrame:
    asked = v.asked(s, d).select("qid", "query_text")
    hits = session.cut(_hybrid(s, d).select("qid", "id", "rank"))
    hits = hits.join(asked, "qid").join(retrieve.chunks_of(v.chunks(s, d, False).select("id", "text"), hits.select("id").distinct()), "id")
    return models.rerank(hits, 5).select("qid", "id", "rank", _r("rerank_score"))


def confidence(s, d) -> DataFrame:
    """Half of the queries ask in a document that does not exist, so that they have no hit."""
    asked = v.asked(s, d)
    return retrieve.confidence(asked, _hybrid(s, d).filter("qid % 2 = 0"))


def group_ranked(s, d) -> DataFrame:
    hits = _hybrid(s, d).join(v.chunks(s, d, False).select("id", F.col("doc_code").alias("context")), "id")
    return retrieve.group_ranked(hits).select("qid", "context", "group_rank", "members")


def reading_order_islands(s, d) -> DataFrame:
    return retrieve.islands(v.table(s, d, "conversations"), "conv_id", "turn", "role")


def subtree(s, d) -> DataFrame:
    return tree.provisions_under(v.places(s, d), "r1.n1", 30)


def parent_context(s, d) -> DataFrame:
    return tree.navigate(v.places(s, d), "r1.n1.c5", "parent_context", 20)


def expand_to_leaves(s, d) -> DataFrame:
    wanted = s.createDataFrame([("r1",), ("r2.n8",), ("r0.n0.body",), ("r0.n1",), ("r9",), ("r1.n",)], "query_path string")
    return tree.expand_to_leaves(v.places(s, d), wanted)


def sibling_windows(s, d) -> DataFrame:
    parents = s.createDataFrame([("r1.n1",), ("r2.n8",)], "parent string")
    return tree.sibling_windows(v.places(s, d), parents).select("parent", "path")


def raw_slice(s, d) -> DataFrame:
    return v.table(s, d, "documents").select("doc_id", T.raw_slice(F.col("text"), 2, 4).alias("lines"))


def line_coverage(s, d) -> DataFrame:
    docs = v.table(s, d, "documents").select(F.col("doc_id").alias("doc_code"), F.size(F.split("text", "\n")).alias("n_lines"))
    held = docs.select("doc_code", F.lit(1).alias("start_line"), F.greatest(F.lit(1), F.col("n_lines") - 1).alias("end_line")).unionByName(docs.filter("doc_code % 2 = 0").select("doc_code", F.lit(1).alias("start_line"), F.lit(1).alias("end_line")))
    return tree.line_coverage(docs, held)


def _walk(s, d, direction):
    return graph.traverse(v.citations(s, d), s.createDataFrame([("s1",), ("s7",), ("p3",)], "start string"), direction, 2)


def graph_traverse_out(s, d) -> DataFrame:
    return _walk(s, d, "OUTGOING")


def graph_traverse_in(s, d) -> DataFrame:
    return _walk(s, d, "INCOMING")


def graph_traverse_both(s, d) -> DataFrame:
    return _walk(s, d, "BOTH")


def graph_links(s, d) -> DataFrame:
    return graph.links(_walk(s, d, "OUTGOING"), v.nodes(v.citations(s, d)), 5)


def edges_touching(s, d) -> DataFrame:
    e = v.citations(s, d)
    places = v.nodes(e).withColumn("doc_code", F.concat("doc_code", (F.col("start_line") % 10).cast("string")))
    return graph.touching(e, places, ["s3", "p7"]).select("edge_id")


def find_edges(s, d) -> DataFrame:
    e = v.citations(s, d)
    keys = e.filter("source like '%1'").select("source", "target", F.when(F.col("relation") == "AMENDS", "SEE_ALSO").otherwise(F.col("relation")).alias("relation"))
    return graph.find_edges(e, keys).select("edge_id")


def edge_paths(s, d) -> DataFrame:
    """Edges by ids of their ends, of which some are gone."""
    e = v.citations(s, d)
    ids = v.nodes(e).select(F.concat(F.lit("id-"), "path").alias("id"), "path", "doc_code")
    by_id = e.select("edge_id", F.concat(F.lit("id-"), "source").alias("source_id"), F.concat(F.lit("id-"), "target").alias("target_id"))
    return graph.with_paths(by_id, ids.filter("path not like '%7'")).select("edge_id", "source", "target", "source_doc", "target_doc")


def edge_insert_absent(s, d) -> DataFrame:
    e = v.citations(s, d)
    more = e.withColumn("target", F.concat("target", F.lit("0"))).unionByName(e)
    return graph.insert_absent(e, more).select("source", "target", "relation")


def edge_invalidated(s, d) -> DataFrame:
    e = v.citations(s, d)
    nodes = e.select(F.col("source").alias("path")).union(e.select("target")).distinct().filter("path not like '%3'").select("path", F.concat(F.lit("cites  p1 s2\n cites s9 "), "path").alias("text"))
    return graph.invalidated(e, nodes).select("edge_id", "reason")


def edge_violations(s, d) -> DataFrame:
    e = v.citations(s, d)
    nodes = e.select(F.col("source").alias("path")).distinct().filter("path not like '%3'").select("path", F.lit("cites p1 and cites s2, cites s9").alias("text"))
    return graph.violations(nodes, e.withColumn("target", F.when(F.col("target") == "p5", F.col("source")).otherwise(F.col("target")))).select("source", "target", "relation", "code")


def upsert_keep_embedding(s, d) -> DataFrame:
    c = v.chunks(s, d)
    given = F.transform("embedding", lambda x: x * F.lit(2).cast("float"))
    new = c.filter("id % 2 = 0").select("path", F.when(F.col("id") % 4 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!"))).alias("text"), F.when(F.col("id") % 3 == 0, given).alias("embedding"))
    extra = c.filter("id % 50 = 0").select(F.concat("path", F.lit(".new")).alias("path"), "text", F.lit(None).cast("array<float>").alias("embedding"))
    out = tables.upsert_chunks(c.filter("id % 5 <> 0").select("path", "text", "embedding"), new.unionByName(extra))
    return out.select("path", F.length("text").cast("long").alias("n"), _summed("embedding"))


def purge_stale(s, d) -> DataFrame:
    c = v.chunks(s, d, False)
    edges = c.select(F.col("path").alias("source"), F.lag("path").over(Window.partitionBy("doc_code").orderBy("id")).alias("target")).filter("target is not null")
    left, kept = tables.purge_stale(c, edges, c.filter("id % 2 = 0").select("path"), "src1")
    return left.groupBy("doc_code").agg(F.count("*").alias("n")).unionByName(kept.agg(F.lit("edges").alias("doc_code"), F.count("*").alias("n")))


def embedding_cache(s, d) -> DataFrame:
    c = v.chunks(s, d)
    cache = c.filter("embedding is not null and id % 2 = 0").dropDuplicates(["text"]).select(F.lit("m").alias("model"), F.lit(64).alias("dim"), T.sha256(F.col("text")).alias("text_sha256"), "embedding")
    return tables.cached_embeddings(c, cache, "m", 64).select("text_sha256", F.col("embedding").isNotNull().alias("cached"))


def missing_embeddings(s, d) -> DataFrame:
    return tables.missing_embeddings(v.chunks(s, d))


def missing_texts(s, d) -> DataFrame:
    return tables.missing_texts(v.chunks(s, d)).select(T.sha256(F.col("text")).alias("text_sha256"))


def json_field(s, d) -> DataFrame:
    e = v.table(s, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.filter("k > 50").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


def slug_label(s, d) -> DataFrame:
    return v.table(s, d, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"))


def flexible_dates(s, d) -> DataFrame:
    o = v.table(s, d, "orders")
    y, m, day = (F.date_format("o_orderdate", p) for p in ("yyyy", "MM", "dd"))
    forms = [F.concat_ws("-", y, m, day), F.concat_ws("/", day, m, y), F.concat_ws("-", day, m, y), F.concat_ws("/", y, m, day), F.concat(F.lit("ngày "), day, F.lit(" tháng "), m, F.lit(" năm "), y), F.concat(F.lit("x"), y)]
    text = F.element_at(F.array(*forms), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return o.select("o_orderkey", T.flexible_date(text).cast("string").alias("parsed"))


def eval_summary(s, d) -> DataFrame:
    cases = v.asked(s, d).select("qid", F.when(F.col("qid") % 5 == 0, "holdout").otherwise("dev").alias("split"), F.array(F.lit("c.en"), F.concat(F.lit("c.fr.src"), (F.col("qid") % 20).cast("string"))).alias("expected"))
    hits = _hybrid(s, d).withColumn("found_in", F.when(F.col("sparse_rank") == 999, "semantic_only").otherwise("both"))
    return evaluate.summary(evaluate.outcomes(cases, hits))


def hit_rates(s, d) -> DataFrame:
    c = v.chunks(s, d, False).select("id", "doc_code")
    hits = _hybrid(s, d).join(c, "id").filter("doc_code = concat('src', qid % 20)").groupBy("qid").agg(F.min("rank").alias("rank"))
    ranks = v.asked(s, d).select("qid", F.when(F.col("qid") % 5 == 0, "holdout").otherwise("dev").alias("split")).join(hits, "qid", "left")
    return evaluate.hit_rates(ranks).select("split", _r("hit_1"), _r("hit_5"), _r("mrr"))


def grounding(s, d) -> DataFrame:
    o = v.table(s, d, "orders")
    answer = F.concat(F.lit("Điều "), F.col("o_orderkey") % 7, F.lit(" phạt "), F.col("o_custkey").cast("string"), F.lit(".000 đồng"))
    source = F.concat(F.lit("Điều "), F.col("o_orderkey") % 5, F.lit(" mức "), (F.col("o_custkey") - F.col("o_custkey") % 2).cast("string"), F.lit("000 đồng"))
    return o.select("o_orderkey", F.array_join(F.array_sort(evaluate.ungrounded(answer, source)), ",").alias("missing"))


def mcnemar(s, d) -> DataFrame:
    return evaluate.mcnemar(v.table(s, d, "labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b"))).select("gains", "losses", _r("p"))


def _graded(s, d) -> DataFrame:
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    answer = F.concat(F.lit("Điều 5: phạt "), (who % 3 + 1).cast("string"), F.lit(" triệu đồng, "), F.when(who % 5 == 0, "không tìm thấy").otherwise("đội mũ"))
    cited = F.when(who % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("d.a_5.c_"), (who % 5).cast("string"))))
    o = v.table(s, d, "orders").select(
        "o_orderkey", (key % 4 != 0).alias("in_scope"), answer.alias("answer"), cited.alias("cited"), F.when(key % 2 == 0, F.array(F.lit("d.a_5.c_1"))).otherwise(F.array(F.lit("d.a_6"))).alias("expected"),
        F.array(F.lit(2_000_000).cast("long")).alias("amounts"), F.array(F.lit("mũ|nón")).alias("facts"), F.lit("Điều 5, mức 2 triệu đồng").alias("sources"), (who % 3).cast("string").alias("style"), (key % 1000).alias("ms"),
        F.when(key % 10 == 0, who.cast("double")).alias("cost"),
    )
    return evaluate.grade(o)


def grade_answers(s, d) -> DataFrame:
    return _graded(s, d).select("o_orderkey", "grounded", "refused", "cite_article", "cite_exact", "correct", F.size("missing_amounts").cast("long").alias("n_amounts"), F.size("missing_facts").cast("long").alias("n_facts"))


def answer_report(s, d) -> DataFrame:
    out = answers.report(_graded(s, d))
    return out.select("n", "n_in_scope", *[_r(c) for c in ("correct", "cite_article", "cite_exact", "whole", "grounded", "wrongly_refused", "rightly_refused", "mean_cost")], "median_ms", "max_ms", _r("cost", 2))


def renumber_citations(s, d) -> DataFrame:
    o = v.table(s, d, "orders")
    path = lambda k: F.concat(F.lit("p"), ((F.col("o_custkey") + k) % 4).cast("string"))
    answer = F.concat(F.lit("x [#1] y[#"), (F.col("o_orderkey") % 4).cast("string"), F.lit("] z [#9]"))
    return o.select("o_orderkey", answers.renumbered(answer, F.array(path(0), path(1)), F.array(F.lit("p0"), F.lit("p1"), F.lit("p2"))).alias("answer"))


def prompts(s, d) -> DataFrame:
    asked = v.asked(s, d).select("qid", "query_text")
    hits = session.cut(_hybrid(s, d, limit=3).select("qid", "rank", "id"))
    hits = hits.join(retrieve.chunks_of(v.chunks(s, d, False), hits.select("id").distinct()), "id").withColumn("address", F.when(F.col("id") % 2 == 0, F.concat(F.lit("Điều "), "id")))
    return answers.prompts(asked, hits, "Header").select("qid", T.sha256(F.col("prompt")).alias("sha256"))


def adversarial_confidence(s, d) -> DataFrame:
    asked = s.createDataFrame([(k, q, None) for k, q in enumerate(evaluate.ADVERSARIAL)], "qid long, query_text string, query_vector array<float>")
    return retrieve.confidence(asked, _hybrid(s, d, asked))


def any_of(s, d) -> DataFrame:
    return retrieve.any_of(v.asked(s, d))


def fill_ratio(s, d) -> DataFrame:
    lines = v.table(s, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter("line like '%|%'")
    return lines.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.sum(T.fill_ratio(F.split("line", r"\|"))), 6).alias("filled"))


def money_amounts(s, d) -> DataFrame:
    o = v.table(s, d, "orders")
    key = F.col("o_orderkey")
    text = F.when(key % 3 == 0, F.concat(F.lit("phạt "), F.replace(F.format_number((F.col("o_custkey") + 1) * 1000, 0), F.lit(","), F.lit(".")), F.lit(" đồng"))).when(key % 3 == 1, F.concat(F.lit("từ "), (key % 7 + 1).cast("string"), F.lit("–9 triệu"))).otherwise(F.concat((key % 9).cast("string"), F.lit(",5 triệu và 800 nghìn")))
    return o.select("o_orderkey", F.array_join(evaluate.amounts_in(text).cast("array<string>"), ",").alias("amounts"))


def address_format(s, d) -> DataFrame:
    c = v.table(s, d, "customer")
    path = F.concat(F.lit("d.c_ii.a_"), F.col("c_custkey").cast("string"), F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit(".c_"), F.col("c_nationkey").cast("string"), F.lit(".p_dd"))).otherwise(""))
    return c.select("c_custkey", citations.format_address(path).alias("address"))


def upsert_documents(s, d) -> DataFrame:
    o = v.table(s, d, "supplier").select("s_suppkey", "s_name", _r("s_acctbal", 2))
    new = o.filter("s_suppkey % 3 = 0").select((F.col("s_suppkey") * 2).alias("s_suppkey"), F.concat("s_name", F.lit("!")).alias("s_name"), (F.col("s_acctbal") * 0).alias("s_acctbal"))
    return tables.upsert_documents(o, new, "s_suppkey", ("s_acctbal",))


def fill_embeddings(s, d) -> DataFrame:
    c = v.chunks(s, d).select("id", "text", "embedding")
    known = c.filter("embedding is null").groupBy("text").agg(F.min("id").alias("at")).filter("at % 2 = 0")
    known = known.select("text", F.array(F.lit(1.0), F.lit(2.0), F.col("at")).cast("array<float>").alias("embedding"))
    return tables.fill_embeddings(c, known).select("id", _summed("embedding"))


def chunk_documents(s, d) -> DataFrame:
    """Each document's lines as the numbered clauses of one article."""
    lines = F.transform(F.split(F.regexp_replace("text", '[“”‘’«»"]', "'"), "\n"), lambda x, k: F.concat((k + 1).cast("string"), F.lit(". "), x))
    docs = v.table(s, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_code"), F.col("lang").alias("title"), F.concat(F.lit("Điều 1. Gồm:\n"), F.array_join(lines, "\n")).alias("raw_text"))
    return structure.chunk_documents(docs).select("doc_code", "path", "start_line", "end_line", F.length("verbatim_text").cast("long").alias("n_chars"))


def canonical_text(s, d) -> DataFrame:
    lines = v.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.posexplode(F.split("text", "\n")).alias("ordinal", "line"))
    blocks = lines.select("path", "ordinal", F.when(F.col("ordinal") % 5 == 4, "footnote").otherwise("text").alias("kind"), F.concat(F.lit(" "), F.replace("line", F.lit(" "), F.lit("  ")), F.lit(" \u200b")).alias("text"))
    return corpus.canonical_text(blocks).select("path", T.sha256(F.col("raw_text")).alias("sha256"))


def document_links(s, d) -> DataFrame:
    pages = v.table(s, d, "pages").select(F.col("page_id").cast("string").alias("doc_code"), F.array(F.lit("no url"), "url", F.concat("url", F.lit("&again=1"))).alias("source_urls"))
    return corpus.document_links(pages, ("example.com", "example.net"))


def manifest(s, d) -> DataFrame:
    end = F.when(F.col("s_suppkey") % 3 == 0, F.date_add(F.lit("2021-01-01").cast("date"), (F.col("s_suppkey") % 50).cast("int")))
    docs = v.table(s, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("doc_code"), F.col("s_name").alias("title"), F.lit("2020-06-01").cast("date").alias("effective"), end.alias("expiration"))
    return corpus.manifest(docs)


def request_order(s, d) -> DataFrame:
    paths = [f"r{r}.n{n}.body" for r in range(5) for n in range(24, -1, -1)]
    return tree.in_request_order(v.places(s, d), [*paths, "none", *paths]).select("path", "ordinal")


def reference_edges(s, d) -> DataFrame:
    k = F.col("c_custkey")
    text = F.concat(F.lit("Điều 1. A\n1. Theo khoản 2 Điều này.\n2. Theo Điều 2 Thông tư này.\nĐiều 2. B\n1. C:\na) D;\nb) Theo khoản "), (k % 4).cast("string"), F.lit(" Điều 1 Thông tư này.\n2. E."))
    docs = v.table(s, d, "customer").select(F.concat(F.lit("o"), k.cast("string")).alias("doc_code"), F.lit("Thông tư thử").alias("title"), text.alias("raw_text"))
    return citations.reference_edges(citations.hints(docs), structure.chunk_documents(docs)).select("source", "target", "relation", "citation")


def _changes(s, d) -> DataFrame:
    k = F.col("c_custkey")
    text = F.concat(F.lit("Điều 1. Sửa đổi, bổ sung một số điều của Nghị định số "), k.cast("string"), F.lit("/2020/ND-CP\n1. Sửa đổi khoản 2 Điều 5 như sau:\n“2. Bãi bỏ Điều 9”.\n2. Bãi bỏ điểm a đến điểm c khoản "), (k % 3 + 1).cast("string"), F.lit(" Điều 6."))
    docs = v.table(s, d, "customer").select(F.concat(F.lit("n"), k.cast("string")).alias("doc_code"), text.alias("raw_text"), F.lit(None).cast("string").alias("amends"))
    return citations.amendments(docs)


def amendments(s, d) -> DataFrame:
    return _changes(s, d).select("doc_code", "source", "action", "target_code", "article", "clause", "point")


def amendment_notes(s, d) -> DataFrame:
    k = F.col("c_custkey")
    c = v.table(s, d, "customer")
    paths = F.explode(F.array(*map(F.lit, ("a_5.c_2", "a_5.c_2.p_a", "a_5.c_1", "a_6.c_1.p_b", "a_6.c_2.p_d", "a_6.c_3.body"))))
    chunks = c.select(F.concat(k.cast("string"), F.lit("/2020/ND-CP")).alias("doc_code"), k, paths.alias("part")).select("doc_code", F.concat(F.lit("l"), k.cast("string"), F.lit("."), "part").alias("path"))
    dates = c.select(F.concat(F.lit("n"), k.cast("string")).alias("doc_code"), F.date_add(F.lit("2021-02-20").cast("date"), (k % 20).cast("int")).alias("effective"))
    return citations.notes(chunks, _changes(s, d), dates, on_date()).select("path", "action", F.array_join("sources", ",").alias("sources"), "n")


def quote_spans(s, d) -> DataFrame:
    text = F.concat(F.lit("ab “"), "s_name", F.lit("” c \""), "s_name", F.lit("\" d «"), F.col("s_suppkey").cast("string"), F.lit("\nlast"))
    spans = F.transform(structure.quote_spans_of(text), lambda x: F.concat_ws("-", x["start"], x["end"]))
    return v.table(s, d, "supplier").select("s_suppkey", F.array_join(spans, ",").alias("spans"))


def normalized_span(s, d) -> DataFrame:
    words = F.slice(F.filter(F.split("text", r"\s+"), lambda x: x != ""), 5, 4)
    span = T.normalized_span(F.col("text"), F.array_join(words, " \n "))
    return v.table(s, d, "documents").select("doc_id", span["start"].cast("long").alias("start"), span["end"].cast("long").alias("end"))


def text_fragments(s, d) -> DataFrame:
    own = F.concat(F.lit("1. Mục số "), F.col("doc_id").cast("string"), F.lit(" của tài liệu này; hết"))
    twice = F.concat(own, F.lit("\nKhác hẳn ở đây một hai:\n"), own)
    docs = v.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("doc_code"), F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("\n"), own)).otherwise(twice).alias("raw_text"), own.alias("text"), F.when(F.col("doc_id") % 2 == 0, 1).otherwise(3).alias("start_line"))
    return fragments.with_fragments(docs.select("doc_code", "text", "start_line"), docs.select("doc_code", "raw_text")).select("doc_code", "source_fragment")


def embed_pending(s, d) -> DataFrame:
    c = v.chunks(s, d, hashed=True).select("id", "text", "text_sha256", "embedding")
    known = c.filter("embedding is null").groupBy("text_sha256").agg(F.min("id").alias("at")).filter("at % 3 = 0")
    cache = known.select(F.lit("m").alias("model"), F.lit(8).alias("dim"), "text_sha256", F.array(*[F.lit(float(k)) for k in range(1, 9)]).cast("array<float>").alias("embedding"))
    filled, _ = models.embed_pending(c, cache, models.SyllableEmbedder(8), "m")
    return filled.select("id", _summed("embedding"))


def cache_store(s, d) -> DataFrame:
    c = v.chunks(s, d).filter("embedding is not null")
    rows = c.select(F.lit("m").alias("model"), (F.col("id") % 2).cast("int").alias("dim"), T.sha256(F.col("doc_code")).alias("text_sha256"), F.lit(1).alias("embedding"))
    cache = rows.filter("dim = 0").dropDuplicates(["text_sha256"])
    return tables.stored_embeddings(cache, rows.withColumn("embedding", F.lit(2))).select("dim", "text_sha256", "embedding")


def snapshot_roundtrip(s, d) -> DataFrame:
    """Chunks with a vector and the documents, written as a snapshot, restored into a store and read from it."""
    c = v.chunks(s, d).filter("embedding is not null").select("id", "path", F.col("text").alias("verbatim_text"), "embedding")
    docs = v.table(s, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("doc_code"), F.col("s_name").alias("title"))
    at = f"{session.work_folder(s)}/snapshot-{v.fresh()}"
    dim = len(c.select("embedding").first()[0])
    corpus.export_snapshot({"chunks": c, "documents": docs}, at, "m", dim, ["001", "002"])
    schemas = {"chunks": "id long, path string, verbatim_text string, embedding array<float>", "documents": "doc_code string, title string"}
    corpus.restore(s, at, f"{at}-store", schemas, "m", dim, ["001", "002"], replace=True)
    back = store.read(s, f"{at}-store", "chunks").select(F.col("id").cast("string").alias("key"), T.sha256(F.col("verbatim_text")).alias("sha256"), _summed("embedding"))
    return back.unionByName(store.read(s, f"{at}-store", "documents").select(F.col("doc_code").alias("key"), T.sha256(F.col("title")).alias("sha256"), F.lit(None).cast("double").alias("embedding")))


def saved_cases(s, d) -> DataFrame:
    cases = v.asked(s, d).select(F.concat(F.lit("b"), F.lpad(F.col("qid").cast("string"), 4, "0")).alias("id"), F.lit("dev").alias("split"), F.col("query_text").alias("question"), F.array("pattern").alias("expected"))
    at = f"{session.work_folder(s)}/cases-{v.fresh()}"
    corpus.save_cases(cases.filter("id < 'b0005'"), at)
    corpus.save_cases(cases, at)
    return corpus.saved_cases(s, at, corpus.RETRIEVAL_CASE).select("id", T.sha256(F.col("question")).alias("sha256"), F.array_join("expected", ",").alias("expected"))


def versioned_upsert(s, d) -> DataFrame:
    """Two versions of a table in a store: the old rows, then those of `upsert_documents`, read when the second is current."""
    at = f"{session.work_folder(s)}/versions-{v.fresh()}"
    store.commit(s, at, {"documents": v.table(s, d, "supplier").select("s_suppkey", "s_name", _r("s_acctbal", 2))})
    old = store.read(s, at, "documents")
    new = old.filter("s_suppkey % 3 = 0").select((F.col("s_suppkey") * 2).alias("s_suppkey"), F.concat("s_name", F.lit("!")).alias("s_name"), (F.col("s_acctbal") * 0).alias("s_acctbal"))
    store.commit(s, at, {"documents": tables.upsert_documents(old, new, "s_suppkey", ("s_acctbal",))})
    return store.read(s, at, "documents")


def citation_hints(s, d) -> DataFrame:
    text = F.concat_ws("\n", F.lit("Điều 1. A"), F.lit("1. Theo khoản 2 Điều này."), F.concat(F.lit("2. Theo điểm a khoản "), (F.col("o_orderkey") % 4).cast("string"), F.lit(" Điều 2 Thông tư này.")), F.lit("Điều 2. B"), F.lit("1. C:"), F.lit("a) D;"), F.lit("2. E:"), F.lit("a) F."))
    docs = v.table(s, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("doc_code"), text.alias("raw_text"))
    return citations.hints(docs).select("doc_code", "source", "target")


def curate_edges(s, d) -> DataFrame:
    placed = lambda c: F.concat(F.lit("g"), F.length(c).cast("string"), F.lit("."), c)
    e = v.citations(s, d).select("edge_id", placed("source").alias("source"), placed("target").alias("target"), "relation", "citation")
    nodes = e.select(F.col("source").alias("path")).union(e.select("target")).distinct().withColumn("text", F.lit("see  x"))
    added = nodes.filter("path like 'g2.s%'").select(F.col("path").alias("source"), F.lit("g2").alias("target"), F.lit("SEE_ALSO").alias("relation"), F.lit("see x").alias("citation"))
    removed = nodes.filter("path like 'g2.%'").select(F.col("path").alias("source"), F.lit("g3").alias("target"), F.lit("REFERENCES").alias("relation"))
    removed = removed.unionByName(s.createDataFrame([("g2.s1", "zz", "AMENDS")], "source string, target string, relation string"))
    return graph.plan_curation(e, nodes, added, removed, "checked").outcome


def _turns(s, d) -> DataFrame:
    return v.table(s, d, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".w_"), F.col("turn").cast("string")).alias("path"), F.concat(F.lit("head\n"), F.col("turn").cast("string"), F.lit(" "), "text").alias("text"), "turn")


def expand_windows(s, d) -> DataFrame:
    turns = _turns(s, d)
    return windows.expand_windows(turns.select("path", "text"), turns.filter("turn = 1").select("path", "text"), 1_000_000).select("path", T.sha256(F.col("text")).alias("sha256"))


def expand_windows_in_budget(s, d) -> DataFrame:
    turns = _turns(s, d)
    return windows.expand_windows(turns.select("path", "text"), turns.filter("turn = 0").select("path", "text"), 1_500).select("path", T.sha256(F.col("text")).alias("sha256"))


def query_perturbations(s, d) -> DataFrame:
    b = v.table(s, d, "benchmark")
    style = F.get(F.array(*map(F.lit, ("formal", "no_diacritics", "very_short", "teencode", "number_format"))), (F.col("item_id") % 5).cast("int"))
    text = F.concat(F.lit("cho hỏi "), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(" 05 người được 2.000.000 hay 1,5 thì bị phạt bao nhiêu?"))
    return perturb.perturbed(b.select(F.col("item_id").alias("ordinal"), text.alias("query"), style.alias("base_style"))).select("ordinal", "style", "query")


QUERIES = {
    f.__name__: f
    for f in (
        syllable_terms, corpus_stats, term_idf, bm25_topk, dense_topk, dense_in_lists, hybrid_search, hybrid_search_filtered, hybrid_without_vectors, hybrid_unaccented, scope_unknown, validity_filter, in_force_catalog,
        grep_substring, grep_regex, grep_each, search_tagged, reranked, confidence, group_ranked, reading_order_islands, subtree, parent_context, expand_to_leaves, sibling_windows, raw_slice, line_coverage,
        graph_traverse_out, graph_traverse_in, graph_traverse_both, graph_links, edges_touching, find_edges, edge_paths, edge_insert_absent, edge_invalidated, edge_violations, upsert_keep_embedding, purge_stale, embedding_cache,
        missing_embeddings, missing_texts, json_field, slug_label, flexible_dates, eval_summary, hit_rates, grounding, mcnemar, fill_ratio,
        money_amounts, address_format, upsert_documents, fill_embeddings, chunk_documents, citation_hints, curate_edges, expand_windows, expand_windows_in_budget, query_perturbations,
        grade_answers, answer_report, renumber_citations, prompts, adversarial_confidence, any_of, canonical_text, document_links, manifest, request_order, reference_edges, amendments, amendment_notes,
        quote_spans, normalized_span, text_fragments, embed_pending, cache_store, snapshot_roundtrip, saved_cases, versioned_upsert,
    )
}
