"""DuckDB SQL of the registered queries. Fold tables are the same literals as Spark's."""

from __future__ import annotations

from lexloom.functions.text import FOLD_FROM, FOLD_TO
from lexloom.operators.evaluate import ADVERSARIAL
from lexloom.operators.perturb import CHAT

ON = "date '2021-03-01'"


def _fold(x: str) -> str:
    return rf"translate(regexp_replace(replace(replace(replace({x}, 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae'), '[\x{{300}}-\x{{36F}}]', '', 'g'), '{FOLD_FROM}', '{FOLD_TO}')"


def _syllables(x: str) -> str:
    clean = _fold(rf"lower(regexp_replace(coalesce({x}, ''), '(\p{{L}}{{3}})(\p{{Nd}})', '\1 \2', 'g'))")
    return f"list_filter(string_split_regex({clean}, '[^0-9a-z]+'), lambda t: t <> '')"


CHUNKS = """chunks as (
  select doc_id as id, doc_id as start_line, 'c.' || lang || '.' || source || '.d' || doc_id as path, source as doc_code, text, date '2020-01-01' + cast(doc_id % 700 as int) as effective,
    case when doc_id % 3 <> 0 then date '2020-01-01' + cast(doc_id % 700 + 200 as int) end as expiration, e.embedding
  from documents left join embeddings e on vec_id = doc_id)"""
ASKED = """asked as (
  select item_id as qid, text as query_text, array_to_string(string_split(text, ' ')[3:5], ' ') as pattern, e.embedding as query_vector from benchmark left join embeddings e on vec_id = item_id)"""
_PAIRS = "list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || '_' || w[i + 1]))"
POSTINGS = f"""words as (select id, {_syllables("text")} as w from chunks),
postings as (select id, term, count(*) as tf, any_value(dl) as dl from (select id, len(w) as dl, unnest({_PAIRS}) as term from words) group by id, term),
stats as (select count(*) as n, greatest(avg(len(w)), 1) as avgdl from words)"""
WANTED = f"""wanted as (
  select distinct qid, wants_pair, term, contains(term, '_') as is_pair from (
    select qid, len(w) > 1 as wants_pair, unnest({_PAIRS}) as term from (select qid, {_syllables("query_text")} as w from asked)))"""
IDF = "idf as (select term, count(*) as df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) as idf from postings, stats where term in (select term from wanted) group by term)"
BM25 = """bm as (
  select qid, id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as bm25, bool_or(is_pair) or not bool_or(wants_pair) as phrase_matched
  from postings join wanted using (term) join idf using (term), stats where id in (select id from open_) group by qid, id)"""
#: A sum's last digits depend on the order of its terms, so scores are compared to 9 places; ties go by path.
SAID = "said as (select * from (select *, row_number() over (partition by qid order by round(bm25, 9) desc, path) as sparse_rank from bm join chunks using (id)) where sparse_rank <= 120)"
NEAR = """sims as (select qid, id, path, list_cosine_similarity(embedding::double[], query_vector::double[]) as similarity from open_, asked where embedding is not null and query_vector is not null),
near as (select * from (select *, row_number() over (partition by qid order by similarity desc, path) as dense_rank from sims) where dense_rank <= 120)"""
FUSED = """fused as (
  select qid, id, coalesce(dense_rank, 999) as dense_rank, coalesce(sparse_rank, 999) as sparse_rank, coalesce(similarity, 0.0) as similarity, coalesce(phrase_matched, false) as phrase_matched,
    coalesce(1.0::double / (20 + dense_rank), 0) + coalesce(1.0::double / (20 + sparse_rank), 0) as rrf_score
  from near full join said using (qid, id)),
hits as (select * from (select f.*, path, row_number() over (partition by qid order by rrf_score desc, path) as rank from fused f join chunks using (id)) where rank <= 10)"""
_VALID = f"effective <= {ON} and (expiration is null or expiration > {ON})"


def _hybrid(open_: str = "true", asked: str = ASKED) -> str:
    return f"with {CHUNKS}, {asked}, open_ as (select * from chunks where {open_}), {POSTINGS}, {WANTED}, {IDF}, {BM25}, {SAID}, {NEAR}, {FUSED} "


_HITS = "select qid, id, rank, dense_rank, sparse_rank, phrase_matched, round(similarity, 6) as similarity, round(rrf_score, 9) as rrf_score from hits"
_UNACCENTED = f"{_fold('text')} = text and len(regexp_extract_all(text, '\\S+')) >= 2"
_WEAK = ASKED.replace("e.embedding as query_vector", f"case when not ({_UNACCENTED}) then e.embedding end as query_vector")
_GREP = """met as (
  select qid, c.id, c.path, doc_code, start_line, case when c.embedding is not null and query_vector is not null then 1 - list_cosine_similarity(c.embedding::double[], query_vector::double[]) end as distance
  from chunks c join asked on contains(lower(text), lower(pattern))),
grep as (select *, count(*) over (partition by qid) as full_count, row_number() over (partition by qid order by distance nulls last, doc_code, start_line, path) as rank from met)"""
_PLACES = """places as (
  select 'r' || n_regionkey || '.n' || n_nationkey || '.c' || c_custkey as path, c_custkey as start_line from customer join nation on c_nationkey = n_nationkey
  union all select 'r' || n_regionkey || '.n' || n_nationkey || '.body', -n_nationkey from nation)"""
_CITED = """edges as (
  select *, source || ':' || target || ':' || relation as edge_id, 'cites ' || target[1:2] as citation from (
    select distinct case when l_returnflag = 'R' then 'p' || l_partkey else 's' || l_suppkey end as source, case when l_returnflag = 'R' then 's' || l_suppkey else 'p' || l_partkey end as target,
      (['REFERENCES', 'AMENDS', 'SEE_ALSO'])[l_linenumber % 3 + 1] as relation from lineitem))"""
_NODES = "nodes as (select path, path[1:1] as doc_code, cast(path[2:] as bigint) as start_line from (select source as path from edges union select target from edges))"


def _summed(c: str) -> str:
    return f"round(list_sum(list_transform({c}, lambda x, i: x::double * i)), 4)"


def _seed(x: str) -> str:
    return f"cast('0x' || substr(sha256({x}), 1, 8) as bigint)"


def _chat(x: str) -> str:
    for full, short in CHAT:
        x = f"regexp_replace({x}, '{full}', '{short}', 'gi')"
    return x


def _walk(direction: str) -> str:
    out = "true" if direction != "INCOMING" else "relation = 'SEE_ALSO'"
    back = "true" if direction != "OUTGOING" else "relation = 'SEE_ALSO'"
    return f"""with recursive {_CITED}, steps as (
  select edge_id, source as a, target as b, relation, citation, 'OUTGOING' as step from edges where {out}
  union all select edge_id, target, source, relation, citation, 'INCOMING' from edges where {back}),
walk as (
  select start, edge_id, a, b, relation, citation, step, 1 as depth, [start, b] as seen from (select unnest(['s1', 's7', 'p3']) as start) join steps on a = start where b <> start
  union all select w.start, s.edge_id, s.a, s.b, s.relation, s.citation, s.step, w.depth + 1, list_append(w.seen, s.b) from walk w join steps s on s.a = w.b where w.depth < 2 and not list_contains(w.seen, s.b)),
walked as (select start, edge_id, a as "from", b as "to", relation, citation, step, cast(min(depth) as bigint) as depth from walk group by all) """


_UNDER = lambda p: f"(path = '{p}' or starts_with(path, '{p}.'))"

_GRADED = """graded as (
  select *, not in_scope and (refused or c = 0) or in_scope and not refused and cite_article and n_amounts = 0 and n_facts = 0 and grounded as correct from (
    select *, o_orderkey % 4 <> 0 as in_scope, o_custkey % 5 as c, o_custkey % 3 = 1 as grounded, o_custkey % 7 = 0 as refused, o_orderkey % 2 = 0 and o_custkey % 7 <> 0 as cite_article,
      o_orderkey % 2 = 0 and o_custkey % 7 <> 0 and o_custkey % 5 = 1 as cite_exact, (o_custkey % 3 <> 1)::int::bigint as n_amounts, (o_custkey % 5 = 0)::int::bigint as n_facts from orders))"""
_CHANGES = """changes as (
  select 'n' || c_custkey as doc_code, 'n' || c_custkey || '.a_1.c_1' as source, 'sửa đổi' as action, c_custkey || '/2020/ND-CP' as target_code, '5' as article, '2' as clause, null as point from customer
  union all select 'n' || c_custkey, 'n' || c_custkey || '.a_1.c_2', 'bãi bỏ', c_custkey || '/2020/ND-CP', '6', cast(c_custkey % 3 + 1 as varchar), unnest(['a', 'b', 'c']) from customer)"""

ORACLES = {
    "syllable_terms": f"with {CHUNKS}, {POSTINGS} select term, cast(sum(tf) as bigint) as tf, count(*) as df from postings group by term",
    "corpus_stats": f"with {CHUNKS}, {POSTINGS} select n, round(avgdl, 6) as avgdl from stats",
    "term_idf": f"with {CHUNKS}, {ASKED}, {POSTINGS}, {WANTED}, {IDF} select term, df, round(idf, 6) as idf from idf",
    "bm25_topk": f"with {CHUNKS}, {ASKED}, open_ as (from chunks), {POSTINGS}, {WANTED}, {IDF}, {BM25}, {SAID} select qid, id, sparse_rank as rank, phrase_matched, round(bm25, 6) as bm25 from said where sparse_rank <= 10",
    "dense_topk": f"with {CHUNKS}, {ASKED}, open_ as (from chunks), {NEAR} select qid, id, dense_rank as rank, round(similarity, 6) as similarity from near where dense_rank <= 20",
    "dense_in_lists": f"with {CHUNKS}, {ASKED}, open_ as (from chunks), {NEAR} select true as recall_reached, count(*) as n from near where dense_rank <= 10",
    "hybrid_search": _hybrid() + _HITS,
    "hybrid_search_filtered": _hybrid(f"{_VALID} and doc_code in ('src1', 'src2', 'src3', 'src4') and {_UNDER('c.en')}") + _HITS,
    "hybrid_without_vectors": _hybrid(asked=ASKED.replace("e.embedding as query_vector", "cast(null as float[]) as query_vector")) + _HITS,
    "hybrid_unaccented": _hybrid(asked=_WEAK) + _HITS,
    "scope_unknown": "select count(*) as n from documents where source = 'no such code'",
    "validity_filter": f"with {CHUNKS} select id, strftime(effective, '%Y-%m-%d') as effective, strftime(expiration, '%Y-%m-%d') as expiration from chunks where {_VALID}",
    "in_force_catalog": f"""with c as (select source, count(*) as n from documents group by source), s as (
      select 'src' || s_suppkey as doc_code, date '2020-06-01' as effective, case when s_suppkey % 2 = 0 then {ON} end as expiration from supplier)
      select doc_code, coalesce(n, 0) as n_chunks, {_VALID} as in_force from s left join c on source = doc_code""",
    "grep_substring": f"""with {CHUNKS}, found as (select *, count(*) over () as full_count, row_number() over (order by doc_code, start_line, path) as rank from chunks where contains(lower(text), lower('The TH')))
      select id, rank, full_count, cast(null as double) as distance from found where rank <= 25""",
    "grep_regex": rf"""with {CHUNKS}, found as (
      select *, 1 - list_cosine_similarity(embedding::double[], (select embedding from embeddings where vec_id = 1)::double[]) as distance, count(*) over () as full_count
      from chunks where {_VALID} and regexp_matches(text, '(?i)[\p{{L}}]+ation [\p{{L}}]{{3}}')), r as (select *, row_number() over (order by distance nulls last, doc_code, start_line, path) as rank from found)
      select id, rank, full_count, round(distance, 6) as distance from r where rank <= 25""",
    "grep_each": f"with {CHUNKS}, {ASKED}, {_GREP} select qid, id, rank, full_count, round(distance, 6) as distance from grep where rank <= 10",
    "search_tagged": _hybrid(asked=_WEAK) + f""", {_GREP}, total as (select distinct qid, full_count from grep), u as (
        select qid, id, case when (qid, id) in (select (qid, id) from met) then 0 else 1 end as bucket, rank as own from hits
        union all select qid, id, 2, rank from grep where rank <= 10 and (qid, id) not in (select (qid, id) from hits))
      select u.qid, row_number() over (partition by u.qid order by bucket, own) as rank, (['both', 'semantic_only', 'verbatim_only'])[bucket + 1] as found_in, u.id, c.path, 'Title of ' || c.doc_code as doc_title,
        coalesce(dense_rank, 999) as dense_rank, coalesce(sparse_rank, 999) as sparse_rank, coalesce(phrase_matched, false) as phrase_matched, round(coalesce(similarity, 0.0), 6) as similarity,
        coalesce(full_count, 0) as verbatim_total, coalesce(full_count, 0) > 10 as truncated
      from u join chunks c on c.id = u.id left join hits h on h.qid = u.qid and h.id = u.id left join total t on t.qid = u.qid""",
    "reranked": _hybrid() + f""", texts as (select id, list_distinct({_syllables("text")}) as t from chunks), said_ as (select qid, query_text, list_distinct({_syllables("query_text")}) as q, {_UNACCENTED.replace("text", "query_text")} as plain from asked),
      x as (select qid, id, rank as before, case when not plain then 4.0::double * len(list_intersect(q, t)) / greatest(len(q), 1) - 2.0 end as rerank_score from hits join said_ using (qid) join texts using (id)),
      y as (select *, row_number() over (partition by qid order by rerank_score desc nulls last, before) as rank from x) select qid, id, rank, round(rerank_score, 6) as rerank_score from y where rank <= 5""",
    "confidence": _hybrid() + """, labels_ as (select qid, case when not bool_or(phrase_matched) then 'none' when max(similarity) = 0 then 'high' when max(similarity) < 0.63 then 'low' else 'high' end as confidence from hits where qid % 2 = 0 group by qid)
      select qid, coalesce(confidence, 'none') as confidence from asked left join labels_ using (qid)""",
    "group_ranked": _hybrid() + """, g as (select qid, doc_code as context, min(rank) as best, string_agg(cast(id as varchar), ',' order by rank) as members from hits join chunks using (id) group by qid, doc_code)
      select qid, context, row_number() over (partition by qid order by best) as group_rank, members from g""",
    "reading_order_islands": """with x as (select *, lag(role) over (partition by conv_id order by turn) as before, row_number() over (partition by conv_id order by turn) as nth from conversations),
      y as (select *, sum(case when nth > 1 and before is not distinct from role then 0 else 1 end) over (partition by conv_id order by turn rows unbounded preceding) as island from x)
      select conv_id, cast(island as bigint) as island, role, min(turn) as "first", count(*) as n from y group by conv_id, island, role""",
    "subtree": f"with {_PLACES} select path, start_line, count(*) over () as full_count from places where {_UNDER('r1.n1')} order by start_line, path limit 30",
    "parent_context": f"with {_PLACES} select path, start_line, count(*) over () as full_count, 'r1.n1.c5' as requested from places where {_UNDER('r1.n1')} order by start_line, path limit 20",
    "expand_to_leaves": f"""with {_PLACES}, q as (select unnest(['r1', 'r2.n8', 'r0.n0.body', 'r0.n1', 'r9', 'r1.n']) as query_path)
      select query_path, path from q join places on path = query_path or starts_with(path, query_path || '.')""",
    "sibling_windows": f"with {_PLACES} select regexp_replace(path, '\\.[^.]*$', '') as parent, path from places where regexp_replace(path, '\\.[^.]*$', '') in ('r1.n1', 'r2.n8')",
    "raw_slice": "select doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) as lines from documents",
    "line_coverage": """with d as (select doc_id, len(string_split(text, chr(10))) as n from documents), l as (select doc_id, n, unnest(generate_series(1, n)) as line from d),
      j as (select doc_id as doc_code, line, cast((line <= greatest(1, n - 1))::int + (line = 1 and doc_id % 2 = 0)::int as bigint) as n from l) select doc_code, line, n from j where n <> 1""",
    "graph_traverse_out": _walk("OUTGOING") + "from walked",
    "graph_traverse_in": _walk("INCOMING") + "from walked",
    "graph_traverse_both": _walk("BOTH") + "from walked",
    "graph_links": _walk("OUTGOING") + f""", {_NODES}, n as (
        select w.*, row_number() over (partition by start, "from", step, relation, citation, depth order by doc_code, start_line, "to") as nth from walked w join nodes on path = "to")
      select start, "from", step, relation, citation, depth, count(*) as total, string_agg("to", ',' order by nth) filter (nth <= 5) as targets, count(*) > 5 as truncated from n group by start, "from", step, relation, citation, depth""",
    "edges_touching": f"with {_CITED} select edge_id from edges where regexp_matches(source, '^s.*3$|^p.*7$') or regexp_matches(target, '^s.*3$|^p.*7$')",
    "find_edges": f"with {_CITED} select edge_id from edges e where source like '%1' and exists (from edges f where f.source = e.source and f.target = e.target and case f.relation when 'AMENDS' then 'SEE_ALSO' else f.relation end = e.relation)",
    "edge_paths": f"with {_CITED} select edge_id, source, target, source[1:1] as source_doc, target[1:1] as target_doc from edges where source not like '%7' and target not like '%7'",
    "edge_insert_absent": f"with {_CITED} select source, target || '0' as target, relation from edges e where not exists (from edges f where f.source = e.source and f.target = e.target || '0' and f.relation = e.relation)",
    "edge_invalidated": f"""with {_CITED}, nodes as (select path, 'cites p1 s2 cites s9 ' || path as text from (select source as path from edges union select target from edges) where path not like '%3')
      select edge_id, case when s.path is null or t.path is null then 'ORPHANED' else 'UNGROUNDED' end as reason
      from edges left join nodes s on source = s.path left join nodes t on target = t.path where s.path is null or t.path is null or not contains(s.text, citation)""",
    "edge_violations": f"""with {_CITED}, nodes as (select distinct source as path from edges where source not like '%3'), p as (select source, case when target = 'p5' then source else target end as target, relation, citation from edges),
      c as (select p.*, case when s.path is null then 'SOURCE_NOT_FOUND' when t.path is null then 'TARGET_NOT_FOUND' when not contains('cites p1 and cites s2, cites s9', citation) then 'UNGROUNDED_CITATION_TEXT' when source = target then 'SELF_REFERENCING_EDGE' end as code
        from p left join nodes s on source = s.path left join nodes t on target = t.path) select source, target, relation, code from c where code is not null""",
    "upsert_keep_embedding": f"""with {CHUNKS}, c as (select id, path, text, embedding from chunks), o as (from c where id % 5 <> 0), n as (
        select path, case when id % 4 = 0 then text else text || '!' end as text, case when id % 3 = 0 then list_transform(embedding, lambda x: (x * 2)::float) end as embedding from c where id % 2 = 0
        union all select path || '.new', text, null from c where id % 50 = 0),
      u as (select coalesce(n.path, o.path) as path, length(case when n.path is not null then n.text else o.text end) as n,
        case when n.path is null then o.embedding else coalesce(n.embedding, case when o.text = n.text then o.embedding end) end as embedding from o full join n on o.path = n.path)
      select path, n, {_summed("embedding")} as embedding from u""",
    "purge_stale": f"""with {CHUNKS}, e as (select path as source, lag(path) over (partition by doc_code order by id) as target from chunks), stale as (select path from chunks where doc_code = 'src1' and id % 2 <> 0)
      select doc_code, count(*) as n from chunks where path not in (from stale) group by doc_code
      union all select 'edges', count(*) from e where target is not null and source not in (from stale) and target not in (from stale)""",
    "embedding_cache": f"with {CHUNKS} select sha256(text) as text_sha256, bool_or(embedding is not null and id % 2 = 0) as cached from chunks group by text",
    "missing_embeddings": f"with {CHUNKS} select doc_code, count(*) as missing from chunks where embedding is null group by doc_code",
    "missing_texts": f"with {CHUNKS} select distinct sha256(text) as text_sha256 from chunks where embedding is null",
    "json_field": "with e as (select event_type, cast(json_extract_string(props, '$.k') as bigint) as k from events) select event_type, count(*) as n, cast(sum(k) as bigint) as k from e where k > 50 group by event_type",
    "slug_label": f"select doc_id, substring(regexp_replace(regexp_replace(lower({_fold('text')}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 250) as slug from documents",
    "flexible_dates": "select o_orderkey, case when o_orderkey % 6 < 5 then strftime(o_orderdate, '%Y-%m-%d') end as parsed from orders",
    "eval_summary": _hybrid() + """, cases as (select qid, case when qid % 5 = 0 then 'holdout' else 'dev' end as split from asked),
      good as (select qid, min(case when sparse_rank = 999 then 1 else 0 end) as bucket from hits where starts_with(path, 'c.en.') or starts_with(path, 'c.fr.src' || (qid % 20) || '.') group by qid)
      select split, count(*) as total, count(*) filter (bucket = 0) as "both", count(*) filter (bucket = 1) as semantic_only, cast(0 as bigint) as verbatim_only, count(*) filter (bucket is null) as missed
      from cases left join good using (qid) group by split""",
    "hit_rates": _hybrid() + """, good as (select qid, min(rank) as rank from hits join chunks using (id) where doc_code = 'src' || (qid % 20) group by qid), r as (
        select case when qid % 5 = 0 then 'holdout' else 'dev' end as split, rank from asked left join good using (qid))
      select split, round(avg(case when rank <= 1 then 1.0 else 0.0 end), 6) as hit_1, round(avg(case when rank <= 5 then 1.0 else 0.0 end), 6) as hit_5, round(avg(coalesce(1.0::double / rank, 0.0)), 6) as mrr from r group by split""",
    "grounding": """select o_orderkey, concat_ws(',', case when o_orderkey % 7 <> o_orderkey % 5 then 'a' || (o_orderkey % 7) end, case when o_custkey % 2 <> 0 then 'd' || o_custkey || '000' end) as missing from orders""",
    "mcnemar": """with n as (select cast(sum((toxic = 0 and quality <> 1)::int) as bigint) as gains, cast(sum((quality = 1 and toxic <> 0)::int) as bigint) as losses from labels),
      i as (select *, unnest(range(least(gains, losses) + 1)) as i from n)
      select gains, losses, round(least(1.0, 2 * sum(exp(lgamma(gains + losses + 1) - lgamma(i + 1) - lgamma(gains + losses - i + 1) - (gains + losses) * ln(2)))), 6) as p from i group by gains, losses""",
    "grade_answers": f"with {_GRADED} select o_orderkey, grounded, refused, cite_article, cite_exact, correct, n_amounts, n_facts from graded",
    "answer_report": f"""with {_GRADED} select count(*) as n, cast(sum(in_scope::int) as bigint) as n_in_scope, round(avg(correct::int) filter (in_scope), 6) as correct, round(avg(cite_article::int) filter (in_scope), 6) as cite_article,
      round(avg(cite_exact::int) filter (in_scope), 6) as cite_exact, round(avg((n_amounts = 0 and n_facts = 0)::int) filter (in_scope), 6) as whole, round(avg(grounded::int), 6) as grounded,
      round(avg(refused::int) filter (in_scope), 6) as wrongly_refused, round(avg(correct::int) filter (not in_scope), 6) as rightly_refused, round(avg(o_custkey::double) filter (o_orderkey % 10 = 0), 6) as mean_cost,
      list_sort(list(o_orderkey % 1000))[cast(floor(count(*) / 2) as bigint) + 1] as median_ms, max(o_orderkey % 1000) as max_ms, round(sum(o_custkey::double) filter (o_orderkey % 10 = 0), 2) as cost from graded""",
    "renumber_citations": """with o as (select o_orderkey, o_orderkey % 4 as n, o_custkey % 4 as a, (o_custkey + 1) % 4 as b from orders),
      t as (select *, case when a < 3 then '[#' || (a + 1) || ']' else '' end as one, case when b < 3 then '[#' || (b + 1) || ']' else '' end as two from o)
      select o_orderkey, 'x ' || one || ' y' || case n when 1 then one when 2 then two else '' end || ' z ' as answer from t""",
    "prompts": _hybrid() + """, h as (select qid, rank, doc_code, effective, trim(text, ' ') as text, case when id % 2 = 0 then 'Điều ' || id else c.path end as place from hits join chunks c using (id) where rank <= 3),
      b as (select qid, string_agg('[#' || rank || '] ' || doc_code || ' — ' || place || ' (hiệu lực ' || strftime(effective, '%Y-%m-%d') || ')' || chr(10) || text, chr(10) || chr(10) order by rank) as blocks from h group by qid)
      select qid, sha256('Header' || chr(10) || chr(10) || '===== ĐIỀU KHOẢN =====' || chr(10) || coalesce(blocks, '') || chr(10) || '===== HẾT =====' || chr(10) || chr(10) || 'CÂU HỎI: ' || trim(query_text, ' ')) as sha256
      from asked left join b using (qid)""",
    "adversarial_confidence": _hybrid(asked="asked as (select unnest(range({})) as qid, unnest([{}]) as query_text, cast(null as float[]) as query_vector)".format(len(ADVERSARIAL), ", ".join(f"'{q}'" for q in ADVERSARIAL)))
    + """, l as (select qid, case when not bool_or(phrase_matched) then 'none' else 'high' end as confidence from hits group by qid) select qid, coalesce(confidence, 'none') as confidence from asked left join l using (qid)""",
    "any_of": f"with {ASKED}, {WANTED} select qid, string_agg(term, ' | ' order by term) as said from wanted group by qid",
    "canonical_text": """with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents),
      n as (select doc_id, pos, trim(regexp_replace(nfc_normalize(line), '\\s+', ' ', 'g')) as line from l where pos % 5 <> 4)
      select cast(doc_id as varchar) as path, sha256(string_agg(line, chr(10) order by pos)) as sha256 from n where line <> '' group by doc_id""",
    "document_links": """with p as (select cast(page_id as varchar) as doc_code, url, lower(regexp_extract(url, '://([^/:?#]+)', 1)) as named from pages), h as (select unnest(['example.com', 'example.net']) as host)
      select doc_code, host, url from p join h on named = host or suffix(named, '.' || host)""",
    "manifest": """select 's' || s_suppkey as doc_code, '- s' || s_suppkey || ': ' || s_name || ' (from 2020-06-01' || case when s_suppkey % 3 = 0 then ' to ' || strftime(date '2021-01-01' + cast(s_suppkey % 50 as int), '%Y-%m-%d') else '' end || ')' as line from supplier""",
    "request_order": f"with {_PLACES} select path, n_regionkey * 25 + 24 - n_nationkey as ordinal from places join nation on path = 'r' || n_regionkey || '.n' || n_nationkey || '.body'",
    "reference_edges": """with o as (select 'o' || c_custkey as p, c_custkey % 4 as k from customer), e as (
        select p || '.a_1.c_1' as source, p || '.a_1.c_2' as target, 'khoản 2 Điều này' as citation from o
        union all select p || '.a_1.c_2', p || unnest(['.a_2.c_1.body', '.a_2.c_1.p_a', '.a_2.c_1.p_b', '.a_2.c_2']), 'Điều 2 Thông tư này' from o
        union all select p || '.a_2.c_1.p_b', p || '.a_1.c_' || k, 'khoản ' || k || ' Điều 1 Thông tư này' from o where k in (1, 2)) select source, target, 'REFERENCES' as relation, citation from e""",
    "amendments": f"with {_CHANGES} select * from changes",
    "amendment_notes": f"""with {_CHANGES}, c as (select c_custkey as k, unnest(['a_5.c_2', 'a_5.c_2.p_a', 'a_5.c_1', 'a_6.c_1.p_b', 'a_6.c_2.p_d', 'a_6.c_3.body']) as p from customer where date '2021-02-20' + cast(c_custkey % 20 as int) <= {ON}),
      m as (select 'l' || k || '.' || p as path, 'sửa đổi' as action, 'n' || k || '.a_1.c_1' as source, 1 as n from c where p in ('a_5.c_2', 'a_5.c_2.p_a')
        union all select 'l' || k || '.' || p, 'bãi bỏ', 'n' || k || '.a_1.c_2', case when p = 'a_6.c_3.body' then 3 else 1 end from c where (p = 'a_6.c_1.p_b' and k % 3 = 0) or (p = 'a_6.c_3.body' and k % 3 = 2))
      select path, action, source as sources, cast(n as bigint) as n from m""",
    "quote_spans": """select s_suppkey, concat_ws(',', '3-' || (5 + n), (8 + n) || '-' || (10 + 2 * n), (13 + 2 * n) || '-' || (14 + 2 * n + length(cast(s_suppkey as varchar)))) as spans from (select s_suppkey, length(s_name) as n from supplier)""",
    "normalized_span": """with w as (select doc_id, text, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')[5:8] as w from documents),
      m as (select doc_id, text, case when len(w) > 0 then regexp_extract(text, array_to_string(list_transform(w, lambda x: regexp_escape(x)), '\\s+')) end as m from w)
      select doc_id, case when m <> '' then instr(text, m) - 1 end as start, case when m <> '' then instr(text, m) - 1 + length(m) end as "end" from m""",
    "text_fragments": """select cast(doc_id as varchar) as doc_code, '#:~:text=' || case when doc_id % 2 = 0 then url_encode('Mục số ' || doc_id || ' của tài liệu này') else url_encode('ở đây một hai:') || ',' || url_encode('tài liệu này') end as source_fragment from documents""",
    "embed_pending": f"""with {CHUNKS}, p as (select text, min(id) % 3 = 0 as known, {_syllables("text")} as w from chunks where embedding is null group by text),
      b as (select *, list_transform(w, lambda x: cast('0x' || substr(md5(x), 1, 4) as int) % 8) as b from p),
      n as (select *, list_transform(range(8), lambda j: len(list_filter(b, lambda x: x = j))::double) as n from b),
      u as (select *, sqrt(list_sum(list_transform(n, lambda x: x * x))) as size from n),
      e as (select text, case when known then [1, 2, 3, 4, 5, 6, 7, 8]::float[] when trim(text) <> '' then list_transform(n, lambda x: cast(x / greatest(size, 1e-300) as float)) end as new from u)
      select id, {_summed("coalesce(embedding, new)")} as embedding from chunks left join e using (text)""",
    "cache_store": f"""with {CHUNKS}, r as (select distinct cast(id % 2 as int) as dim, sha256(doc_code) as text_sha256 from chunks where embedding is not null) select dim, text_sha256, cast(dim + 1 as int) as embedding from r""",
    "snapshot_roundtrip": f"""with {CHUNKS} select cast(id as varchar) as key, sha256(text) as sha256, {_summed("embedding")} as embedding from chunks where embedding is not null
      union all select 's' || s_suppkey, sha256(s_name), null from supplier""",
    "saved_cases": f"with {ASKED} select 'b' || lpad(cast(qid as varchar), 4, '0') as id, sha256(query_text) as sha256, pattern as expected from asked",
    "chunk_documents": """with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(generate_series(1, len(string_split(text, chr(10))))) as n from documents)
      select 'd' || doc_id as doc_code, 'd' || doc_id || '.a_1.body' as path, 1 as start_line, 1 as end_line, 12 as n_chars from documents
      union all select 'd' || doc_id, 'd' || doc_id || '.a_1.c_' || n, n + 1, n + 1, length(n || '. ' || line) from l""",
    "expand_windows_in_budget": """with t as (select conv_id, turn, turn || ' ' || text as body, length(turn || ' ' || text) + 1 as cost, count(*) over (partition by conv_id) as n from conversations),
      w as (select *, 5 + sum(cost) over (partition by conv_id) - 1 as whole, sum(cost) over (partition by conv_id order by turn) as upto from t),
      k as (select *, whole <= 1500 or turn = 0 or upto <= 1500 - 40 - 2 - 5 as kept from w),
      j as (select conv_id, any_value(n) as n, string_agg(body, chr(10) order by turn) filter (kept) as body, not bool_and(kept) as cut from k group by conv_id)
      select 'c' || conv_id || '.w_0' as path, sha256('head' || chr(10) || body || case when cut then chr(10) || '| ... | (lược bớt phần khác của bảng) |' else '' end) as sha256 from j join conversations using (conv_id) where turn = 0""",
    "fill_ratio": """with l as (select doc_id, string_split(line, '|') as c from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where contains(line, '|'))
      select doc_id, count(*) as n, round(sum(len(list_filter(c, lambda x: trim(x) <> '')) / len(c)), 6) as filled from l group by doc_id""",
    "money_amounts": """select o_orderkey, case o_orderkey % 3 when 0 then cast((o_custkey + 1) * 1000 as varchar) when 1 then array_to_string(list_sort(list_distinct([(o_orderkey % 7 + 1) * 1000000, 9000000])), ',')
      else array_to_string(list_sort([800000, o_orderkey % 9 * 1000000 + 500000]), ',') end as amounts from orders""",
    "address_format": "select c_custkey, 'Điều ' || c_custkey || case when c_nationkey % 2 = 0 then ', Khoản ' || c_nationkey || ', Điểm đ' else '' end as address from customer",
    "upsert_documents": """with o as (select s_suppkey, s_name, round(s_acctbal, 2) as s_acctbal from supplier), n as (select s_suppkey * 2 as s_suppkey, s_name || '!' as s_name, s_acctbal * 0 as s_acctbal from o where s_suppkey % 3 = 0)
      select coalesce(n.s_suppkey, o.s_suppkey) as s_suppkey, coalesce(n.s_name, o.s_name) as s_name, coalesce(o.s_acctbal, n.s_acctbal) as s_acctbal from o full join n on o.s_suppkey = n.s_suppkey""",
    "fill_embeddings": f"""with {CHUNKS}, v as (select text, [1, 2, min(id)]::float[] as known from chunks where embedding is null group by text having min(id) % 2 = 0),
      u as (select id, coalesce(embedding, known) as embedding from chunks left join v using (text)) select id, {_summed("embedding")} as embedding from u""",
    "citation_hints": """with o as (select 'o' || o_orderkey as doc_code, o_orderkey % 4 as k from orders)
      select doc_code, doc_code || '.a_1.c_1' as source, doc_code || '.a_1.c_2' as target from o
      union all select doc_code, doc_code || '.a_1.c_2', case when k in (1, 2) then doc_code || '.a_2.c_' || k || '.p_a' end from o""",
    "curate_edges": f"""with {_CITED}, e as (select 'g' || length(source) || '.' || source as source, 'g' || length(target) || '.' || target as target, relation from edges),
      nodes as (select source as path from e union select target from e),
      gone as (from e where source like 'g2.%' and target like 'g3.%' and relation = 'REFERENCES'), remain as (from e except from gone),
      missed as (select path as source, 'g3' as target, 'REFERENCES' as relation from nodes where path like 'g2.%' and path not in (select source from gone) union all select 'g2.s1', 'zz', 'AMENDS'),
      wanted as (select a.path as source, t.path as target, 'SEE_ALSO' as relation from nodes a join nodes t on a.path <> t.path where a.path like 'g2.s%' and t.path like 'g2.%')
      select 'removed' as outcome, * from gone union all select 'not_found', * from missed union all select 'added', * from (from wanted except from remain) union all select 'existing', * from (from wanted intersect from remain)""",
    "expand_windows": """with w as (select conv_id, count(*) as n, string_agg(turn || ' ' || text, chr(10) order by turn) as body from conversations group by conv_id)
      select 'c' || conv_id || '.w_1' as path, sha256('head' || chr(10) || body) as sha256 from w join conversations using (conv_id) where turn = 1""",
    "query_perturbations": f"""with q as (
        select item_id as ordinal, ['formal', 'no_diacritics', 'very_short', 'teencode', 'number_format'][item_id % 5 + 1] as base, 'cho hỏi ' || replace(text, chr(10), ' ') || ' 05 người được 2.000.000 hay 1,5 thì bị phạt bao nhiêu?' as query from benchmark),
      w as (select *, {_seed("query")} as seed, string_split_regex(query, '\\s+') as w from q), c as (select *, list_filter(range(len(w)), lambda i: regexp_full_match(w[i + 1], '\\p{{L}}{{5,}}')) as spots from w),
      t as (select *, spots[seed % len(spots) + 1] + 1 as k, w[spots[seed % len(spots) + 1] + 1] as word from c), u as (select *, 1 + {_seed("word")} % (length(word) - 2) as cut from t),
      made as (select ordinal, query, seed, list_filter([
          {{'style': 'p_no_diacritics', 'variant': translate(query, '{FOLD_FROM}', '{FOLD_TO}')}}, {{'style': 'p_chat_abbrev', 'variant': {_chat("query")}}},
          {{'style': 'p_truncate', 'variant': trim(regexp_replace(regexp_replace(query, '^cho hỏi ', ''), ' thì bị phạt bao nhiêu\\?$', ''), ' ?.,')}},
          {{'style': 'p_number_reformat', 'variant': regexp_replace(regexp_replace(regexp_replace(query, '2\\.000\\.000', '2 triệu'), '\\b0(\\d)\\b', '\\1', 'g'), '\\b(\\d+),(\\d+)\\b', '\\1.\\2', 'g')}},
          {{'style': 'p_typo', 'variant': array_to_string(list_transform(w, lambda x, i: case when i = k then x[1:cut] || x[cut + 2] || x[cut + 1] || x[cut + 3:] else x end), ' ')}},
          {{'style': 'p_noise', 'variant': ['cho hỏi ', 'mọi người ơi ', 'anh chị cho em hỏi '][seed % 3 + 1] || rtrim(query, '?. ') || ' ???'}}],
          lambda x: not coalesce(list_contains(case base when 'no_diacritics' then ['p_no_diacritics', 'p_typo'] when 'very_short' then ['p_truncate'] when 'teencode' then ['p_chat_abbrev', 'p_no_diacritics'] when 'number_format' then ['p_number_reformat'] end, x.style), false)) as usable from u),
      picked as (select ordinal, query, nth, usable[(seed + nth) % len(usable) + 1] as x from made, range(2) r(nth)),
      firsts as (select ordinal, x.style as style, x.variant as query, row_number() over (partition by lower(x.variant) order by ordinal, nth) as n from picked where x.variant <> query)
      select ordinal, style, query from firsts where n = 1""",
}
ORACLES["versioned_upsert"] = ORACLES["upsert_documents"]
