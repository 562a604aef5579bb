"""DuckDB SQL for the operators that SQL can express. XXH64, tokenizers and trained models have none there."""

_BLANK = r"[\x20\x09-\x0D]"
_SOLID = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) as pos
  from documents
), keyed as (
  select *, translate(regexp_replace(regexp_replace(line, '^{_BLANK}+', ''), '{_BLANK}+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines
), common as (
  select key, max(doc_id) as top from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5
), judged as (
  select k.doc_id, k.pos, k.line, c.key is not null and k.doc_id <> c.top as gone from keyed k left join common c using (key)
)
select doc_id, count(*) as n_lines, cast(sum(gone::int) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from judged group by doc_id
"""

OP2 = rf"""
with docs as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_SOLID}') as w from documents
), lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line from docs
), per_line as (
  select doc_id, count(*) as n_lines, count(distinct line) as n_once from lines where regexp_matches(line, '{_SOLID}') group by doc_id
), grams as (
  select doc_id, i, array_to_string(w[i : i + 4], ' ') as g from (select doc_id, w, unnest(generate_series(1, len(w) - 4)) as i from docs)
), again as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from grams) where n > 1
), covered as (
  select doc_id, count(distinct i + k) as n from again, (select unnest(generate_series(0, 4)) as k) group by doc_id
), ledger as (
  select d.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    coalesce(p.n_lines - p.n_once, 0) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words, coalesce(p.n_lines, 0) as n_lines,
    len(list_filter(w, lambda x: length(regexp_replace(x, '[^A-Z]', '', 'g')) >= 2 and not regexp_matches(x, '[a-z]'))) as n_caps,
    len(list_filter(w, lambda x: suffix(x, '!'))) as n_bang,
    len(list_filter(generate_series(2, len(w)), lambda i: w[i] = w[i - 1])) as n_stutters
  from docs d left join per_line p using (doc_id) left join covered c using (doc_id)
), judged as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from ledger
)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
  not (base_failed or 100 * n_symbols > 10 * n_words or (n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines)
    or (n_words >= 10 and 100 * n_caps > 25 * n_words) or 100 * n_bang > 10 * n_words or word_chars > 25 * n_words
    or 100 * n_stutters > 25 * n_words) as kept
from judged
"""

OP5 = rf"""
with sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{_SOLID}')) as bigint) as size,
    md5('mix-1:' || coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as digest from documents
), sources as (
  select source, cast(sum(size) as bigint) as source_size from sized group by source
), weighed as (
  select *, ([5.0, 2.0, 1.0]::double[])[((row_number() over (order by source nulls last) - 1) % 3) + 1] as w,
    3.0::double * source_size as cap, row_number() over (order by source nulls last) as nth, cast(sum(source_size) over () as double) as total from sources
), leveled as (
  select *, (total - coalesce(sum(cap) over (order by cap / w, nth rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by cap / w, nth rows between current row and unbounded following) as level from weighed
), targets as (
  select source, source_size, least(cap, coalesce((select arg_min(level, (cap / w, nth)) from leveled where cap / w >= level) * w, cap)) as target from leveled
), plan as (
  select *, case when source_size > 0 then least(cast(floor(target / source_size) as bigint), 3) else 0 end as whole from targets
), digests as (
  select source, digest, cast(sum(size) as bigint) as size from sized group by source, digest
), run as (
  select d.source, digest, p.source_size, p.target, p.whole, cast(round(p.target) as bigint) - p.whole * p.source_size as need,
    cast(sum(d.size) over (partition by d.source order by digest) as bigint) - d.size as before
  from digests d join plan p on d.source is not distinct from p.source
)
select s.doc_id, s.size, r.source_size, r.target,
  r.whole * s.size + cast(greatest(0, least(s.size, r.need - r.before - (row_number() over (partition by s.source, s.digest) - 1) * s.size)) as bigint) as taken
from sized s join run r on s.source is not distinct from r.source and s.digest = r.digest
"""

OP9 = rf"""
with docs as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '{_SOLID}') as w from documents
), windows as (
  select doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) as h from (select doc_id, w, unnest(generate_series(1, len(w) - 19)) as i from docs)
), later as (
  select doc_id, i from (select doc_id, i, row_number() over (partition by h order by doc_id, i) as nth from windows) where nth > 1
), covered as (
  select distinct doc_id, i + k as pos from later, (select unnest(generate_series(0, 19)) as k)
), words as (
  select doc_id, unnest(w) as word, unnest(generate_series(1, len(w))) as pos from docs
), kept as (
  select doc_id, count(*) filter (c.pos is not null) as n_removed, string_agg(word, ' ' order by words.pos) filter (c.pos is null) as left_over
  from words left join covered c using (doc_id, pos) group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(left_over, '')) as kept_sha256
from docs left join kept using (doc_id)
"""

ORACLES = {"op1_line_dedup": OP1, "op2_quality_rules": OP2, "op5_mix_sources": OP5, "op9_substring_dedup": OP9}
