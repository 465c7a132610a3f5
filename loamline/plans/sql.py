"""The same queries in SQL for DuckDB, written from what the operators mean, not from how they run."""

from __future__ import annotations

from loamline.functions.constants import ALIASES, QUERY_PREFIX, STOPWORDS
from loamline.functions.text import stem_word
from loamline.plans.queries import AS_OF, QUESTION

_SPACE = r"\t\n\x{0B}\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_WS = f"[{_SPACE}]"
_LINE = r"\n\r\x{2028}\x{2029}"
_NL = "chr(10)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sub(s: str, pattern: str, instead: str) -> str:
    return f"regexp_replace({s}, {_quoted(pattern)}, {_quoted(instead)}, 'g')"


def _trim(s: str) -> str:
    return _sub(s, f"^{_WS}+|{_WS}+$", "")


def _strip(s: str) -> str:
    for pattern, instead in (
        (r"(?s)```.*?```", " "),
        (r"`([^`]+)`", r"\1"),
        (r"!\[[^\]]*\]\([^)]*\)", " "),
        (r"\[([^\]]+)\]\([^)]*\)", r"\1"),
        (r"\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|([^\]]+))?\]\]", r"\2 \1"),
        (rf"(^|[{_LINE}])#{{1,6}}{_WS}+", r"\1"),
        (r"[*_~>|-]+", " "),
        (f"{_WS}+", " "),
    ):
        s = _sub(s, pattern, instead)
    return f"trim({s})"


def _words(s: str) -> str:
    return f"list_filter(string_split({_strip(s)}, ' '), lambda w: w <> '')"


def _stem(t: str) -> str:
    n = f"length({t})"
    return (
        f"case when {n} > 5 and {t} like '%ing' then left({t}, {n} - 3) when {n} > 4 and {t} like '%ied' then left({t}, {n} - 3) || 'y' "
        f"when {n} > 4 and ({t} like '%ed' or {t} like '%es') then left({t}, {n} - 2) when {n} > 3 and {t} like '%s' then left({t}, {n} - 1) else {t} end"
    )


_STOP = "[" + ", ".join(_quoted(w) for w in sorted(STOPWORDS)) + "]"
_MAP = "map([" + ", ".join(_quoted(k) for k in ALIASES) + "], [" + ", ".join("[" + ", ".join(_quoted(stem_word(v)) for v in vs) + "]" for vs in ALIASES.values()) + "])"


def _tokens(s: str, aliases: bool = True) -> str:
    bare = _sub(_sub(f"lower({_strip(s)})", "['’]", ""), "[^a-z0-9]+", " ")
    base = f"list_filter(list_transform(string_split({bare}, ' '), lambda t: {_stem('t')}), lambda t: length(t) > 1 and not list_contains({_STOP}, t))"
    return f"flatten(list_transform({base}, lambda t: list_concat([t], coalesce({_MAP}[t], []))))" if aliases else base


def _windows(words: str, size: int = 260, overlap: int = 48) -> str:
    """Rows (ordinal, content) of a list of words, as a lateral subquery."""
    step = max(1, size - overlap)
    return f"(select i as ordinal, array_to_string({words}[i * {step} + 1 : i * {step} + {size}], ' ') as content from range(case when len({words}) <= {size} then 1 else cast(ceil((len({words}) - {size}) / {step}.0) as bigint) + 1 end) r(i))"


_TEXTS = "texts as (select doc_id, lang, source, coalesce(text, '') as raw from documents)"
_UNIX = f"replace(raw, chr(13) || {_NL}, {_NL})"
_FENCES = f"""
opened as (select *, {_UNIX} as u, (starts_with(raw, '---' || {_NL}) or starts_with(raw, '---' || chr(13) || {_NL})) as opens from texts),
fenced as (select *, case when opens and instr(substr(u, 5), {_NL} || '---' || {_NL}) > 0 then instr(substr(u, 5), {_NL} || '---' || {_NL}) + 4 else 0 end as fence from opened),
parts as (select *, case when fence > 0 then substr(u, 5, fence - 5) end as block, case when fence > 0 then substr(u, fence + 5) else raw end as body from fenced)
"""
#: An item belongs to the last line that isn't one, if that is a key without a value.
_YAML = rf"""
lines as (select doc_id, i, {_sub("x.line", f"{_WS}+$", "")} as line from parts, unnest(string_split(block, {_NL})) with ordinality x(line, i) where block is not null),
kept as (select *, regexp_extract(line, '^{_WS}*-{_WS}+([^\n\r]+)$', 1) as item, lower(regexp_extract(line, '^([A-Za-z0-9_-]+):', 1)) as key,
  regexp_extract(line, '^[A-Za-z0-9_-]+:{_WS}*([^\n\r]*)$', 1) as value from lines where not regexp_matches(line, '^{_WS}*(#|$)')),
heads as (select *, last_value(case when item = '' then i end ignore nulls) over (partition by doc_id order by i rows between unbounded preceding and current row) as head from kept),
owners as (select doc_id, i, key, value from kept where item = '' and key <> ''),
entries as (
  select doc_id, key, i, value = '' or regexp_matches({_trim("value")}, '^\[[^\n\r]*\]$') as is_list,
    case when value = '' then [] when regexp_matches({_trim("value")}, '^\[[^\n\r]*\]$')
      then list_filter(list_transform(string_split(regexp_extract({_trim("value")}, '^\[([^\n\r]*)\]$', 1), ','), lambda v: {_sub(_trim("v"), "^['\"]|['\"]$", "")}), lambda v: v <> '')
      else [{_sub(_trim("value"), "^['\"]|['\"]$", "")}] end as own
  from owners),
items as (select h.doc_id, h.head, list({_sub(_trim("h.item"), "^['\"]|['\"]$", "")} order by h.i) as held from heads h join owners o on o.doc_id = h.doc_id and o.i = h.head and o.value = '' where h.item <> '' group by 1, 2),
yaml as (
  select doc_id, key, is_list, list_concat(own, coalesce(held, [])) as "values" from entries e left join items x on x.doc_id = e.doc_id and x.head = e.i
  qualify row_number() over (partition by e.doc_id, key order by e.i desc) = 1)
""".replace("x.doc_id = e.doc_id", "x.doc_id = e.doc_id").replace("select doc_id, key, is_list, list_concat", "select e.doc_id, key, is_list, list_concat")

_TAG = rf"(?:^|[{_SPACE}(\[{{>])#([A-Za-z][A-Za-z0-9_/-]{{1,64}})\b"
_LINK = r"\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]"
_LINKS = f"list_filter(list_transform(regexp_extract_all(body, {_quoted(_LINK)}, 1), lambda x: {_sub(_trim('x'), _WS + '+', ' ')}), lambda x: x <> '')"
_INLINE = f"list_transform(regexp_extract_all(body, {_quoted(_TAG)}, 1), lambda x: lower({_sub(_trim('x'), '^#', '')}))"


def _title(file_name: str) -> str:
    found = f"regexp_extract(body, '(?:^|[{_LINE}])#{_WS}+([^{_LINE}]+)', 1)"
    bare = _sub(_sub(file_name, r"\.[^.]+$", ""), "[-_]+", " ")
    return f"case when {found} <> '' then {_trim(found)} else {bare} end"


def _folders(path: str) -> str:
    parts = f"list_filter(string_split(replace({path}, chr(92), '/'), '/'), lambda p: p <> '')"
    return f"list_distinct(list_concat(['.'], list_transform(range(1, len({parts})), lambda i: array_to_string({parts}[1:i], '/'))))"


def _date(keys: tuple[str, ...]) -> str:
    return "coalesce(" + ", ".join(f"max(case when key = '{k}' and not is_list then try_cast(\"values\"[1] as timestamp) end)" for k in keys) + ")"


_TAGS_OF = "list_filter(list_transform(case when is_list then \"values\" else string_split(\"values\"[1], ',') end, lambda x: lower(" + _sub(_trim("x"), "^#", "") + ")), lambda x: x <> '')"

_DOCS = f"""
{_TEXTS}, {_FENCES}, {_YAML},
dated as (select doc_id, {_date(("created", "created_at", "date"))} as fm_created, {_date(("modified", "updated", "updated_at"))} as fm_modified, max(case when key = 'tags' then {_TAGS_OF} end) as fm_tags from yaml group by 1),
located as (
  select p.doc_id as n, lower(coalesce(source, 'loose')) || '/' || lower(coalesce(lang, 'xx')) || '/doc-' || p.doc_id || '.md' as relative_path, body, fm_tags,
    coalesce(fm_created, timestamp '2024-01-01' + to_days(cast(p.doc_id % 720 as integer))) as created_at,
    coalesce(fm_modified, timestamp '2024-01-01' + to_days(cast(p.doc_id % 720 + p.doc_id % 30 as integer))) as modified_at
  from parts p left join dated d on d.doc_id = p.doc_id),
docs as (
  select n, relative_path, rtrim(replace(replace(to_base64(encode(relative_path)), '+', '-'), '/', '_'), '=') as doc_id, body, {_title("'doc-' || n || '.md'")} as title, created_at, modified_at,
    len({_words(_strip("body"))}) as word_count,
    list_sort(list_distinct(list_concat(
      list_transform(list_concat(coalesce(fm_tags, []), {_INLINE}), lambda t: 'tag:' || lower({_sub(_sub(_trim("t"), _WS + "+", " "), "^#", "")})),
      list_transform({_LINKS}, lambda t: 'link:' || t),
      list_transform({_folders("relative_path")}, lambda t: 'folder:' || t)))) as entities
  from located),
kept_docs as materialized (select * from docs where word_count > 0),
worded as (select *, {_words("body")} as words from kept_docs),
chunks as materialized (select doc_id || ':' || ordinal as chunk_id, doc_id, relative_path, title, created_at, modified_at, entities, ordinal, content, {_tokens("title || ' ' || content")} as tokens from worded, lateral {_windows("words")} w)
"""
_IDF = """
df as (select term, count(*) as df from (select distinct chunk_id, unnest(tokens) as term from chunks) group by 1),
idf as materialized (select term, df, ln(((select greatest(1, count(*)) from chunks) + 1) / (df + 1)::double) + 1 as idf from df),
most as (select coalesce(max(idf), 1) as top from idf)
"""


def _tfidf(name: str, source: str, key: str) -> str:
    """CTEs that end in ``name`` (key, term, weight) of ``source`` (key, tokens)."""
    return f"""
{name}_n as (select {key}, term, count(*) as tf from (select {key}, unnest(tokens) as term from {source}) group by 1, 2),
{name}_w as (select {key}, n.term, (1 + ln(tf)) * coalesce(idf, (select top from most)) as w from {name}_n n left join idf using (term)),
{name} as materialized (select {key}, term, w / sqrt(sum(w * w) over (partition by {key})) as weight from {name}_w)
"""


def _hashed(name: str, source: str, key: str) -> str:
    """CTEs that end in ``name`` (key, slot, value), the places of a hashed vector that aren't 0."""
    return f"""
{name}_t as (select {key}, ('0x' || substr(sha256(term), 1, 8))::bigint % 384 as slot, case when ('0x' || substr(sha256(term), 10, 1))::int % 2 = 0 then 1 else -1 end as sign from (select {key}, unnest(tokens) as term from {source})),
{name}_s as (select {key}, slot, sum(sign)::double as v from {name}_t group by 1, 2),
{name} as materialized (select {key}, slot, v / sqrt(sum(v * v) over (partition by {key})) as value from {name}_s where v <> 0)
"""


_VECTORS = _tfidf("chunk_terms", "chunks", "chunk_id") + "," + _hashed("chunk_dense", "chunks", "chunk_id")
_AGE = "greatest(0, epoch_us(timestamp '{as_of}') - epoch_us({d})) / 8.64e10"


def _age(d: str, as_of: str = AS_OF) -> str:
    return "(" + _AGE.format(as_of=as_of, d=d) + ")"


def _trend(recent: str, previous: str, freshest: str) -> str:
    return f"case when {freshest} is null then 'stable' when {recent} >= greatest(2, {previous} * 1.35) then 'rising' when {freshest} <= 120 then 'active' when {freshest} > 365 then 'dormant' else 'stable' end"


def _activity(d: str, as_of: str = AS_OF) -> str:
    age = _age(d, as_of)
    recent, previous = f"count(*) filter ({age} <= 90)", f"count(*) filter ({age} > 90 and {age} <= 365)"
    return f"count(*) as n, count(*) filter ({age} <= 365) as frequency12m, min({d}) as first_seen, max({d}) as last_seen, {_trend(recent, previous, f'min({age})')} as trend"


_SUMMARY = f"""
doc_entities as (select unnest(entities) as entity_id, created_at, relative_path from kept_docs),
chunk_entities as materialized (select unnest(entities) as entity_id, chunk_id, content, created_at, relative_path, ordinal from chunks),
summary as (
  select entity_id, split_part(entity_id, ':', 1) as entity_type, substr(entity_id, instr(entity_id, ':') + 1) as name, n, coalesce(chunk_count, 0) as chunk_count, frequency12m, first_seen, last_seen, trend, first_path,
    n * 2 + coalesce(chunk_count, 0) + frequency12m * 1.5 + exp(-ln(2) * {_age("last_seen")} / 180) * 2 as score
  from (select entity_id, {_activity("created_at")}, min(relative_path) as first_path from doc_entities group by 1) left join (select entity_id, count(*) as chunk_count from chunk_entities group by 1) using (entity_id)),
top_entities as materialized (select *, row_number() over (order by round(score, 9) desc, first_path, entity_id) - 1 as entity_pos from summary qualify entity_pos < 48)
"""


def _ordered(term: str = "term") -> str:
    return f"list({term} order by rank)"


_TERMS = f"""
entity_tokens as materialized (select entity_id, {_tokens("content")} as tokens, {_tokens("content", False)} as plain from chunk_entities semi join top_entities using (entity_id)),
entity_counts as materialized (select entity_id, term, count(*) as tf from (select entity_id, unnest(tokens) as term from entity_tokens) group by 1, 2),
heavy as (select entity_id, {_ordered()} as top_terms from (select *, row_number() over (partition by entity_id order by tf * coalesce(idf, 1) desc, term) as rank from entity_counts left join idf using (term) qualify rank <= 12) group by 1),
frequent as (select entity_id, {_ordered()} as words from (select *, row_number() over (partition by entity_id order by tf desc, term) as rank from entity_counts qualify rank <= 12) group by 1),
runs as (select entity_id, unnest(list_concat(list_transform(range(1, len(plain)), lambda i: array_to_string(plain[i:i + 1], ' ')), list_transform(range(1, len(plain) - 1), lambda i: array_to_string(plain[i:i + 2], ' ')))) as term from entity_tokens),
run_counts as (select entity_id, term, count(*) as tf from runs where length(term) > 4 group by 1, 2),
phrases as (select entity_id, {_ordered()} as phrases from (select *, row_number() over (partition by entity_id order by tf desc, term) as rank from run_counts qualify rank <= 6) group by 1),
all_terms as (select entity_id, list_concat(coalesce(top_terms, []), list_transform(coalesce(phrases, []), lambda p: replace(p, ' ', '_')), coalesce(words, [])) as a, coalesce(top_terms, []) as top_terms
  from top_entities left join heavy using (entity_id) left join phrases using (entity_id) left join frequent using (entity_id)),
picked as materialized (select entity_id, list_filter(a, lambda x, i: list_position(a, x) = i)[1:10] as terms, top_terms from all_terms)
"""


def _quarter(d: str) -> str:
    return f"year({d}) || ' Q' || quarter({d})"


def _one_term(which: str, order: str) -> str:
    return f"""
{which} as (select entity_id, {_tokens("content")} as tokens from (select *, row_number() over (partition by entity_id order by {order}) as r from chunk_entities semi join top_entities using (entity_id)) where r = 1),
{which}_term as (select entity_id, term as {which}_term from (select entity_id, term, count(*) as tf from (select entity_id, unnest(tokens) as term from {which}) group by 1, 2) qualify row_number() over (partition by entity_id order by tf desc, term) = 1)
"""


_SHOWN = "case entity_type when 'tag' then '#' || name when 'link' then '[[' || name || ']]' else case when name = '.' then 'root folder' when name <> '' then 'folder:' || name else 'folder:.' end end"
_PROBES = f"""
{_one_term("early", "created_at, relative_path, ordinal")}, {_one_term("recent", "created_at desc, relative_path desc, ordinal desc")},
filled as (
  select entity_id, entity_pos, entity_type, name, {_SHOWN} as shown, terms, chunk_count,
    replace(coalesce(terms[1], 'this thread'), '_', ' ') as a, replace(coalesce(terms[2], 'nearby ideas'), '_', ' ') as b, replace(coalesce(terms[3], 'older context'), '_', ' ') as c, replace(coalesce(terms[4], 'new evidence'), '_', ' ') as d,
    early_term, recent_term, case when {_quarter("first_seen")} = {_quarter("last_seen")} then {_quarter("first_seen")} else {_quarter("first_seen")} || ' to ' || {_quarter("last_seen")} end as era
  from top_entities join picked using (entity_id) left join early_term using (entity_id) left join recent_term using (entity_id) where chunk_count > 0),
scoped as (select *, case entity_type when 'folder' then shown else 'the ' || shown || ' material' end as scope, case when chunk_count > 1 then replace(coalesce(early_term, a), '_', ' ') else a end as early_t, case when chunk_count > 1 then replace(coalesce(recent_term, b), '_', ' ') else b end as recent_t from filled),
asked as (select *, [
    'What keeps connecting ' || a || ' with ' || b || ' across ' || scope || '?',
    'Where does ' || scope || ' show tension between ' || a || ' and ' || c || '?',
    'How did ' || scope || ' shift from ' || early_t || ' toward ' || recent_t || ' during ' || era || '?',
    'Which older notes about ' || c || ' still matter when ' || d || ' appears?'] as texts from scoped),
probes as materialized (
  select 'cat_' || substr(sha1(entity_id || {_NL} || x.text), 1, 12) as probe_id, entity_id, entity_pos, x.i as ordinal, era, array_to_string(terms[1:5], ' / ') as context, x.text as text, array_to_string(terms, ' ') as terms,
    {_tokens("shown || ' ' || x.text || ' ' || array_to_string(terms, ' ')")} as tokens, {_tokens(_quoted(QUERY_PREFIX) + " || name || ' ' || x.text || ' ' || array_to_string(terms, ' ')")} as dense_tokens
  from asked, unnest(list_filter(texts, lambda t, i: list_position(texts, t) = i)) with ordinality x(text, i))
"""
_PROBE_VECTORS = _tfidf("probe_terms", "probes", "probe_id") + "," + _hashed("probe_dense", "(select probe_id, dense_tokens as tokens from probes)", "probe_id")


def _links(chunks: str, terms: str, dense: str, limit: int, restricted: bool) -> str:
    """CTE links (probe_id, chunk_id, score, rank); without a dense score the sparse one counts."""
    inside = "where list_contains(c.entities, p.entity_id)" if restricted else ""
    return f"""
dense_pairs as (select p.probe_id, c.chunk_id, sum(p.value * c.value) as dense from (select * from probe_dense join (select probe_id, entity_id from probes) using (probe_id)) p
  join (select * from {dense} join (select chunk_id, entities from {chunks}) using (chunk_id)) c on p.slot = c.slot {inside} group by 1, 2),
sparse_pairs as (select p.probe_id, c.chunk_id, sum(p.weight * c.weight) as sparse from (select * from probe_terms join (select probe_id, entity_id from probes) using (probe_id)) p
  join (select * from {terms} join (select chunk_id, entities from {chunks}) using (chunk_id)) c on p.term = c.term {inside} group by 1, 2),
scored_pairs as (select probe_id, chunk_id, round(case when coalesce(abs(dense), 0) > 1e-12 then dense else sparse end, 12) as score from dense_pairs full join sparse_pairs using (probe_id, chunk_id)),
links as materialized (select probe_id, s.chunk_id, score, row_number() over (partition by probe_id order by score desc, relative_path, ordinal) as rank from scored_pairs s join {chunks} c on c.chunk_id = s.chunk_id where score > 0 qualify rank <= {limit})
"""


_QUERY = f"""
asked_query as (select 0 as k, {_tokens(_quoted(QUESTION))} as tokens), asked_dense as (select 0 as k, {_tokens(_quoted(QUERY_PREFIX + QUESTION))} as tokens),
{_tfidf("query_terms", "asked_query", "k")}, {_hashed("query_dense", "asked_dense", "k")}
"""
_COMBINED = "case when greatest(0, coalesce(dense, 0)) > 1e-12 then dense * 0.84 + greatest(0, coalesce(sparse, 0)) * 0.16 else greatest(0, coalesce(sparse, 0)) end"
_MATCHED = f"""
probe_scores as (select probe_id, entity_id, entity_pos, ordinal, round({_COMBINED}, 12) as score from probes
  left join (select probe_id, sum(p.value * q.value) as dense from probe_dense p join query_dense q using (slot) group by 1) using (probe_id)
  left join (select probe_id, sum(p.weight * q.weight) as sparse from probe_terms p join query_terms q using (term) group by 1) using (probe_id)),
matched as materialized (select *, row_number() over (order by score desc, entity_pos, ordinal) as place from probe_scores where score > 0)
"""


def _found(chunks: str, terms: str, dense: str, limit: int = 8) -> str:
    return f"""
contributions as (select chunk_id, max(greatest(0, l.score * m.score)) as by_probe, list(probe_id order by place)[1:5] as probe_ids from links l join (select * from matched where place <= 10) m using (probe_id) group by 1),
direct_scores as (select chunk_id, {_COMBINED} as direct from (select chunk_id from {chunks})
  left join (select chunk_id, sum(c.value * q.value) as dense from {dense} c join query_dense q using (slot) group by 1) using (chunk_id)
  left join (select chunk_id, sum(c.weight * q.weight) as sparse from {terms} c join query_terms q using (term) group by 1) using (chunk_id)),
fused as (select c.chunk_id, relative_path, title, content, ordinal, coalesce(probe_ids, []) as probe_ids,
    case when direct + coalesce(by_probe, 0) > 0 then direct * 0.72 + coalesce(by_probe, 0) * 0.82 + exp(-ln(2) * {_age("modified_at")} / 180) * 0.03 else 0 end as score
  from {chunks} c join direct_scores using (chunk_id) left join contributions using (chunk_id)),
hits as (select *, row_number() over (order by round(score, 6) desc, relative_path, ordinal) as rank from fused where score > 0 qualify rank <= {limit})
"""


_SNIP = _strip("content")
_SNIPPET = f"case when length({_SNIP}) <= 900 then {_SNIP} else {_trim(f'left({_SNIP}, 899)')} || '...' end"
_BASE = f"with {_DOCS}"
_INDEX = f"{_BASE}, {_IDF}"
_GRAPH = f"{_INDEX}, {_SUMMARY}, {_TERMS}"
_ASKED = f"{_GRAPH}, {_VECTORS}, {_PROBES}, {_PROBE_VECTORS}"
_LINKED = f"{_ASKED}, {_links('chunks', 'chunk_terms', 'chunk_dense', 24, True)}"
_SEARCHED = f"{_LINKED}, {_QUERY}, {_MATCHED}"
_TARGET = f"""
target_texts as (select doc_no as n, max(content) as raw from garden_documents where doc_no is not null and content is not null group by 1),
t_opened as (select *, {_UNIX} as u, (starts_with(raw, '---' || {_NL}) or starts_with(raw, '---' || chr(13) || {_NL})) as opens from target_texts),
target_bodies as (select n, 'garden/note-' || n || '.md' as relative_path, case when opens and instr(substr(u, 5), {_NL} || '---' || {_NL}) > 0 then substr(u, instr(substr(u, 5), {_NL} || '---' || {_NL}) + 9) else raw end as body from t_opened),
target_docs as (select rtrim(replace(replace(to_base64(encode(relative_path)), '+', '-'), '/', '_'), '=') as doc_id, relative_path, {_title("'note-' || n || '.md'")} as title, timestamp '2025-01-01' + to_days(cast(n % 300 as integer)) as modified_at, {_words("body")} as words from target_bodies where len({_words(_strip("body"))}) > 0),
target_chunks as materialized (select doc_id || ':' || ordinal as chunk_id, relative_path, title, modified_at, []::varchar[] as entities, ordinal, content, {_tokens("title || ' ' || content")} as tokens from target_docs, lateral {_windows("words")} w),
{_tfidf("target_terms", "target_chunks", "chunk_id")}, {_hashed("target_dense", "target_chunks", "chunk_id")}
"""
_APPLIED = f"{_ASKED}, {_TARGET}, {_links('target_chunks', 'target_terms', 'target_dense', 32, False)}"


def _by_lang(value: str, count: str, rank: str, rows: str = "") -> str:
    return f"with {_TEXTS}{rows}, counts as (select lang, term, count(*) as tf from ({value}) group by 1, 2) select lang, term, {count}, {rank}"


_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%gZ')"
_LANG_TOKENS = f"tokenized as materialized (select row_number() over () as id, coalesce(lang, '') as lang, {_tokens('raw')} as tokens from texts)"
_LANG_PLAIN = f"tokenized as (select coalesce(lang, '') as lang, {_tokens('raw', False)} as plain from texts)"

_MONTHS = "map(['jan', 'feb', 'mar', 'mär', 'apr', 'may', 'mai', 'jun', 'jul', 'aug', 'sep', 'oct', 'okt', 'nov', 'dec', 'dez'], [1, 2, 3, 3, 4, 5, 5, 6, 7, 8, 9, 10, 10, 11, 12, 12])"
_MINUTES = "map(['z', 'utc', 'gmt', 'wet', 'west', 'bst', 'cet', 'cest', 'eet', 'eest', 'est', 'edt', 'cst', 'cdt', 'mst', 'mdt', 'pst', 'pdt', 'jst'], [0, 0, 0, 0, 60, 60, 60, 120, 120, 180, -300, -240, -360, -300, -420, -360, -480, -420, 540])"
#: The forms of a date: pattern, and what its groups are; o and q are day and month in the order of the vault, n is the name of a month, x what stands for a zone.
_FORMS = [
    (r"^(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)? ?(Z|z|[+-]\d{2}:?\d{2}|[A-Z]{3,4}|\[?[A-Za-z]+/[A-Za-z_]+\]?)?)?$", "y m d h i s f x"),
    (r"^(\d{4})(\d{2})(\d{2})(?:T(\d{2})(\d{2})(\d{2}))?$", "y m d h i s"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})(?: (\d{1,2}):(\d{2})(?::(\d{2}))?(?: (AM|PM))?)?$", "o q y h i s p"),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})(?: (\d{1,2}):(\d{2}))?$", "d m y h i"),
    (r"^(?:[A-Za-z]{3}, )?(\d{1,2}) ([A-Za-z]+) (\d{4}) (\d{2}):(\d{2}):(\d{2}) ([+-]\d{4}|[A-Z]{3,4})$", "d n y h i s x"),
    (r"^([A-Za-z]+) (\d{1,2}), (\d{4})(?: (\d{2}):(\d{2}):(\d{2}))?$", "n d y h i s"),
    (r"^(\d{1,2})\. (\p{L}+) (\d{4}), (\d{2}):(\d{2}) Uhr$", "d n y h i"),
    (r"^(\d{1,2}) ([A-Za-z]+) (\d{4}) at (\d{1,2}):(\d{2})(am|pm)$", "d n y h i p"),
    (r"^(\d{4})-(\d{2})$", "y m"),
]


def _form(pattern: str, groups: str) -> str:
    names = groups.split()
    got = f"regexp_extract(t, {_quoted(pattern)}, [{', '.join(_quoted(n) for n in names)}])"
    number = lambda n, other: f"coalesce(try_cast(g.{n} as int), {other})" if n in names else other
    text = lambda n: f"coalesce(g.{n}, '')" if n in names else "''"
    day, month = number("d", "1"), f"{_MONTHS}[lower(left(g.n, 3))]" if "n" in names else number("m", "1")
    if "o" in names:
        day, month = "try_cast(case when day_order = 'mdy' then g.q else g.o end as int)", "try_cast(case when day_order = 'mdy' then g.o else g.q end as int)"
    return f"select doc_no, field, home, try_cast(g.y as int) as y, {month} as m, {day} as d, {number('h', 'null')} as h, {number('i', '0')} as i, {number('s', '0')} as s, {text('f')} as f, lower({text('p')}) as p, {text('x')} as x from (select *, {got} as g from typed where regexp_matches(t, {_quoted(pattern)}))"


_DATES = f"""
with zero as (select coalesce(max(home_zone), 'UTC') as z, coalesce(max(date_order), 'dmy') as o from vault_configs where vault_id = 0),
own as (select vault_id, max(home_zone) as z, max(date_order) as o from vault_configs group by 1),
fields as (
  select doc_no, vault_id, 'created_at' as field, created_at as v from garden_documents union all select doc_no, vault_id, 'modified_at', modified_at from garden_documents union all
  select doc_no, vault_id, 'frontmatter.' || e.key, e.value.values[1] from (select doc_no, vault_id, unnest(map_entries(frontmatter)) as e from garden_documents) where not e.value.is_list and e.key in ('created', 'created_at', 'date', 'modified', 'updated', 'updated_at')),
typed as (
  select distinct doc_no, field, {_trim("v")} as t, coalesce(own.z, (select z from zero)) as home, coalesce(own.o, (select o from zero)) as day_order from fields left join own using (vault_id)
  where doc_no is not null and v is not null and not regexp_matches(v, '^\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}\\.\\d{{3}}Z$')),
read as ({" union all ".join(_form(*f) for f in _FORMS)}),
timed as (
  select *, try_cast(printf('%04d-%02d-%02d', y, m, d) as date) as day, case when p = '' then coalesce(h, 0) when h between 1 and 12 then h % 12 + case p when 'pm' then 12 else 0 end else 99 end as hour from read),
local as (select *, day + to_hours(hour) + to_minutes(i) + to_seconds(s) + to_milliseconds(cast(left(f || '000', 3) as int)) as moment from timed where day is not null and hour < 24 and i < 60 and s < 60),
zoned as (select *, case when x like '%/%' then trim(x, '[]') when x = '' then case when h is null then 'UTC' else home end end as tz from local),
late as (select *, case when tz is not null then timezone('UTC', timezone(tz, moment)) end as u from zoned),
solved as (
  -- Of two instants with this local time the earlier one.
  select doc_no, field, case when tz is not null then
      case when timezone(tz, timezone('UTC', u - to_hours(1))) = moment then u - to_hours(1) when timezone(tz, timezone('UTC', u - to_minutes(30))) = moment then u - to_minutes(30) else u end
    when regexp_matches(x, '^[+-]') then moment - to_minutes((case left(x, 1) when '-' then -1 else 1 end) * (cast(substr(x, 2, 2) as int) * 60 + cast(right(x, 2) as int)))
    else moment - to_minutes({_MINUTES}[lower(x)]) end as utc from late
  union all select doc_no, field, make_timestamp(case length(t) when 10 then try_cast(t as bigint) * 1000000 when 13 then try_cast(t as bigint) * 1000 else try_cast(t as bigint) end) from typed where regexp_matches(t, '^(\\d{{10}}|\\d{{13}}|\\d{{16}})$'))
select doc_no, field, min(strftime(utc, '%Y-%m-%dT%H:%M:%S.%gZ')) as utc from solved where utc is not null group by 1, 2
"""

SQL: dict[str, str] = {
    "p3_found": _DATES,
    "strip_markdown": f"with {_TEXTS} select doc_id, {_strip('raw')} as stripped from texts",
    "word_count": f"with {_TEXTS} select doc_id, len({_words('raw')}) as words, len({_words(_strip('raw'))}) as word_count from texts",
    "snippets": f"with {_TEXTS} select doc_id, {_SNIPPET.replace('content', 'raw')} as snippet from texts",
    "chunk_windows": f"with {_TEXTS}, worded as (select doc_id, {_words('raw')} as words from texts) select doc_id, ordinal, content from worded, lateral {_windows('words')} w",
    "tokenize_terms": f"with {_TEXTS} select doc_id, array_to_string({_tokens('raw')}, ' ') as tokens from texts",
    "tokenize_no_alias": f"with {_TEXTS} select doc_id, array_to_string({_tokens('raw', False)}, ' ') as tokens from texts",
    "stem_terms": f"with {_TEXTS}, words as (select distinct unnest(string_split({_sub('lower(raw)', '[^a-z0-9]+', ' ')}, ' ')) as word from texts) select word, {_stem('word')} as stem from words where word <> ''",
    "frontmatter": f"with {_TEXTS}, {_FENCES} select doc_id, block, length(body) as body_chars from parts where block is not null",
    "frontmatter_values": f"with {_TEXTS}, {_FENCES}, {_YAML} select doc_id, key, is_list, array_to_string(\"values\", '|') as joined from yaml",
    "titles": f"with {_TEXTS}, {_FENCES} select doc_id, {_title(chr(39) + 'doc-' + chr(39) + ' || doc_id || ' + chr(39) + '.md' + chr(39))} as title from parts",
    "inline_tags": f"with {_TEXTS}, {_FENCES} select distinct doc_id, unnest({_INLINE}) as tag from parts",
    "wiki_links": f"with {_TEXTS}, {_FENCES} select distinct doc_id, unnest({_LINKS}) as link from parts",
    "folder_ancestors": f"select doc_no, unnest({_folders('relative_path')}) as folder from (select distinct doc_no, relative_path from garden_documents where relative_path is not null)",
    "stable_ids": "select doc_no, rtrim(replace(replace(to_base64(encode(relative_path)), '+', '-'), '/', '_'), '=') as doc_id, substr(sha1(relative_path), 1, 12) as target_id from (select distinct doc_no, relative_path from garden_documents where relative_path is not null)",
    "entity_names": f"select *, {_SHOWN} as shown from (select distinct entity_no, split_part(entity_id, ':', 1) as entity_type, substr(entity_id, instr(entity_id, ':') + 1) as name from entity_summaries where entity_id is not null)",
    "corpus_documents": f"{_BASE} select relative_path, doc_id, title, word_count, array_to_string(entities, '|') as entities, {_ISO.format('created_at')} as created, {_ISO.format('modified_at')} as modified from kept_docs",
    "entity_ids": f"{_BASE} select doc_id, unnest(entities) as entity_id from kept_docs",
    "corpus_stats": f"{_GRAPH}, {_PROBES} select (select count(*) from kept_docs) as documents, (select count(*) from chunks) as chunks, (select count(*) from top_entities) as entities, (select count(*) from probes) as probes",
    "doc_frequency_idf": f"{_INDEX} select term, df, round(idf, 9) as idf from idf",
    "tfidf_weights": f"{_INDEX}, {_tfidf('chunk_terms', 'chunks', 'chunk_id')} select chunk_id, term, round(weight, 9) as weight from chunk_terms",
    "sparse_cosine_topk": f"{_INDEX}, {_tfidf('chunk_terms', 'chunks', 'chunk_id')}, asked_query as (select 0 as k, {_tokens(_quoted(QUESTION))} as tokens), {_tfidf('query_terms', 'asked_query', 'k')} select chunk_id, round(sum(c.weight * q.weight), 9) as score from chunk_terms c join query_terms q using (term) group by 1 order by score desc, chunk_id limit 10",
    "top_terms_by_lang": _by_lang("select lang, unnest(tokens) as term from tokenized", "tf", "row_number() over (partition by lang order by tf desc, term) as rank from counts qualify rank <= 8", f", {_LANG_TOKENS}"),
    "top_phrases_by_lang": _by_lang(
        "select * from (select lang, unnest(list_concat(list_transform(range(1, len(plain)), lambda i: array_to_string(plain[i:i + 1], ' ')), list_transform(range(1, len(plain) - 1), lambda i: array_to_string(plain[i:i + 2], ' ')))) as term from tokenized) where length(term) > 4",
        "tf", "row_number() over (partition by lang order by tf desc, term) as rank from counts qualify rank <= 8", f", {_LANG_PLAIN}",
    ),
    "weighted_terms_by_lang": _by_lang(
        "select lang, unnest(tokens) as term from tokenized", "round(tf * coalesce(idf, 1), 6) as score", "row_number() over (partition by lang order by tf * coalesce(idf, 1) desc, term) as rank from counts left join idf using (term) qualify rank <= 12",
        f", {_LANG_TOKENS}, df as (select term, count(*) as df from (select distinct id, unnest(tokens) as term from tokenized) group by 1), idf as (select term, ln(((select greatest(1, count(*)) from tokenized) + 1) / (df + 1)::double) + 1 as idf from df)",
    ),
    "hash_buckets": f"with {_TEXTS}, terms as (select distinct unnest({_tokens('raw')}) as term from texts) select term, ('0x' || substr(sha256(term), 1, 8))::bigint % 384 as slot, case when ('0x' || substr(sha256(term), 10, 1))::int % 2 = 0 then 1 else -1 end::bigint as sign from terms",
    "hash_embedding_nonzero": f"{_BASE}, {_hashed('chunk_dense', 'chunks', 'chunk_id')} select chunk_id, slot, round(value, 9) as value from chunk_dense",
    "dense_cosine_topk": "with a as (select embedding::double[] as e from embeddings order by vec_id limit 1) select vec_id, round(list_cosine_similarity(embedding::double[], (select e from a)), 9) as score from embeddings where vec_id <> (select min(vec_id) from embeddings) order by score desc, vec_id limit 10",
    "dense_knn_per_vector": "select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from (select q.vec_id as query_id, e.vec_id, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 9) as score from embeddings q join embeddings e on q.vec_id <> e.vec_id where q.vec_id % 20 = 0) where score > 0 qualify rank <= 5",
    "recency_score": f"select event_id, round({_age('ts', '2024-04-15')}, 6) as age, round(exp(-ln(2) * {_age('ts', '2024-04-15')} / 180), 9) as recency from events",
    "quarter_label": f"select o_custkey, {_quarter('a')} as first_quarter, case when {_quarter('a')} = {_quarter('b')} then {_quarter('a')} else {_quarter('a')} || ' to ' || {_quarter('b')} end as era from (select o_custkey, min(o_orderdate) as a, max(o_orderdate) as b from orders group by 1)",
    "activity_trend": " union all ".join(f"select user_id, '{at}' as as_of, trend, frequency12m from (select user_id, {_activity('ts', at)} from events group by 1)" for at in ("2024-04-15 00:00:00", "2024-08-01 00:00:00", "2025-06-01 00:00:00")),
    "freq_last_year": f"select o_custkey, frequency12m, trend, n as orders from (select o_custkey, {_activity('o_orderdate', '1998-08-01')} from orders group by 1)",
    "entity_summary": f"{_BASE}, {_SUMMARY} select entity_id, entity_type, name, n as document_count, chunk_count, frequency12m, {_ISO.format('first_seen')} as first_seen, {_ISO.format('last_seen')} as last_seen, trend as activity_trend, round(score, 6) as score from summary",
    "entity_topk": f"{_GRAPH} select entity_pos, entity_id, round(score, 6) as score, array_to_string(top_terms, ' ') as top_terms from top_entities join picked using (entity_id)",
    "entity_probes": f"{_GRAPH}, {_PROBES} select entity_id, row_number() over (partition by entity_id order by ordinal) - 1 as pos, probe_id from probes",
    "top_vector_terms": f"{_INDEX}, {_tfidf('chunk_terms', 'chunks', 'chunk_id')} select chunk_id, term, round(weight, 9) as weight, row_number() over (partition by chunk_id order by round(weight, 9) desc, term) as rank from chunk_terms qualify rank <= 5",
    "hydrate_entities": "select distinct catalyst_no, case when catalyst_no % 2 = 0 or coalesce(entity_name, '') = '' then substr(entity_id, instr(entity_id, ':') + 1) else entity_name end as entity_name, case when catalyst_no % 2 = 0 or coalesce(entity_type, '') = '' then split_part(entity_id, ':', 1) else entity_type end as entity_type from catalysts where entity_id is not null",
    "probe_questions": f"{_GRAPH}, {_PROBES} select probe_id, entity_id, era, context, text, terms from probes",
    "probe_links": f"{_LINKED} select probe_id, chunk_id, rank, round(score, 6) as score from links",
    "probe_ranking": f"{_SEARCHED} select place as rank, probe_id, round(score, 6) as score from matched where place <= 5",
    "search_fused": f"{_SEARCHED}, {_found('chunks', 'chunk_terms', 'chunk_dense')} select rank, chunk_id, array_to_string(probe_ids, ' ') as probe_ids, {_SNIPPET} as content, relative_path, round(score, 6) as score, title from hits",
    "graph_all": f"{_GRAPH}, {_PROBES} select probe_id, entity_id, text from probes order by entity_pos, ordinal limit 24",
    "graph_query": f"{_ASKED}, {_QUERY}, {_MATCHED}, near as (select * from matched where place <= 20) select 'probe' as what, probe_id as id from (select * from probes semi join near using (probe_id) order by entity_pos, ordinal limit 20) union all select 'entity', entity_id from (select * from top_entities semi join near using (entity_id) order by entity_pos limit 12)",
    "apply_target": f"{_APPLIED} select probe_id, chunk_id, rank, round(score, 6) as score from links",
    "apply_search": f"{_APPLIED}, {_QUERY}, {_MATCHED}, {_found('target_chunks', 'target_terms', 'target_dense')} select rank, chunk_id, relative_path, round(score, 6) as score, title from hits",
    "stored_links": f"{_LINKED} select probe_id, chunk_id, rank, round(score, 6) as score from links",
    "stored_search": f"{_SEARCHED}, {_found('chunks', 'chunk_terms', 'chunk_dense')} select rank, chunk_id, relative_path, round(score, 6) as score, title from hits",
    "answer_json": f"{_SEARCHED}, {_found('chunks', 'chunk_terms', 'chunk_dense')} select rank, relative_path as path, round(score, 6) as score, title from hits",
    "answer_json_probes": f"{_SEARCHED} select place as rank, probe_id, round(score, 6) as score from matched where place <= 5",
    "answer_lines": f"{_SEARCHED}, {_found('chunks', 'chunk_terms', 'chunk_dense')} select rank, rank || '. ' || title || ' (' || relative_path || ')' as line from hits",
    "vault_settings": "with zero as (select * from vault_configs where vault_id = 0) select v.vault_id, "
    + ", ".join(f"coalesce(v.{k}, (select {k} from zero), {n})::bigint as {k}" for k, n in (("chunk_size_words", 260), ("chunk_overlap_words", 48), ("max_files", 1024), ("max_results", 8)))
    + " from vault_configs v where v.vault_id is not null",
    "target_resolution": "with p as (select distinct vault_path as path from vault_configs where vault_path is not null) select unnest([path, substr(sha1(path), 1, 12), string_split(path, '/')[-1]]) as wanted, path from p",
    "target_upsert": "select row_number() over (order by lower(path), path) - 1 as pos, substr(sha1(path), 1, 12) as id, path, doc_count from (values ('/a/Notes', 2::bigint), ('/b/notes', 3::bigint)) t(path, doc_count)",
}
