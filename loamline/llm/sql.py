"""The same queries in SQL, where SQL can say them."""

from __future__ import annotations

_SPACE = r"[\t\n\x{0B}\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _stripped(column: str) -> str:
    s = column
    for pattern, instead in (
        (r"(?s)```.*?```", " "),
        (r"`([^`]+)`", r"\1"),
        (r"!\[[^\]]*\]\([^)]*\)", " "),
        (r"\[([^\]]+)\]\([^)]*\)", r"\1"),
        (r"\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|([^\]]+))?\]\]", r"\2 \1"),
        (r"(^|[\n\r\x{2028}\x{2029}])#{1,6}" + _SPACE + "+", r"\1"),
        (r"[*_~>|-]+", " "),
        (_SPACE + "+", " "),
    ):
        s = f"regexp_replace({s}, '{pattern}', '{instead}', 'g')"
    return f"trim({s})"


_TOP = """
with newest as (
  select link_no, entity_id, chunk_no, score from (
    select *, row_number() over (partition by link_no order by coalesce(rev, -2147483648) desc, scored_at desc nulls last, score desc) as n from catalyst_links where link_no is not null
  ) where n = 1
), ranked as (
  select *, row_number() over (partition by entity_id order by score desc, chunk_no, link_no) as rank
  from newest where score > 0 and not isnan(score) and entity_id is not null and chunk_no is not null
)
"""

SQL = {
    "p1_found": f"""
with zero as (select max(chunk_size_words) as size from vault_configs where vault_id = 0),
words as (select doc_no, vault_id, len(list_filter(string_split({_stripped("coalesce(content, '')")}, ' '), lambda w: w <> '')) as n from garden_documents)
select distinct doc_no from words left join (select vault_id, max(chunk_size_words) as size from vault_configs group by vault_id) v using (vault_id)
where doc_no is not null and n > greatest(1, coalesce(v.size, (select size from zero), 260))
""",
    "p2_found": """
with rows as (select chunk_no as n, embedding as e from garden_chunks union select catalyst_no, embedding from catalysts),
usable as (select n, list_transform(max(e), lambda x: x::double) as e from rows where n is not null and len(e) = 96 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0 group by 1),
near as (select a.n as a, b.n as b, round(list_cosine_similarity(a.e, b.e), 7) as cosine from usable a join usable b on a.n <> b.n where list_cosine_similarity(a.e, b.e) >= 0.79),
best as (select a, b from near where cosine >= 0.8 qualify row_number() over (partition by a order by cosine desc, b) <= 5)
select distinct least(a, b) as vector_no_a, greatest(a, b) as vector_no_b from best
""",
    "p5_found": _TOP + "select entity_id, link_no from ranked where rank <= 8",
    "p5_ranked": _TOP + "select entity_id, rank, link_no, chunk_no, score from ranked where rank <= 8",
}
