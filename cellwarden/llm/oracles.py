"""DuckDB SQL for the queries that SQL can express, written without the operators' methods."""

from __future__ import annotations

import string

LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
WORDS = f"list_filter(string_split_regex({LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def component_cte(docs: str, name: str = "component") -> str:
    """CTEs that end in ``name`` (doc_id, n_shingles, component_id) for the rows of ``docs``."""
    return f"""
words as (select doc_id, {WORDS} as w from {docs}),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) end as s from words
),
grams as (select doc_id, len(s) as n, unnest(s) as g from sets),
links as (
  select a.doc_id as a, b.doc_id as b from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id having 100 * count(*) >= 75 * (max(a.n) + max(b.n) - count(*))
),
reached(a, b) as (select a, b from links union select r.a, l.b from reached r join links l on r.b = l.a),
{name} as (
  select s.doc_id, len(s.s) as n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) as component_id
  from sets s left join reached r on r.a = s.doc_id group by s.doc_id, s.s
)"""


#: Vectors without null or non-finite components, as doubles.
_VECTORS = """
select vec_id, label, cast(embedding as double[]) as v from embeddings
where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"""

TOP_K = f"""
with v as ({_VECTORS}),
w as (select vec_id, list_transform(v, lambda x: floor(256 * x)) as w from v),
scores as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.w, c.w) as bigint) as score
  from w q join w c on q.vec_id <> c.vec_id and len(q.w) = len(c.w) where q.vec_id % 50 = 0
),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scores)
select query_id, cast(rank as int) as rank, vec_id, score from ranked where rank <= 5"""

NEAR_VECTORS = f"""
with recursive v as (select * from ({_VECTORS}) where label is not null and len(list_filter(v, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and len(a.v) = len(b.v) and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.v, b.v) >= 0.93
),
reached(a, b) as (select a, b from links union select r.a, l.b from reached r join links l on r.b = l.a),
counted as (select a, count(*) as n from links group by a),
least_of as (select a, min(b) as b from reached group by a)
select e.vec_id, coalesce(n, 0) as n_links, least(e.vec_id, coalesce(b, e.vec_id)) as component_id,
  e.vec_id = least(e.vec_id, coalesce(b, e.vec_id)) as kept
from embeddings e left join counted c on c.a = e.vec_id left join least_of l on l.a = e.vec_id"""


def _part(column: str) -> str:
    return f"coalesce(strlen(cast({column} as varchar)) || ':' || {column}, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_part, ['doc_id', 'source', 'lang', 'n_chars', text]))})"


def _levels(name: str, group: str, first: str) -> str:
    """All levels of trees as strings of digests: ``group``, lvl, s."""
    above = "array_to_string(list_transform(range(0, (length(s) + 511) // 512), lambda i: sha256(substr(s, i * 512 + 1, 512))), '')"
    return f"{name} as ({first} union all select {group}, lvl + 1, {above} from {name} where length(s) > 64)"


_SIDES = """substr(s, (j // 8) * 512 + 1, (j % 8) * 64) as l, substr(s, j * 64 + 65, (7 - j % 8) * 64) as r"""
#: CRC-32 of the bytes of a short text, bit by bit.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::ubigint)),
  lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0]::ubigint[], lambda x, y: case when x % 2 = 1 then xor(x // 2, 3988292384::ubigint) else x // 2 end)), 4294967295::ubigint)"""

MERKLE = f"""
with recursive leaves as (
  select doc_id, lang, {_leaf("text")} as leaf,
    case when {_CRC32} % 3 = 0 then {_leaf(f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")} end as tampered
  from documents
),
numbered as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as spot from leaves),
{_levels("levels", "lang", "select lang, 0 as lvl, string_agg(leaf, '' order by spot) as s from numbered group by lang")},
subroots as (select lang, s as subroot, row_number() over (order by lang nulls first) - 1 as place from levels where length(s) = 64),
{_levels("tops", "one", "select 1 as one, 0 as lvl, string_agg(subroot, '' order by place) as s from subroots")},
steps as (
  select doc_id, n.lang, spot, lvl, {_SIDES}
  from (select n.*, t.lvl, t.s, n.spot // cast(pow(8, t.lvl) as bigint) as j from numbered n join levels t on n.lang is not distinct from t.lang and length(t.s) > 64) n
  union all
  select doc_id, n.lang, spot, 100 + lvl, {_SIDES}
  from (select n.*, t.lvl, t.s, r.place // cast(pow(8, t.lvl) as bigint) as j
        from numbered n join subroots r on n.lang is not distinct from r.lang join tops t on length(t.s) > 64) n
),
proofs as (select lang, spot, list(l || '|' || r order by lvl) as p, string_agg(l || r, '' order by lvl) as siblings from steps group by lang, spot),
checked as (
  select n.doc_id, n.leaf, r.subroot, t.s as root, sha256(coalesce(p.siblings, '')) as proof_sha256,
    list_reduce(list_prepend(coalesce(n.tampered, n.leaf), coalesce(p.p, [])), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) as folded_root
  from numbered n join subroots r on n.lang is not distinct from r.lang join tops t on length(t.s) = 64
  left join proofs p on p.lang is not distinct from n.lang and p.spot = n.spot
)
select *, folded_root = root as verified from checked"""

_DRAW = "('0x' || substr(sha256('1:' || coalesce(cast(doc_id as varchar), '')), {at}, 8))::bigint"

FILL_MIDDLE = f"""
with u as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as units,
    {_DRAW.format(at=1)} as h1, {_DRAW.format(at=9)} as h2, {_DRAW.format(at=17)} as h3, {_DRAW.format(at=25)} as h4
  from documents
),
c as (select *, len(units) as n, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b from u),
p as (
  select doc_id, t, n, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
      when h4 % 100 < 20 then 'spm' else 'psm' end as form,
    coalesce(array_to_string(list_slice(units, 1, a), ''), '') as prefix, coalesce(array_to_string(list_slice(units, a + 1, b), ''), '') as middle,
    coalesce(array_to_string(list_slice(units, b + 1, n), ''), '') as suffix
  from c
)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then length(prefix) end as prefix_chars,
  case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(t) as restored_sha256
from p"""

ORACLES = {
    "op2_exact_topk": TOP_K,
    "op9_ngram_jaccard_join": f"with recursive {component_cte('documents')} select * from component",
    "op10_embedding_near_dedup": NEAR_VECTORS,
    "op12_merkle_manifest": MERKLE,
    "op13_fill_middle": FILL_MIDDLE,
}
