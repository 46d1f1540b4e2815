"""The same results in SQL, where SQL can express them."""

from __future__ import annotations

from .secrets import FIRST_WEAK, KINDS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATE = f"""
with d as (select row_number() over () as row, doc_id, {_WORDS} as w from documents),
i as (select coalesce(cast(item_id as varchar), 'null') as item, {_WORDS} as w from benchmark),
win as (select distinct item, least(10, len(w)) as n, array_to_string(list_slice(w, k, k + least(10, len(w)) - 1), ' ') as gram from (select *, unnest(generate_series(1, greatest(1, len(w) - 9))) as k from i where len(w) > 0)),
sizes as (select distinct n from win),
grams as (select row, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') as gram from (select row, w, n, unnest(generate_series(1, len(w) - n + 1)) as k from d, sizes where len(w) >= n)),
hits as (select g.row, g.k, g.n, win.item from grams g join win on g.gram = win.gram and g.n = win.n),
h as (select row, count(distinct p) as n_hit from (select row, unnest(generate_series(k, k + n - 1)) as p from hits) group by row),
t as (select row, count(distinct item) as n_items, array_to_string(list_sort(list(distinct item)), ',') as items from hits group by row),
p as (select row, unnest(w) as word, unnest(generate_series(1, len(w))) as place from d),
u as (select n, gram, row_number() over () as u, string_split(gram, ' ') as ws from (select distinct n, gram from win)),
j as (select u, n, unnest(ws) as word, unnest(generate_series(1, n)) as j from u),
rare as (select u, arg_min(j.word, (coalesce(c, 0), j)) as word, arg_min(j, (coalesce(c, 0), j)) as j from j left join (select word, count(*) as c from p group by word) f on j.word = f.word group by u),
starts as (select distinct p.row, rare.u, p.place - rare.j + 1 + s as start from rare join p on rare.word = p.word, (select unnest(generate_series(-2, 2)) as s)),
near as (select starts.row, starts.u from starts join d on starts.row = d.row join j on starts.u = j.u group by starts.row, starts.u, start
  having bool_and(start + j.j + 1 >= 1 and list_contains(list_slice(w, greatest(1, start + j.j - 3), greatest(1, start + j.j + 1)), j.word))),
q as (select near.row, count(distinct item) as n_items, array_to_string(list_sort(list(distinct item)), ',') as items from near join u on near.u = u.u join win on u.gram = win.gram and u.n = win.n group by near.row)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(t.n_items, 0) as n_items, sha256(coalesce(t.items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated,
coalesce(q.n_items, 0) as n_near_items, sha256(coalesce(q.items, '')) as near_items_sha256
from d left join h on d.row = h.row left join t on d.row = t.row left join q on d.row = q.row
"""

WARC = """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n from pages), f as (select *, min(page_id) over (partition by html) as first_id from p)
select page_id, cast(n as bigint) as payload_bytes, sha256(html) as payload_digest, case when n >= 100 and first_id < page_id then 'revisit' else 'response' end as record_type,
case when n >= 100 and first_id < page_id then first_id end as refers_to from f
"""


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def secrets(scope: int = 200) -> str:
    parts = []
    for n, k in enumerate(KINDS):
        p = _literal(k.pattern)
        value = f"regexp_extract(m, {p}, {k.group})" if k.group else "m"
        also = "".join(f" and regexp_matches(m, {_literal(a)})" for a in k.also)
        parts.append(
            f"select row, {n} as kind, i, length(piece) as gap, length(m) as size, length({value}) >= {k.least}{also} as ok from "
            f"(select row, unnest(ms) as m, unnest(list_slice(ps, 1, len(ms))) as piece, unnest(generate_series(1, len(ms))) as i from (select row, regexp_extract_all(text, {p}) as ms, string_split_regex(text, {p}) as ps from d) where len(ms) > 0)"
        )
    listed = lambda role: ", ".join(str(n) for n, k in enumerate(KINDS) if k.role == role)
    near = lambda role, t, also="": f"exists (select 1 from {t} o where o.row = {t}.row and o.kind in ({listed(role)}){also} and (o.e between {t}.s - {scope} and {t}.s or o.s between {t}.e and {t}.e + {scope}))"
    covered = f"exists (select 1 from b o where o.row = b.row and o.kind < {FIRST_WEAK} and o.s < b.e and o.e > b.s)"
    names = "[" + ", ".join(f"'{k.name}'" for k in KINDS) + "]"
    counts = ", ".join(f"count(case when kind = {n} then 1 end) as n_{k.name}" for n, k in enumerate(KINDS) if not k.weak)
    return f"""
with d as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents), m as ({" union all ".join(parts)}),
a as (select row, kind, ok, size, sum(gap + size) over (partition by row, kind order by i) as e from m),
b as (select row, kind, cast(e - size as bigint) as s, cast(e as bigint) as e from a where ok),
n as (select *, {near("identifier", "b")} as near_identifier, {near("secret", "b")} as near_secret, {covered} as covered from b),
c as (select *, {near("identifier", "n", " and o.near_secret")} and {near("secret", "n", " and o.near_identifier")} as near_both from n),
r as (select row, kind, s, e, list_extract({names}, kind + 1) || ':' || s || ':' || e as span from c where kind < {FIRST_WEAK} or (not covered and
    case when kind in ({listed("identifier")}) then near_secret when kind in ({listed("secret")}) then near_identifier else near_both end)),
g as (select row, {counts}, coalesce(string_agg(case when kind < {FIRST_WEAK} then span end, ',' order by s, kind, e), '') as base, string_agg(span, ',' order by s, kind, e) as spans, count(case when kind >= {FIRST_WEAK} then 1 end) as n_linked from r group by row)
select d.doc_id, {", ".join(f"coalesce(n_{k.name}, 0) as n_{k.name}" for k in KINDS if not k.weak)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_linked, 0) as n_linked from d left join g on d.row = g.row
"""


SQL = {"op2_decontaminate": DECONTAMINATE, "op3_secret_links": secrets(), "op7_warc_salvage": WARC}
