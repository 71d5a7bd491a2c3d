"""SQL that checks the queries of this subpackage."""

from __future__ import annotations


def vector_codes(n_parts: int = 4, n_entries: int = 256, rounds: int = 4) -> str:
    """Codes, errors and codebooks by plain joins, for vectors of one length that ``n_parts`` divides."""
    steps = [
        """kept as (select row_number() over (order by vec_id) - 1 as k, vec_id, label, embedding from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"""comp as (select k, vec_id, label, (i - 1) // w as p, (i - 1) % w as j, x from (select k, vec_id, label, len(embedding) // {n_parts} as w,
            unnest(range(1, len(embedding) + 1)) as i, unnest(list_transform(embedding, lambda x: floor(1024 * x::double)::bigint)) as x from kept))""",
        f"book0 as (select p, k as e, j, x from comp where k < {n_entries})",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""near{r} as (select k, p, arg_min(e, d * {n_entries} + e) as e, min(d) as d from
            (select c.k, c.p, b.e, sum((c.x - b.x) * (c.x - b.x))::bigint as d from comp c join book{r} b on c.p = b.p and c.j = b.j group by all) group by k, p)"""
        )
        if r < rounds:
            steps.append(
                f"""mean{r} as (select p, e, j, (s - ((s % n) + n) % n) // n as x from
                (select n.p, n.e, c.j, sum(c.x)::bigint as s, count(*) as n from near{r} n join comp c on c.k = n.k and c.p = n.p group by all))"""
            )
            steps.append(f"book{r + 1} as (select b.p, b.e, b.j, coalesce(m.x, b.x) as x from book{r} b left join mean{r} m on b.p = m.p and b.e = m.e and b.j = m.j)")
    return f"""with {", ".join(steps)},
        coded as (select k, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' order by p) as code, sum(d)::bigint as error from near{rounds} group by k),
        digest as (select sha256(string_agg(x::varchar, ',' order by p, e, j)) as codebooks_sha256 from book{rounds})
        select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
        from coded join kept using (k) cross join digest"""


#: CRC-32 of a decimal number, digit by digit and bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda ch: ascii(ch)::bigint)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
        lambda v, z: xor(v >> 1, 3988292384::bigint * (v & 1)))), 4294967295::bigint)"""

#: Every prefix of every conversation written out; subtrees by joining each node to all its ancestors.
PREFIX_TRIE = f"""
with t as (select conv_id, coalesce(role, '') as r, coalesce(text, '') as x, row_number() over (partition by conv_id order by turn nulls first) as rn
        from conversations where conv_id is not null),
    h as (select c, {_CRC} % 9 as h from (select distinct conv_id as c from t)),
    reb as (select c, r, x, row_number() over (partition by c order by part, rn) as d from (
        select c, 0 as part, rn, r, x from h join t on t.conv_id = c - c % 5 where rn <= h
        union all select c, 1, rn, r, x from h join t on t.conv_id = c where rn > h)),
    named as (select c, d, x, sha256(string_agg(sha256(strlen(r) || ':' || r || x), '') over (partition by c order by d rows unbounded preceding)) as name from reb),
    pref as (select c, d, x, name, coalesce(lag(name) over (partition by c order by d), '') as parent from named
        union all select c, 0, '', '', null from h),
    nodes as (select name, d, min(c) as conv_id, count(*) as n, any_value(x) as x, any_value(parent) as parent from pref group by name, d),
    kids as (select parent, count(*) as k from nodes where parent is not null group by parent),
    below as (select p.name, sum((n.n - 1) * strlen(n.x)) as saved, count(*) filter (where kids.k is null) as leaves
        from nodes n join pref p on p.c = n.conv_id and p.d <= n.d left join kids on kids.parent = n.name group by p.name),
    ends as (select name, sha256(string_agg(c::varchar, ',' order by c)) as e from (select c, name, row_number() over (partition by c order by d desc) as last from pref) where last = 1 group by name)
select n.conv_id, n.d::bigint as depth, up.conv_id as parent_conv_id, n.n as n_convs, coalesce(kids.k, 0) as n_children,
    below.leaves as n_leaves, below.saved::bigint as saved_tokens, coalesce(ends.e, sha256('')) as ends_sha256
from nodes n left join nodes up on up.name = n.parent left join kids on kids.parent = n.name join below on below.name = n.name left join ends on ends.name = n.name
"""
