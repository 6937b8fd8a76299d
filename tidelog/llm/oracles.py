"""DuckDB SQL of the operators that SQL can express on whole tables."""

from __future__ import annotations

from tidelog.llm import licenses as L
from tidelog.llm import secrets as S

ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def near_dedup(width: int, percent: int) -> str:
    lowered = ASCII_LOWER.format("coalesce(text, '')")
    return rf"""
with recursive words as (
  select doc_id, regexp_extract_all({lowered}, '[^\x20\x09-\x0D]+') as w from documents
), sets as (
  select doc_id, list_distinct(list_transform(range(1, greatest(len(w) - {width - 1}, least(len(w), 1)) + 1),
         lambda i: array_to_string(w[i:i + {width - 1}], ' '))) as s
  from words
), grams as (select doc_id, unnest(s) as g from sets),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared
  from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by all
), links as (
  select p.a, p.b from pairs p join sets x on x.doc_id = p.a join sets y on y.doc_id = p.b
  where 100 * p.shared >= {percent} * (len(x.s) + len(y.s) - p.shared)
), both_ways as (select a, b from links union all select b, a from links),
reach(node, other) as (
  select doc_id, doc_id from sets
  union
  select r.node, l.b from reach r join both_ways l on l.a = r.other
), comp as (select node, min(other) as component_id from reach group by node)
select s.doc_id, len(s.s)::bigint as n_shingles, c.component_id, s.doc_id = c.component_id as kept
from sets s join comp c on c.node = s.doc_id
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _match_list(pattern: str, kind: int) -> str:
    """Matches with offsets, from the lengths of gaps and matches in turn."""
    p = _quoted(pattern)
    return f"""(select coalesce(list({{'start': list_sum(g[1:i]) + coalesce(list_sum(h[1:i - 1]), 0), 'kind': {kind},
        'end': list_sum(g[1:i]) + list_sum(h[1:i]), 'value': v[i]}} order by i), [])
      from (select list_transform(string_split_regex(t, {p}), lambda x: length(x)) as g,
                   list_transform(regexp_extract_all(t, {p}), lambda x: length(x)) as h,
                   regexp_extract_all(t, {p}) as v), unnest(range(1, len(v) + 1)) as r(i))"""


def secret_scan() -> str:
    base = [
        f"list_filter({_match_list(pattern, k)}, lambda s: length(regexp_extract(s.value, {_quoted(pattern)}, {group})) >= {least})"
        for k, (_, pattern, group, least) in enumerate(S.KINDS)
    ]
    names = "[" + ", ".join(f"'{n}'" for n in S.NAMES) + "]"
    joined = f"list_transform({{0}}, lambda s: {names}[s.kind + 1] || ':' || s.start || ':' || s.end)"
    text_of = lambda spans: f"array_to_string({joined.format(spans)}, ',')"
    return rf"""
with docs as (select doc_id, coalesce(text, '') as t, row_number() over () as rid from documents),
found as (
  select rid, doc_id, t, list_sort(list_concat(list_concat({base[0]}, {base[1]}), {base[2]})) as base,
         {_match_list(S.CANDIDATE, len(S.KINDS))} as cand
  from docs
), samples as (
  select unnest(regexp_extract_all(t, '{S.ORDINARY}')) as w, 0 as r from docs
  union all select unnest(list_transform(base, lambda s: s.value)), 1 from found
  union all select to_base64(unhex(sha256(coalesce(doc_id::varchar, '')))), 1 from docs
), counts as (
  select w[i] as a, w[i + 1] as b, count(*) filter (r = 1) as n_r, count(*) filter (r = 0) as n_o
  from (select w, r, unnest(range(1, length(w))) as i from samples) group by all
), letters as (select unnest(string_split({_quoted(S.ALPHABET)}, '')) as c),
known as (select * from counts where a in (from letters) and b in (from letters)),
totals as (select c as a, coalesce(sum(n_r), 0) as t_r, coalesce(sum(n_o), 0) as t_o from letters left join known on a = c group by c),
model as (
  select a.c || b.c as pair, floor(1000 * (ln((coalesce(n_r, 0) + 1) / (t_r + {len(S.ALPHABET)}))
         - ln((coalesce(n_o, 0) + 1) / (t_o + {len(S.ALPHABET)}))) + 0.5)::bigint as llr
  from letters a cross join letters b join totals t on t.a = a.c left join known k on k.a = a.c and k.b = b.c
), cands as (
  select rid, c, unnest(range(1, length(c.value))) as i
  from (select rid, base, unnest(cand) as c from found)
  where regexp_matches(c.value, '[A-Za-z]') and len(list_distinct(string_split(c.value, ''))) >= {S.MIN_DISTINCT} and len(list_filter(base, lambda b: b.start < c."end" and c.start < b."end")) = 0
), scored as (
  select rid, c from cands join model on pair = c.value[i] || c.value[i + 1]
  group by rid, c having sum(llr) >= {round(1000 * S.MIN_RATIO)} * (length(any_value(c.value)) - 1)
), extra as (select rid, list(c) as more from scored group by rid),
whole as (select f.*, list_sort(list_concat(base, coalesce(more, []))) as spans from found f left join extra using (rid))
select doc_id,
  len(list_filter(base, lambda s: s.kind = 0))::bigint as n_assign, len(list_filter(base, lambda s: s.kind = 1))::bigint as n_access,
  len(list_filter(base, lambda s: s.kind = 2))::bigint as n_hex,
  sha256({text_of("base")}) as base_sha256, {text_of("spans")} as spans
from whole
"""


def decontamination() -> str:
    """Every alignment of every item with every text, without seeds."""
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return rf"""
with dw as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), {word}) as w from documents),
iw as (select item_id, regexp_extract_all(lower(coalesce(text, '')), {word}) as w from benchmark),
d as (select doc_id, unnest(w) as word, unnest(range(len(w))) as p from dw),
i as (select item_id, len(w) as n, least(16, len(w)) as win, unnest(w) as word, unnest(range(len(w))) as q from iw where len(w) > 0),
same as (select doc_id, item_id, n, win, p - q as off, q from d join i using (word)),
runs as (
  select doc_id, item_id, n, win, off, q, list(q) over (partition by doc_id, item_id, off order by q range between current row and 15 following) as qs
  from same qualify count(*) over (partition by doc_id, item_id, off) >= least(7, n)
), best as (
  -- a window may start up to three replaced words before its first agreeing one, or end with the item
  select doc_id, item_id, n, win, off, s, len(list_filter(qs, lambda x: x < s + win)) as matched
  from (select *, unnest(range(greatest(0, q - 3), q + 1)) as s from runs) where s + win <= n
)
select doc_id, item_id, max(win)::int as "window", max(matched)::int as matched
from best
where matched >= win - (case when win >= 16 then 3 when win >= 12 then 2 when win >= 8 then 1 else 0 end)
group by all
"""


def mixing(block: int, units: int) -> str:
    """Earliest deadline first over all blocks, slot by slot in a recursive query."""
    goes_on = "t < until or (t = until and len(list_filter(active, lambda i: (b[i] - done[i])::hugeint * total // w[i] = until and loc[i] < b[i] - done[i])) > 0)"
    stretch = """
    select *, list_min(list_transform(active, lambda i: (b[i] - done[i])::hugeint * total // w[i])) as until from (
      select *, list_sum(list_transform(active, lambda i: w[i]))::hugeint as total from (
        select *, list_filter(range(1, len(b) + 1), lambda i: b[i] > done[i]) as active from {0}))"""
    again = f"""(
      select position, case when same then t else 0 end as t, case when same then done else list_transform(done, lambda d, i: d + loc[i]) end as done,
        case when same then loc else list_transform(loc, lambda x: 0::bigint) end as loc, b, w
      from (select *, {goes_on} as same from ({stretch.format('edf')})))"""
    return f"""
with recursive ranked as (
  select doc_id, source, row_number() over (partition by source order by md5(coalesce(doc_id::varchar, '')), doc_id) - 1 as r from documents
), sizes as (select source, count(*) as n from ranked group by source),
srcs as (
  select source, row_number() over (order by source nulls first) as s, (n + {block - 1}) // {block} as b,
         greatest(1, floor({units} * (sqrt(n) / sum(sqrt(n)) over ()) + 0.5))::bigint as w
  from sizes
), lists as (select list(b order by s) as b, list(w order by s) as w from srcs having count(*) > 0),
edf(position, t, done, loc, pick, source_block, b, w) as (
  select -1::bigint, 0::bigint, list_transform(b, lambda x: 0::bigint), list_transform(b, lambda x: 0::bigint), 0::bigint, 0::bigint, b, w from lists
  union all
  select position + 1, t + 1, done, list_transform(loc, lambda n, i: case when i = p.i then n + 1 else n end), p.i, done[p.i] + loc[p.i], b, w from (
    select *, list_min(list_transform(list_filter(active, lambda i: loc[i]::hugeint * total // w[i] <= t),
      lambda i: {{'due': ((loc[i] + 1)::hugeint * total + w[i] - 1) // w[i], 'i': i::bigint}})) as p
    from ({stretch.format(again)}) where len(active) > 0)
), placed as (
  select r.*, s.s, r // {block} as sb from ranked r join srcs s on r.source is not distinct from s.source
)
select doc_id, source, sb::bigint as source_block, e.position, (r - sb * {block})::int as place
from placed join edf e on e.position >= 0 and e.pick = placed.s and e.source_block = placed.sb
"""


def license_scan() -> str:
    lowered = ASCII_LOWER.format("coalesce(text, '')")
    rules = ", ".join(f"({o}, {p}, {c}::double, {_quoted(label)}, {_quoted(key)}, {_quoted(pattern)})" for o, p, c, label, key, pattern in L.rules())
    phrases = ", ".join(f"({_quoted(p)}, {len(p.split())}, {_quoted(label)})" for p, label in L.BASE)
    blanks = "(length({0}) - length(replace({0}, ' ', ''))) // 2"
    return rf"""
with docs as (
  select row_number() over () as rid, doc_id, regexp_extract_all({lowered}, '{L.WORD}') as w from documents
), rules(rule, priority, confidence, label, keyword, pattern) as (values {rules}),
phrases(phrase, n, label) as (values {phrases}),
spots as (select rid, w, unnest(range(1, len(w) + 1)) as i from docs where list_contains(w, 'license')),
base as (select rid, i - 1 as first, label from spots join phrases on w[i] = string_split(phrase, ' ')[1] and array_to_string(w[i:i + n - 1], ' ') = phrase),
spaced as (
  select rid, ' ' || array_to_string(w, '  ') || ' ' as t from docs
  where regexp_matches(array_to_string(w, ' '), '{"|".join(L.gate())}')
), pairs as (
  select rid, rule, priority, confidence, label, regexp_extract_all(t, pattern) as h, string_split_regex(t, pattern) as g
  from spaced join rules on contains(t, keyword)
), found as (
  select rid, rule, priority, confidence, label,
         list_sum(list_transform(g[1:i], lambda x: {blanks.format("x")})) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: {blanks.format("x")})), 0) as a,
         {blanks.format("h[i]")} as n
  from (select *, unnest(range(1, len(h) + 1)) as i from pairs)
), spans as (select *, a + n as z from found),
kept as (
  select * from spans d where not exists (
    select 1 from spans e where e.rid = d.rid and e.a <= d.a and e.z >= d.z and (
      e.priority < d.priority or (e.priority = d.priority and (e.z - e.a > d.z - d.a or (e.z - e.a = d.z - d.a and e.rule < d.rule)))))
), all_labels as (select rid, label, confidence from kept union all select rid, label, 0.7 from base),
of_base as (select rid, count(*) as n, min(first) as f, max(first) as l, string_agg(distinct label, ',' order by label) as labels from base group by rid),
of_all as (select rid, max(confidence) as score, string_agg(distinct label, ',' order by label) as labels from all_labels group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(b.n, 0)::bigint as n_base, b.f::bigint as first_word, b.l::bigint as last_word,
       coalesce(b.labels, '') as base_labels, coalesce(m.labels, '') as labels, coalesce(m.score, 0)::double as score
from docs left join of_base b using (rid) left join of_all m using (rid)
"""


def hamming(k: int) -> str:
    return f"""
with codes as (select vec_id, list_transform(embedding, lambda x: x > 0) as code from embeddings where len(embedding) > 0),
pairs as (
  select q.vec_id as query_id, v.vec_id, len(list_filter(list_zip(q.code, v.code), lambda p: p[1] <> p[2])) as distance
  from codes q join codes v on q.vec_id % 100 = 0 and q.vec_id <> v.vec_id and len(q.code) = len(v.code)
)
select query_id, row_number() over (partition by query_id order by distance, vec_id)::int as rank, vec_id, distance::int as distance
from pairs qualify rank <= {k}
"""


def repeats(length: int) -> str:
    """Every string of every text by its hash; hexadecimal digits stand for bytes."""
    return f"""
with docs as (select row_number() over () as rid, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
grams as (
  select rid, i, md5(substr(h, 2 * i + 1, {2 * length})) as g
  from (select rid, h, unnest(range(0, greatest(0, length(h) // 2 - {length - 1}))) as i from docs)
), repeated as (select rid, i from grams qualify count(*) over (partition by g) > 1),
islands as (
  select rid, i, sum(case when i - before <= {length} then 0 else 1 end) over (partition by rid order by i) as island
  from (select rid, i, lag(i) over (partition by rid order by i) as before from repeated)
), spans as (select rid, min(i) as a, max(i) + {length} as z from islands group by rid, island),
sums as (
  select rid, sum(z - a) as removed, count(*) as n, list(a order by a) as starts, list(z order by a) as ends from spans group by rid
)
select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(n, 0)::bigint as n_spans,
  sha256(unhex(case when n is null then h else
    array_to_string(list_transform(range(1, n + 2), lambda k: substr(h, 2 * (case when k = 1 then 0 else ends[k - 1] end) + 1,
      2 * ((case when k > n then length(h) // 2 else starts[k] end) - (case when k = 1 then 0 else ends[k - 1] end)))), '') end)) as kept_sha256
from docs left join sums using (rid)
"""
