"""DuckDB SQL for the corpus queries that SQL can express, over the tables as views."""

from __future__ import annotations

from sessionloom.llm.licenses import LOWER, TEMPLATES, UPPER

#: op2: the same keys, shards, targets and quotas, quotients ranked by plain sorting.
SOURCE_MIX = r"""
with sized as (
    select doc_id, source is not null as known, coalesce(source, '') as name,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
        md5('7|' || coalesce(cast(doc_id as varchar), '') || '|' || coalesce(text, '')) as drawn
    from documents),
sources as (
    select known, name, sum(size)::bigint as source_size, sum(sum(size)) over ()::bigint as total,
        [5, 2, 1][1 + (row_number() over (order by not known, name) - 1) % 3] as weight
    from sized group by known, name),
filled as (
    select *, total - coalesce(sum(3 * source_size) over (order by 3 * source_size / weight, not known, name rows between unbounded preceding and 1 preceding), 0) as rest,
        sum(weight) over (order by 3 * source_size / weight, not known, name rows between current row and unbounded following) as open
    from sources),
level as (select rest, open from filled where rest * weight / open <= 3 * source_size order by open desc limit 1),
constants as (
    select any_value(total) as total, greatest(1, any_value(total) // greatest(512, any_value(total) // 10000000)) as cell,
        least(1024, greatest(1, any_value(total) // 1048576)) as block
    from sources),
targets as (
    select s.known, s.name, s.source_size, least(3.0::double * s.source_size, l.rest::double * s.weight / l.open) as target,
        greatest(1, (s.source_size + c.cell - 1) // c.cell) as shards, (3 * s.source_size + c.block - 1) // c.block as cap
    from sources s, constants c left join level l on true),
seats as (
    select known, name, count(*) as quota from (
        select known, name from (select known, name, target, cap, unnest(range(cap::bigint)) as h from targets where target > 0)
        order by target / (2 * h + 1) desc, not known, name
        limit (select round_even(total / block, 0)::bigint from constants))
    group by known, name),
units as (
    select s.known, s.name, ('0x' || substr(s.drawn, 17, 8))::bigint % t.shards as shard, substr(s.drawn, 1, 16) as key, s.size, count(*) as copies
    from sized s join targets t on s.known = t.known and s.name = t.name where s.size > 0 group by all),
cells as (select known, name, shard, sum(size * copies)::bigint as cell_size from units group by all),
dealt as (
    select known, name, shard, count(*) as quota from (
        select c.known, c.name, c.shard, q.quota, row_number() over (partition by c.known, c.name order by c.cell_size / (2 * c.h + 1) desc, c.shard) as place
        from (select *, unnest(range((3 * cell_size + (select block from constants) - 1) // (select block from constants))) as h from cells) c
        join seats q on c.known = q.known and c.name = q.name)
    where place <= quota group by all),
plan as (
    select c.*, least(coalesce(d.quota, 0) * (select block from constants), 3 * c.cell_size) // c.cell_size as passes,
        least(coalesce(d.quota, 0) * (select block from constants), 3 * c.cell_size) % c.cell_size as rest
    from cells c left join dealt d on c.known = d.known and c.name = d.name and c.shard = d.shard),
placed as (
    select u.*, p.passes, p.rest, sum(u.size * u.copies) over (partition by u.known, u.name, u.shard order by u.key, u.size) - u.size * u.copies as before
    from units u join plan p on u.known = p.known and u.name = p.name and u.shard = p.shard)
select s.doc_id, s.size::bigint as size, t.source_size, t.target,
    coalesce(p.passes * s.size + greatest(0, least(s.size, (p.rest - p.before) // p.copies)), 0)::bigint as taken
from sized s join targets t on s.known = t.known and s.name = t.name
left join placed p on s.known = p.known and s.name = p.name and p.size = s.size and p.key = substr(s.drawn, 1, 16)
"""


def license_sql(least: float = 0.6) -> str:
    """op1: every template laid at every place where its key phrase stands."""
    rows = []
    for i, (label, text, key, base) in enumerate(TEMPLATES):
        words, phrase = text.split(), key.split()
        start = next(k for k in range(len(words)) if words[k : k + len(phrase)] == phrase)
        rows.append(f"({i}, '{label}', {str(base).lower()}, {words}, {phrase}, {start})")
    return rf"""
with templates(t, label, base, w, key, k) as (values {", ".join(rows)}),
docs as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
stands as (select r, unnest(words) as word, unnest(range(len(words))) as s from docs),
frequency as (select word, count(distinct r) as n from stands group by word),
idf as (
    select t, q, word, ln((2 + (select count(*) from docs)) / (1 + coalesce(n, 0))) as x
    from (select t, unnest(w) as word, unnest(range(len(w))) as q from templates) left join frequency using (word)),
places as (
    select d.r, t.t, t.label, t.base, s.s, s.s - t.k as origin
    from stands s join templates t on s.word = t.key[1] join docs d on d.r = s.r where d.words[s.s + 1 : s.s + len(t.key)] = t.key),
scored as (
    select p.r, p.label, p.base, p.s, case when p.base then 1.0::double
        else sum(case when p.origin + i.q >= -2 and list_contains(d.words[greatest(1, p.origin + i.q - 1) : p.origin + i.q + 3], i.word) then i.x else 0 end) / sum(i.x) end as score
    from places p join docs d on d.r = p.r join idf i on i.t = p.t group by p.r, p.t, p.label, p.base, p.s),
kept as (select * from scored where base or score >= {least}),
by_doc as (
    select r, count(*) filter (base) as n_base, min(s) filter (base) as first_word, max(s) filter (base) as last_word,
        string_agg(distinct label, ',' order by label) filter (base) as base_labels, string_agg(distinct label, ',' order by label) as labels, max(score) as score
    from kept group by r)
select d.doc_id, len(d.words)::bigint as n_words, coalesce(b.n_base, 0)::bigint as n_base, b.first_word::bigint as first_word, b.last_word::bigint as last_word,
    coalesce(b.base_labels, '') as base_labels, coalesce(b.labels, '') as labels, round(least(1.0, coalesce(b.score, 0)), 9)::double as score
from docs d left join by_doc b on b.r = d.r
"""


#: Components of ``nodes`` (id) and ``links`` (a, b) in both directions: each node's smallest reachable one.
COMPONENTS = """
reach(id, to_id) as (select id, id from nodes union select r.id, l.b from reach r join links l on l.a = r.to_id),
components as (select id, min(to_id) as component from reach group by id)"""

#: op3: the exact answer. At small sizes one list holds every row, and the query's is the same.
NEAREST = """
with rows_ as (
    select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (select q.vec_id as query_id, r.vec_id, list_distance(q.v, r.v) as score from rows_ q join rows_ r on q.vec_id % 100 = 0 and q.vec_id <> r.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score, vec_id) as rank from pairs)
select query_id, rank::integer as rank, vec_id, score from ranked where rank <= 10
"""

#: op4: all pairs by cosine.
NEAR_VECTORS = f"""
with recursive rows_ as (
    select vec_id as id, list_transform(embedding, lambda x: x::double) as v from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.id as a, b.id as b from rows_ a join rows_ b on a.id <> b.id and list_cosine_similarity(a.v, b.v) >= 0.95),
nodes as (select id from rows_),{COMPONENTS},
counts as (select a, count(*) as n from links group by a)
select e.vec_id, coalesce(n, 0)::bigint as n_links, coalesce(component, e.vec_id) as component_id, coalesce(component, e.vec_id) = e.vec_id as kept
from embeddings e left join components c on c.id = e.vec_id left join counts on counts.a = e.vec_id
"""

#: op5: pairs of texts by shared shingles; equal sets are one node until the end.
NEAR_DUPLICATES = rf"""
with recursive texts as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
    select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) end as items from texts),
classes as (select items, min(doc_id) as id, len(items) as n from sets where len(items) > 0 group by items),
shared as (select id, n, unnest(items) as item from classes),
links as (
    select a.id as a, b.id as b from shared a join shared b on a.item = b.item and a.id <> b.id and 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
    group by a.id, b.id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
nodes as (select id from classes),{COMPONENTS}
select s.doc_id, len(s.items)::bigint as n_shingles, coalesce(c.component, s.doc_id) as component_id, coalesce(c.component, s.doc_id) = s.doc_id as kept
from sets s left join classes k on k.items = s.items left join components c on c.id = k.id
"""

#: op13: every kept term laid beside every group.
SOURCE_AUDIT = rf"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as text from documents),
words as (select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term, count(*) as n from words group by lang, term having count(distinct r) >= 3),
groups as (select distinct lang, source from d),
langs as (select lang, count(*)::hugeint as v, sum(n)::hugeint as total from kept group by lang),
counts as (select w.lang, w.source, w.term, count(*) as n from words w join kept k on w.lang = k.lang and w.term = k.term group by all),
totals as (select lang, source, sum(n) as total from counts group by all),
p as (
    select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (coalesce(t.total, 0) + l.v) as p,
        1 + 1000000000::hugeint * (k.n + 1) // (l.total + l.v) as q
    from groups g join langs l on g.lang = l.lang join kept k on k.lang = g.lang left join totals t on t.lang = g.lang and t.source = g.source
    left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
sums as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
every as (
    select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
    union all select lang, source, 'term', term, (p - q) * (p - q) // q from p where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from every)
select lang, source, part, item, value::bigint as value, rank::integer as rank from ranked where part = 'pair' or rank <= 200
"""

#: op11: CRC-32 by its rule; near words by the keys that one letter less gives.
SPELLING = rf"""
with recursive rounds as (
    select i, i as c, 0 as k from (select unnest(range(256)) as i)
    union all select i, case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, k + 1 from rounds where k < 8),
crc as (select list(c order by i) as t from rounds where k = 8),
found as (
    select doc_id, run, count(*) as n from (
        select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as run from documents)
    where length(run) >= 6 group by all),
hashed as (
    select run, n, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(octet_length(b)), lambda i: ('0x' || substr(hex(b), 2 * i::bigint + 1, 2))::bigint)),
        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) as h
    from (select run, n, encode(coalesce(doc_id::varchar, '') || ':' || run) as b, t from found, crc)),
words as (
    select word, sum(n)::bigint as n from (
        select case when h % 199 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from hashed)
    where length(word) >= 6 group by word having sum(n) >= 5),
cut as (select word, n, left(word, i) || substr(word, i + 2) as rest, left(word, i) || '.' || substr(word, i + 2) as hole from (select *, unnest(range(length(word))) as i from words)),
near as (
    select distinct a.word, b.word as other, b.n as other_n from cut a join cut b on a.hole = b.hole and a.word <> b.word
    union select a.word, b.word, b.n from cut a join words b on a.rest = b.word union select b.word, a.word, a.n from cut a join words b on a.rest = b.word),
best as (select word, count(*) as n_near, arg_min(other, (-other_n, other)) as other, max(other_n) as other_n from near group by word),
formed as (
    select w.word, w.n, coalesce(n_near, 0) as n_near, case when other_n >= 5 * w.n then other end as form, case when other_n >= 5 * w.n then other_n end as form_n
    from words w left join best b on b.word = w.word),
walk as (select word, word as at from formed union select k.word, f.form from walk k join formed f on f.word = k.at where f.form is not null),
roots as (select k.word, k.at as root from walk k join formed f on f.word = k.at where f.form is null)
select f.word, form, root, n, n_near::bigint as n_near, form_n::bigint as form_n from formed f join roots r on r.word = f.word
"""

ORACLES = {
    "op1_licenses": license_sql(),
    "op2_source_mix": SOURCE_MIX,
    "op3_nearest": NEAREST,
    "op4_near_vectors": NEAR_VECTORS,
    "op5_near_duplicates": NEAR_DUPLICATES,
    "op11_spelling_variants": SPELLING,
    "op13_source_audit": SOURCE_AUDIT,
}
