"""DuckDB SQL for the queries that SQL can express, in the words of the contracts."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

OP1 = """
with named as (
  select conv_id, coalesce(turn, -4611686018427387904) t, coalesce(role, '') name, coalesce(text, '') content, role is null unknown,
         coalesce(cast(floor(turn / 64.0) as bigint), -1) part
  from conversations),
turns as (select *, (row_number() over (partition by conv_id, part order by t, name, content, unknown) - 1) // 64 slice from named),
speakers as (select distinct conv_id, role speaker from conversations where role is not null and role <> 'system'),
pieces as (
  select s.conv_id, s.speaker, m.part, m.slice, m.t, m.name, m.content, m.unknown, not m.unknown and m.name = s.speaker own,
         '<|im_start|>' || case when not m.unknown and m.name = s.speaker then 'assistant' when m.unknown then 'user name=unknown'
              when m.name = 'system' then 'system' else 'user name=' || m.name end || chr(10) head,
         m.content || '<|im_end|>' || chr(10) body
  from turns m join speakers s on m.conv_id is not distinct from s.conv_id),
placed as (
  select *, sum(length(head) + length(body)) over w - length(body) start_at, row_number() over w n
  from pieces window w as (partition by conv_id, speaker, part, slice order by t, name, content, unknown rows unbounded preceding))
select conv_id, speaker, part, slice, count(*) n_turns, count(*) filter (where own) n_trained, string_agg(head || body, '' order by n) as text,
       coalesce(string_agg(cast(start_at as bigint) || '-' || cast(start_at + length(body) - 1 as bigint), ',' order by n) filter (where own), '') spans
from placed group by conv_id, speaker, part, slice
"""


def op4(buckets: int = 8, budget: int = 65536) -> str:
    """The dynamic program as one step of SQL for each bucket."""
    steps = "".join(
        f""",
c{k} as (
  select j, cost, i from (
    select b.j, a.cost + b.g * (b.upto - p.upto) cost, a.j i, row_number() over (partition by b.j order by a.cost + b.g * (b.upto - p.upto), a.j) r
    from c{k - 1} a join hist p on p.j = a.j join hist b on b.j > a.j) where r = 1)"""
        for k in range(2, buckets + 1)
    )
    last = " union all ".join(f"select {k} k, cost from c{k}, n where j = n.n" for k in range(1, buckets + 1))
    back = "".join(f",\nb{k} as (select {k} k, n.n j from n, best where best.k = {k}" + (f" union all select {k}, c.i from c{k + 1} c join b{k + 1} on c.j = b{k + 1}.j" if k < buckets else "") + ")" for k in range(buckets, 0, -1))
    ends = " union all ".join(f"select k, j from b{k}" for k in range(1, buckets + 1))
    return rf"""
with docs as (
  select doc_id, len({WORDS.format("text")}) n, md5('pack:' || coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) k from documents),
grids as (select *, greatest(1, n) g from docs),
hist as (select g, row_number() over (order by g) j, sum(c) over (order by g) upto from (select g, count(*) c from grids group by g)),
n as (select max(j) n from hist),
c1 as (select j, g * upto cost, 0 i from hist){steps},
best as (select k from ({last}) order by cost, k limit 1){back},
ends as (select row_number() over (order by h.g) - 1 bucket, h.g bucket_length from ({ends}) e join hist h on h.j = e.j),
placed as (select g.*, (select min(bucket_length) from ends where bucket_length >= g.g) bucket_length from grids g),
ranked as (select *, row_number() over (partition by bucket_length order by k) - 1 pos, greatest(1, {budget} // bucket_length) room from placed)
select doc_id, cast(n as bigint) length, cast(bucket as bigint) bucket, cast(r.bucket_length as bigint) bucket_length, cast(pos // room as bigint) batch,
       cast(pos % room as bigint) slot, cast(r.bucket_length - n as bigint) padding
from ranked r join ends using (bucket_length)
"""


OP5 = rf"""
with docs as (
  select doc_id, source, len({WORDS.format("text")}) size, md5('mix:' || coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) k from documents),
sources as (
  select source, sum(size) source_size, cast((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1 as double) weight from docs group by source),
levels as (
  select *, 3.0::double * source_size most, sum(source_size) over () total, sum(3.0::double * source_size) over w - 3.0::double * source_size full_,
         sum(weight) over () - sum(weight) over w + weight open
  from sources window w as (order by 3.0::double * source_size / weight, encode(source) nulls last rows unbounded preceding)),
targets as (
  select source, source_size, least(most, weight * max(case when (total - full_) / open <= most / weight then (total - full_) / open end) over ()) target from levels),
queued as (
  select d.*, t.source_size, t.target, sum(d.size) over (partition by d.source order by d.k rows unbounded preceding) source_to
  from docs d join targets t on d.source is not distinct from t.source),
copies as (
  select q.*, sum(size) over (order by (c.copy * source_size + source_to) / target, encode(source) nulls last, k, c.copy rows unbounded preceding) all_to
  from queued q, (values (0), (1), (2)) c(copy) where size > 0 and target > 0),
taken as (select source, k, count(*) hits from copies where all_to <= (select sum(size) from docs) group by source, k)
select q.doc_id, q.source, cast(q.size as bigint) size, cast(q.source_size as bigint) source_size, cast(coalesce(q.target, 0) as double) target,
       cast(coalesce(t.hits, 0) * q.size as bigint) taken
from queued q left join taken t on q.source is not distinct from t.source and q.k = t.k
"""


def op6() -> str:
    from .quality import LINE_LIMIT, NGRAM_LIMITS

    grams = sorted({5, *NGRAM_LIMITS})
    cover = "".join(
        f""",
g{n} as (
  select doc_id, i, count(*) over (partition by doc_id, g) c, row_number() over (partition by doc_id, g order by i) r
  from (select doc_id, i, list_slice(w, i, i + {n - 1}) g from docs, unnest(range(1, len(w) - {n - 2})) u(i) where len(w) >= {n})),
v{n} as (select doc_id, count(distinct i + o) filter (where true) n_all from g{n}, range({n}) x(o) where c > 1 group by doc_id),
s{n} as (
  select doc_id, sum(length(w[p])) chars from (select distinct g.doc_id, g.i + o p from g{n} g, range({n}) x(o) where c > 1 and r > 1) join docs using (doc_id) group by doc_id)"""
        for n in grams
    )
    over = " or ".join(f"coalesce(s{n}.chars, 0) / greatest(word_chars, 1) > {x}" for n, x in sorted(NGRAM_LIMITS.items()))
    joins = " ".join(f"left join s{n} using (doc_id)" for n in sorted(NGRAM_LIMITS))
    return rf"""
with docs as (select doc_id, coalesce(text, '') text, {WORDS.format("text")} w from documents),
lines as (
  select doc_id, list_sum(list_transform({WORDS.format("line")}, lambda x: length(x))) chars, row_number() over (partition by doc_id, line order by pos) r
  from (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) pos from docs)
  where len({WORDS.format("line")}) > 0),
dup as (select doc_id, count(*) n, sum(chars) chars from lines where r > 1 group by doc_id){cover},
base as (
  select doc_id, len(w) n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) n_symbols, coalesce(dup.n, 0) n_dup_lines, coalesce(v5.n_all, 0) n_repeat_words, dup.chars dup_chars
  from docs left join dup using (doc_id) left join v5 using (doc_id)),
judged as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from base)
select doc_id, cast(n_words as bigint) n_words, cast(word_chars as bigint) word_chars, cast(n_symbols as bigint) n_symbols, cast(n_dup_lines as bigint) n_dup_lines,
       cast(n_repeat_words as bigint) n_repeat_words, base_failed, not (base_failed or {over} or coalesce(dup_chars, 0) / greatest(word_chars, 1) > {LINE_LIMIT}) kept
from judged {joins}
"""


#: Smallest node reachable over links(a, b), for nodes(id).
REACH = """
both_ways as (select a, b from links union select b, a from links),
reach as (select id, id other from nodes union select r.id, l.b from reach r join both_ways l on r.other = l.a),
classes as (select id, min(other) component from reach group by id)"""

OP2 = f"""
with recursive vectors as (
  select vec_id, label, embedding, len(embedding) dim, coalesce(
    vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0, false) fit
  from embeddings),
units as (select *, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) norm from vectors where fit),
links as (
  select x.vec_id a, y.vec_id b from units x join units y on x.label = y.label and x.dim = y.dim and x.vec_id < y.vec_id
  where list_dot_product(x.embedding::double[], y.embedding::double[]) / (x.norm * y.norm) >= 0.93),
nodes as (select distinct vec_id id from vectors where vec_id is not null),{REACH},
degree as (select a, count(*) n from both_ways group by a)
select v.vec_id, cast(coalesce(d.n, 0) as bigint) n_links, c.component component_id, coalesce(v.vec_id = c.component, true) kept
from vectors v left join degree d on d.a = v.vec_id left join classes c on c.id = v.vec_id
"""

OP9 = rf"""
with recursive docs as (select doc_id, {WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [list_aggregate(w, 'string_agg', ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end s
  from docs),
items as (select doc_id, hash(x) x from (select doc_id, unnest(s) x from sets where doc_id is not null)),
links as (
  select a.doc_id a, b.doc_id b from items a join items b on a.x = b.x and a.doc_id < b.doc_id
  join sets p on p.doc_id = a.doc_id join sets q on q.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, len(p.s), len(q.s) having 100 * count(*) >= 85 * (len(p.s) + len(q.s) - count(*))),
nodes as (select distinct doc_id id from docs where doc_id is not null),{REACH}
select s.doc_id, cast(len(s.s) as bigint) n_shingles, c.component component_id, coalesce(s.doc_id = c.component, true) kept
from sets s left join classes c on c.id = s.doc_id
"""


def op7() -> str:
    from .license_texts import TEMPLATES
    from .licenses import CONTAINMENT, PHRASES

    lower = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    phrases = ", ".join(f"('{label}', {phrase.split()})" for phrase, label in PHRASES.items())
    quoted = lambda x: x.replace("'", "''")
    templates = ", ".join(f"('{label}', '{quoted(text)}')" for label, text in TEMPLATES)
    return f"""
with docs as (select row_number() over () r, doc_id, text, {words.format("text")} w from documents),
phrases as (select * from (values {phrases}) p(label, p)),
templates as (select label, list_distinct(t) t, len(t) span from (select label, {words.format("text")} t from (values {templates}) t(label, text))),
places as (
  select r, label, i - 1 pos from (select r, label, w, p, unnest(range(1, len(w) - len(p) + 2)) i from docs, phrases) where w[i:i + len(p) - 1] = p),
base as (select r, count(*) n, min(pos) a, max(pos) z, list_distinct(list(label)) labels from places group by r),
blocks as (
  select r, label, t, w[b * span + 1 : b * span + 2 * span] own
  from (select r, w, label, t, span, unnest(range(0, (len(w) + span - 1) // span)) b from docs, templates)),
met as (select r, label, len(list_intersect(own, t)) * 1.0::double / len(t) share from blocks where len(list_intersect(own, t)) >= {CONTAINMENT} * len(t) - 1e-9),
own as (select r, list_distinct(list(label)) labels, max(share) share from met group by r)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(b.n, 0) as bigint) n_base, cast(b.a as bigint) first_word, cast(b.z as bigint) last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(o.labels, [])))), ','), '') labels,
       case when coalesce(b.n, 0) > 0 then 1.0::double else coalesce(o.share, 0.0::double) end score
from docs left join base b using (r) left join own o using (r)
"""


OP11 = r"""
with docs as (
  select doc_id, coalesce(text, '') body, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') units, sha256('1:' || coalesce(cast(doc_id as varchar), '')) s from documents),
drawn as (
  select *, len(units) n, cast('0x' || substr(s, 1, 8) as bigint) h1, cast('0x' || substr(s, 9, 8) as bigint) h2,
         cast('0x' || substr(s, 17, 8) as bigint) h3, cast('0x' || substr(s, 25, 8) as bigint) h4 from docs),
cut as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
         case when body = '' or contains(body, '<P>') or contains(body, '<S>') or contains(body, '<M>') or h3 % 100 >= 90 then 'plain'
              when h4 % 100 < 20 then 'spm' else 'psm' end form from drawn),
parts as (
  select doc_id, body, n, form, array_to_string(units[1:a], '') p, array_to_string(units[a + 1:b], '') m, array_to_string(units[b + 1:], '') s from cut)
select doc_id, cast(n as bigint) n, form, case when form <> 'plain' then length(p) end prefix_chars, case when form <> 'plain' then length(m) end middle_chars,
       sha256(case form when 'plain' then body when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256,
       sha256(body) restored_sha256
from parts
"""


def op12(levels: int = 15) -> str:
    """Runs from equal windows of 1, 2, 4, ... words, up to periods of 2 ** (levels - 1) words.

    A window of k words, k not under the period, comes next exactly one period later inside a run, so
    consecutive places with one distance to the next equal window are a run.
    """
    named = "".join(
        f""",
w{k} as materialized (
  select a.doc_id, a.i, dense_rank() over (order by a.doc_id, a.r, b.r) r from w{k - 1} a join w{k - 1} b on b.doc_id = a.doc_id and b.i = a.i + {1 << k >> 1})"""
        for k in range(1, levels)
    )
    found = " union all ".join(
        f"select doc_id, i, {1 << k} k, lead(i) over (partition by doc_id, r order by i) - i q from w{k}" for k in range(levels)
    )
    return rf"""
with digits as (select doc_id, {WORDS.format("text")} w, coalesce(cast(doc_id as varchar), '') s from documents),
sums as (
  select doc_id, w, len(w) n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(s, ''), lambda c: [cast(ascii(c) as bigint), 0, 0, 0, 0, 0, 0, 0]))),
         lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1)))) h from digits),
cuts as (select *, h // 10 g, case when h % 10 = 0 and n > 0 then (h // 10) % n end a from sums),
lows as (select *, 1 + (n - a) // (3 + g % 8) p from cuts),
words as (
  select doc_id, i, w[1 + case when i >= a then a + (i - a) % p else i end] word from (select *, unnest(range(n)) i from lows)),
w0 as materialized (select doc_id, i, dense_rank() over (order by doc_id, word) r from words){named},
next as (select * from ({found}) where q <= k and 2 * q > k),
islands as (
  select doc_id, min(i) as start, max(i) - min(i) + q + k as length, q as period from (select *, i - row_number() over (partition by doc_id, k, q order by i) g from next) group by doc_id, k, q, g),
runs as (select * from islands where length >= greatest(6, 4 * period)),
kept as (select * from words w where not exists (select 1 from runs r where r.doc_id = w.doc_id and w.i >= r.start + r.period and w.i < r.start + r.length)),
texts as (select doc_id, sha256(string_agg(word, ' ' order by i)) collapsed_sha256 from kept group by doc_id),
firsts as (
  select doc_id, count(*) n_runs, arg_min({{'s': start, 'l': length, 'p': period}}, (-length, start, period)) best,
         sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period)) runs_sha256 from runs group by doc_id)
select d.doc_id, coalesce(n_runs, 0) n_runs, best.s as start, best.l as length, best.p as period, 1000 * best.l // best.p exponent_milli,
       coalesce(runs_sha256, sha256('')) runs_sha256, coalesce(collapsed_sha256, sha256('')) collapsed_sha256
from documents d left join firsts using (doc_id) left join texts using (doc_id)
"""


OP13 = """
with payloads as (select page_id, coalesce(html, '') h, octet_length(encode(coalesce(html, ''))) n from pages),
lasts as (select *, case when n >= 1000 then max(page_id) over (partition by n >= 1000, h) end last from payloads)
select page_id, n payload_bytes, sha1(h) payload_digest, case when last <> page_id then 'revisit' else 'response' end record_type,
       case when last <> page_id then last end refers_to
from lasts
"""
