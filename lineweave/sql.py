"""DuckDB SQL for the queries of ``lineweave.queries`` that SQL can express."""

from __future__ import annotations

from .functions.text import ENDINGS, OPENINGS
from .operators.usage import TYPES
from .queries import BOXES, SPEECH

S = r"\s\x{00A0}\x{2000}-\x{200A}\x{3000}"
KANA = r"[\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{31f0}-\x{31ff}\x{ff66}-\x{ff9f}]"
KANA_LETTERS = r"[\x{3040}-\x{309f}\x{30a0}-\x{30fa}\x{30fd}-\x{30ff}]"
HAN = r"[\x{4e00}-\x{9fff}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{S}]+|[{S}]+$', '', 'g')"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


DOC_LINES = "lines as (select doc_id, lang, generate_subscripts(string_split(text, chr(10)), 1) - 1 seq, unnest(string_split(text, chr(10))) text from documents)"
CUES = "cues as (select cast(conv_id as varchar) file, turn seq, turn * 2500 + 17 time_ms, role, text from conversations)"
CUE_LINES = """lines as (select *, row_number() over (partition by file order by turn, k) - 1 seq, turn * 2500 + 17 + k * 100 time_ms from (
  select cast(conv_id as varchar) file, turn, role, generate_subscripts(string_split(text, chr(10)), 1) - 1 k, unnest(string_split(text, chr(10))) text from conversations))"""
USAGE = """usage as (
  select event_id seq, event_type request_type, 'works/w' || (user_id % 50) work_key, ts, user_id, value, event_id * 37 % 5000 hit, event_id * 53 % 7000 miss,
         event_id * 11 % 3000 completion, event_id % 7 * 10 reasoning, event_id * 37 % 5000 + event_id * 53 % 7000 prompt,
         (event_id * 37 % 5000) / 1000000.0::double * 0.02::double + (event_id * 53 % 7000) / 1000000.0::double * 1.0::double + (event_id * 11 % 3000) / 1000000.0::double * 2.0::double
           + case when user_id % 7 = 0 then 0.01::double else 0.0::double end cost
  from events)"""
TYPE_NAME = "case request_type " + " ".join(f"when '{k}' then '{v}'" for k, v in TYPES.items()) + " else request_type end"


#: Long turns and the pieces that the cheapest path cuts them into: one place after another joins the window of
#: places reached so far, and takes its best predecessor there.
PIECES = f"""{CUES}, timed as (
  select file, seq, time_ms, string_split({strip("regexp_replace(text, '\\s+', ' ', 'g')")}, ' ') w from cues),
long as (select *, len(w) n, length(array_to_string(w, '')) chars from timed where length(array_to_string(w, '')) > 40 or (length(array_to_string(w, '')) >= 6 and len(w) * 280 / 1000.0::double > 8.5)),
places as (
  select file, seq, k, k = n final, length(array_to_string(w[1:k], '')) c, time_ms + (k - 1) * 300 + (k - 1) // 7 * 400 + 280 e, time_ms + k * 300 + k // 7 * 400 s, w[k] l, w[k + 1] r from (select *, unnest(range(1, n + 1)) k from long)),
legal as (
  select *, row_number() over (partition by file, seq order by k) t from places
  where final or case when regexp_matches(l, '[。！？!?、，,…]$') then not regexp_matches(r, '^[。！？!?、，,…]') else s - e >= 300 end),
reached as (
  select file, seq, cast(0 as bigint) t, cast(0 as bigint) k, cast(0 as bigint) c, time_ms s, 0.0::double cost, cast([] as struct(k bigint, c bigint, e bigint, s bigint)[]) way, false final from long
  union all
  select file, seq, t, k, c, s, cost, way, final from (
    select r.file, r.seq, i.t, r.k came, f, if(f, i.k, r.k) k, if(f, i.c, r.c) c, if(f, i.s, r.s) s, if(f, r.cost + greatest(0.0::double, (i.e - r.s) / 1000.0::double - 8.0::double - 0.5::double) * 1000 + 1000, r.cost) cost,
           if(f, list_append(r.way, {{'k': i.k, 'c': i.c, 'e': i.e, 's': i.s}}), r.way) way, f and i.final final
    from reached r join legal i on i.file = r.file and i.seq = r.seq and i.t = r.t + 1, (values (false), (true)) v(f) where i.c - r.c <= 40 and (not f or i.c - r.c >= 2))
  qualify not f or row_number() over (partition by file, seq, f order by cost, came) = 1),
best as (select r.file, r.seq, l.w, l.n, l.time_ms, way, list_prepend({{'k': 0, 'c': 0, 'e': 0, 's': l.time_ms}}, way) ends from reached r join long l using (file, seq) where r.final and len(way) > 1),
lean as (
  select *, case when len(list_filter(range(1, len(ends)), lambda i: (ends[i + 1].e - ends[i].s) / 1000.0::double > 8.05)) > 0 then list_transform(way[:-2], lambda x: x.k)
    else list_transform(list_reduce(list_transform(range(1, len(way)), lambda i: [{{'a': way[i], 'b': way[i + 1]}}]), lambda kept, x:
      case when (x[1].b.e - kept[-1].a.s) / 1000.0::double <= 8.05 and x[1].b.c - kept[-1].a.c <= 40 then kept else list_concat(kept, x) end, [{{'a': ends[1], 'b': ends[1]}}])[2:], lambda x: x.a.k) end cuts from best),
bounds as (select *, list_concat([0], cuts, [n]) ks from lean where len(cuts) > 0),
pieces as (
  select file, seq, piece, time_ms + a * 300 + a // 7 * 400 time_ms, time_ms + (b - 1) * 300 + (b - 1) // 7 * 400 + 280 end_ms, array_to_string(w[a + 1:b], '') text
  from (select *, ks[piece + 1] a, ks[piece + 2] b from (select *, unnest(range(len(ks) - 1)) piece from bounds)))"""


PAGE_GLYPHS = """glyphs as (
  select cast(l_orderkey // 128 as varchar) doc, l_linenumber page, cast(l_quantity * 5 as double) x, cast(l_extendedprice % 90 as double) y, l_returnflag flag,
         ['あ', '7', '漢', '1', '♪', ' ', '字', '22'][l_partkey % 8 + 1] letter, {'a': l_orderkey, 'b': l_partkey, 'c': l_suppkey, 'd': l_extendedprice} seq from lineitem)"""


def glyph_lines(out: str, source: str, down: bool, text: str) -> str:
    """Columns (or rows) of glyphs as CTEs: small ones join their nearest in a fold over the page's orphans."""
    across, along, gap = ("x", "y", 24) if down else ("y", "x", 8)
    near = "list_sort(list_transform(s.large, lambda l: {'d': abs(o.large[1].b - l.b), 'm': -l.n, 'b': l.b}))[1].b"
    return f"""{out}_g as (select *, {text} t, round_even({across} / {gap}, 0) * {gap} bucket from {source}),
{out}_b as (select doc, page, bucket, count(*) n, min(seq) seen from {out}_g group by doc, page, bucket),
{out}_p as (
  select doc, page, list({{'b': bucket, 'n': n}} order by bucket) filter (n >= 5) large, list({{'large': [{{'b': bucket, 'n': n}}], 'moved': [{{'b': bucket, 't': bucket}}]}} order by seen, bucket) filter (n < 5) small from {out}_b group by doc, page),
{out}_f as (
  select doc, page, unnest(list_reduce(small, lambda s, o: {{'large': list_transform(s.large, lambda l: {{'b': l.b, 'n': l.n + if(l.b = {near}, o.large[1].n, 0)}}), 'moved': list_append(s.moved, {{'b': o.large[1].b, 't': {near}}})}},
    {{'large': large, 'moved': [{{'b': -1.0::double, 't': -1.0::double}}]}}).moved) m from {out}_p where large is not null and small is not null),
{out}_j as (
  select g.*, coalesce(f.m.t, bucket) target from {out}_g g left join {out}_f f on f.doc = g.doc and f.page = g.page and f.m.b = g.bucket),
{out}_l as (select doc, page, target, {strip(f"string_agg(t, '' order by {along}, seq)")} as text from {out}_j group by doc, page, target),
{out} as (select doc, page, row_number() over (partition by doc, page order by target {'desc' if down else 'asc'}) line, text from {out}_l where text <> '' and not regexp_matches(text, '^\\d+$'))"""


def quality(lines: str) -> str:
    return f"""select doc, page, sum(len(regexp_extract_all(text, '[ぁ-ん一-鿿]')) - 2.0::double * len(regexp_extract_all(text, '[♪]'))) / greatest(sum(length(text)), 1) q from {lines} group by doc, page"""


def page_noise(x: str) -> str:
    s = strip(x)
    runs = "|".join(str(d) * 4 for d in range(10))
    return f"""case when regexp_matches({s}, '^\\d{{1,4}}$|^\\d{{1,4}}\\s*/\\s*\\d{{1,4}}$') or regexp_matches({s}, '製糖|製作|発行|著作') or regexp_matches({s}, '^\\d+$')
      or (regexp_matches({s}, '{runs}') and not regexp_matches({s}, '{KANA_LETTERS}|{HAN}')) then null
      when regexp_matches({s}, '^\\d{{8,}}') then nullif({strip(f"regexp_replace({s}, '^[0-9]+[{S}]*', '')")}, '') else {x} end"""


WORDS = rf"list_filter(string_split_regex({strip('text')}, '[{S},.!?、。！？…]+'), lambda w: length(w) >= 2)"
REPEATS = """(length(text) >= 5 and (
    len(list_filter(list_distinct(string_split(text, '')), lambda c: contains(text, repeat(c, 5)))) > 0
    or (length(text) >= 6 and 2 * n2 > length(text) * 0.7 and n2 >= 3) or (length(text) >= 9 and 3 * n3 > length(text) * 0.7 and n3 >= 3)))"""
HEADS = "(length(text) - length(replace(text, text[1:2], ''))) / length(text[1:2]) n2, (length(text) - length(replace(text, text[1:3], ''))) / length(text[1:3]) n3"


def stamp(ms: str) -> str:
    cs = f"((greatest({ms}, 0) + 5) // 10)"
    return f"printf('[%02d:%02d.%02d]', {cs} // 6000, {cs} % 6000 // 100, {cs} % 100)"


def hms(s: str) -> str:
    h, m = f"({s} // 3600)", f"({s} % 3600 // 60)"
    return f"(case when {h} > 0 then {h} || 'h' else '' end || case when {h} > 0 or {m} > 0 then {m} || 'm' else '' end || ({s} % 60) || 's')"


def dice(a: str, b: str) -> str:
    g = lambda x: f"list_distinct(list_transform(range(1, length({x})), lambda i: substring({x}, i, 2)))"
    return f"case when length({a}) > 1 and length({b}) > 1 then 2.0::double * len(list_intersect({g(a)}, {g(b)})) / (len({g(a)}) + len({g(b)})) else 0.0::double end"


def _phrases(words: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _boxes(page: str = "o_orderkey // 128 + 100") -> str:
    return f"""boxes as (select page, cx::double cx, cy::double cy, w::double w, h::double h, text from (values {BOXES}) t(page, cx, cy, w, h, text) union all
  select {page}, o_totalprice % 600, (o_orderkey % 900)::double, (o_orderkey % 17 * 3)::double, (o_orderkey % 13 * 3 + 5)::double,
         o_orderpriority || case when o_orderkey % 3 = 0 then ' of order number ' || o_orderkey else '' end from orders)"""


SQL = {
    "line_explode_stats": f"""
with {DOC_LINES}, kept as (select lang, {page_noise('text')} text from lines), k as (select * from kept where text is not null),
words as (select lang, count(distinct w) n from (select lang, unnest({WORDS}) w from k) group by lang)
select lang, count(*) total_lines, cast(sum(length(regexp_replace(text, '[{S}]', '', 'g'))) as bigint) total_chars,
       count(*) filter (where regexp_matches(text, '{KANA}')) japanese_lines, max(coalesce(words.n, 0)) unique_words
from k left join words using (lang) group by lang""",
    "word_frequency_topk": f"""
with {DOC_LINES}, each as (select lang, doc_id, seq, unnest({WORDS}) w, generate_subscripts({WORDS}, 1) i from lines),
ranked as (select lang, w word, count(*) n, row_number() over (partition by lang order by count(*) desc, min((doc_id, seq, i))) rank from each group by lang, w)
select lang, word, n, cast(rank as integer) rank from ranked where rank <= 50 and n >= 2""",
    "lang_detect": f"""
with docs as (select cast(doc_id as varchar) id, text from documents union all select * from (values {SPEECH}) t(id, text)),
c as (select id, {count('text', KANA_LETTERS)} kana, {count('text', HAN)} han,
  array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip("regexp_replace(x, '\\[\\d{2}:\\d{2}\\.\\d{2,3}\\]', '', 'g')")}), lambda x: x <> '' and not regexp_matches(x, '^\\[(ti|ar|al|by|offset):')), ' ') t from docs),
r as (select *, length(replace(t, ' ', '')) n, regexp_matches(t, '{KANA}') k, regexp_matches(t, '{HAN}') h, {count('t', '[a-zA-Z]')} * 1.0::double / nullif(length(replace(t, ' ', '')), 0) latin from c)
select id, case when (kana > 0 and han > 0 and kana * 1.0::double / han > 0.1) or (kana > 0 and han = 0) then 'japanese' when han > 0 then 'chinese' else 'unknown' end file_language,
  case when n = 0 then 'unknown' when k then case when h and latin < 0.3 then 'ja' when latin > 0.5 then 'mixed' else 'ja' end
       when h then case when latin < 0.3 then 'zh' else 'mixed' end when latin > 0.7 then 'en' else 'unknown' end content_language,
  (han > 0 and kana = 0) or (han > 0 and kana <= 0.1 * han) chinese from (select r.*, regexp_matches(t, '{KANA}') kk from r)""",
    "page_noise_filter": f"""
with {DOC_LINES}, every as (select doc_id, text from lines union all select * from (values (-1, '12'), (-2, '3/57'), (-3, '22222x'), (-4, '2222あ'), (-5, '12345678 body'), (-6, '製作 x'), (-7, '123456789')) t(doc_id, text)),
k as (select doc_id, {page_noise('text')} kept from every)
select doc_id, count(*) n_lines, count(kept) n_kept, cast(coalesce(sum(length(kept)), 0) as bigint) kept_chars from k group by doc_id""",
    "repetition_filter": f"""
with {DOC_LINES}, every as (select doc_id, text from lines union all select * from (values (-1, 'aaaaa'), (-1, 'aaaa'), (-1, 'ababab'), (-1, 'abcabd')) t(doc_id, text)),
h as (select doc_id, text, {HEADS} from every)
select doc_id, count(*) n_lines, count(*) filter (where {REPEATS}) n_repetitive from h group by doc_id""",
    "dropped_lines": f"""
with {CUE_LINES}, t as (select role, {strip("regexp_replace(text, '^\\d{2,3}:\\s*', '')")} text, (seq + 1) * 1.0::double / count(*) over (partition by file) p from lines),
f as (select *, {HEADS}, list_filter({_phrases(ENDINGS)}, lambda w: contains(lower(text), lower(w)) or contains(text, w))[1] e, list_filter({_phrases(OPENINGS)}, lambda w: contains(lower(text), lower(w)) or contains(text, w))[1] o from t),
r as (select role, case when text = '' then 'kept' when p < 0.9 and e is not null then 'mid_file_ending:' || e when p > 0.1 and o is not null then 'late_file_opening:' || o
  when p < 0.9 and regexp_matches(lower(text), '^thank\\s*you[。．.]?$|^thanks[。．.]?$|^bye[。．.]?$|^goodbye[。．.]?$|^hello[。．.]?$|^hi[。．.]?$|^welcome[。．.]?$') then 'short_ending_pattern'
  when {REPEATS} then 'repetition' when length(text) < 3 then 'short' when regexp_matches(text, '^[\\d\\s_\\p{{P}}\\p{{S}}]+$') then 'symbols'
  when not regexp_matches(text, '{KANA}') and not regexp_matches(text, '{HAN}') then 'no_script' else 'kept' end reason from f)
select role, reason, count(*) n from r group by role, reason""",
    "usage_cost_by_work": f"""
with {USAGE}, types as (select work_key, {TYPE_NAME} type, count(*) n from usage group by 1, 2),
listed as (select work_key, string_agg(type || ' x' || n, ' + ' order by type) types from types group by work_key)
select work_key, string_split(work_key, '/')[-1] as name, count(*) calls, max(types) types, cast(sum(prompt) as bigint) prompt_tokens, cast(sum(hit) as bigint) hit_tokens, cast(sum(miss) as bigint) miss_tokens,
       cast(sum(completion) as bigint) completion_tokens, cast(sum(reasoning) as bigint) reasoning_tokens, round(sum(cost), 6) cost,
       round(case when sum(hit + miss) > 0 then sum(hit)::double / sum(hit + miss)::double * 100.0::double else 0.0::double end, 6) hit_rate
from usage join listed using (work_key) group by work_key""",
    "usage_by_type": f"with {USAGE} select {TYPE_NAME} type, count(*) n from usage group by 1",
    "usage_totals": f"""with {USAGE} select count(*) calls, cast(sum(prompt) as bigint) prompt_tokens, cast(sum(hit) as bigint) hit_tokens, cast(sum(miss) as bigint) miss_tokens,
       cast(sum(completion) as bigint) completion_tokens, cast(sum(reasoning) as bigint) reasoning_tokens, round(sum(cost), 6) cost from usage""",
    "usage_reconcile": f"""
with {USAGE}, s as (select work_key, sum(cost) booked, sum(hit) / 1000000.0::double * 0.02::double + sum(miss) / 1000000.0::double * 1.0::double + sum(completion) / 1000000.0::double * 2.0::double computed from usage group by work_key)
select work_key, round(booked, 6) booked, round(computed, 6) computed from s where abs(booked - computed) > 1e-4""",
    "status_manifest": """
with runs as (select user_id % 20 work, user_id file, event_id attempt, case when event_id % 5 = 0 then 'failed' when event_id % 11 = 0 then 'skipped' else 'success' end status, (event_id % 100)::double elapsed from events),
last as (select work, file, arg_max(status, attempt) status, arg_max(elapsed, attempt) elapsed from runs group by work, file)
select work, count(*) filter (where status = 'success') succeeded, count(*) filter (where status = 'failed') failed, count(*) filter (where status = 'skipped') skipped, count(*) seen,
       round(sum(elapsed), 1) elapsed, count(*) total, true complete from last group by work""",
    "peak_cost_split": f"""
with b as (select event_id, ts + interval 8 hour t from events),
h as (select event_id, t, hour(t) h from b),
w as (select event_id, h >= 9 and h < 12 or h >= 14 and h < 18 peak, case when h >= 9 and h < 12 then date_trunc('day', t) + interval 12 hour when h >= 14 and h < 18 then date_trunc('day', t) + interval 18 hour else t end idle, t from h),
s as (select event_id, peak, (epoch_us(idle) - epoch_us(t)) // 1000000 wait_s from w)
select event_id, peak, cast(wait_s as bigint) wait_s, {hms('wait_s')} shown from s""",
    "gap_sessions": """
with e as (select user_id, epoch_us(ts) // 1000000 s from events),
j as (select *, coalesce(case when s - lag(s) over (partition by user_id order by s) > 86400 then 1 else 0 end, 0) jump from e),
g as (select *, sum(jump) over (partition by user_id order by s rows unbounded preceding) gap_group from j)
select user_id, cast(gap_group as bigint) gap_group, count(*) n, min(s) begins, max(s) ends from g group by user_id, gap_group""",
    "asof_prev_event": """
select c.event_id, (select max(v.event_id) from events v where v.user_id = c.user_id and v.event_type = 'view' and v.ts = (
    select max(x.ts) from events x where x.user_id = c.user_id and x.event_type = 'view' and x.ts <= c.ts and x.ts >= c.ts - interval 1 day)) view_id
from events c where c.event_type = 'click'""",
    "interval_match": """
select a.user_id, a.event_id, b.event_id other_id from events a join events b on a.user_id = b.user_id and a.event_id < b.event_id and abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 7200000000""",
    "turn_context": f"""
with {CUES}
select file, seq, md5(coalesce(lag(text) over w, '')) previous, md5(coalesce(lead(text) over w, '')) as next,
       md5(coalesce(array_to_string(list(text) over (partition by file order by seq rows between 2 preceding and 1 preceding), '|'), '')) "before",
       md5(coalesce(array_to_string(list(text) over (partition by file order by seq rows between 1 following and 2 following), '|'), '')) "after"
from cues window w as (partition by file order by seq)""",
    "chunk_fixed": f"with {CUES} select file, seq, (row_number() over (partition by file order by seq) - 1) // 3 chunk from cues",
    "chunk_budget": f"""
with recursive {CUES}, r as (select file, seq, length(text) size, row_number() over (partition by file order by seq) n from cues),
fold as (
  select file, seq, n, 0 chunk, size used from r where n = 1
  union all
  select r.file, r.seq, r.n, f.chunk + case when f.used > 0 and f.used + r.size > 1500 then 1 else 0 end, case when f.used > 0 and f.used + r.size > 1500 then r.size else f.used + r.size end
  from fold f join r on r.file = f.file and r.n = f.n + 1)
select file, seq, cast(chunk as bigint) chunk from fold""",
    "budget_cut": f"with {CUES}, u as (select file as work, seq, sum(length(text)) over (partition by file order by seq rows unbounded preceding) used from cues) select work, seq, cast(used as bigint) used from u where used <= 2000",
    "stride_sample": f"""
with {DOC_LINES}, r as (select doc_id file, seq, row_number() over (partition by doc_id order by seq) - 1 pos, greatest(1, count(*) over (partition by doc_id) // 5) step from lines)
select file, seq from r where pos % step = 0 and pos / step < 5""",
    "first_n_dedupe": f"""
with {DOC_LINES}, d as (select doc_id file, {strip('text')} text, min(seq) seq from lines where {strip('text')} <> '' group by 1, 2),
r as (select file, seq, text, row_number() over (partition by file order by seq) n from d)
select file, seq, md5(text) text, n from r where n <= 20""",
    "numbered_lines": f"""
with {CUES}, r as (select *, row_number() over (partition by file order by seq) n from cues)
select file, seq, n, md5(case when length(n::varchar) >= 4 then n::varchar else lpad(n::varchar, 4, '0') end || ': ' || coalesce(text, '')) numbered from r""",
    "blank_tails": f"""
with {DOC_LINES}, r as (select doc_id file, case when seq % 3 = 0 then text else '' end text, row_number() over (partition by doc_id order by seq) n from lines)
select file, count(*) - coalesce(max(n) filter (where {strip('text')} <> ''), 0) blank_tail from r group by file""",
    "anti_semi_labels": """
select lang, case when exists (select 1 from labels l where l.doc_id = d.doc_id) then 'labelled' else 'unlabelled' end kind, count(*) n from documents d group by 1, 2""",
    "dice_pairs": f"""
with p as (select p_partkey, p_name a, lead(p_name) over (partition by p_brand order by p_partkey) b from part)
select p_partkey, round({dice('a', 'b')}, 9) dice from p where b is not null""",
    "anchor_match": f"""
with {DOC_LINES}, t as (select track, text, row_number() over (partition by track order by seq) n from (
  select item_id track, generate_subscripts(string_split(text, chr(10)), 1) seq, {strip("unnest(string_split(text, chr(10)))")} text from benchmark) where length(text) > 8),
g as (select track, n, list_distinct(list_transform(range(1, length(text)), lambda i: substring(text, i, 2))) a from t where n <= 5),
s as (select doc_id, seq line_no, list_distinct(list_transform(range(1, length(t)), lambda i: substring(t, i, 2))) b from (select doc_id, seq, {strip('text')} t from lines) where length(t) > 1),
x as (select track, n, doc_id, line_no, 2.0::double * len(list_intersect(a, b)) / (len(a) + len(b)) score from g, s),
best as (select *, row_number() over (partition by track, n, doc_id order by score desc, line_no) r from x where score >= 0.5)
select track, doc_id, cast(trunc(median(line_no)) as bigint) anchor from best where r = 1 group by track, doc_id""",
    "longest_prefix": """
with e as (select * from (values ('http', 'any'), ('https://blog', 'blog'), ('HTTPS://', 'secure'), ('http://www.', 'www'), ('https://blog.th', 'th')) t(key, entry))
select page_id, (select entry from e where starts_with(lower(url), lower(key)) order by length(key) desc limit 1) entry from pages""",
    "name_tier_join": """
with w as (select p_partkey seq, case p_partkey % 4 when 0 then upper(p_name) when 1 then string_split(p_name, ' ')[-1] when 2 then p_name || '_' || p_partkey else 'no-such ' || p_partkey end as name from part),
k as (select name, seq, lower(regexp_replace(name, '[\\s_\\-]', '', 'g')) key from w),
h as (select p_name as match, min(p_partkey) match_seq, lower(regexp_replace(p_name, '[\\s_\\-]', '', 'g')) match_key from part group by p_name),
m as (select name, seq, match, match_seq, case when key = match_key then 1 when contains(key, match_key) or contains(match_key, key) then 2 end tier from k, h),
b as (select *, row_number() over (partition by name, seq order by tier, match_seq) r from m where tier is not null)
select w.name, w.seq, b.match, b.tier from w left join b on b.name = w.name and b.seq = w.seq and b.r = 1""",
    "term_merge": """
with p as (select p_size as work, p_type || ' ' || p_brand src, p_name, p_partkey from part),
u as (select work, src, 'own ' || max(p_name) tgt, 0 p from p where p_partkey % 3 = 0 group by work, src
  union all select work, src, 'world ' || max(p_name), 1 from p where p_partkey % 3 <> 1 group by work, src union all select work, src, 'shared ' || max(p_name), 2 from p group by work, src)
select work, src, arg_min(tgt, p) tgt from u group by work, src""",
    "natural_sort": """
with s as (select s_suppkey, (s_suppkey % 3)::varchar dir, regexp_replace(s_name, '0*([0-9]+)$', '\\1') stem from supplier)
select s_suppkey, dir, cast(row_number() over (partition by dir order by coalesce(try_cast(nullif(regexp_extract(stem, '[0-9]+'), '') as hugeint), 999999), stem) as integer) place from s""",
    "usage_window_cum": """
with t as (select user_id cue, event_id seq, event_type word, event_id * 10 as s, event_id * 10 + 7 as e from events)
select cue, seq, coalesce(s - lag(e) over w, 0) gap, cast(sum(length(word)) over (partition by cue order by seq rows unbounded preceding) as bigint) chars_to, e - first(s) over (partition by cue order by seq rows unbounded preceding) elapsed
from t window w as (partition by cue order by seq)""",
    "lrc_roundtrip": f"""
with {CUE_LINES}, l as (select file, seq, ((time_ms + 5) // 10) * 10 ms, {strip('text')} text from lines),
r as (select *, ms // 60000 m, (ms % 60000 // 10) / 100.0::double s from l)
select file, cast(seq as integer) seq, cast(trunc((m * 60 + s) * 1000) as bigint) time_ms, cast(ms as bigint) rounded_ms, md5(text) text from r""",
    "lrc_structure": f"""
with {CUE_LINES}, slots as (
  select file, turn, 0 k, {stamp('min(time_ms) filter (where k = 0)')} || replace(array_to_string(list(case when k = 0 then regexp_replace(text, '^\\s+', '') else {strip('text')} end order by k) filter (where k = 0 or {strip('text')} <> ''), ' '), 'e', 'EE') line
  from lines group by file, turn),
every as (select * from slots union all select file, turn, k, text from lines where k > 0 and {strip('text')} = '' union all select distinct file, -1, 0, '[ti:title]' from lines),
f as (select file, string_agg(line, chr(10) order by turn, k) || chr(10) content from every group by file)
select file, cast(length(content) as integer) chars, md5(content) content from f""",
    "srt_clean": f"""
with {CUES}, f as (select file, string_agg((seq + 1) || chr(10) || '00:00:01,000 --> 00:00:02,000' || chr(10) || case when seq % 3 = 1 then '' else text || chr(10) end, chr(10) order by seq) content from cues group by file),
b as (select file, list_filter(list_transform(string_split_regex(regexp_replace(content, '^\\n+|\\n+$', '', 'g'), '\\n[ \\t]*\\n'), lambda x: {strip('x')}), lambda x: x <> '') b from f),
k as (select file, b, list_filter(b, lambda x: not (contains(x, '-->') and {strip("regexp_replace(x, '(?s)^.*?-->[^\\n]*', '')")} = '')) kept from b)
select file, len(b) - len(kept) removed, md5(case when len(kept) > 0 then array_to_string(kept, chr(10) || chr(10)) || chr(10) else '' end) content from k""",
    "layout_order": f"with {_boxes()} select page, text, cast(row_number() over (partition by page order by round_even(cy / 30, 0), cx, cy, text) as integer) nth from boxes",
    "glyph_histogram": """
with g as (select l_returnflag doc, l_quantity x, floor(l_extendedprice / 100) y from lineitem)
select doc, 'x' axis, cast(floor(x / 20) * 20 as bigint) bin, count(*) n from g group by 1, 3 union all select doc, 'y', cast(floor(y / 30) * 30 as bigint), count(*) from g group by 1, 3""",
    "translate_stub": f"with {CUES} select file, seq, md5('» ' || text) new_text, 'json' how from cues",
    "label_excel": """
with ks as (select k, cast((26.0::double ** k - 26) / 25 as bigint) below, cast((26.0::double ** (k + 1) - 26) / 25 as bigint) above from range(1, 9) r(k))
select p_partkey i, array_to_string(list_transform(range(k), lambda j: chr(cast(65 + (p_partkey - below) // cast(26.0::double ** (k - 1 - j) as bigint) % 26 as integer))), '') as label
from part join ks on p_partkey >= below and p_partkey < above""",
    "time_stamps": f"""
with {USAGE}
select seq, {stamp('hit * 977')} stamp, {hms('(miss * 13)')} shown, round(case when hit + miss > 0 then hit::double / (hit + miss)::double * 100.0::double else 0.0::double end, 6) rate,
       case when hit * 7 >= 10000 then regexp_replace((hit * 7)::varchar, '(\\d)(\\d{{3}})$', '\\1,\\2') else (hit * 7)::varchar end tokens from usage""",
    "work_roots": """
with p as (select page_id, 'lib/' || case when page_id % 3 = 0 then 'rj' || (page_id + 100000) || '/' else '' end || 'disc/' || page_id || '.lrc' path from pages)
select page_id, case when page_id % 3 = 0 then 'lib/rj' || (page_id + 100000) else 'lib/disc' end root, case when page_id % 3 = 0 then 'RJ' || (page_id + 100000) end number from p""",
    "txt_over_pdf": """
with f as (select 'd' || (page_id // 20) dir, 'n' || case when page_id % 5 = 0 then page_id else page_id // 2 end stem, case when page_id % 2 = 0 then '.txt' else '.pdf' end ext from pages),
k as (select *, max(ext = '.txt') over (partition by dir, stem) twin from f), r as (select * from k where not (ext = '.pdf' and twin))
select dir || '/' || stem || ext path, cast(row_number() over (partition by dir order by cast(stem[2:] as bigint), stem, dir || '/' || stem || ext) as integer) place from r""",
    "script_names": """
select p_partkey, case when p_partkey % 11 = 0 then false when p_partkey % 7 in (1, 5) then false when p_partkey % 7 in (0, 2, 6) then true when p_partkey % 13 = 0 then true else p_partkey % 7 = 3 end script from part""",
    "variant_inherit": """
with p as (select p_size as work, p_name || ' ' || p_partkey track, replace(p_name, ' ', '|') lines from part)
select * from p union all select work, track || '（room）', lines from p""",
    "coverage_fill": """
with n as (select p_partkey % 97 as work, p_partkey k, (p_partkey % (p_partkey % 97 % 3 + 2) = 0)::int a from part),
c as (select *, avg(a) over (partition by work) c from n), l as (select work, case when a = 1 then 1 when c < 0.5 and k % 2 = 0 then 2 else 0 end n from c)
select work, count(*) tracks, count(*) filter (where n > 0) matched, cast(sum(n) as bigint) total, sum(n) > 0 and count(*) filter (where n > 0) * 1.0::double / count(*) >= 0.3 accepted from l group by work""",
    "error_kinds": """
with e as (select [200, 400, 429, 500, 402][event_id % 5 + 1] status, ['ok', 'Unsupported value', 'rate limit', 'connection reset', 'no credit', 'timed out'][event_id % 6 + 1] said from events)
select status, said, count(*) n, status in (400, 422) or said = 'Unsupported value' parameter, said not in ('connection reset', 'timed out') and (status in (429, 402, 403) or said in ('rate limit', 'no credit')) quota
from e group by status, said""",
    "usage_normal": """
select event_id, event_id prompt_tokens, case when event_id % 2 = 0 then 3 else 7 end::bigint hit_tokens, case when event_id % 2 = 0 then 5 when event_id > 0 then event_id - 7 else 0 end::bigint miss_tokens,
       case when event_id % 2 = 0 then 2 else 0 end::bigint completion_tokens, case when event_id % 2 = 0 then 0 else 4 end::bigint reasoning_tokens from events""",
    "chunk_tokens": f"with {USAGE} select user_id file, cast(sum(hit) as bigint) all_hits, arg_max(hit, seq) last_hits from usage group by user_id",
    "box_columns": """
with b as (select o_orderkey // 128 page, o_totalprice % 600 cx, (o_orderkey % 13 + 5)::double h from orders),
c as (select page, count(*) filter (where m >= 2) columns from (select page, round_even(cx / 30, 0) k, count(*) m from b group by 1, 2) group by page)
select page, count(*) >= 4 and (avg((h > 12)::int) > 0.3 or max(columns) >= 2) vertical from b join c using (page) group by page""",
    "box_reading_order": f"""
with {_boxes("o_custkey % 40 + 100")}, k as (select *, h > w * 1.2 tall, case when h > w * 1.2 then 'v' when w > h then case when length(text) < 20 then 'v' else 'w' end else 's' end kind from boxes),
j as (select *, round_even(cx / 30, 0) col, case when cy - lag(cy) over (partition by page, kind <> 'w', round_even(cx / 30, 0) order by cy) > 100 then 1 else 0 end jump from k),
g as (select *, sum(jump) over (partition by page, kind <> 'w', col order by cy rows unbounded preceding) grp from j),
t as (
  select page, 0 part, -col k1, grp k2, string_agg(text, '' order by cy, text) text from g where kind <> 'w' group by page, col, grp
  union all
  select page, 1, round_even(cy / 50, 0), cx, text from k where kind = 'w' and w <= 1000 and not exists (select 1 from k v where v.page = k.page and v.kind = 'v' and contains(v.text, k.text)))
select page, cast(row_number() over (partition by page order by part, k1, k2, text) as integer) nth, text from t""",
    "line_quality": f"""
with {DOC_LINES}, every as (select lang, text from lines union all select * from (values ('ja', '漢字かな交じり'), ('ja', '♡♪ab'), ('ja', '12')) t(lang, text)),
s as (select lang, {strip('text')} s from every), k as (select * from s where s <> '' and not regexp_matches(s, '^\\d+$'))
select lang, round(sum({count('s', '[\\x{3040}-\\x{309f}\\x{30a0}-\\x{30fa}\\x{4e00}-\\x{9fff}]')} - 2.0::double * {count('s', '[♡♪/＝・…※✧⩌⩊]')}) / greatest(sum(length(s)), 1), 9) quality from k group by lang""",
    "speech_time": f"""
with {CUES}, w as (select file, seq, string_split({strip("regexp_replace(text, '\\s+', ' ', 'g')")}, ' ') w from cues),
n as (select file, seq, len(w) * 280 ms, length(array_to_string(w, '')) chars from w)
select file, seq, cast(ms as bigint) speech_ms, chars > 0 and (chars > 40 or (chars >= 6 and ms / 1000.0 > 8.5)) too_long from n""",
    "resegment_local": f"with recursive {PIECES} select file, seq, cast(piece as integer) piece, time_ms, end_ms, text from pieces where text <> ''",
    "resegment_rounds": f"""
with recursive {PIECES}, wishes as (
  select *, case when seq % 3 <> 1 then range(7, n, 7) when seq % 2 = 0 then [3] end ks from long),
legal_ks as (select file, seq, list(k) filter (not final) legal from legal group by file, seq),
checked as (
  select w.*, coalesce(len(ks) > 0 and len(list_filter(ks, lambda k: not coalesce(list_contains(legal, k), false))) = 0
    and len(list_filter(range(len(ks) + 1), lambda i: length(array_to_string(w[coalesce(list_concat([0], ks)[i + 1], 0) + 1:list_concat(ks, [n])[i + 1]], '')) not between 2 and 40)) = 0, false) valid
  from wishes w left join legal_ks using (file, seq)),
ways as (select c.*, b.file is not null cut from checked c left join (select distinct file, seq from best) b using (file, seq))
select file, count(*) long, cast(count(*) + count(*) filter (where seq % 3 = 1) as bigint) asked, count(*) filter (where ks is null) unanswered, count(*) filter (where valid) proposed,
       count(*) filter (where not valid and cut) searched, count(*) filter (where not valid and not cut and chars > 40) rejected, count(*) filter (where not valid and not cut and chars <= 40) kept from ways group by file""",
    "json_ladder": rf"""
with {CUES}, t as (select file, list(upper(replace(regexp_replace(text, '["\\\n]', ' ', 'g'), 'ß', 'SS')) order by seq) l from cues group by file)
select file, cast(len(l) as integer) parsed, 'json' how, md5(array_to_string(l, '|')) texts from t""",
    "cut_requests": f"""
with recursive {PIECES}, shown as (
  select l.file, l.seq, l.k, case when t > 26 then chr(cast(64 + (t - 1) // 26 as integer)) else '' end || chr(cast(65 + (t - 1) % 26 as integer)) label, case when regexp_matches(l.l, '[。！？!?、，,…]$') then 'S' else 'P' end as level,
         c, e - g.time_ms ms, right(array_to_string(w[1:k], ''), 16) || '|' || left(array_to_string(w[k + 1:], ''), 16) preview from legal l join long g using (file, seq) where not final),
lists as (select file, seq, count(*) n, string_agg(label || ' ' || level || ' ' || c || ' ' || ms || ' ' || preview, chr(10) order by k) x from shown group by file, seq)
select file, seq, cast(chars as integer) chars, (l.n - 1) * 300 + (l.n - 1) // 7 * 400 + 280 ms, cast(coalesce(s.n, 0) as integer) n, md5(coalesce(x, '')) choices, case when s.n > 0 then 'A' end as first from long l left join lists s using (file, seq)""",
    "split_and_render": f"""
with recursive {PIECES}, items as (
  select file, seq, piece, coalesce(p.time_ms, t.time_ms) time_ms, end_ms from timed t left join pieces p using (file, seq)),
next as (select *, lead(time_ms) over (partition by file order by seq, piece) follow from items)
select file, count(*) lyrics, count(*) filter (where piece is not null and (follow is null or follow - end_ms >= 800)) clears, true lossless from next group by file""",
    "layout_glyphs": f"with {PAGE_GLYPHS}, {glyph_lines('lines', 'glyphs', True, 'flag')} select doc, page, cast(line as integer) line, cast(length(text) as integer) glyphs, md5(text) as text from lines",
    "page_votes": f"""
with {PAGE_GLYPHS}, ranks as (select *, dense_rank() over (partition by doc order by page) r, count(*) over (partition by doc, page) n from glyphs),
first as (select * from ranks where r <= 3 and n >= 20), shown as (select * from first where {strip('letter')} <> ''),
{glyph_lines('down', 'shown', True, 'letter')}, {glyph_lines('across', 'first', False, "case when letter in ('7', '1', '22') then '' else letter end")},
v as ({quality('down')}), h as ({quality('across')}),
votes as (select doc, sum(sign(coalesce(h.q, 0) - coalesce(v.q, 0))) votes from v full join h using (doc, page) group by doc)
select doc, coalesce(votes, 0) > 0 horizontal from (select distinct doc from glyphs) left join votes using (doc)""",
    "name_similarity": """
with p as (select p_partkey, p_name a, lead(p_name) over (partition by p_brand order by p_partkey) b from part)
select p_partkey, contains(a, b) or contains(b, a) or len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substring(a, i, 1) = substring(b, i, 1))) * 1.0::double / least(length(a), length(b)) > 0.5 as similar
from p where b is not null""",
    "archived_originals": """
with p as (select page_id, ['.lrc', '.srt', '.vtt'][page_id % 3 + 1] ext, page_id % 5 <> 0 live, page_id % 2 = 0 kept from pages)
select ext, count(*) filter (where live or kept) n, count(*) filter (where kept and not live) restored, count(*) filter (where live and not kept) to_archive, count(*) filter (where live and kept) with_original from p group by ext""",
}
