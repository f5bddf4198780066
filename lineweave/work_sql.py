"""DuckDB SQL for the queries of ``lineweave.work_queries``."""

from __future__ import annotations

from .functions.text import ALIGN_SYMBOLS, ECHO_SYMBOLS, HIRAGANA, KATAKANA
from .sql import CUE_LINES, CUES, DOC_LINES, HAN, KANA_LETTERS, S, count, stamp, strip
from .work_queries import NOISE

PARTS = "p as (select p_size as work, p_partkey k, p_name as name, p_type kind from part)"


def pick(n: str, *values: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][{n} % {len(values)} + 1]"


#: Turns as cues of whole files, with the lines that are spoken: those before the first blank one.
SPOKEN = f"""turns as (
  select cast(conv_id as varchar) file, turn, string_split(text, chr(10)) l from conversations),
spoken as (select file, turn, list_slice(l, 1, coalesce(list_position(list_transform(l, lambda x: {strip('x')} = ''), true) - 1, len(l))) l, l[1] one from turns)"""
MARK = pick("cast(file as bigint)", "かな漢字 ", "漢字 ", "")
LISTING = """f as (select page_id n, 'lib/d' || (page_id % 8) dir, 'n' || (page_id // 3) stem, ['.MP3', '.lrc', '.ja.lrc'][page_id % 3 + 1] ext, page_id * 7919 % 1009 t from pages)"""
LOG = """log as (
  select 'lib/w' || (user_id % 20) as work, 'f' || user_id || '.lrc' file, row_number() over (partition by user_id order by event_id) - 1 attempt, event_id % 9 lines, event_id,
         case when event_id % 3 = 0 then 'success' when event_id % 11 = 0 then 'skipped' else 'failed' end status, (event_id % 100)::double elapsed, event_type from events)"""
LATEST = "latest as (select work, file, arg_max(status, attempt) status, arg_max(elapsed, attempt) elapsed from log group by work, file)"
GLYPHS = "g as (select l_returnflag || l_orderkey // 4096 doc, l_linenumber page, l_extendedprice % 500 x, floor(l_quantity / 13) * 8 y, l_linestatus text, l_orderkey * 10 + l_linenumber seq, l_partkey part from lineitem)"


def quoted(pattern: str) -> str:
    """A Java pattern of one character class as RE2 in a SQL string."""
    return pattern.replace("\\s", S).replace("'", "''")


def noise(x: str) -> str:
    s = strip(x)
    return f"({s} = '' or starts_with({s}, '※') or (regexp_matches({s}, '^[ぁ-んァ-ン♥……っ！!～~。、{S}]+$') and length({s}) < 8))"


def pre_clean(x: str) -> str:
    for pattern, by in ((f"<!--[{S}]*page[{S}]+\\d+[{S}]*-->", ""), ("ＳＥ：[^\\n]*", ""), (f"(?i)SE[{S}]*[:：][^\\n]*", ""), (f"(?m)^\\d{{1,4}}[{S}]*$", ""), (f"(?m)^\\d+/\\d+[{S}]*$", ""), ("\\n{3,}", "\n\n")):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return strip(x)


WORK_SQL = {
    "lrc_item_scan": rf"""
with {CUE_LINES}, l as (select file, seq, case k % 4 when 1 then text when 2 then {stamp('time_ms')} when 3 then {stamp('time_ms')} || '  ' || text else {stamp('time_ms')} || text end line from lines),
m as (select *, regexp_extract(line, '^\[(\d+):(\d+(?:\.\d+)?)\](.*)$', ['a', 'b', 'c']) x, regexp_matches(line, '^\[(\d+):(\d+(?:\.\d+)?)\](.*)$') timed from l)
select file, cast(seq as integer) line_no, case when not timed then 'raw' when {strip('x.c')} = '' then 'clear' else 'lyric' end item_type,
       case when timed then cast(round_even((try_cast(x.a as bigint) * 60 + try_cast(x.b as double)) * 1000, 0) as bigint) end time_ms, md5(case when timed then {strip('x.c')} else '-' end) text from m""",
    "spoken_text_scan": f"""
with {SPOKEN}, each as (
  select file || ext file, turn, ext, case when ext = '.lrc' then [{strip(f"{MARK} || one")}] else list_transform(l, lambda x, i: {strip(f"case when i = 1 then {MARK} || x else x end")}) end t from spoken, (values ('.lrc'), ('.srt'), ('.vtt')) e(ext)),
f as (select file, flatten(list(t order by turn)) t from each group by file),
c as (select file, t, {count("array_to_string(t, '')", KANA_LETTERS)} kana, {count("array_to_string(t, '')", HAN)} han from f)
select file, len(t) n, md5(array_to_string(t, '|')) texts, case when len(t) = 0 then 'empty' when (kana > 0 and han > 0 and kana * 1.0::double / han > 0.1) or (kana > 0 and han = 0) then 'japanese' when han > 0 then 'chinese' else 'unknown' end as language from c""",
    "normal_texts": f"""
with d as (select doc_id, text || chr(10) || 'カタカナ、「かな」ヴヶ！' t from documents)
select doc_id, md5(translate(regexp_replace(t, '{quoted(ALIGN_SYMBOLS)}', '', 'g'), '{KATAKANA}', '{HIRAGANA}')) normal, cast(length(regexp_replace(t, '{quoted(ECHO_SYMBOLS)}', '', 'g')) as integer) echo,
       cast(length(regexp_replace(t, '[{S}]', '', 'g')) as integer) compact from d""",
    "legal_cut_levels": f"""
with {CUES}, w as (select file, seq, string_split({strip("regexp_replace(text, '\\s+', ' ', 'g')")}, ' ') w from cues),
k as (select file, seq, w[k] l, w[k + 1] r, k, k * 300 + k // 7 * 400 - ((k - 1) * 300 + (k - 1) // 7 * 400 + 280) gap from (select *, unnest(range(1, len(w))) k from w)),
c as (select file, seq, k, case when regexp_matches(l, '[。！？!?、，,…]$') then case when not regexp_matches(r, '^[。！？!?、，,…]') then 'S' end when gap >= 300 then 'P' end as level from k)
select file, seq, count(*) filter (where level = 'S') stops, count(*) filter (where level = 'P') pauses, cast(sum(k) as bigint) places from c where level is not null group by file, seq""",
    "pre_clean_merge": f"""
with d as (select doc_id, {pre_clean("'<!-- page 3 -->' || chr(10) || 'SE: bang' || chr(10) || '12' || chr(10) || '3/4' || repeat(chr(10), 4) || text || chr(10) || 'short' || chr(10) || '■mark' || chr(10) || '12abc（note）'")} t from documents),
m as (
  select *, list_reduce(list_transform(string_split(t, chr(10)), lambda x: [{strip('x')}]), lambda acc, x:
    case when x[1] <> '' and coalesce(acc[-1], '') <> '' and length(x[1]) < 10 and not regexp_matches(x[1], '^[◆■○●]') then list_concat(acc[:-2], [acc[-1] || x[1]]) else list_concat(acc, x) end, []::varchar[]) merged,
    list_transform(string_split(t, chr(10)), lambda x: case when {strip('x')} = '' or starts_with({strip('x')}, '<!--') or regexp_matches({strip('x')}, '^\\d+$') then x
      else case when regexp_matches(regexp_replace({strip('x')}, '^\\d{{1,3}}([^\\d{S}])', '\\1'), '^\\d+$') then '' else regexp_replace({strip('x')}, '^\\d{{1,3}}([^\\d{S}])', '\\1') end end) numbers from d)
select doc_id, cast(length(t) as integer) cleaned, cast(length(array_to_string(list_filter(merged, lambda x: x <> ''), chr(10))) as integer) merged, cast(length(array_to_string(numbers, chr(10))) as integer) numbers,
       cast(length({strip("regexp_replace(regexp_replace(t, '[（(][^）)]*[）)]', '', 'g'), '[（(].*$', '')")}) as integer) bare from m""",
    "script_marks": f"""
with d as (select concat_ws('/', lang, ((doc_id - (doc_id % 9 + 9) % 9) // 9)::varchar) as work, (doc_id % 9 + 9) % 9 + 1 n, text from documents where doc_id is not null),
s as (select work, n, string_agg(text, chr(10) order by text) text from d group by work, n),
l as (select work, n, list_filter(list_transform(string_split('トラック' || n || chr(10) || text, chr(10)), lambda x: {strip('x')}), lambda x: x <> '' and not starts_with(x, '※') and not regexp_matches(x, '^[《【].*[》】]$')) l from s)
select work, 'tr0' || n track, cast(len(l) as integer) n_lines, md5(array_to_string(l, chr(10))) lines from l""",
    "timeline_files": f"with {CUE_LINES} select file, md5(string_agg({stamp('time_ms')} || replace(text, 'e', 'EE'), chr(10) order by seq)) content from lines where seq % 5 <> 4 group by file",
    "sibling_files": f"""
with {SPOKEN}, s as (select file, flatten(list(l order by turn)) t from spoken group by file)
select 'd/c' || file || ext file, cast(i - 1 as integer) slot, md5(replace(t[i], 'e', 'EE')) new_text from (select file, t, unnest(range(1, len(t) + 1)) i from s where cast(file as bigint) % 4 <> 0), (values ('.srt'), ('.vtt')) e(ext)""",
    "blank_cue_writer": f"""
with {CUES}, c as (select *, seq % 3 = 1 and cast(file as bigint) % 5 <> 0 gone, (seq + 1) || chr(10) || '00:00:01,000 --> 00:00:02,000' || chr(10) head from cues where cast(file as bigint) % 2 = 0),
f as (select file, count(*) filter (where gone) n, string_agg(head || case when gone then '' else text || chr(10) end, chr(10) order by seq) backup,
  string_agg({strip("head || text")}, chr(10) || chr(10) order by seq) filter (where not gone) || chr(10) content from c group by file)
select file, md5(content) content, md5(backup) backup, cast(1 as integer) n from f where n > 0
union all select 'all', count(*)::varchar, (count(*) filter (where n > 0))::varchar, cast(sum(n) as integer) from f""",
    "translated_files": f"""
with {CUE_LINES}, t as (select * from lines where cast(file as bigint) % 3 <> 1),
slots as (select file, turn, 0 k, {stamp('min(time_ms) filter (where k = 0)')} || '» ' || array_to_string(list(case when k = 0 then regexp_replace({MARK} || text, '^\\s+', '') else {strip('text')} end order by k) filter (where k = 0 or {strip('text')} <> ''), ' ') line from t group by file, turn),
every as (select * from slots union all select file, turn, k, text from t where k > 0 and {strip('text')} = '' union all select distinct file, -1, 0, '[ti:title]' from t),
f as (select file, string_agg(line, chr(10) order by turn, k) || chr(10) content from every group by file)
select file, cast(length(content) as integer) chars, md5(content) content from f""",
    "untranscribed_audio": "select 'lib/d' || (page_id % 4) || '/n' || page_id || case when page_id % 2 = 0 then '.MP3' else '.wav' end path, case when page_id % 2 = 0 then '.mp3' else '.wav' end ext from pages where page_id % 3 <> 0",
    "track_stem_scan": f"with {LISTING} select distinct stem from f where ext <> '.ja.lrc'",
    "live_by_time": f"""
with {LISTING}, k as (select * from f where dir <> 'lib/d7'), live as (select dir, stem, t from k where ext = '.lrc'),
every as (select * from live union all select dir, stem, t from k a where ext = '.ja.lrc' and not exists (select 1 from live l where l.dir = a.dir and l.stem = a.stem))
select dir || '/' || stem || '.lrc' path, cast(row_number() over (partition by dir order by t, dir || '/' || stem || '.lrc') as integer) nth from every""",
    "script_discovery": f"""
with {PARTS}, l as (select k, work, case when k % 3 = 0 and work % 2 = 0 then 'Script' when k % 3 = 1 then '05.台本' else 'misc' end folder, {pick('k', '台本', 'readme', 'トラック３', 'x_cleaned台本')} head, {pick('k', '.txt', '.PDF', '.txt', '.txt', '.doc')} ext from p),
s as (select 'lib/w' || work || '/' || folder || '/' || head || k || ext path, 'w' || work as work, case folder when 'Script' then 1 when '05.台本' then 2 else 3 end tier from l where ext <> '.doc' and head in ('台本', 'トラック３'))
select work, path, tier, true candidate from s qualify tier = min(tier) over (partition by work)""",
    "word_sidecars": """
with b as (select page_id n, 'w/d' || (page_id % 8) d from pages), w as (select distinct d from b where n % 8 = 1), v as (select distinct d from b where n % 8 in (1, 3))
select d || '/t' || n || '.mp3' track, case when n % 5 = 0 then d || '/raw/t' || n || '.words.jsonl' when n % 3 = 0 then d || '/t' || n || '.words.jsonl' when n % 2 = 0 then d || '/raw/t' || n || '.jsonl'
  when d in (from w) then d || '/raw/words.jsonl' else d || '/words.jsonl' end words
from b where n % 5 = 0 or n % 3 = 0 or n % 2 = 0 or d in (from v)""",
    "presplit_names": f"with {PARTS} select work, avg((k % (work % 3 + 2) = 0 or k % 7 = 0)::int) >= 0.5 presplit from p group by work",
    "files_of_tracks": f"""
with {PARTS}, t as (select work, k seq, 'Tr.' || (k % 40) || ' ' || name || k track, k % 40 n from p)
select p.work, p.k::varchar path, arg_min(t.track, t.seq) track from p join t on t.work = p.work and t.n = p.k % 30 group by p.work, p.k""",
    "free_talk_works": f"with {PARTS} select k as work from p where k % 6 not in (0, 2, 4)",
    "noise_lines": f"with {DOC_LINES}, every as (select lang, text from lines union all select * from (values {NOISE}) t(lang, text)) select lang, count(*) n, count(*) filter (where {noise('text')}) noise from every group by lang",
    "decoded_scripts": f"select doc_id, md5(case when doc_id % 5 = 0 then 'テスト。 1' when doc_id % 7 = 0 or {strip('text')} = '' then 'none' else text end) text from documents",
    "raw_script_tracks": f"""
with d as (select lang as work, row_number() over (partition by lang order by doc_id) track, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), lambda x: x <> '') l from documents)
select work, cast(track as integer) track, len(l) n, md5(array_to_string(l, chr(10))) lines from d where len(l) > 0""",
    "bar_tables": f"select doc_id, contains(h, '|') and (contains(h, '日本語') or contains(h, '中国語') or contains(h, '中文') or contains(h, '原文') or contains(h, '訳文') or contains(h, '译文')) bar from (select doc_id, substr({pick('doc_id', '原文|訳文' + chr(10), 'a|b' + chr(10), '中文 ' + chr(10))} || text, 1, 500) h from documents)",
    "accepted_texts": f"""
with d as (select doc_id::varchar id, text from documents union all select doc_id || 'h', string_split(text, chr(10))[1] || case when doc_id % 2 = 0 then 'かなかなかな' else '' end from documents)
select id, length(text) > 100 and (length(text) > 500 or {count('text', '[぀-ヿ一-鿿]')} * 1.0::double / greatest(length(text), 1) > 0.03) accepted from d""",
    "ranged_scripts": f"""
with d as (select doc_id as work, string_split(text, chr(10)) l from documents),
cut as (
  select work, 'tr01' track, case when len(l) >= 1 then list_slice(l, 1, 3) else [] end l from d union all
  select work, 'tr02', case when len(l) >= 4 then list_slice(l, 4, 99) else [] end from d),
clean as (select work, track, list_filter(string_split({pre_clean("array_to_string(l, chr(10))")}, chr(10)), lambda x: not {noise('x')}) l from cut),
every as (
  select * from clean union all select work, 'tr03', [] from d union all select work, 'tr04', ['one ' || work, 'two'] from d union all select work, 'tr05', [] from d),
n as (select work, md5(array_to_string(list_transform(l, lambda x, i: lpad(i::varchar, 5, '0') || '|' || x), chr(10))) numbered from d)
select work, track, cast(len(l) as integer) n, md5(array_to_string(l, chr(10))) lines, numbered from every join n using (work)""",
    "resolved_scripts": """
with p as (select p_partkey % 89 as work, p_partkey k, p_name as name from part),
l as (select work, k, case when k % (work % 5 + 1) = 0 then 'c ' || name end c, case when k % (work % 7 + 1) = 0 then 'a ' || name end a, case when k % 2 = 0 then 'm ' || name end m from p),
s as (select *, count(c) over (partition by work) * 1.0::double / count(*) over (partition by work) cs, count(a) over (partition by work) * 1.0::double / count(*) over (partition by work) sa from l)
select work, 't' || k track, coalesce(case when cs >= 0.3 then c when a is null and sa < 0.5 then m else a end, '') lines from s""",
    "cached_script_reuse": """
with p as (select p_partkey % 91 as work, p_partkey k, lpad(p_partkey::varchar, 8, '0') track, p_name as name from part),
n as (select *, count(*) over (partition by work) n, count(*) filter (where work % 3 = 1 and k % 4 < work % 5) over (partition by work) m from p),
l as (
  select work, track, case when k % 5 < 3 then name || '|x' else '' end lines from n where work % 3 = 0 and work % 6 <> 3 union all
  select work, track, case when k % 4 < work % 5 then 'a|b' || name else '' end from n where work % 3 = 1 and m >= n * 0.5 and m > 0),
c as (select *, count(*) filter (where lines <> '') over (partition by work) g, count(*) over (partition by work) t from l)
select work, track, lines from c where g > 0 and g * 1.0::double / t >= 0.3""",
    "asr_first_lines": f"""
with {CUE_LINES}, t as (select file, seq, {strip('text')} text, row_number() over (partition by file order by seq) n from lines where seq % 4 <> 1 and {strip('text')} <> '')
select file track, md5(string_agg(text, chr(10) order by seq)) text from t where n <= 15 group by file""",
    "exported_scripts": f"""
with {PARTS}, t as (select work::varchar as work, name || '/' || k track, case when k % 3 = 0 or work = 7 then [] else string_split(name, ' ') end l, replace(name, '/', '_') || '_' || k file from p),
full_ as (select work, '{{' || string_agg('"' || track || '":[' || array_to_string(list_transform(l, lambda x: '"' || x || '"'), ',') || ']', ',' order by track) || '}}' json from t group by work having sum(len(l)) > 0)
select work, '_scriptbook_export.txt' path, md5('raw ' || work) content from full_ union all select work, '_scriptbook_clean.json', md5(json) from full_
union all select work, '_split_tracks/' || file || '.txt', md5(array_to_string(l, chr(10))) from t where len(l) > 0""",
    "json_files": f"""
with {PARTS}, l as (select work, k % 50 key, arg_max(name, k) as name, max(k) k from p group by work, k % 50)
select work, md5('{{' || string_agg('"' || key || '":"' || name || '"', ',' order by k) || '}}') content from l group by work""",
    "term_files": f"""
with {PARTS}, t as (select work, k, name || ' ' || kind src from p)
select work, src || ' ' || k src, 't' || k tgt from t where work % 2 = 0 union all select work, src, arg_max('t' || k, k) from t where work % 2 = 1 group by work, src""",
    "alias_lists": f"with {PARTS} select k, case when k % 3 = 0 then replace(name, ' ', '|') else '' end names from p",
    "world_files": f"""
with p as (select p_partkey % 97 as work, p_partkey k, p_name || ' ' || p_partkey v, {pick('(p_partkey + p_partkey // 97)', 'world.txt', 'worldview.json', '.worldview.json', 'scene.md', 'notes.txt', 'setting.json')} as name from part),
r as (select *, case when name in ('world.txt', 'worldview.json', '.worldview.json') then 'w' when name in ('scene.md', 'setting.json') then 's' end kind, case when name = '.worldview.json' then -1 else k end rank from p),
hidden as (select work, min(k) first_hidden, count(*) n from r where rank = -1 group by work)
select work, arg_max(v, rank) filter (where kind = 'w') worldview, arg_max(v, rank) filter (where kind = 's') scene from r where kind is not null group by work""",
    "world_people": """
with p as (select p_partkey % 83 as work, p_partkey k, p_name || ' ' || p_partkey v from part),
u as (select work, 'p ' || v src, 'own' tgt, 0 o from p where k % 3 = 0 union all select work, 'p ' || v, 'cn ' || v, 1 from p union all select work, 's ' || v, 't ' || v, 2 from p union all
  select work, 'g ' || v, 'shared', 3 from p where k % 2 = 0 and k % 5 = 0)
select work, src, arg_min(tgt, o) tgt from u group by work, src""",
    "work_context": f"""
with {PARTS}, t as (select work, name || ' ' || kind src, 't' || max(k) tgt from p group by work, name || ' ' || kind), r as (select *, row_number() over (partition by work order by src) n from t),
l as (select work, string_agg(src || '→' || tgt, '|' order by src || '→' || tgt) terms from r where n <= 5 group by work)
select p.work, p.k, l.terms from p left join l using (work)""",
    "same_reading_terms": f"""
with {PARTS}, t as (select work, k, lower(string_split(name || ' ' || kind, ' ')[1] || (k % 3)) reading from p),
g as (select work, reading, count(*) n, min(k) first_, string_agg(k::varchar, ',' order by k) members from t group by work, reading)
select work, reading, cast(n as integer) n, n < 2 single, first_ as first, cast(row_number() over (partition by work order by n < 2, first_) as integer) nth, members from g""",
    "blank_values": f"with {PARTS} select k, case when k % 3 = 2 then 'own' else name end a, case when k % 2 = 0 then name else 'preset' end b, case when k % 2 = 0 then 'x' else '' end c from p",
    "matched_segments": f"""
with {CUE_LINES} select a.file, a.seq, b.seq seg from lines a join lines b on a.file = b.file and abs(b.time_ms + 10 - a.time_ms) <= 80 and b.seq % 3 <> 2
  and regexp_replace(a.text, '[{S}]', '', 'g') = regexp_replace(replace(b.text, ' ', ''), '[{S}]', '', 'g') where {strip('a.text')} <> ''""",
    "as_of_turns": f"with {CUE_LINES} select file, seq, turn seg, cast(len(list_filter(string_split(text, ' '), lambda w: w <> '')) as integer) n, time_ms as start from lines where {strip('text')} <> ''",
    "segment_fit": f"""
with {CUE_LINES}, n as (select file, cast(file as bigint) f, count(*) n from lines group by file) select file, f % 4 < 3 and f % 5 <> 0 fits from n where n > 1 or f % 5 <> 0""",
    "word_offsets": f"""
with {CUES}, w as (select file, seq, string_split({strip("regexp_replace(text, '\\s+', ' ', 'g')")}, ' ') w from cues),
h as (select *, len(w) // 2 h from w where len(w) > 1)
select file, seq, md5(array_to_string(list_transform(range(0, len(w)), lambda i: length(array_to_string(w[1:i], ''))), ',')) offsets, md5(right(array_to_string(w[1:h], ''), 16) || '|' || left(array_to_string(w[h + 1:], ''), 16)) preview from h""",
    "morpheme_cuts": f"""
with {CUE_LINES}, t as (select file, seq, list_filter(string_split(text, ' '), lambda w: w <> '') w from lines where {strip('text')} <> ''),
k as (
  select file, seq, w, k, w[k] l, w[k + 1] r, (k - 1) % 5 lp, k % 5 rp, case when (k - 1) % 10 = 1 then 1 when (k - 1) % 7 = 3 then 2 else 0 end l2, case when k % 10 = 1 then 1 when k % 7 = 3 then 2 else 0 end r2,
         k * 300 + k // 5 * 900 - ((k - 1) * 300 + (k - 1) // 5 * 900 + case when (k - 1) % 3 = 0 then 290 else 280 end) gap from (select *, unnest(range(1, len(w))) k from t)),
b as (
  select *, rp in (0, 2, 4) and lp <> 3 and not (r = l and length(r) >= 2) and not (l2 = 2 and r2 = 2) ok, lp = 1 and l2 = 1 clause, regexp_matches(l, '[。！？!?、，,…]$') stop, regexp_matches(r, '^[。！？!?、，,…]') opens,
         length(array_to_string(w[1:k], '')) left_, length(array_to_string(w[k + 1:], '')) right_ from k),
c as (
  select file, seq, k, case when stop then case when not opens then 'S' end when ok and gap >= 300 then 'P' when ok and clause then 'C' end as level from b union all
  select file, seq, k, 'W' from b where not stop and gap < 300 and not clause and ok union all
  select file, seq, k, 'G' from b where ok and gap >= 800 and not stop and not opens and left_ >= 3 and right_ >= 3)
select file, seq, level, count(*) n, cast(sum(k) as bigint) places from c where level is not null group by file, seq, level""",
    "cjk_gaps": "select doc_id, md5('漢字かなx ' || text || ' あい y') as \"all\", md5('漢字' || chr(10) || 'かなx ' || text || ' あい y') kept from documents" .replace("かなx ", "かな　x "),
    "float_stamps": """
with e as (select event_id, event_id * 997 ms, case event_id % 3 when 0 then round(event_id / 1e8, 6) when 1 then round(event_id / 2e6, 6) else event_id / 64.0::double end c from events)
select event_id, printf('[%02d:%05.2f]', cast(floor(ms / 1000.0::double / 60) as bigint), (ms / 1000.0::double) % 60) stamp, '¥' || case when c < 0.0001 then printf('%.6f', c) when c < 0.01 then printf('%.4f', c) else printf('%.2f', c) end cost from e""",
    "glyph_rows": f"""
with {GLYPHS}, b as (select doc, page, y, count(*) n, count(*) filter (where text <> 'O') other from g where y <> 16 group by doc, page, y)
select doc, page, cast(row_number() over (partition by doc, page order by y) as integer) line, cast(n as integer) n, cast(other as integer) other from b""",
    "glyph_files": """
with c as (select p_partkey, p_size, p_name[i + 1] c, i from (select *, unnest(range(length(p_name))) i from part))
select cast(p_partkey as integer) page, cast(i as integer) seq, c as text, case when i % 7 <> 3 then i * 10 + p_size::double else 0 end x, case when i % 7 <> 3 then round_even(i * 10 + p_size + 0.25::double, 1) else 0 end y,
       case when i % 7 <> 3 then 8.0::double else 0 end w, case when i % 7 <> 3 then round_even(12.25::double, 1) else 0 end h, 595.3::double page_w, 841.9::double page_h from c where c <> ' '""",
    "word_files": f"""
with {CUES}, t as (
  select file, seq, file || ' ' || seq key, time_ms, string_split({strip("regexp_replace(text, '\\s+', ' ', 'g')")}, ' ') w, (cast(file as bigint) + seq) % 6 r from cues)
select case when r in (0, 2, 5) then time_ms when r = 3 then 5 end as start, case when r in (0, 2, 5) then time_ms + (len(w) - 1) * 300 + (len(w) - 1) // 7 * 400 + 280 end as end, case when r in (0, 2, 5) then key when r = 3 then chr(65533) || key end as text,
       cast(case when r in (0, 2, 5) then len(w) end as integer) n, case when r in (0, 2, 5) then w[-1] end as last, case r when 1 then '{{"text": "' || key when 4 then '["' || key || '"]' end corrupt, r = 3 replaced from t""",
    "dense_page_glyphs": f"""
with {GLYPHS}, pages_ as (select doc, page, count(*) n, row_number() over (partition by doc order by count(*) desc, page) r from g group by doc, page having count(*) > 50),
k as (select doc, page, part, row_number() over (partition by doc, page order by g.seq, part, x) - 1 at_, n from g join pages_ using (doc, page) where r <= 3)
select doc, page, count(*) n, cast(sum(part) as bigint) parts from k where at_ % greatest(1, n // 150) = 0 group by doc, page""",
    "representative_files": "select seq % 50 grp, arg_max(seq::varchar, (n, -seq)) path from (select l_orderkey seq, count(*) n from lineitem group by l_orderkey) group by seq % 50",
    "body_blocks": """
with o as (select o_orderkey // 128 page, o_orderkey % 900 y0, o_orderkey % 900 + o_orderkey % 70 y1, o_orderkey k from orders),
b as (select page, count(*) blocks, md5(string_agg(k::varchar, ',' order by y0, k)) texts from o where y1 >= 100 and y0 <= 700 group by page)
select page, blocks, texts, glyphs from b join (select page, count(*) glyphs from o where y0 between 100 and 700 group by page) using (page)""",
    "run_log_files": f"""
with {LOG}, l as (select *, '---- ' || case when attempt = 0 then 'first round' else 'retry ' || attempt end || ' (' || status || printf(', %.1fs)', elapsed) || case when status = 'failed' and event_type <> '' then '  reason: ' || event_type else '' end line from log),
f as (select work, file, string_agg(line, chr(10) order by attempt) body, arg_max(status, attempt) status from l group by work, file)
select work, string_split(work, '/')[-1] || '/' || replace(file, '.lrc', '') || '.log' path, md5('track: ' || file || chr(10) || body || chr(10)) content from f
union all
select work, string_split(work, '/')[-1] || '.log', md5('work: ' || work || '  tracks: ' || count(*) || '  succeeded: ' || count(*) filter (where status = 'success') || chr(10) || string_agg(file || '  status: ' || status || chr(10) || body, chr(10) order by file) || chr(10)) from f group by work""",
    "retry_states": f"""
with {LOG}, w as (select *, min(attempt) filter (where status = 'success') over (partition by work, file) won from log),
s as (select work, file, coalesce(min(won) + 1, count(*)) attempts, case when min(won) is not null then 'success' else arg_max(status, attempt) end last from w group by work, file)
select work, file, cast(attempts as integer) attempts, case when last <> 'success' and attempts >= 3 then 'failed_for_good' else last end status, last <> 'success' and attempts < 3 retry from s""",
    "progress_counts": f"with {LOG} select event_id // 300 * 300 as start, status, count(*) n from log group by 1, 2",
    "batch_manifest": f"""
with {LOG}, {LATEST}, m as (
  select work, count(*) + case when work in ('lib/w3', 'lib/w8') then 1 else 0 end total, count(*) filter (where status = 'success') succeeded, count(*) filter (where status = 'failed') failed, count(*) filter (where status = 'skipped') skipped,
         round(sum(elapsed), 1) elapsed, work not in ('lib/w3', 'lib/w8') complete from latest group by work)
select *, complete named from m union all select 'all', cast(sum(total) as bigint), cast(sum(succeeded) as bigint), cast(sum(failed) as bigint), cast(sum(skipped) as bigint), round(sum(elapsed), 1), bool_and(complete), false from m""",
    "manifest_lines": f"""
with {LOG}, {LATEST} select work, '{{"work":"' || work || '","total":' || count(*) || ',"failed":' || count(*) filter (where status = 'failed') || '}}' json from latest group by work""",
    "directory_deltas": f"with {LOG} select work, count(distinct file) files, cast(sum(lines) as bigint) lines, sum(elapsed) elapsed from log group by work",
    "polished_texts": f"with {CUE_LINES} select file, seq, md5(case seq when 0 then 'new' when 3 then 'four' else text end) text from lines",
    "title_answers": f"with {PARTS}, s as (select *, row_number() over (partition by work order by k) seq from p) select work, cast(seq as integer) seq, case seq when 1 then 'first' when 4 then 'fourth' else name end title from s",
    "cut_label_answers": f"with {PARTS} select k::varchar id, (k % 9) || ',12' cuts from p where k % 4 <> 1",
    "directory_texts": f"""
with {CUE_LINES}, n as (select file, count(*) n from lines group by file)
select (cast(file as bigint) % 10)::varchar dir, file, cast(i as integer) seq, case when cast(file as bigint) % 3 > 0 and i = 1 then 'one ' || file when cast(file as bigint) % 3 > 0 and i = 3 then 'three' else '' end text from (select file, unnest(range(1, n + 1)) i from n)""",
    "retried_chunks": f"with {CUE_LINES} select file, seq, md5('» ' || text) new_text, 'json' how from lines",
    "indexed_answers": f"with {CUE_LINES} select file, md5(string_agg(case when seq % 3 <> 1 then replace(text, 'e', 'EE') || '\\q' else '' end, '|' order by seq)) texts from lines group by file",
}
