"""Queries of the rules over files, works, scripts, glossaries, layouts and model answers.

Conversations stand for subtitle files, parts and pages for listings of works, documents for scripts,
line items for glyphs and events for run logs.  Each reads its whole tables; ``lineweave.work_sql`` has
the same queries in DuckDB's SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import jsonrepair, names, text, timing
from .functions.nested import running
from .operators import layout, matching, model, scripts, segment, usage, windows
from .operators.cut import shared_folder
from .plans import tracks as track_plans
from .plans import works
from .queries import cue_lines, cue_rows, doc_lines, read, timed_words, whole_files
from .sources import files, subtitles, writers
from .streaming import runs

NOISE = "('ja', 'あっ！'), ('ja', '※note'), ('ja', '　'), ('ja', 'はぁ…'), ('ja', 'ああああああああああ'), ('ja', 'はい、そうです。')"


def in_order(value: Column, *keys: str, sep: str = "\n") -> Column:
    """Texts of a group joined in the order of ``keys``."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*keys, value.alias("v")))), lambda x: x["v"]), sep)


def pick(column: Column, *values: str) -> Column:
    """One of a few values, by the remainder of a number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(column, F.lit(len(values))) + 1).cast("int"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as things of works: (work, k, name)."""
    return read(spark, sf_dir, "part").select(F.col("p_size").alias("work"), F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"))


# --- subtitle files ------------------------------------------------------------------------------------


def lrc_item_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lyrics, cleared times and raw lines of files with either kind of line end."""
    c = cue_lines(spark, sf_dir)
    stamp = timing.ms_to_stamp(F.col("time_ms"))
    line = F.when(F.col("k") % 4 == 1, F.col("text")).when(F.col("k") % 4 == 2, stamp).when(F.col("k") % 4 == 3, F.concat(stamp, F.lit("  "), "text")).otherwise(F.concat(stamp, "text"))
    end = F.when(F.col("file").cast("long") % 2 == 1, "\r\n").otherwise("\n")
    content = c.groupBy("file").agg(in_order(line, "seq", sep="\n").alias("t")).select("file", F.lit(".lrc").alias("ext"), F.concat(F.replace("t", F.lit("\n"), end), end).alias("content"))
    return subtitles.lrc_items(content).select("file", "line_no", "item_type", "time_ms", F.md5(F.coalesce("text", F.lit("-"))).alias("text"))


def marked_files(spark: SparkSession, sf_dir: str, ext: str) -> DataFrame:
    """``whole_files`` with han, with kana and han, or with nothing in front of each turn."""
    head = pick(F.col("file").cast("long"), "かな漢字 ", "漢字 ", "")
    f = whole_files(spark, sf_dir, ext)
    first = {".lrc": r"(?m)^(\[\d+:\d+\.\d+\])", ".srt": r"(?m)^(\d\d:\d\d:\d\d,\d{3} --> [\d:,]+\n)", ".vtt": r"(?m)^(\d\d:\d\d:\d\d\.\d{3} --> [\d:.]+\n)"}[ext]
    return f.withColumn("content", F.regexp_replace("content", F.lit(first), F.concat(F.lit("$1"), head)))


def spoken_text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is spoken in files of the three formats, and in which language."""
    every = None
    for ext in (".lrc", ".srt", ".vtt"):
        f = marked_files(spark, sf_dir, ext).withColumn("file", F.concat("file", F.lit(ext)))
        every = f if every is None else every.unionByName(f)
    spoken = subtitles.spoken_texts(every).groupBy("file").agg(F.count("*").alias("n"), F.md5(in_order(F.col("text"), "line_no", sep="|")).alias("texts"))
    return spoken.join(subtitles.language_of_files(every), "file")


def timeline_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: stamps of cues with new texts, where there are any."""
    c = cue_lines(spark, sf_dir)
    new = c.filter("seq % 5 <> 4").select("file", "seq", F.replace("text", F.lit("e"), F.lit("EE")).alias("new_text"))
    return subtitles.timeline(c.select("file", "seq", "time_ms"), new).select("file", F.md5("content").alias("content"))


def sibling_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: new texts of an LRC for its SRT and VTT siblings; every fourth LRC has lost a text."""
    pair = None
    for ext in (".srt", ".vtt"):
        f = whole_files(spark, sf_dir, ext).withColumn("file", F.concat(F.lit("d/c"), "file", F.lit(ext)))
        pair = f if pair is None else pair.unionByName(f)
    lines = subtitles.structure(pair)
    mine = lines.filter("kind = 'text' and ext = '.srt'")
    last = F.max("slot").over(Window.partitionBy("file"))
    number = F.regexp_extract("file", r"(\d+)\.", 1).cast("long")
    mine = mine.withColumn("last", last).filter((number % 4 != 0) | (F.col("slot") < F.col("last")))
    new = mine.select(F.regexp_replace("file", r"\.srt$", ".lrc").alias("file"), F.col("slot").alias("seq"), F.replace("text", F.lit("e"), F.lit("EE")).alias("new_text"))
    return subtitles.sibling_texts(lines, new).select("file", "slot", F.md5("new_text").alias("new_text"))


def blank_cue_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with an archived original lose their blank cues, if they have any."""
    c = cue_rows(spark, sf_dir).withColumn("body", F.when((F.col("seq") % 3 == 1) & (F.col("file").cast("long") % 5 != 0), "").otherwise(F.concat("text", F.lit("\n"))))
    block = F.concat((F.col("seq") + 1).cast("string"), F.lit("\n00:00:01,000 --> 00:00:02,000\n"), "body")
    srt = c.groupBy("file").agg(in_order(block, "seq").alias("content")).withColumn("ext", F.lit(".srt"))
    listed = srt.select(F.explode(F.array(F.concat(F.lit("w/"), "file", F.lit(".srt")), F.when(F.col("file").cast("long") % 2 == 0, F.concat(F.lit("w/"), "file", F.lit(".ja.srt"))))).alias("path")).filter("path is not null")
    originals = files.with_original(listed).select(F.col("stem").alias("file"))
    changed, counters = writers.clean_blank_cues(srt, originals)
    out = changed.select("file", F.md5("content").alias("content"), F.md5("backup").alias("backup"), F.lit(1).alias("n"))
    return out.unionByName(counters.select(F.lit("all").alias("file"), F.col("seen").cast("string").alias("content"), F.col("changed").cast("string").alias("backup"), F.col("removed").cast("int").alias("n")))


def translated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are not Chinese yet, translated in requests of four lines by a stand-in."""
    out = track_plans.translate_files(marked_files(spark, sf_dir, ".lrc"), [model.echo_model], lines_per_request=4)
    return out.select("file", F.length("content").alias("chars"), F.md5("content").alias("content"))


# --- listings ------------------------------------------------------------------------------------------


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as audio, transcripts, archived transcripts and word files of eight folders."""
    n = F.col("page_id")
    base = F.concat(F.lit("lib/d"), (n % 8).cast("string"), F.lit("/"))
    stem = F.concat(F.lit("n"), F.floor(n / 3).cast("string"))
    path = F.when(n % 3 == 0, F.concat(base, stem, F.lit(".MP3"))).when(n % 3 == 1, F.concat(base, stem, F.lit(".lrc"))).otherwise(F.concat(base, stem, F.lit(".ja.lrc")))
    return read(spark, sf_dir, "pages").select(path.alias("path"), F.timestamp_seconds(n * 7919 % 1009).alias("mtime"))


def untranscribed_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio without an archived transcript in its folder."""
    n = F.col("page_id")
    audio = read(spark, sf_dir, "pages").select(F.concat(F.lit("lib/d"), (n % 4).cast("string"), F.lit("/n"), n.cast("string"), F.when(n % 2 == 0, ".MP3").otherwise(".wav")).alias("path"))
    done = read(spark, sf_dir, "pages").filter("page_id % 3 = 0").select(F.concat(F.lit("lib/d"), (n % 4).cast("string"), F.lit("/n"), n.cast("string"), F.lit(".ja.lrc")).alias("path"))
    return files.untranscribed(audio.unionByName(done)).select("path", "ext")


def track_stem_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names of tracks from audio and live transcripts."""
    return files.track_stems(listing(spark, sf_dir))


def live_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live and restored transcripts in the order of their time; one folder is left out."""
    odd = listing(spark, sf_dir).withColumn("path", F.regexp_replace("path", "^lib/d7/", "lib/bug_collection/"))
    live, _, _ = files.subtitles(odd)
    return files.in_time_order(live).select("path", "nth")


def script_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts of each work from the best kind of folder that it has."""
    p = parts(spark, sf_dir)
    folder = F.when((F.col("k") % 3 == 0) & (F.col("work") % 2 == 0), "Script").when(F.col("k") % 3 == 1, "05.台本").otherwise("misc")
    name = F.concat(pick(F.col("k"), "台本", "readme", "トラック３", "x_cleaned台本"), F.col("k").cast("string"), pick(F.col("k"), ".txt", ".PDF", ".txt", ".txt", ".doc"))
    listed = p.select(F.concat(F.lit("lib/w"), F.col("work").cast("string"), F.lit("/"), folder, F.lit("/"), name).alias("path"))
    best = files.discover_scripts(listed, F.element_at(F.split("path", "/"), 2)).select("work", "path", "tier")
    return best.join(files.script_candidates(listed).select("path", F.lit(True).alias("candidate")), "path", "left").na.fill(False)


def word_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word timing of each track, the first of five places that exists."""
    n, pages = F.col("page_id"), read(spark, sf_dir, "pages")
    base = F.concat(F.lit("w/d"), (n % 8).cast("string"), F.lit("/"))
    at = lambda when, *path: pages.filter(when).select(F.concat(base, *[F.lit(x) if isinstance(x, str) else x for x in path]).alias("path"))
    number = n.cast("string")
    made = at("page_id % 5 = 0", "raw/t", number, ".words.jsonl").unionByName(at("page_id % 3 = 0", "t", number, ".words.jsonl")).unionByName(at("page_id % 2 = 0", "raw/t", number, ".jsonl"))
    made = made.unionByName(at("page_id % 8 = 1", "raw/words.jsonl")).unionByName(at("page_id % 8 in (1, 3)", "words.jsonl"))
    return files.words_file(at("true", "t", number, ".mp3"), made)


def presplit_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works whose script files are named like tracks."""
    p = parts(spark, sf_dir)
    stem = F.when(F.col("k") % (F.col("work") % 3 + 2) == 0, F.concat(F.lit("トラック３ "), "name")).when(F.col("k") % 7 == 0, F.concat(F.lit("#12 "), "name")).otherwise(F.col("name"))
    return matching.presplit_works(p.select("work", stem.alias("stem")))


def files_of_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script files to the first track of their work with the same number."""
    p = parts(spark, sf_dir)
    n = (F.col("k") % 30).cast("string")
    listed = p.select("work", F.col("k").cast("string").alias("path"), F.concat(pick(F.col("k"), "トラック", "track_", "tr", "#"), F.when(F.col("k") % 4 == 3, F.concat(n, F.lit(" x"))).otherwise(n)).alias("stem"))
    tracks = p.select("work", F.concat(F.lit("Tr."), (F.col("k") % 40).cast("string"), F.lit(" "), "name", F.col("k").cast("string")).alias("track"), F.col("k").alias("seq"))
    return matching.files_to_tracks(listed, tracks)


def free_talk_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works that need a world, since no part of their path tells of free talk."""
    path = F.concat(F.lit("lib/"), pick(F.col("k"), "01フリートーク", "フリートーク", "1 Free Talk", "main", "xxおまけ", "おまけ"), F.lit("/"), "name")
    p = parts(spark, sf_dir).select(F.col("k").alias("work"), path.alias("path"))
    return works.needs_world(p).select("work")


# --- scripts -------------------------------------------------------------------------------------------


def noise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank lines, notes and sounds among the lines of documents and a few Japanese ones."""
    extra = spark.sql(f"SELECT * FROM VALUES {NOISE} AS t(lang, text)")
    return doc_lines(spark, sf_dir).select("lang", "text").unionByName(extra).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(text.is_noise_line("text")).alias("noise"))


def decoded_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of documents as text by the first encoding that fits; some are Shift-JIS, some nothing."""
    raw = F.when(F.col("doc_id") % 5 == 0, F.unhex(F.lit("83658358836781422031"))).when(F.col("doc_id") % 7 == 0, F.unhex(F.lit("2009"))).otherwise(F.encode("text", "UTF-8"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce(scripts.decode_udf()(raw), F.lit("none"))).alias("text"))


def raw_script_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17: documents of a language as files of a work; the order of files numbers the tracks."""
    d = read(spark, sf_dir, "documents").select(F.col("lang").alias("work"), F.col("doc_id").alias("seq"), F.concat(F.lit(" \n"), "text").alias("content"))
    return scripts.raw_script(d).groupBy("work", "track").agg(F.count("*").alias("n"), F.md5(in_order(F.col("text"), "line_no")).alias("lines"))


def bar_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that begin like a table of two languages."""
    head = pick(F.col("doc_id"), "原文|訳文\n", "a|b\n", "中文 \n")
    return read(spark, sf_dir, "documents").select("doc_id", scripts.is_bar_table(F.concat(head, F.col("text"))).alias("bar"))


def accepted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of layout documents that are long or Japanese enough, over whole documents and their first lines."""
    d = read(spark, sf_dir, "documents")
    head = d.select(F.concat(F.col("doc_id").cast("string"), F.lit("h")).alias("id"), F.concat(F.element_at(F.split("text", "\n"), 1), F.when(F.col("doc_id") % 2 == 0, "かなかなかな").otherwise("")).alias("text"))
    return layout.accept_text(d.select(F.col("doc_id").cast("string").alias("id"), "text").unionByName(head)).select("id", "accepted")


def ranged_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines of documents cut up by an answer of line ranges and lists."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("work"), F.split("text", "\n", -1).alias("lines"))
    w = F.col("work").cast("string")
    raw = F.concat(F.when(F.col("work") % 2 == 0, "```json\n").otherwise("ok "), F.lit('{"tracks": {"Tr-01": [1, 3], "tr02": ["4", 99], "tr 03": [5, 4], "tr04": ["one '), w, F.lit('", "※x", "two"]}}'), F.when(F.col("work") % 2 == 0, "\n```").otherwise(""))
    answers = d.select("work", raw.alias("raw"))
    tracks = d.select("work", F.posexplode(F.array(*[F.lit(f"tr{i:02d}") for i in range(1, 6)])).alias("seq", "track"))
    got = scripts.tracks_from_answer(answers, tracks, d)
    numbered = d.select("work", F.md5(scripts.number_lines(F.array_join("lines", "\n"))).alias("numbered"))
    return got.join(numbered, "work").select("work", "track", F.size("lines").alias("n"), F.md5(F.array_join("lines", "\n")).alias("lines"), "numbered")


def resolved_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cached lines of a work if they are enough, else an answer filled up by marks."""
    p = parts(spark, sf_dir).withColumns({"work": F.col("k") % 89, "track": F.concat(F.lit("t"), F.col("k").cast("string"))})
    none = F.array().cast("array<string>")
    lines = lambda when, mark: F.when(F.expr(when), F.array(F.concat(F.lit(mark), "name"))).otherwise(none).alias("lines")
    cached = p.select("work", "track", lines("k % (work % 5 + 1) = 0", "c "))
    answered, marks = p.select("work", "track", lines("k % (work % 7 + 1) = 0", "a ")), p.select("work", "track", lines("k % 2 = 0", "m "))
    return scripts.resolve_scripts(cached, answered, marks).select("work", "track", F.array_join("lines", "|").alias("lines"))


def cached_script_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier exports of works: a map of tracks, else split files of like names."""
    p = parts(spark, sf_dir).withColumns({"work": F.col("k") % 91, "track": F.lpad(F.col("k").cast("string"), 8, "0")})
    tracks = p.select("work", "track", F.col("k").alias("seq"))
    entry = F.struct(F.when(F.col("work") % 6 == 3, F.concat(F.lit("other"), "track")).otherwise(F.col("track")).alias("key"), F.when(F.col("k") % 5 < 3, F.array("name", F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("value"))
    caches = p.filter("work % 3 = 0").groupBy("work").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("content"))
    split = p.filter("work % 3 = 1 and k % 4 < work % 5").select("work", F.concat("track", F.lit("_x")).alias("stem"), F.concat(F.lit(" a\n\nb"), "name").alias("content"))
    return works.accepted_cache(works.cached_scripts(caches, split, tracks)).select("work", "track", F.array_join("lines", "|").alias("lines"))


def asr_first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifteen lines with text of each track."""
    c = cue_lines(spark, sf_dir).select(F.col("file").alias("track"), "seq", F.when(F.col("seq") % 4 == 1, "  ").otherwise(F.concat(F.lit(" "), "text")).alias("text"))
    return works.asr_samples(c).select("track", F.md5("text").alias("text"))


def exported_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: raw text, map of tracks and one text for each track of works that have lines."""
    p = parts(spark, sf_dir).withColumn("work", F.col("work").cast("string"))
    tracks = p.select("work", F.concat("name", F.lit("/"), F.col("k").cast("string")).alias("track"), F.when((F.col("k") % 3 == 0) | (F.col("work") == "7"), F.array().cast("array<string>")).otherwise(F.split("name", " ")).alias("lines"))
    raw = p.select("work").distinct().select("work", F.concat(F.lit("raw "), "work").alias("content"))
    return writers.script_exports(tracks, raw).select("work", "path", F.md5("content").alias("content"))


def json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6, K7: one JSON object of names for each work; of equal keys the last."""
    p = parts(spark, sf_dir).withColumn("key", (F.col("k") % 50).cast("string"))
    return writers.json_map(p, "work", "key", "name", "k").select("work", F.md5("content").alias("content"))


# --- glossaries ----------------------------------------------------------------------------------------


def term_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossaries as JSON objects, or as lines with any of four separators, comments and blanks."""
    p = parts(spark, sf_dir).withColumn("src", F.concat_ws(" ", "name", "kind"))
    line = F.concat(F.lit(" "), "src", pick(F.col("k"), "→", "\t", ": ", "："), F.lit(" t"), F.col("k").cast("string"), pick(F.col("k"), "", "\n# note: x", "\n\n"))
    entry = F.struct(F.concat("src", F.lit(" "), F.col("k").cast("string")).alias("key"), F.concat(F.lit("t"), F.col("k").cast("string")).alias("value"))
    as_lines = p.filter("work % 2 = 1").groupBy("work").agg(in_order(line, "k").alias("content"))
    as_json = p.filter("work % 2 = 0").groupBy("work").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("content"))
    return scripts.read_terms(as_lines.unionByName(as_json)).select("work", "src", "tgt")


def alias_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of names in JSON; what is no list is empty."""
    p = parts(spark, sf_dir)
    content = F.when(F.col("k") % 3 == 0, F.to_json(F.split("name", " "))).when(F.col("k") % 3 == 1, F.concat(F.lit("no list: "), "name")).otherwise(F.lit("[]"))
    return p.select("k", F.array_join(scripts.read_list(content), "|").alias("names"))


def world_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worlds and scenes of works from several files; later ones win, a hidden one only fills."""
    p = parts(spark, sf_dir).withColumn("work", F.col("k") % 97)
    name = pick(F.col("k") + F.floor(F.col("k") / 97), "world.txt", "worldview.json", ".worldview.json", "scene.md", "notes.txt", "setting.json")
    plain = F.concat_ws(" ", "name", F.col("k").cast("string"))
    content = F.when(F.endswith(name, F.lit(".json")), F.concat(F.lit('{"description": "'), plain, F.lit('", "text": "no"}'))).otherwise(F.concat(F.lit(" "), plain))
    return works.world_of_files(p.select("work", name.alias("name"), F.col("k").alias("priority"), content.alias("content")))


def world_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A work's own terms, then the names of its world's people and its special terms."""
    p = parts(spark, sf_dir).withColumn("work", F.col("k") % 83)
    one = lambda mark: F.concat_ws(" ", F.lit(mark), "name", F.col("k").cast("string"))
    person = F.to_json(F.struct(one("p").alias("name"), F.concat(one("cn"), F.lit("（note）")).alias("name_cn")))
    w = p.groupBy("work").agg(F.array_sort(F.collect_list(F.struct("k", person.alias("j"), F.concat(F.lit('"'), one("s"), F.lit('": "'), one("t"), F.lit('"')).alias("s"), F.concat(F.lit('"'), F.col("k").cast("string"), F.lit('": '), person).alias("m")))).alias("a"))
    joined = lambda f: F.array_join(F.transform("a", lambda x: x[f]), ", ")
    people = F.when(F.col("work") % 2 == 0, F.concat(F.lit("["), joined("j"), F.lit("]"))).otherwise(F.concat(F.lit("{"), joined("m"), F.lit("}")))
    worlds = w.select("work", F.concat(F.lit('{"characters": '), people, F.lit(', "special_terms": {'), joined("s"), F.lit("}}")).alias("content"))
    own = p.filter("k % 3 = 0").select("work", one("p").alias("src"), F.lit("own").alias("tgt"))
    shared = p.filter("k % 5 = 0").select(one("g").alias("src"), F.lit("shared").alias("tgt"))
    return works.work_terms(own, worlds, shared, p.filter("k % 2 = 0").select("work", one("g").alias("src")))


def work_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most five terms of its work beside every track."""
    p = parts(spark, sf_dir)
    terms = p.groupBy("work", F.concat_ws(" ", "name", "kind").alias("src")).agg(F.concat(F.lit("t"), F.max("k").cast("string")).alias("tgt"))
    return works.with_context(p.select("work", "k"), terms, 5).select("work", "k", F.array_join("terms", "|").alias("terms"))


def same_reading_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of a work that are read alike, groups before single ones."""
    p = parts(spark, sf_dir).select("work", F.col("k").alias("line_no"), F.concat_ws(" ", "name", "kind").alias("src"), F.col("k").cast("string").alias("tgt"))
    out = matching.same_reading(p, F.lower(F.concat_ws("", F.element_at(F.split("src", " "), 1), (F.col("line_no") % 3).cast("string"))))
    return out.select("work", "reading", F.size("members").alias("n"), "single", F.col("first_seen").alias("first"), "nth", F.array_join(F.transform("members", lambda m: m["tgt"]), ",").alias("members"))


def blank_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two maps of values, the second filling what the first leaves blank."""
    p = parts(spark, sf_dir)
    user = F.create_map(F.lit("a"), pick(F.col("k"), "", "  ", "own"), F.lit("b"), F.when(F.col("k") % 2 == 0, F.col("name")))
    preset = F.create_map(F.lit("a"), F.col("name"), F.lit("b"), F.lit("preset"), F.lit("c"), pick(F.col("k"), "x", ""))
    filled = names.fill_blank(user, preset)
    return p.select("k", *[F.coalesce(F.try_element_at(filled, F.lit(c)), F.lit("none")).alias(c) for c in ("a", "b", "c")])


# --- words and cues ------------------------------------------------------------------------------------


def line_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of turns with a word every two milliseconds: (file, turn, seq, time_ms, text, ws)."""
    c = cue_lines(spark, sf_dir).filter(text.strip("text") != "")
    ws = F.filter(F.split("text", " "), lambda w: w != "")
    at = lambda i: F.col("time_ms") + i * 2
    return c.withColumn("ws", F.transform(ws, lambda w, i: F.struct(at(i).alias("start"), (at(i) + 1).alias("end"), w.alias("word"))))


def matched_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of turns as cues, and as segments ten milliseconds later; every third is missing."""
    c = cue_lines(spark, sf_dir)
    s = c.filter("seq % 3 <> 2").select("file", F.col("seq").alias("seg"), (F.col("time_ms") + 10).alias("start"), F.replace("text", F.lit(" "), F.lit("")).alias("text"))
    return matching.match_segments(c.filter(text.strip("text") != "").select("file", "seq", "time_ms", "text"), s)


def as_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as cues inside whole turns as segments: the turn and the words that spell the line, nearest to its time."""
    c = line_words(spark, sf_dir)
    s = c.groupBy("file", F.col("turn").alias("seg")).agg(F.min("time_ms").alias("start"), F.max(F.element_at("ws", -1)["end"]).alias("end"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "ws"))), lambda x: x["ws"])).alias("words"))
    return matching.as_of_segments(c.select("file", "seq", "time_ms", "text"), s, nearest=True).select("file", "seq", "seg", F.size("words").alias("n"), F.element_at("words", 1)["start"].alias("start"))


def segment_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20: whether segments, later by up to 90 ms, fit the cues of their file."""
    c = cue_lines(spark, sf_dir).select("file", "seq", "time_ms")
    n = F.col("file").cast("long")
    s = c.filter((n % 5 != 0) | (F.col("seq") > 0)).select("file", F.col("seq").alias("seg"), (F.col("time_ms") + n % 4 * 30).alias("start"))
    return matching.segments_fit(c, s)


def word_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the words of a turn begin in its joined text, and what a cut in its middle shows."""
    t = timed_words(spark, sf_dir)
    offsets = segment.with_offsets(F.col("words"))
    half = F.floor(F.size("words") / 2).cast("int")
    return t.filter("size(words) > 1").select("file", "seq", F.md5(F.array_join(offsets.cast("array<string>"), ",")).alias("offsets"), F.md5(segment.cut_preview(F.col("words"), half)).alias("preview"))


def morpheme_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal, weak and long-gap cuts of lines whose words are morphemes of a tagger's table."""
    c = cue_lines(spark, sf_dir).filter(text.strip("text") != "")
    ws = F.filter(F.split("text", " "), lambda w: w != "")
    start = lambda i: (i * 300 + F.floor(i / 5) * 900).cast("long")
    words = F.transform(ws, lambda w, i: F.struct(start(i).alias("start"), (start(i) + F.when(i % 3 == 0, 290).otherwise(0 + 280)).alias("end"), w.alias("word")))
    c = c.select("file", "seq", words.alias("words"), running(ws, F.length).alias("before"))
    pos1 = lambda i: pick(i, "名詞", "助詞", "動詞", "助動詞", "形容詞")
    pos2 = lambda i: F.when(i % 10 == 1, "終助詞").when(i % 7 == 3, "助数詞").otherwise("一般")
    at = lambda i: F.get("before", i)
    morphemes = F.transform("words", lambda w, i: F.struct(at(i).alias("start"), at(i + 1).alias("end"), pos1(i).alias("pos1"), pos2(i).alias("pos2"), F.concat(w["word"], F.lit("-x")).alias("lemma"), w["word"].alias("surface")))
    c = c.select("file", "seq", "words", morphemes.alias("morphemes")).withColumn("cuts", segment.cut_table(F.col("words"), F.col("morphemes")))
    every = F.concat(segment.legal_of(F.col("cuts")), segment.weak_of(F.col("cuts")), segment.gaps_of(F.col("cuts")))
    cuts = c.select("file", "seq", F.explode_outer(every).alias("c")).filter("c is not null")
    return cuts.groupBy("file", "seq", F.col("c.level").alias("level")).agg(F.count("*").alias("n"), F.sum("c.k").alias("places"))


def cjk_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """blanks between wide characters go, others and, if asked for, line feeds stay."""
    t = F.concat(F.lit("漢 字\nかな　x "), "text", F.lit(" あ い y"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.join_cjk(t)).alias("all"), F.md5(text.join_cjk(t, True)).alias("kept"))


def float_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stamps with rounded seconds, which may show 60, and costs by their magnitude."""
    n = F.col("event_id")
    cost = F.when(n % 3 == 0, n / 1e8).when(n % 3 == 1, n / 2e6).otherwise(n / 64.0)
    return read(spark, sf_dir, "events").select("event_id", timing.ms_to_float_stamp(n * 997).alias("stamp"), timing.show_cost(F.when(n % 3 == 2, cost).otherwise(F.round(cost, 6))).alias("cost"))


# --- layout --------------------------------------------------------------------------------------------


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", F.expr("l_orderkey div 4096").cast("string")).alias("doc"), F.col("l_linenumber").alias("page"), (F.col("l_extendedprice") % 500).alias("x"), (F.floor(F.col("l_quantity") / 13) * 8).alias("y"),
        F.col("l_linestatus").alias("text"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_partkey").alias("part"),
    )


def glyph_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs to rows from the top; rows of digits alone go."""
    g = glyphs(spark, sf_dir).withColumn("text", F.when(F.col("y") == 16, "7").otherwise(F.col("text")))
    rows = layout.glyph_lines(g, False)
    return rows.select("doc", "page", "line", F.length("text").alias("n"), F.length(F.replace("text", F.lit("O"), F.lit(""))).alias("other"))


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def glyph_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages of glyph files, one letter of the name after another, written and read back."""
    p = read(spark, sf_dir, "part")
    box = lambda i: F.array(*[(i * 10 + F.col("p_size") + d).cast("double") for d in (0, 0.25, 8, 12.5)])
    chars = F.transform(F.split("p_name", ""), lambda c, i: F.struct(c.alias("c"), F.when(i % 7 != 3, box(i)).alias("bbox")))
    spans = lambda some: F.array(F.struct(F.array(F.struct(some.alias("chars"))).alias("spans")))
    blocks = F.array(F.struct(spans(F.slice(chars, 1, 4)).alias("lines")), F.struct(F.lit(None).cast("array<struct<spans:array<struct<chars:array<struct<c:string,bbox:array<double>>>>>>>").alias("lines")), F.struct(spans(F.slice(chars, 5, 1000)).alias("lines")))
    path = fresh_folder(spark, "glyphs")
    p.select(F.col("p_partkey").cast("int").alias("page"), F.lit(595.28).alias("width"), F.lit(841.89).alias("height"), blocks.alias("blocks")).write.json(path)
    return layout.read_glyphs(spark, path).drop("doc")


def word_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed turns as lines of JSON, some blank, some broken, some with bytes that are no UTF-8, written and read back."""
    t = timed_words(spark, sf_dir).withColumn("n", (F.col("file").cast("long") + F.col("seq")) % 6)
    line = F.to_json(F.struct(F.get("words", F.lit(0))["start"].alias("start"), F.element_at("words", -1)["end"].alias("end"), F.concat_ws(" ", "file", "seq").alias("text"), "words"))
    bad = F.concat(F.lit('{"start": 5, "text": "').cast("binary"), F.unhex(F.lit("FF")), F.concat_ws(" ", "file", "seq").cast("binary"), F.lit('"}').cast("binary")).cast("string")
    key = F.concat_ws(" ", "file", "seq")
    value = F.when(F.col("n") == 1, F.concat(F.lit('{"text": "'), key)).when(F.col("n") == 2, F.concat(F.lit(" "), line, F.lit("\n \t\n"))).when(F.col("n") == 3, bad).when(F.col("n") == 4, F.concat(F.lit('["'), key, F.lit('"]'))).otherwise(line)
    path = fresh_folder(spark, "words")
    t.select(value.alias("value")).write.text(path)
    got = scripts.read_words(spark, path)
    return got.select("start", "end", "text", F.size("words").alias("n"), F.element_at("words", -1)["word"].alias("last"), "corrupt", "replaced")


def dense_page_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document the three fullest pages, thinned out to 150 glyphs or a little more."""
    g = glyphs(spark, sf_dir)
    return layout.dense_pages(g.withColumn("seq", F.struct("seq", "part", "x"))).groupBy("doc", "page").agg(F.count("*").alias("n"), F.sum("part").alias("parts"))


def representative_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the files of a group the one with most glyphs, the first of equals."""
    o = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("seq")).agg(F.count("*").alias("n"))
    return layout.representative(o.select((F.col("seq") % 50).alias("grp"), F.col("seq").cast("string").alias("path"), "seq", "n"))


def body_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that reach into the body of the page, in order, and glyphs inside it."""
    o = read(spark, sf_dir, "orders").select(F.expr("o_orderkey div 128").alias("page"), (F.col("o_orderkey") % 900).alias("y0"), (F.col("o_orderkey") % 900 + F.col("o_orderkey") % 70).alias("y1"), F.col("o_orderkey").alias("k"))
    blocks = layout.in_body(o, 100, 700).groupBy("page").agg(F.count("*").alias("blocks"), F.md5(in_order(F.col("k").cast("string"), "y0", "k", sep=",")).alias("texts"))
    points = layout.in_body(o.select("page", F.col("y0").alias("y")), 100, 700).groupBy("page").agg(F.count("*").alias("glyphs"))
    return blocks.join(points, "page")


# --- run logs ------------------------------------------------------------------------------------------


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts at the files of works, numbered for each file."""
    e = read(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 3 == 0, "success").when(F.col("event_id") % 11 == 0, "skipped").otherwise("failed")
    attempt = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return e.select(
        F.concat(F.lit("lib/w"), (F.col("user_id") % 20).cast("string")).alias("work"), F.concat(F.lit("f"), F.col("user_id").cast("string"), F.lit(".lrc")).alias("file"), attempt.alias("attempt"), status.alias("status"),
        (F.col("event_id") % 100).cast("double").alias("elapsed"), F.when(status == "failed", F.col("event_type")).alias("reason"), F.timestamp_seconds(F.col("event_id")).alias("ts"), (F.col("event_id") % 9).alias("lines"),
    )


def run_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log for every work and every file."""
    return writers.work_logs(run_log(spark, sf_dir)).select("work", "path", F.md5("content").alias("content"))


def retry_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of each file up to its first success, and what is tried again or given up."""
    return runs.retry_table(run_log(spark, sf_dir))


def progress_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts by status in windows of five minutes."""
    return runs.progress(run_log(spark, sf_dir)).select(F.unix_seconds("start").alias("start"), "status", "n")


def batch_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works with the tracks expected of them, which of them are complete, and the totals of the batch."""
    log = run_log(spark, sf_dir)
    listed = log.select("work", F.col("file").alias("track")).unionByName(log.filter("work in ('lib/w3', 'lib/w8')").select("work", F.lit("missing.lrc").alias("track")).distinct())
    expected = usage.expected_tracks(listed)
    rows = usage.manifest(log, expected)
    done = runs.completed_works(log, expected).select("work", F.lit(True).alias("named"))
    total = usage.batch_totals(rows).select(F.lit("all").alias("work"), "total", "succeeded", "failed", "skipped", "elapsed", (F.col("works") == F.col("complete")).alias("complete"), F.lit(False).alias("named"))
    return rows.join(done, "work", "left").select("work", "total", "succeeded", "failed", "skipped", "elapsed", "complete", F.coalesce("named", F.lit(False)).alias("named")).unionByName(total)


def manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: each work of a batch as a line of JSON."""
    rows = usage.manifest(run_log(spark, sf_dir)).select("work", "total", "failed")
    return usage.manifest_json(rows).select("work", "json")


def directory_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, lines and time of each work."""
    return usage.work_deltas(run_log(spark, sf_dir))


# --- model answers -------------------------------------------------------------------------------------


def polished_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few lines replaced by number; blanks and keys that are no number change nothing."""
    c = cue_lines(spark, sf_dir).select("file", "seq", "text")
    updates = c.select("file").distinct().select("file", F.lit('{"1": "new", "2": "  ", "x": "no", "4": "four", "999999": "out"}').alias("raw"))
    return model.polish(c, updates).select("file", "seq", F.md5("text").alias("text"))


def title_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of tracks by number, the name where none was given."""
    p = parts(spark, sf_dir).withColumn("seq", F.row_number().over(Window.partitionBy("work").orderBy("k")))
    answers = p.select("work").distinct().select("work", F.lit('{"1": " first ", "2": "", "three": "x", "4": "fourth"}').alias("raw"))
    return model.titles(p.select("work", "seq", "name"), answers).select("work", "seq", "title")


def cut_label_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cuts proposed for known ids; what is no number is left out."""
    p = parts(spark, sf_dir).withColumn("id", F.col("k").cast("string"))
    raw = F.concat(F.lit('{"'), "id", F.lit('": ["'), (F.col("k") % 9).cast("string"), F.lit('", "x", "12"], "no'), "id", F.lit('": ["1"]}'))
    return model.cut_answers(p.select(raw.alias("raw")), p.filter("k % 4 <> 1").select("id")).select("id", F.array_join(F.col("cuts").cast("array<string>"), ",").alias("cuts"))


def directory_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: a line for every line of the files of a directory; what the answer lacks is blank."""
    n = cue_lines(spark, sf_dir).groupBy("file").agg(F.count("*").cast("int").alias("n")).withColumn("dir", (F.col("file").cast("long") % 10).cast("string"))
    entry = F.concat(F.lit('"'), "file", F.lit('": [{"index": 1, "text": "one '), "file", F.lit('"}, {"index": 3, "text": "three"}]'))
    answers = n.filter("cast(file as bigint) % 3 > 0").groupBy("dir").agg(F.concat(F.lit("{"), in_order(entry, "file", sep=", "), F.lit("}")).alias("raw"))
    return works.directory_answers(answers, n)


def _refuses(prompts: pd.Series) -> pd.Series:
    return prompts.map(lambda p: "no answer" if len(p) % 2 else model.echo_model(pd.Series([p]))[0])


def retried_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that a model refuses go to the next one."""
    rows = windows.fixed_chunks(cue_lines(spark, sf_dir), 5).select("file", "chunk", "seq", "text")
    return model.translate_with_retries(rows, ["file", "chunk"], [_refuses, model.echo_model]).select("file", "seq", F.md5("new_text").alias("new_text"), "how")


def indexed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by index with a wrong escape in every text, put right first."""
    c = cue_lines(spark, sf_dir).withColumn("n", F.col("seq") + 1)
    item = F.concat(F.lit('{"index": '), F.col("n").cast("string"), F.lit(', "text": "'), F.replace("text", F.lit("e"), F.lit("EE")), F.lit('\\q"}'))
    raw = F.concat(F.lit('{"translations": ['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("seq")).alias("o"), F.when(F.col("seq") % 3 != 1, item).alias("v")))), lambda x: x["v"]), ", "), F.lit("]}"))
    g = c.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]).alias("originals"), raw.alias("raw"))
    return g.select("file", F.md5(F.array_join(jsonrepair.answers_by_index(F.col("originals"), jsonrepair.repair_backslashes(F.col("raw"))), "|")).alias("texts"))


WORK_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        lrc_item_scan, spoken_text_scan, timeline_files, sibling_files, blank_cue_writer, translated_files, untranscribed_audio, track_stem_scan, live_by_time, script_discovery, word_sidecars,
        presplit_names, files_of_tracks, free_talk_works, noise_lines, decoded_scripts, raw_script_tracks, bar_tables, accepted_texts, ranged_scripts, resolved_scripts, cached_script_reuse,
        asr_first_lines, exported_scripts, json_files, term_files, alias_lists, world_files, world_people, work_context, same_reading_terms, blank_values, matched_segments, as_of_turns, segment_fit,
        word_offsets, morpheme_cuts, cjk_gaps, float_stamps, glyph_rows, glyph_files, word_files, dense_page_glyphs, representative_files, body_blocks, run_log_files, retry_states, progress_counts, batch_manifest,
        manifest_lines, directory_deltas, polished_texts, title_answers, cut_label_answers, directory_texts, retried_chunks, indexed_answers,
    )
}
