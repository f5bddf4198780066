"""Queries over the driver's tables: documents stand for scripts, conversations for cues, events for usage.

Each reads its whole tables.  ``lineweave.sql`` has the same queries in DuckDB's SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import names, text, timing
from .operators import align, asof, layout, matching, model, scripts, segment, usage, windows
from .functions.jsonrepair import with_answer_texts
from .sources import files, subtitles

BOXES = "(1, 300, 10, 10, 60, 'a'), (1, 300, 90, 10, 50, 'b'), (1, 302, 400, 12, 50, 'c'), (1, 45, 20, 11, 40, 'd'), (1, 75, 10, 10, 44, 'e'), (1, 150, 610, 500, 20, 'a line that is long and wide'), (1, 20, 612, 700, 20, 'another line long and wide'), (2, 10, 10, 50, 10, 'x'), (2, 70, 12, 50, 10, 'y'), (2, 10, 44, 60, 12, 'z')"
SPEECH = "('10 han', '一二三四五六七八九十あ'), ('ja', '一二三四五六七八九十ああ'), ('none', 'abc'), ('digits', '12 34'), ('kana', 'ありがとうございます')"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt over all tasks, as a file may be one row group, which one task reads."""
    return read(spark, sf_dir, "documents").repartition("doc_id")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as scripts: (doc_id, lang, seq, text)."""
    return read(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("seq", "text"))


def cue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as cues: (file, seq, time_ms, text)."""
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("seq"), (F.col("turn") * 2500 + 17).alias("time_ms"), "role", "text")


def cue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every turn as a cue: (file, turn, k, role, text, seq, time_ms)."""
    c = cue_rows(spark, sf_dir).select("file", F.col("seq").alias("turn"), "role", F.posexplode(F.split("text", "\n", -1)).alias("k", "text"))
    seq = F.row_number().over(Window.partitionBy("file").orderBy("turn", "k")) - 1
    return c.withColumns({"seq": seq, "time_ms": F.col("turn") * 2500 + 17 + F.col("k") * 100})


def usage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as usage."""
    e = read(spark, sf_dir, "events")
    n = F.col("event_id")
    u = e.select(
        n.alias("seq"), F.col("event_type").alias("request_type"), F.concat(F.lit("works/w"), (F.col("user_id") % 50).cast("string")).alias("work_key"), "ts", "user_id", "value",
        (n * 37 % 5000).alias("hit_tokens"), (n * 53 % 7000).alias("miss_tokens"), (n * 11 % 3000).alias("completion_tokens"), (n % 7 * 10).alias("reasoning_tokens"),
    )
    u = u.withColumn("prompt_tokens", F.col("hit_tokens") + F.col("miss_tokens"))
    booked = timing.cost(F.col("hit_tokens"), F.col("miss_tokens"), F.col("completion_tokens"))
    return u.withColumn("cost", booked + F.when(F.col("user_id") % 7 == 0, 0.01).otherwise(0.0))


def line_explode_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2-style explode, P8, A9: the flagship."""
    docs = spread_documents(spark, sf_dir).select("lang", F.explode(F.split("text", "\n", -1)).alias("text"))
    lines = docs.withColumn("text", text.page_noise("text")).filter("text is not null")
    return windows.text_statistics(lines, "lang")


def word_frequency_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = doc_lines(spark, sf_dir).select("lang", F.struct("doc_id", "seq").alias("seq"), "text")
    return windows.frequent_words(lines, "lang")


def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    speech = spark.sql(f"SELECT * FROM VALUES {SPEECH} AS t(id, text)")
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text").unionByName(speech)
    kana, han = text.count_class("text", text.KANA_LETTERS), text.count_class("text", text.HAN)
    return docs.select("id", text.file_language(kana, han, F.lit(1)).alias("file_language"), text.content_language("text").alias("content_language"), text.is_chinese(kana, han).alias("chinese"))


def page_noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql("SELECT * FROM VALUES (-1L, '12'), (-2L, '3/57'), (-3L, '22222x'), (-4L, '2222あ'), (-5L, '12345678 body'), (-6L, '製作 x'), (-7L, '123456789') AS t(doc_id, text)")
    lines = doc_lines(spark, sf_dir).select("doc_id", "text").unionByName(extra).withColumn("kept", text.page_noise("text"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count("kept").alias("n_kept"), F.coalesce(F.sum(F.length("kept")), F.lit(0)).alias("kept_chars"))


def repetition_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql("SELECT * FROM VALUES (-1L, 0, 'aaaaa'), (-1L, 1, 'aaaa'), (-1L, 2, 'ababab'), (-1L, 3, 'abcabd') AS t(doc_id, seq, text)")
    lines = doc_lines(spark, sf_dir).select("doc_id", "seq", "text").unionByName(extra)
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(text.repeats_too_much("text")).alias("n_repetitive"))


def dropped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11, P13, W6 over the lines of conversations: lines dropped by reason."""
    rows = windows.position_share(cue_lines(spark, sf_dir))
    rows = rows.withColumn("reason", F.coalesce(text.drop_reason("text", F.col("position")), F.lit("kept")))
    return rows.groupBy("role", "reason").agg(F.count("*").alias("n"))


def usage_cost_by_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = usage.work_summaries(usage_rows(spark, sf_dir))
    return out.select("work_key", "name", "calls", "types", *usage.TOKENS, F.round("cost", 6).alias("cost"), F.round(timing.hit_rate(F.col("hit_tokens"), F.col("miss_tokens")), 6).alias("hit_rate"))


def usage_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.type_counts(usage_rows(spark, sf_dir))


def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.totals(usage_rows(spark, sf_dir)).withColumn("cost", F.round("cost", 6))


def usage_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = usage.reconcile(usage_rows(spark, sf_dir))
    return out.select("work_key", F.round("booked", 6).alias("booked"), F.round("computed", 6).alias("computed"))


def status_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 5 == 0, "failed").when(F.col("event_id") % 11 == 0, "skipped").otherwise("success")
    runs = e.select((F.col("user_id") % 20).alias("work"), F.col("user_id").alias("file"), F.col("event_id").alias("attempt"), status.alias("status"), (F.col("event_id") % 100).cast("double").alias("elapsed"), F.lit("").alias("reason"))
    return usage.manifest(runs)


def peak_cost_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    wait = timing.seconds_until_idle(F.col("ts"))
    return e.select("event_id", timing.is_peak(F.col("ts")).alias("peak"), wait.alias("wait_s"), timing.hms(wait).alias("shown"))


def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("s"))
    g = windows.gap_groups(e, ["user_id"], "s", 86_400)
    return g.groupBy("user_id", "gap_group").agg(F.count("*").alias("n"), F.min("s").alias("begins"), F.max("s").alias("ends"))


def asof_prev_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    clicks = e.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    views = e.filter("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", F.col("ts").alias("view_ts"))
    return asof.as_of(clicks, views, "user_id", "ts", "view_ts", ["view_id"], 86_400.0).select("event_id", "view_id")


def interval_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    other = e.select("user_id", F.col("event_id").alias("other_id"), F.col("at").alias("other_at"))
    pairs = asof.within_interval(e, other, ["user_id"], F.col("at"), F.col("other_at"), 7_200_000_000)
    return pairs.filter("event_id < other_id").select("user_id", "event_id", "other_id")


def turn_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.context(windows.neighbours(cue_rows(spark, sf_dir)), 2)
    return rows.select("file", "seq", F.md5(F.coalesce("previous", F.lit(""))).alias("previous"), F.md5(F.coalesce("next", F.lit(""))).alias("next"), F.md5(F.array_join("before", "|")).alias("before"), F.md5(F.array_join("after", "|")).alias("after"))


def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.fixed_chunks(cue_rows(spark, sf_dir), 3).select("file", "seq", "chunk")


def chunk_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cue_rows(spark, sf_dir).withColumn("size", F.length("text"))
    return windows.pack_by_budget(rows, 1500).select("file", "seq", F.col("chunk").cast("long").alias("chunk"))


def budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cue_rows(spark, sf_dir).withColumnRenamed("file", "work")
    return windows.within_budget(rows, 2000).select("work", "seq", "used")


def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doc_lines(spark, sf_dir).withColumnRenamed("doc_id", "file")
    return windows.stride_sample(rows, 5).select("file", "seq")


def first_n_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doc_lines(spark, sf_dir).withColumnRenamed("doc_id", "file")
    return windows.first_distinct(rows, 20).select("file", "seq", F.md5("text").alias("text"), "n")


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.numbered(cue_rows(spark, sf_dir)).select("file", "seq", "n", F.md5("numbered").alias("numbered"))


def blank_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doc_lines(spark, sf_dir).select(F.col("doc_id").alias("file"), "seq", F.when(F.col("seq") % 3 == 0, F.col("text")).otherwise("").alias("text"))
    return windows.trailing_blanks(rows)


def anti_semi_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "labels").select("doc_id")
    both = d.join(lab, "doc_id", "left_semi").withColumn("kind", F.lit("labelled")).unionByName(d.join(lab, "doc_id", "left_anti").withColumn("kind", F.lit("unlabelled")))
    return both.groupBy("lang", "kind").agg(F.count("*").alias("n"))


def dice_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"), F.lead("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("b")).filter("b is not null")
    return part.select("p_partkey", F.round(text.dice("a", "b"), 9).alias("dice"))


def anchor_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7, A12 with Dice: where benchmark passages stand among the lines of each document."""
    tracks = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("track"), F.posexplode(F.split("text", "\n", -1)).alias("seq", "text"))
    script = spread_documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    return matching.anchors(tracks, script, by=("doc_id",))


def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.sql("SELECT * FROM VALUES ('http', 'any'), ('https://blog', 'blog'), ('HTTPS://', 'secure'), ('http://www.', 'www'), ('https://blog.th', 'th') AS t(key, entry)")
    return matching.longest_prefix(read(spark, sf_dir, "pages").select("page_id", "url"), "url", entries).select("page_id", "entry")


def name_tier_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts in other spellings, shortened or with a number, against the names themselves."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    short = F.element_at(F.split("p_name", " "), -1)
    name = F.when(F.col("p_partkey") % 4 == 0, F.upper("p_name")).when(F.col("p_partkey") % 4 == 1, short).when(F.col("p_partkey") % 4 == 2, F.concat("p_name", F.lit("_"), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("no-such "), F.col("p_partkey").cast("string")))
    have = part.groupBy(F.col("p_name").alias("match")).agg(F.min("p_partkey").alias("match_seq"))
    return matching.tiered_names(part.select(name.alias("name"), F.col("p_partkey").alias("seq")), have)


def term_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of parts as a work's own terms, its world's and shared ones; the first source that has a term wins."""
    part = read(spark, sf_dir, "part").select(F.col("p_size").alias("work"), F.concat_ws(" ", "p_type", "p_brand").alias("src"), "p_name", "p_partkey")
    named = lambda df, by, tgt: df.groupBy("work", "src").agg(F.concat(F.lit(tgt), F.max(by)).alias("tgt"))
    own = named(part.filter("p_partkey % 3 = 0"), "p_name", "own ")
    world = named(part.filter("p_partkey % 3 <> 1"), "p_name", "world ")
    return matching.merge_terms(own, world, named(part, "p_name", "shared "))


def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    stems = read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 3).cast("string").alias("dir"), F.regexp_replace("s_name", "0*([0-9]+)$", "$1").alias("stem"))
    order = Window.partitionBy("dir").orderBy(names.first_number(F.col("stem")), "stem")
    return stems.select("s_suppkey", "dir", F.row_number().over(order).alias("place"))


def usage_window_cum(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = read(spark, sf_dir, "events").select(F.col("user_id").alias("cue"), F.col("event_id").alias("seq"), F.col("event_type").alias("word"), (F.col("event_id") * 10).alias("start"), (F.col("event_id") * 10 + 7).alias("end"))
    return windows.progress(windows.gaps(tokens)).select("cue", "seq", "gap", "chars_to", "elapsed")


def lrc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = cue_lines(spark, sf_dir).select("file", F.col("seq").alias("line_no"), F.lit("lyric").alias("item_type"), "time_ms", "text", F.lit(None).cast("string").alias("raw"))
    return subtitles.render_items(cues).withColumn("ext", F.lit(".lrc"))


def whole_files(spark: SparkSession, sf_dir: str, ext: str) -> DataFrame:
    """Conversations as subtitle files of any format: a turn is one cue of as many lines as it has."""
    c = cue_rows(spark, sf_dir)
    number, stamp = (F.col("seq") + 1).cast("string"), timing.ms_to_stamp(F.col("time_ms"))
    block = {
        ".lrc": F.concat(stamp, "text"), ".srt": F.concat(number, F.lit("\n00:00:01,000 --> 00:00:02,000\n"), "text", F.lit("\n")),
        ".vtt": F.concat(F.when(F.col("seq") % 2 == 0, F.concat(number, F.lit("\n"))).otherwise(""), F.lit("00:00:01.000 --> 00:00:02.000\n"), "text", F.lit("\n")),
    }[ext]
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", block.alias("b")))), lambda x: x["b"]), "\n")
    head = {".lrc": "[ti:title]\n", ".srt": "", ".vtt": "WEBVTT\n\n"}[ext]
    return c.groupBy("file").agg(F.concat(F.lit(head), body, F.lit("\n")).alias("content")).withColumn("ext", F.lit(ext))


def lrc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3 then S2 in both time modes."""
    lrc = lrc_files(spark, sf_dir)
    a, b = subtitles.lrc_cues(lrc, "trunc"), subtitles.lrc_cues(lrc, "round").select("file", "seq", F.col("time_ms").alias("rounded_ms"))
    return a.join(b, ["file", "seq"]).select("file", "seq", "time_ms", "rounded_ms", F.md5("text").alias("text"))


def lrc_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 then K1 with changed texts, on cues whose further lines continue the first."""
    lines = subtitles.structure(whole_files(spark, sf_dir, ".lrc"))
    new = subtitles.replace_texts(lines, lines.filter("slot is not null").select("file", "slot", F.replace("text", F.lit("e"), F.lit("EE")).alias("new_text")))
    return new.select("file", F.length("content").alias("chars"), F.md5("content").alias("content"))


def srt_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7 on SRT files with every third cue emptied and all lines of the others."""
    c = cue_rows(spark, sf_dir).withColumn("body", F.when(F.col("seq") % 3 == 1, "").otherwise(F.concat("text", F.lit("\n"))))
    block = F.concat((F.col("seq") + 1).cast("string"), F.lit("\n00:00:01,000 --> 00:00:02,000\n"), "body")
    srt = c.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", block.alias("b")))), lambda x: x["b"]), "\n").alias("content")).withColumn("ext", F.lit(".srt"))
    return subtitles.without_blank_cues(srt).select("file", "removed", F.md5("content").alias("content"))


def timed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with words timed 300 ms each and a pause after every seventh."""
    cues = cue_rows(spark, sf_dir).withColumn("line", F.trim(F.regexp_replace(F.col("text"), r"\s+", " ")))
    words = F.transform(F.split("line", " "), lambda w, i: F.struct((F.col("time_ms") + i * 300 + F.floor(i / 7) * 400).alias("start"), (F.col("time_ms") + i * 300 + F.floor(i / 7) * 400 + 280).alias("end"), w.alias("word")))
    out = cues.withColumn("words", words)
    return out.select("file", "seq", F.array_join(F.transform("words", lambda w: w["word"]), "").alias("text"), "words")


def resegment_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15, C4, C8-C11, F21, F22."""
    pieces = segment.pieces_of(segment.plan_cuts(timed_words(spark, sf_dir)))
    return pieces.select("file", "seq", "piece", "time_ms", "end_ms", "text")


def resegment_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of long turns when one asker answers for most of them and another for some of the rest."""

    def every_seventh(cues: DataFrame) -> DataFrame:
        n = F.size("words")
        return cues.filter("seq % 3 <> 1").withColumn("proposed", F.when(n > 7, F.sequence(F.lit(7), n - 1, F.lit(7))).otherwise(F.array().cast("array<int>")))

    def third(cues: DataFrame) -> DataFrame:
        return cues.filter("seq % 2 = 0").withColumn("proposed", F.array(F.lit(3)))

    return segment.plan_in_rounds(timed_words(spark, sf_dir), [every_seventh, third])[1]


def cut_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The choices of each long turn, as a model is asked for them."""
    rows = segment.cut_requests(timed_words(spark, sf_dir))
    line = F.transform("choices", lambda c: F.concat_ws(" ", c["label"], c["level"], c["chars"].cast("string"), c["ms"].cast("string"), c["preview"]))
    asked = F.get_json_object("prompt", "$.choices[0].label").alias("first")
    return rows.select("file", "seq", "chars", "ms", F.size("choices").alias("n"), F.md5(F.array_join(line, "\n")).alias("choices"), asked)


def legal_cut_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = timed_words(spark, sf_dir).select("file", "seq", F.explode(segment.legal_cuts(F.col("words"))).alias("c"))
    return cuts.groupBy("file", "seq").agg(F.count_if(F.col("c.level") == "S").alias("stops"), F.count_if(F.col("c.level") == "P").alias("pauses"), F.sum("c.k").alias("places"))


def align_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns against the script of their conversation, every fifth word changed."""
    c = cue_rows(spark, sf_dir).repartition("file")  # the table may be one row group
    changed = F.array_join(F.transform(F.split("text", " "), lambda w, i: F.when(i % 5 == 2, "xx").otherwise(w)), " ")
    line_no = F.row_number().over(Window.partitionBy("file").orderBy("seq")) - 1
    return align.align_script(c.select(F.col("file").alias("track"), "seq", changed.alias("text")), c.select(F.col("file").alias("track"), line_no.alias("line_no"), "text"))


def page_boxes(spark: SparkSession, sf_dir: str, page: str = "o_orderkey div 128 + 100") -> DataFrame:
    """Orders of customers as boxes on pages, tall, wide and square ones, and pages of a few known boxes."""
    text = F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" of order number "), F.col("o_orderkey").cast("string"))).otherwise(""))
    orders = read(spark, sf_dir, "orders").select(
        F.expr(page).alias("page"), (F.col("o_totalprice") % 600).alias("cx"), (F.col("o_orderkey") % 900).cast("double").alias("cy"),
        (F.col("o_orderkey") % 17 * 3).cast("double").alias("w"), (F.col("o_orderkey") % 13 * 3 + 5).cast("double").alias("h"), text.alias("text"),
    )
    known = spark.sql(f"SELECT cast(page as bigint) page, cast(cx as double) cx, cast(cy as double) cy, cast(w as double) w, cast(h as double) h, text FROM VALUES {BOXES} AS t(page, cx, cy, w, h, text)")
    return orders.unionByName(known)


def layout_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O4 on boxes."""
    return layout.horizontal_order(page_boxes(spark, sf_dir)).select("page", "text", "nth")


def page_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as glyphs: some 32 orders are a document, their line numbers its pages; x from the quantity, y from the price."""
    letter = F.element_at(F.array(*[F.lit(c) for c in ("あ", "7", "漢", "1", "♪", " ", "字", "22")]), (F.col("l_partkey") % 8 + 1).cast("int"))
    return read(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey div 128").cast("string").alias("doc"), F.col("l_linenumber").alias("page"), (F.col("l_quantity") * 5).alias("x"), (F.col("l_extendedprice") % 90).alias("y"),
        F.col("l_returnflag").alias("flag"), letter.alias("letter"), F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"),
    )


def layout_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs to columns, those of few glyphs joined to their nearest."""
    lines = layout.glyph_lines(page_glyphs(spark, sf_dir).withColumn("text", F.col("flag")), True)
    return lines.select("doc", "page", "line", F.length("text").alias("glyphs"), F.md5("text").alias("text"))


def page_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the first pages of a document read better across than down."""
    return layout.is_horizontal(page_glyphs(spark, sf_dir).withColumn("text", F.col("letter")), 3, 20)


def glyph_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("doc"), F.col("l_quantity").alias("x"), F.floor(F.col("l_extendedprice") / 100).alias("y"))
    return layout.histograms(li)


def json_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns answered as JSON, some broken, read back."""
    c = cue_rows(spark, sf_dir).withColumn("plain", F.regexp_replace("text", r'["\\\n]', " "))
    grouped = c.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("seq", "plain"))).alias("rows"))
    items = F.transform("rows", lambda r, i: F.concat(F.lit('{"index": '), (i + 1).cast("string"), F.lit(', "text": "'), F.upper(r["plain"]), F.lit('"}')))
    broken = F.col("file").cast("long") % 3
    raw = F.when(broken == 0, F.concat(F.lit('{"translations": ['), F.array_join(items, ", "), F.lit("]}"))).when(broken == 1, F.array_join(items, "},\n")).otherwise(F.concat(F.lit('ok {"translations": ['), F.array_join(items, ", ")))
    asked = grouped.select("file", F.transform("rows", lambda r: r["plain"]).alias("originals"), raw.alias("raw"))
    return with_answer_texts(asked, "originals", "raw", "got").select("file", F.col("got.parsed").alias("parsed"), F.col("got.how").alias("how"), F.md5(F.array_join("got.texts", "|")).alias("texts"))


def translate_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 with the offline stand-in."""
    rows = windows.fixed_chunks(cue_rows(spark, sf_dir), 4).select("file", "chunk", "seq", "text")
    return model.translate(rows, ["file", "chunk"], model.echo_model).select("file", "seq", F.md5("new_text").alias("new_text"), "how")


def script_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine documents of one language in a row as a script with marks between them; rows of one doc_id share a mark."""
    d = read(spark, sf_dir, "documents").filter(F.col("doc_id").isNotNull()).withColumn("n", F.pmod("doc_id", F.lit(9)) + 1)
    d = d.withColumn("work", F.concat_ws("/", "lang", F.expr("(doc_id - pmod(doc_id, 9)) div 9").cast("string")))
    sections = d.groupBy("work", "n").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text"))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat(F.lit("トラック"), F.col("n").cast("string"), F.lit("\n"), "text").alias("t")))), lambda x: x["t"]), "\n")
    s = sections.groupBy("work").agg(content.alias("content"))
    tracks = sections.select("work", F.concat(F.lit("tr0"), F.col("n").cast("string")).alias("track"), F.col("n").alias("seq"))
    return scripts.split_by_marks(s, tracks).select("work", "track", F.size("lines").alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("lines"))


def pre_clean_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8, F9, F11, F12."""
    d = spread_documents(spark, sf_dir).select("doc_id", F.concat(F.lit("<!-- page 3 -->\nSE: bang\n12\n3/4\n\n\n\n"), "text", F.lit("\nshort\n■mark\n12abc（note）")).alias("text"))
    cleaned = text.pre_clean("text")
    return d.select("doc_id", F.length(cleaned).alias("cleaned"), F.length(text.merge_short_lines(cleaned)).alias("merged"), F.length(text.clean_number_lines(cleaned)).alias("numbers"), F.length(text.without_brackets(cleaned)).alias("bare"))


def label_excel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), names.sheet_label(F.col("p_partkey")).alias("label"))


def time_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6, F18, F19, A2, A3."""
    e = usage_rows(spark, sf_dir)
    return e.select("seq", timing.ms_to_stamp(F.col("hit_tokens") * 977).alias("stamp"), timing.hms(F.col("miss_tokens") * 13).alias("shown"), F.round(timing.hit_rate(F.col("hit_tokens"), F.col("miss_tokens")), 6).alias("rate"), timing.show_tokens(F.col("hit_tokens") * 7).alias("tokens"))


def work_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files of works, some below a numbered folder."""
    number = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("rj"), (F.col("page_id") + 100_000).cast("string"), F.lit("/"))).otherwise("")
    paths = read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("lib/"), number, F.lit("disc/"), F.col("page_id").cast("string"), F.lit(".lrc")).alias("path"))
    return paths.select("page_id", files.work_root(F.col("path")).alias("root"), names.work_number(F.col("path")).alias("number"))


def txt_over_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as scripts, two to a name."""
    ext = F.when(F.col("page_id") % 2 == 0, ".txt").otherwise(".pdf")
    stem = F.when(F.col("page_id") % 5 == 0, F.col("page_id")).otherwise(F.floor(F.col("page_id") / 2))
    listed = read(spark, sf_dir, "pages").select(F.concat(F.lit("d"), (F.floor(F.col("page_id") / 20)).cast("string"), F.lit("/n"), stem.cast("string"), ext).alias("path"))
    kept = files.prefer_txt(listed)
    order = Window.partitionBy("dir").orderBy(names.first_number(F.col("stem")), "stem", "path")
    return kept.select("path", F.row_number().over(order).alias("place"))


def script_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10 on names built from parts."""
    word = F.element_at(F.array(*[F.lit(w) for w in ("台本", "readme", "Track", "01_", "plain", "credit_台本", "トラック３")]), (F.col("p_partkey") % 7 + 1).cast("int"))
    stem = F.concat(word, F.col("p_partkey").cast("string"))
    ext = F.when(F.col("p_partkey") % 11 == 0, ".doc").otherwise(".txt")
    parent = F.when(F.col("p_partkey") % 13 == 0, "05.台本").otherwise("misc")
    return read(spark, sf_dir, "part").select("p_partkey", files.is_script(F.concat(stem, ext), stem, ext, parent).alias("script"))


def variant_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tracks, each with an empty variant."""
    p = read(spark, sf_dir, "part").select(F.col("p_size").alias("work"), F.concat_ws(" ", "p_name", "p_partkey").alias("track"), F.split("p_name", " ").alias("lines"))
    empty = p.select("work", F.concat("track", F.lit("（room）")).alias("track"), F.array().cast("array<string>").alias("lines"))
    return matching.inherit_variants(p.unionByName(empty)).select("work", "track", F.array_join("lines", "|").alias("lines"))


def coverage_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tracks of works, some with lines."""
    p = read(spark, sf_dir, "part").select((F.col("p_partkey") % 97).alias("work"), "p_partkey", F.concat_ws(" ", "p_name", "p_partkey").alias("track"))
    a = p.filter("p_partkey % (work % 3 + 2) = 0").select("work", "track", F.array(F.lit("a")).alias("lines"))
    b = p.filter("p_partkey % 2 = 0").select("work", "track", F.array(F.lit("b"), F.lit("c")).alias("lines"))
    return scripts.coverage(matching.fill_missing(a, b, p.select("work", "track"))).select("work", "tracks", "matched", "total", "accepted")


def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as failed calls."""
    e = read(spark, sf_dir, "events")
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 400, 429, 500, 402)]), (F.col("event_id") % 5 + 1).cast("int"))
    said = F.element_at(F.array(*[F.lit(x) for x in ("ok", "Unsupported value", "rate limit", "connection reset", "no credit", "timed out")]), (F.col("event_id") % 6 + 1).cast("int"))
    rows = e.select(status.alias("status"), said.alias("said"))
    return rows.groupBy("status", "said").agg(F.count("*").alias("n")).select("status", "said", "n", names.is_unsupported_parameter(F.col("status"), F.col("said")).alias("parameter"), names.is_quota_exhausted(F.col("status"), F.col("said")).alias("quota"))


def usage_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as provider usage in two shapes."""
    n = F.col("event_id").cast("string")
    one = F.concat(F.lit('{"prompt_tokens": '), n, F.lit(', "prompt_cache_hit_tokens": 3, "prompt_cache_miss_tokens": 5, "completion_tokens": 2}'))
    two = F.concat(F.lit('{"prompt_tokens": '), n, F.lit(', "prompt_tokens_details": {"cached_tokens": 7}, "completion_tokens_details": {"reasoning_tokens": 4}}'))
    raw = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, one).otherwise(two).alias("usage"))
    return usage.normal_usage(raw).drop("usage")


def chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as files, events as attempts, with and without chunks."""
    e = usage_rows(spark, sf_dir).withColumnsRenamed({"user_id": "file", "seq": "attempt"})
    every = usage.chunk_usage(e, True).select("file", F.col("hit_tokens").alias("all_hits"))
    return every.join(usage.chunk_usage(e, False).select("file", F.col("hit_tokens").alias("last_hits")), "file")


def box_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers as boxes on pages."""
    b = read(spark, sf_dir, "orders").select(F.expr("o_orderkey div 128").alias("page"), (F.col("o_totalprice") % 600).alias("cx"), (F.col("o_orderkey") % 900).cast("double").alias("cy"), F.lit(10.0).alias("w"), (F.col("o_orderkey") % 13 + 5).cast("double").alias("h"), F.col("o_orderpriority").alias("text"))
    return layout.vertical_pages(b)


def box_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3, W3 on boxes."""
    return layout.vertical_order(page_boxes(spark, sf_dir, "o_custkey % 40 + 100"))


def line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16 over documents and a few Japanese lines."""
    extra = spark.sql("SELECT * FROM VALUES ('ja', '漢字かな交じり'), ('ja', '♡♪ab'), ('ja', '12') AS t(lang, text)")
    out = layout.text_quality(doc_lines(spark, sf_dir).select("lang", "text").unionByName(extra), ["lang"])
    return out.select("lang", F.round("quality", 9).alias("quality"))


def speech_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoken time of turns, and whether they are too long."""
    t = timed_words(spark, sf_dir)
    return t.select("file", "seq", timing.speech_ms(F.col("words")).alias("speech_ms"), timing.is_too_long(F.col("text"), F.col("words")).alias("too_long"))


def split_and_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long turns split inside their files."""
    t = timed_words(spark, sf_dir)
    items = t.select("file", F.col("seq").cast("int").alias("line_no"), F.lit("lyric").alias("item_type"), F.get("words", F.lit(0))["start"].alias("time_ms"), "text", F.lit(None).cast("string").alias("raw"))
    dense = t.withColumn("seq", F.row_number().over(Window.partitionBy("file").orderBy("seq")) - 1)
    new = segment.apply_cuts(items, segment.pieces_of(segment.plan_cuts(dense)))
    return new.groupBy("file").agg(F.count_if(F.col("item_type") == "lyric").alias("lyrics"), F.count_if(F.col("item_type") == "clear").alias("clears"), F.bool_and("lossless").alias("lossless"))


def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 on neighbouring part names."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"), F.lead("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("b")).filter("b is not null")
    return part.select("p_partkey", names.similar_names(F.col("a"), F.col("b")).alias("similar"))


def normal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F2, F5 on documents with a Japanese line."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\nカタカナ、「かな」ヴヶ！")).alias("text"))
    return d.select("doc_id", F.md5(text.align_normal("text")).alias("normal"), F.length(text.echo_normal("text")).alias("echo"), text.compact_length("text").alias("compact"))


def archived_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as subtitle files, some archived, some gone."""
    ext = F.element_at(F.array(F.lit(".lrc"), F.lit(".srt"), F.lit(".vtt")), (F.col("page_id") % 3 + 1).cast("int"))
    base = F.concat(F.lit("w/d"), (F.col("page_id") % 4).cast("string"), F.lit("/"), F.col("page_id").cast("string"))
    p = read(spark, sf_dir, "pages")
    listed = p.filter("page_id % 5 <> 0").select(F.concat(base, ext).alias("path")).unionByName(p.filter("page_id % 2 = 0").select(F.concat(base, F.lit(".ja"), ext).alias("path"))).withColumn("mtime", F.lit(None).cast("timestamp"))
    live, _, restore = files.subtitles(listed)
    counted = files.count_by_extension(live)
    again, todo, done = restore.groupBy("ext").agg(F.count("*").alias("restored")), files.to_archive(listed), files.with_original(listed).groupBy("ext").agg(F.count("*").alias("with_original"))
    todo = todo.groupBy(F.regexp_extract("path", r"(\.[a-z]+)$", 1).alias("ext")).agg(F.count("*").alias("to_archive"))
    out = counted
    for other in (again, todo, done):
        out = out.join(other, "ext", "left")
    return out.na.fill(0)


def _all() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            line_explode_stats, word_frequency_topk, lang_detect, page_noise_filter, repetition_filter, dropped_lines, usage_cost_by_work, usage_by_type, usage_totals, usage_reconcile,
            status_manifest, peak_cost_split, gap_sessions, asof_prev_event, interval_match, turn_context, chunk_fixed, chunk_budget, budget_cut, stride_sample, first_n_dedupe,
            numbered_lines, blank_tails, anti_semi_labels, dice_pairs, anchor_match, longest_prefix, name_tier_join, term_merge, natural_sort, usage_window_cum, lrc_roundtrip,
            lrc_structure, srt_clean, resegment_local, resegment_rounds, cut_requests, legal_cut_levels, align_spans, layout_order, layout_glyphs, page_votes, glyph_histogram, json_ladder, translate_stub, script_marks,
            pre_clean_merge, label_excel, time_stamps, work_roots, txt_over_pdf, script_names, variant_inherit, coverage_fill, error_kinds, usage_normal, chunk_tokens, box_columns,
            box_reading_order, line_quality, speech_time, split_and_render, name_similarity, normal_texts, archived_originals,
        )
    }


QUERIES = _all()
