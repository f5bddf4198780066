"""Subtitle text to rows and back.

Input everywhere: files(file string, ext string, content string).  Line numbers carry the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import KANA_LETTERS, count_class, file_language, strip
from ..functions.timing import ms_to_stamp, stamp_to_ms

ARROW = "-->"
TIME_TAG = r"^\[(\d+):(\d+(?:\.\d+)?)\]"
ANY_TAG = r"^(\[.*?\])\s*(.*)"


def lines_of(files: DataFrame, separator: str = "\n") -> DataFrame:
    """Rows (file, ext, line_no, line), lines counted from 0."""
    return files.select("file", "ext", F.posexplode(F.split("content", separator, -1)).alias("line_no", "line"))


def lrc_cues(files: DataFrame, mode: str = "trunc") -> DataFrame:
    """Rows (file, seq, time_ms, text) of timed lines; seq is dense over them."""
    s = strip("line")
    timed = lines_of(files).withColumn("line", s).filter(F.rlike("line", F.lit(TIME_TAG)))
    at = stamp_to_ms(F.regexp_extract("line", TIME_TAG, 1), F.regexp_extract("line", TIME_TAG, 2), mode)
    seq = F.row_number().over(Window.partitionBy("file").orderBy("line_no")) - 1
    return timed.select("file", seq.alias("seq"), at.alias("time_ms"), strip(F.regexp_replace("line", TIME_TAG, "")).alias("text"))


def lrc_items(files: DataFrame) -> DataFrame:
    """Rows (file, line_no, item_type, time_ms, text, raw); other lines stay as raw items."""
    pattern = TIME_TAG + r"(.*)$"
    content = F.regexp_replace("content", r"(\r\n|\r|\n)\z", "")
    rows = lines_of(files.withColumn("content", content), r"\r\n|\r|\n").filter((F.col("line_no") > 0) | (F.col("line") != ""))
    is_time = F.rlike("line", F.lit(pattern))
    text = F.when(is_time, strip(F.regexp_extract("line", pattern, 3)))
    at = F.when(is_time, stamp_to_ms(F.regexp_extract("line", pattern, 1).try_cast("long"), F.regexp_extract("line", pattern, 2).try_cast("double")))
    kind = F.when(~is_time, "raw").when(text == "", "clear").otherwise("lyric")
    return rows.select("file", "line_no", kind.alias("item_type"), at.alias("time_ms"), text.alias("text"), F.col("line").alias("raw"))


def render_items(items: DataFrame, order: str = "line_no") -> DataFrame:
    """K3: files(file, content) from items; stamps in centiseconds."""
    line = F.when(F.col("item_type") == "raw", F.col("raw")).otherwise(F.concat(ms_to_stamp(F.col("time_ms")), F.coalesce("text", F.lit(""))))
    return items.groupBy("file").agg(F.concat(_in_order(order, line, "\n"), F.lit("\n")).alias("content"))


def _in_order(order: str, line: Column, separator: str) -> Column:
    """Lines of a file joined in order; null lines are left out."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return F.array_join(F.transform(pairs, lambda p: p["line"]), separator)


def structure(files: DataFrame) -> DataFrame:
    """S3: rows (file, ext, line_no, kind, tag, text, verbatim, slot).

    kind is text for a replaceable slot (numbered from 0 by ``slot``) and verbatim for a line kept as
    it is.  In LRC a line without a tag continues the timed line before it.  Files without any text
    give no rows.
    """
    content = F.regexp_replace("content", r"\n\z", "")
    rows = lines_of(files.withColumn("content", content)).withColumn("line", F.regexp_replace("line", r"\r$", ""))
    s = strip("line")
    by = Window.partitionBy("file").orderBy("line_no")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"s": s, "ext": F.lower("ext")})

    lrc = rows.filter("ext = '.lrc'")
    tag = F.regexp_extract("line", ANY_TAG, 1)
    lrc = lrc.withColumn("tag", F.when(F.rlike("line", F.lit(ANY_TAG)), tag)).withColumn("timed", F.coalesce(F.rlike("tag", F.lit(r"(?U)\[\d{1,3}:\d{2}\.\d{2,3}\]")), F.lit(False)))
    lrc = lrc.withColumn("owner", F.sum(F.col("timed").cast("int")).over(by))
    lrc = lrc.withColumn("joins", F.col("tag").isNull() & (F.col("s") != "") & (F.col("owner") > 0))
    part = F.when(F.col("timed"), F.regexp_extract("line", ANY_TAG, 2)).otherwise(F.col("s"))
    slots = lrc.filter("timed or joins").groupBy("file", "ext", "owner").agg(F.min("line_no").alias("line_no"), F.max(F.when(F.col("timed"), F.col("tag"))).alias("tag"), _in_order("line_no", part, " ").alias("text"))
    lrc = slots.select("file", "ext", "line_no", F.lit("text").alias("kind"), "tag", "text", F.lit(None).cast("string").alias("verbatim")).unionByName(
        lrc.filter("not timed and not joins").select("file", "ext", "line_no", F.lit("verbatim").alias("kind"), F.lit(None).cast("string").alias("tag"), F.lit(None).cast("string").alias("text"), F.col("line").alias("verbatim"))
    )

    arrow = F.contains("line", F.lit(ARROW))
    digits = F.rlike("s", F.lit(r"(?U)^\d+$"))
    srt = rows.filter("ext = '.srt'").withColumns({"segment": F.sum((F.col("s") == "").cast("int")).over(by), "opens": arrow & F.coalesce(F.lag(digits).over(by), F.lit(False))})
    first = F.min(F.when(F.col("opens"), F.col("line_no"))).over(Window.partitionBy("file", "segment"))
    srt = srt.withColumn("is_text", F.coalesce(F.col("line_no") > first, F.lit(False)) & (F.col("s") != ""))

    header = (F.col("s") == "WEBVTT") | F.startswith("s", F.lit("NOTE")) | F.startswith("s", F.lit("STYLE"))
    event = F.when(F.contains("s", F.lit(ARROW)), ~header).when(F.col("s") == "", False)
    vtt = rows.filter("ext = '.vtt'").withColumn("is_text", F.coalesce(F.last(event, ignorenulls=True).over(before), F.lit(False)) & (F.col("s") != "") & ~F.contains("s", F.lit(ARROW)))
    blocks = [
        x.select(
            "file", "ext", "line_no", F.when(F.col("is_text"), "text").otherwise("verbatim").alias("kind"), F.when(F.col("is_text"), "").alias("tag"),
            F.when(F.col("is_text"), F.col("line")).alias("text"), F.when(~F.col("is_text"), F.col("line")).alias("verbatim"),
        )
        for x in (srt, vtt)
    ]
    out = lrc.unionByName(blocks[0]).unionByName(blocks[1])
    out = out.withColumn("has_text", F.max(F.col("kind") == "text").over(Window.partitionBy("file"))).filter("has_text").drop("has_text")
    nth = F.sum((F.col("kind") == "text").cast("int")).over(by) - 1
    return out.withColumn("slot", F.when(F.col("kind") == "text", nth).cast("int"))


def replace_texts(lines: DataFrame, texts: DataFrame, drop_empty: bool = False) -> DataFrame:
    """K1: files(file, ext, content) with slot texts replaced by texts(file, slot, new_text).

    Slots without a new text stay empty.  With ``drop_empty``, LRC loses blank lines altogether, the
    other formats only the empty slots.
    """
    joined = lines.join(texts.select("file", "slot", "new_text", F.lit(True).alias("given")), ["file", "slot"], "left")
    is_lrc, empty = F.col("ext") == ".lrc", strip(F.coalesce("new_text", F.lit(""))) == ""
    slot = F.when(F.col("given").isNull(), F.lit(None if drop_empty else "")).when(is_lrc & empty & F.lit(drop_empty), F.lit(None)).when(is_lrc, F.concat("tag", F.coalesce("new_text", F.lit("")))).otherwise(F.coalesce("new_text", F.lit("")))
    line = F.when(F.col("kind") == "text", slot).otherwise(F.when(is_lrc & F.lit(drop_empty) & (strip("verbatim") == ""), F.lit(None)).otherwise(F.col("verbatim")))
    out = joined.withColumn("out", line).filter("out is not null")
    return out.groupBy("file", "ext").agg(F.concat(_in_order("line_no", F.col("out"), "\n"), F.lit("\n")).alias("content"))


def timeline(cues: DataFrame, texts: DataFrame) -> DataFrame:
    """K2: files(file, content): stamps of cues with texts(file, seq, new_text); the shorter side ends it."""
    line = F.concat(ms_to_stamp(F.col("time_ms")), F.col("new_text"))
    return cues.join(texts, ["file", "seq"]).groupBy("file").agg(_in_order("seq", line, "\n").alias("content"))


def sibling_texts(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """K4: new texts for sibling files, only where the number of texts equals the number of slots.

    ``texts`` has (file, seq, new_text) of the LRC; siblings share its path without the extension.
    """
    stem = lambda c: F.regexp_replace(c, r"\.[^./]+$", "")
    spoken = texts.filter(strip("new_text") != "").withColumn("stem", stem("file"))
    dense = F.row_number().over(Window.partitionBy("stem").orderBy("seq")) - 1
    spoken = spoken.select("stem", "new_text", dense.alias("slot"), F.count("*").over(Window.partitionBy("stem")).alias("n"))
    slots = lines.filter("kind = 'text' and ext <> '.lrc'").withColumns({"stem": stem("file"), "n": F.count("*").over(Window.partitionBy("file"))})
    return slots.join(spoken, ["stem", "n", "slot"]).select("file", "slot", "new_text")


def spoken_texts(files: DataFrame, any_hour: bool = False) -> DataFrame:
    """Rows (file, line_no, text) without stamps and numbers.

    A VTT file is read from its first line that starts with ``00:`` (Q4) unless ``any_hour``.
    """
    rows = lines_of(files).withColumns({"s": strip("line"), "ext": F.lower("ext")})
    by = Window.partitionBy("file").orderBy("line_no")
    timed = F.rlike(F.regexp_extract("s", ANY_TAG, 1), F.lit(r"(?U)\[\d+:\d{2}\.\d{2,3}\]"))
    lrc = rows.filter("ext = '.lrc'").filter(timed).select("file", "line_no", F.regexp_extract("s", ANY_TAG, 2).alias("text"))

    digits = F.rlike("s", F.lit(r"(?U)^\d+$"))
    srt = rows.filter("ext = '.srt'").withColumns({"digits": digits, "segment": F.sum((F.col("s") == "").cast("int")).over(by)})
    run = F.col("line_no") - F.max(F.when(~F.col("digits"), F.col("line_no"))).over(by)  # numbers in a row up to here
    srt = srt.withColumn("run", F.when(F.col("digits"), F.coalesce(run, F.col("line_no") + 1)).otherwise(0))
    opens = F.contains("line", F.lit(ARROW)) & (F.coalesce(F.lag("run").over(by), F.lit(0)) % 2 == 1)
    srt = srt.withColumn("opens", opens)
    first = F.min(F.when(F.col("opens"), F.col("line_no"))).over(Window.partitionBy("file", "segment"))
    srt = srt.withColumn("first", first).filter("line_no > first and s <> ''").select("file", "line_no", F.col("s").alias("text"))

    vtt = rows.filter("ext = '.vtt'")
    if not any_hour:
        begins = F.min(F.when(F.startswith("s", F.lit("00:")), F.col("line_no"))).over(Window.partitionBy("file"))
        vtt = vtt.withColumn("begins", begins).filter("line_no >= begins")
    event = F.when(F.contains("s", F.lit(ARROW)), ~F.startswith("s", F.lit("NOTE"))).when(F.col("s") == "", False)
    inside = F.last(event, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    vtt = vtt.withColumn("inside", inside).filter("inside and s <> ''").filter(~F.contains("s", F.lit(ARROW))).select("file", "line_no", F.col("s").alias("text"))
    return lrc.unionByName(srt).unionByName(vtt)


def language_of_files(files: DataFrame) -> DataFrame:
    """Rows (file, language) over the spoken texts of each file."""
    texts = spoken_texts(files).groupBy("file").agg(F.sum(count_class("text", KANA_LETTERS)).alias("kana"), F.sum(count_class("text", "[一-鿿]")).alias("han"), F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    joined = files.select("file").join(texts, "file", "left").select("file", *[F.coalesce(c, zero).alias(c) for c in ("kana", "han", "n")])
    return joined.select("file", file_language(F.col("kana"), F.col("han"), F.col("n")).alias("language"))


def without_blank_cues(files: DataFrame) -> DataFrame:
    """files(file, ext, content, removed) without blank cues.

    LRC loses blank lines and lines with nothing but time tags.  SRT and VTT lose blocks with a time
    but no text; headers, notes and styles come first.
    """
    text = F.regexp_replace(F.col("content"), r"(\r\n|\r|\n)\z", "")
    lines = F.when(F.col("content") == "", F.array().cast("array<string>")).otherwise(F.split(text, r"\r\n|\r|\n", -1))
    tag = r"\[\d+:\d+(?:\.\d+)?\]"
    blank = lambda x: (strip(x) == "") | (F.rlike(x, F.lit(tag)) & (strip(F.regexp_replace(x, tag, "")) == ""))
    kept = F.filter(lines, lambda x: ~blank(x))
    lrc_text = F.when(F.size(kept) > 0, F.concat(F.array_join(kept, "\n"), F.lit("\n"))).otherwise("")

    blocks = F.split(F.regexp_replace(F.replace("content", F.lit("\r\n"), F.lit("\n")), r"^\n+|\n+\z", ""), r"\n[ \t]*\n", -1)
    blocks = F.filter(F.transform(blocks, lambda b: strip(b)), lambda b: b != "")
    is_head = lambda b: F.rlike(b, F.lit("^(WEBVTT|NOTE|STYLE)"))
    head, body = F.filter(blocks, is_head), F.filter(blocks, lambda b: ~is_head(b))
    empty = lambda b: F.contains(b, F.lit(ARROW)) & (strip(F.regexp_replace(b, r"(?s)^.*?-->[^\n]*", "")) == "")
    full = F.concat(head, F.filter(body, lambda b: ~empty(b)))
    block_text = F.when(F.size(full) > 0, F.concat(F.array_join(full, "\n\n"), F.lit("\n"))).otherwise("")
    is_lrc = F.lower("ext") == ".lrc"
    return files.select(
        "file", "ext", F.when(is_lrc, lrc_text).otherwise(block_text).alias("content"),
        F.when(is_lrc, F.size(lines) - F.size(kept)).otherwise(F.size(F.filter(body, empty))).cast("long").alias("removed"),
    )
