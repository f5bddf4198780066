"""Scripts by track."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import name_key, similar_names
from ..functions.nested import let
from ..functions.text import is_noise_line, merge_short_lines, pre_clean, strip
from .cut import checkpointed

# Fixed value: a track mark, with full-width or plain digits.
MARK = r"(?i)(?:《|【|■|□)?トラック\s*([0-9０-９]+)|(?:《|【|■|□)?Track\s*(\d+)"
ENCODINGS = ("utf-8", "shift-jis", "cp932", "euc-jp", "iso-2022-jp")


def decode_udf():
    """Bytes to text by the first encoding that gives anything but blanks; null if none does."""

    @F.pandas_udf("string")
    def decode(content: pd.Series) -> pd.Series:
        def one(raw):
            for name in ENCODINGS if raw is not None else ():
                try:
                    text = bytes(raw).decode(name)
                except UnicodeDecodeError:
                    continue
                if text.strip():
                    return text
            return None

        return content.map(one)

    return decode


def raw_script(files: DataFrame) -> DataFrame:
    """C17: script_lines(work, track, line_no, text): the order of files numbers the tracks.

    files(work, seq, content); blank lines go, files without any are left out.  Files are sorted over all tasks
    and counted from the first of their work, so no task reads a whole work.
    """
    lines = F.filter(F.transform(F.split("content", "\n"), lambda x: strip(x)), lambda x: x != "")
    ordered = files.select("work", "seq", lines.alias("lines")).repartitionByRange("work", "seq").sortWithinPartitions("work", "seq")
    placed = checkpointed(ordered.withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))})
    runs = placed.groupBy("work", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("work").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("work").alias("of"), F.col("part").alias("in"), (earlier - F.col("first") + 1).alias("plus"))
    numbered = placed.join(runs, F.col("work").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")))
    return numbered.select("work", (F.col("at") + F.col("plus")).cast("int").alias("track"), F.posexplode("lines").alias("line_no", "text"))


def split_by_marks(scripts: DataFrame, tracks: DataFrame) -> DataFrame:
    """Rows (work, track, lines) for all tracks.  scripts(work, content), tracks(work, track, seq).

    Marks sorted by number each take the text from their own place to that of the next mark in number
    order, which is empty if it stands before (Q8).  A number goes to the first track whose name holds
    it, else to the track of that place.  Without marks all lines go to the first track.
    """
    # The text between marks gives their places.
    sizes = F.zip_with(F.split("content", MARK, -1), F.regexp_extract_all("content", F.lit(MARK), F.lit(0)), lambda p, m: F.struct(F.length(p).alias("before"), F.length(m).alias("size"), m.alias("mark")))
    digits = lambda mark: F.translate(F.regexp_extract(mark, "([0-9０-９]+)$", 1), "０１２３４５６７８９", "0123456789").cast("int")
    step = lambda acc, x: F.struct(
        (acc["at"] + x["before"] + F.coalesce(x["size"], F.lit(0))).alias("at"),
        F.when(x["mark"].isNotNull(), F.array_append(acc["out"], F.struct(digits(x["mark"]).alias("number"), F.size(acc["out"]).alias("nth"), (acc["at"] + x["before"]).alias("pos")))).otherwise(acc["out"]).alias("out"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<number:int,nth:int,pos:int>>").alias("out"))
    marks = F.array_sort(F.aggregate(sizes, zero, step, lambda acc: acc["out"]))

    def plain(text: Column, noise: bool) -> Column:
        bare = F.transform(F.split(text, "\n"), lambda x: F.struct(strip(x).alias("s"), x.alias("x")))
        kept = lambda x: (x["s"] != "") & (~F.startswith(x["s"], F.lit("※")) & ~F.rlike(x["s"], F.lit("^[《【].*[》】]$")) if noise else ~F.startswith(x["x"], F.lit("※")))
        return F.transform(F.filter(bare, kept), lambda x: x["s"])

    def sections(ms: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            until = F.coalesce(F.get(ms, i + 1)["pos"], F.length("content"))
            text = F.substring(F.col("content"), m["pos"] + 1, F.greatest(F.lit(0), until - m["pos"]))
            return F.struct(m["number"].alias("number"), (i + 1).alias("rank"), plain(text, True).alias("lines"))

        whole = F.struct(F.lit(None).cast("int").alias("number"), F.lit(0).alias("rank"), plain(F.col("content"), False).alias("lines"))
        return F.when(F.size(ms) > 0, F.transform(ms, one)).otherwise(F.array(whole))

    # Outer, as the optimizer would else ask for the size of the array first and work it out again.
    each = scripts.select("work", F.explode_outer(let(marks, sections)).alias("s")).select("work", "s.*")

    t = tracks.withColumn("key", name_key(F.col("track"))).withColumn("place", F.row_number().over(Window.partitionBy("work").orderBy("seq")))
    by_name = F.contains("key", F.col("number").cast("string")) | F.contains("key", F.concat(F.lit("tr"), F.lpad(F.col("number").cast("string"), 2, "0")))
    held = each.join(t, "work").filter(F.when(F.col("rank") == 0, F.col("place") == 1).otherwise(by_name | (F.col("place") == F.col("number"))))
    chosen = held.groupBy("work", "rank").agg(F.min_by(F.struct("track", "lines"), F.struct(F.when(by_name, 0).otherwise(1), "place")).alias("c")).select("work", "rank", "c.*")
    last = chosen.groupBy("work", "track").agg(F.max_by("lines", "rank").alias("lines"))
    return tracks.select("work", "track").join(last, ["work", "track"], "left").select("work", "track", F.coalesce("lines", F.array().cast("array<string>")).alias("lines"))


def number_lines(content: Column) -> Column:
    """Every line behind its five-digit number."""
    lines = F.split(content, "\n", -1)
    return F.array_join(F.transform(lines, lambda x, i: F.concat(F.lpad((i + 1).cast("string"), 5, "0"), F.lit("|"), x)), "\n")


def lines_in_range(lines: Column, start: Column, end: Column) -> Column:
    """lines start to end (from 1, both included), cleaned, without noise; empty if out of range."""
    fits = (start >= 1) & (end >= start) & (start <= F.size(lines))
    part = F.slice(lines, F.greatest(start, F.lit(1)), F.greatest(F.lit(0), F.least(end, F.size(lines)) - start + 1))
    cleaned = F.split(pre_clean(F.array_join(part, "\n")), "\n")
    return F.when(fits, F.filter(cleaned, lambda x: ~is_noise_line(x))).otherwise(F.array().cast("array<string>"))


def prepare_script(content: Column) -> Column:
    """Cleaned and merged text, ready for numbering."""
    return merge_short_lines(pre_clean(content))


def tracks_from_answer(answers: DataFrame, tracks: DataFrame, scripts: DataFrame) -> DataFrame:
    """lines by track from answers(work, raw) as line ranges or as lists of lines.

    ``{"tracks": {name: [start, end]}}`` or ``{"tracks": {name: [line, ...]}}``, fences allowed.  Names
    are matched by key, else by similarity; tracks without an entry get no lines.
    scripts(work, lines array) holds the numbered lines.
    """
    fenced = F.regexp_extract("raw", r"(?s)```(?:json)?(.*?)```", 1)
    text = F.regexp_extract(F.when(fenced != "", fenced).otherwise(F.col("raw")), r"(?s)(\{.*\})", 1)
    parsed = F.from_json(text, "tracks map<string,array<string>>")["tracks"]
    each = answers.select("work", F.explode(parsed).alias("name", "values")).withColumn("key", name_key(F.col("name")))
    t = tracks.withColumn("track_key", name_key(F.col("track")))
    met = each.join(t, "work").withColumn("tier", F.when(F.col("key") == F.col("track_key"), 0).when(similar_names(F.col("key"), F.col("track_key")), 1)).filter("tier is not null")
    best = met.groupBy("work", "name").agg(F.min_by(F.struct("track", "values"), F.struct("tier", "seq")).alias("b")).select("work", "b.*").join(scripts, "work")
    is_range = (F.size("values") == 2) & F.forall("values", lambda v: F.rlike(v, F.lit(r"^-?\d+(\.\d+)?$")))
    at = lambda i: F.get("values", F.lit(i)).try_cast("double").cast("int")
    plain = F.filter("values", lambda v: v.isNotNull() & ~is_noise_line(v))
    got = best.select("work", "track", F.when(is_range, lines_in_range(F.col("lines"), at(0), at(1))).otherwise(plain).alias("found"))
    none = F.array().cast("array<string>")
    return tracks.select("work", "track").join(got, ["work", "track"], "left").select("work", "track", F.coalesce("found", none).alias("lines"))


def coverage(script_map: DataFrame, least: float = 0.3) -> DataFrame:
    """Per work tracks with lines, total lines and whether a cached result is good enough."""
    c = script_map.groupBy("work").agg(F.count("*").alias("tracks"), F.count_if(F.size("lines") > 0).alias("matched"), F.sum(F.size("lines")).alias("total"))
    return c.withColumn("accepted", (F.col("total") > 0) & (F.col("matched") / F.col("tracks") >= least))


def resolve_scripts(cached: DataFrame, answered: DataFrame, regex: DataFrame) -> DataFrame:
    """Per work the cached lines if good enough, else the answer, filled up by marks where empty."""
    from .matching import fill_missing

    good = coverage(cached).filter("accepted").select("work")
    fresh = fill_missing(answered, regex, regex.select("work", "track"))
    return cached.join(good, "work", "left_semi").unionByName(fresh.join(good, "work", "left_anti"))


def is_bar_table(content: Column, words: tuple[str, ...] = ("日本語", "中国語", "中文", "原文", "訳文", "译文")) -> Column:
    """A bar and a header word within the first 500 characters."""
    head = F.substring(content, 1, 500)
    return F.contains(head, F.lit("|")) & F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(head, w))


# --- glossaries ------------------------------------------------------------------------------------------


def read_terms(files: DataFrame) -> DataFrame:
    """terms(work, src, tgt) from files(work, content): a JSON object, else ``src SEP tgt`` lines.

    Separators in order: arrow, tab, colon, wide colon; # starts a comment; the last of a source wins.
    """
    pairs = F.map_entries(F.from_json("content", "map<string,string>"))
    is_json = F.try_parse_json("content").isNotNull() & F.rlike(F.ltrim("content"), F.lit(r"^\{"))
    entry = lambda k, v: F.struct(strip(k).alias("src"), strip(v).alias("tgt"))

    def of_line(x):
        s = strip(x)
        out = F.lit(None).cast("struct<src:string,tgt:string>")
        for sep in reversed(("→", "\t", ":", "：")):
            at = F.instr(s, sep)
            out = F.when(at > 0, entry(F.substring(s, F.lit(1), at - 1), F.substring(s, at + 1, F.length(s)))).otherwise(out)
        return F.when((s != "") & ~F.startswith(s, F.lit("#")), out)

    found = F.when(is_json, F.transform(pairs, lambda p: entry(p["key"], p["value"]))).otherwise(F.array_compact(F.transform(F.split("content", "\n"), of_line)))
    rows = files.select("work", F.posexplode(found).alias("line_no", "t")).select("work", "line_no", "t.src", "t.tgt").filter("src <> '' and tgt <> ''")
    return rows.groupBy("work", "src").agg(F.max_by("tgt", "line_no").alias("tgt"), F.max("line_no").alias("line_no"))


def read_list(content: Column) -> Column:
    """A JSON list of names; anything else is empty."""
    return F.coalesce(F.from_json(content, "array<string>"), F.array().cast("array<string>"))


def characters(worldviews: DataFrame) -> DataFrame:
    """characters(work, name, name_cn, role, personality, relationship) from list or map form."""
    fields = "name string, name_cn string, role string, personality string, relationship string"
    as_list = F.from_json(F.get_json_object("content", "$.characters"), f"array<struct<{fields.replace(' string', ':string')}>>")
    as_map = F.transform(F.map_entries(F.from_json(F.get_json_object("content", "$.characters"), f"map<string,struct<{fields.replace(' string', ':string')}>>")), lambda e: F.struct(
        F.coalesce(e["value"]["name"], e["key"]).alias("name"), *[e["value"][c].alias(c) for c in ("name_cn", "role", "personality", "relationship")]))
    is_list = F.startswith(F.ltrim(F.get_json_object("content", "$.characters")), F.lit("["))
    return worldviews.select("work", F.explode(F.when(is_list, as_list).otherwise(as_map)).alias("c")).select("work", "c.*").filter("name is not null")


def is_free_talk(path: Column, words: tuple[str, ...] = ("フリートーク", "free talk", "freetalk", "おまけ", "キャストトーク")) -> Column:
    """P14 with generic words: a path part holds one, looked for from its third character (Q13)."""
    parts = F.split(F.lower(path), "/")
    return F.exists(parts, lambda p: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.substring(p, F.lit(3), F.length(p)), w)))


WORD_LINE = "start bigint, end bigint, text string, words array<struct<start:bigint,end:bigint,word:string>>"


def read_words(spark, path: str) -> DataFrame:
    """Word segments of JSON-lines files: rows (file, start, end, text, words, corrupt, replaced).

    Blank lines go.  A line that is no such object gives a row with nothing but ``corrupt``, the line itself.
    Bytes that are no UTF-8 become U+FFFD, and ``replaced`` says so.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("raw"))
    lines = lines.select("file", F.make_valid_utf8("raw").alias("line"), (~F.is_valid_utf8("raw")).alias("replaced")).filter(strip("line") != "")
    read = lines.withColumn("r", F.from_json("line", WORD_LINE + ", corrupt string", {"columnNameOfCorruptRecord": "corrupt", "mode": "PERMISSIVE"}))
    whole = F.col("r.corrupt").isNull() & F.rlike(strip("line"), F.lit(r"^\{"))
    return read.select("file", *[F.when(whole, F.col(f"r.{c}")).alias(c) for c in ("start", "end", "text", "words")], F.when(~whole, F.col("line")).alias("corrupt"), "replaced")
