"""File listings as tables and the rules over them.

A listing is files(path string, mtime timestamp); ``listing`` makes one from a folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import RJ, natural_order

# Names that mark scripts and names that rule them out.
SCRIPT_WORDS = (
    "台本", "だいほん", "だい本", "ダイホン", "script", "台本付き", "仮台本", "かり台本", "本編", "ほんぺん", "セリフ初稿", "せりふしょこう", "シナリオ", "しなりお",
    "演技指定", "えんぎしてい", "全章", "track", "トラック", "RJ", "音声作品", "シチュエーション",
)
OTHER_WORDS = (
    "finishtime", "finish_time", "フィニッシュタイム", "クレジット", "credit", "readme", "read me", "read_me", "説明", "説明書", "特典", "bonus", "おまけ", "omake", "キャスト", "cast",
    "声優", "購入特典", "プロローグ", "prologue", "はじめに", "初めに", "必ず", "読んで", "お読みください", "せつめいしょ", "注意事項", "_cleaned", "_processed", "_export",
    "あとがき", "アトガキ", "感想", "かんそう", "紹介", "しょうかい",
)
SCRIPT_FOLDERS = ("台本", "だいほん", "script", "scripts", "scenario", "scenarios")
SUBTITLES = (".lrc", ".srt", ".vtt")
AUDIO = (".mp3", ".wav", ".flac", ".m4a", ".aac", ".ogg", ".wma", ".mp4", ".mkv", ".avi", ".mov", ".webm", ".flv", ".wmv")


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Paths and times below a folder; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return found.select("path", F.col("modificationTime").alias("mtime"))


def with_parts(files: DataFrame) -> DataFrame:
    """Add dir, name, stem and ext (lower case, with its dot) of ``path``."""
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return files.withColumns({"dir": F.regexp_replace("path", "/[^/]*$", ""), "name": name, "ext": ext, "stem": F.regexp_replace(name, r"\.[^.]*$", "")})


def subtitles(files: DataFrame, excluded_dir: str = "bug_collection") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Live subtitle files, archived originals (``.ja``), and archives to restore."""
    parts = with_parts(files).filter(F.col("ext").isin(*SUBTITLES)).filter(~F.array_contains(F.split("path", "/"), excluded_dir))
    archived = parts.filter(F.endswith("stem", F.lit(".ja"))).withColumn("base", F.regexp_replace("stem", r"\.ja$", ""))
    live = parts.filter(~F.endswith("stem", F.lit(".ja")))
    restore = archived.join(live.select("dir", F.col("stem").alias("base"), "ext"), ["dir", "base", "ext"], "left_anti")
    restore = restore.withColumn("target", F.concat("dir", F.lit("/"), "base", "ext"))
    all_live = live.select("path", "mtime", "dir", "ext").unionByName(restore.select(F.col("target").alias("path"), "mtime", "dir", "ext"))
    return all_live, archived, restore


def in_time_order(live: DataFrame) -> DataFrame:
    """O2: files with ``nth``, their place by time inside their folder; ties by path."""
    return live.withColumn("nth", F.row_number().over(Window.partitionBy("dir").orderBy("mtime", "path")))


def count_by_extension(live: DataFrame) -> DataFrame:
    """A7."""
    return live.groupBy("ext").agg(F.count("*").alias("n"))


def untranscribed(files: DataFrame, extensions: tuple[str, ...] = AUDIO) -> DataFrame:
    """Audio without an archived transcript beside it."""
    parts = with_parts(files)
    done = parts.filter(F.endswith("path", F.lit(".ja.lrc"))).select("dir", F.regexp_replace("stem", r"\.ja$", "").alias("stem"))
    return parts.filter(F.col("ext").isin(*extensions)).join(done, ["dir", "stem"], "left_anti")


def with_original(files: DataFrame) -> DataFrame:
    """Live subtitles that have an archived original."""
    parts = with_parts(files)
    originals = parts.filter(F.endswith("stem", F.lit(".ja"))).select("dir", F.regexp_replace("stem", r"\.ja$", "").alias("stem"), "ext")
    return parts.filter(F.col("ext").isin(*SUBTITLES)).filter(~F.endswith("stem", F.lit(".ja"))).join(originals, ["dir", "stem", "ext"], "left_semi")


def to_archive(files: DataFrame) -> DataFrame:
    """K5: live files to copy to ``.ja`` before the first overwrite: rows (path, target)."""
    parts = with_parts(files)
    archived = parts.filter(F.endswith("stem", F.lit(".ja"))).select("dir", F.regexp_replace("stem", r"\.ja$", "").alias("stem"), "ext")
    live = parts.filter(F.col("ext").isin(*SUBTITLES)).filter(~F.endswith("stem", F.lit(".ja")))
    return live.join(archived, ["dir", "stem", "ext"], "left_anti").select("path", F.concat("dir", F.lit("/"), "stem", F.lit(".ja"), "ext").alias("target"))


def prefer_txt(files: DataFrame) -> DataFrame:
    """Without a pdf whose folder has a txt of the same name."""
    twin = Window.partitionBy("dir", "stem")
    parts = with_parts(files).withColumn("has_txt", F.max(F.col("ext") == ".txt").over(twin))
    return parts.filter(~((F.col("ext") == ".pdf") & F.col("has_txt"))).drop("has_txt")


def in_natural_order(files: DataFrame) -> DataFrame:
    """O1."""
    return with_parts(files).orderBy(*natural_order(F.col("dir"), F.col("stem")))


def is_script(name: Column, stem: Column, ext: Column, parent: Column) -> Column:
    """P10: the first rule that applies decides."""
    low = F.lower(name)
    holds = lambda words: F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(low, w))
    number = "[０-９0-9]+"
    return (
        F.when(~ext.isin(".txt", ".pdf"), False)
        .when(F.rlike(stem, F.lit("_cleaned|_processed|_export|_scriptbook_export")), False)
        .when(holds(OTHER_WORDS), False)
        .when(holds(SCRIPT_WORDS), True)
        .when(F.rlike(stem, F.lit(f"(?iu)^(トラック|track|tr){number}")), True)
        .when(F.lower(parent).isin(*SCRIPT_FOLDERS) & F.rlike(stem, F.lit(f"^{number}$|^{number}[-_]{number}")), True)
        .when(F.contains(parent, F.lit("台本")), True)
        .otherwise(F.rlike(stem, F.lit(r"^[０-９0-9]{2,3}[_\-．. ]")))
    )


def script_candidates(files: DataFrame) -> DataFrame:
    """Texts and PDFs that the program did not write."""
    parts = with_parts(files).filter(F.col("ext").isin(".txt", ".pdf"))
    return parts.filter(~F.rlike("stem", F.lit("_cleaned|_processed|_export|_scriptbook_export")))


def discover_scripts(files: DataFrame, root: Column) -> DataFrame:
    """Scripts of each work; a named subfolder comes before folders with 台本, then anything."""
    parts = with_parts(files).withColumn("work", root).withColumn("parent", F.element_at(F.split("dir", "/"), -1))
    tier = F.when(F.lower("parent").isin(*SCRIPT_FOLDERS), 1).when(F.contains("parent", F.lit("台本")), 2).otherwise(3)
    scripts = parts.filter(is_script(F.col("name"), F.col("stem"), F.col("ext"), F.col("parent"))).withColumn("tier", tier)
    return scripts.withColumn("best", F.min("tier").over(Window.partitionBy("work"))).filter("tier = best").drop("best")


def work_root(path: Column, levels: int = 5) -> Column:
    """The nearest folder with a work number within ``levels`` levels, else the parent folder."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    n = F.size(folders)
    at = F.filter(F.sequence(n, F.greatest(F.lit(1), n - levels + 1)), lambda i: F.rlike(F.element_at(folders, i), F.lit(RJ)))
    return F.array_join(F.slice(folders, 1, F.coalesce(F.get(at, F.lit(0)), n)), "/")


def track_stems(files: DataFrame) -> DataFrame:
    """Distinct track names from audio and live subtitles."""
    parts = with_parts(files).filter(F.col("ext").isin(*AUDIO, *SUBTITLES)).filter(~F.endswith("stem", F.lit(".ja")))
    return parts.select("stem").distinct()


def words_file(tracks: DataFrame, files: DataFrame) -> DataFrame:
    """The first existing of five places for the word timing of tracks(path)."""
    t = with_parts(tracks.select("path"))
    places = [("raw/", ".words.jsonl"), ("", ".words.jsonl"), ("raw/", ".jsonl")]
    names = [F.concat("dir", F.lit("/" + a), "stem", F.lit(b)) for a, b in places] + [F.concat("dir", F.lit("/raw/words.jsonl")), F.concat("dir", F.lit("/words.jsonl"))]
    wanted = t.select(F.col("path").alias("track"), F.posexplode(F.array(*names)).alias("priority", "path"))
    return wanted.join(files.select("path").distinct(), "path").groupBy("track").agg(F.min_by("path", "priority").alias("words"))
