"""Tables to files' worth of text.

Writers make one row per file; ``write_files`` puts them below a folder, partitioned by directory, so
tasks write different files and a rerun replaces them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import safe_file_name, short_id
from .subtitles import without_blank_cues


def json_map(rows: DataFrame, by: str, key: str, value: str, order: str | None = None) -> DataFrame:
    """K6, K7: per group one JSON object of key and value, in order; of equal keys the last."""
    last = rows.groupBy(by, key).agg(F.max_by(value, order or value).alias("_v"), F.max(order or key).alias("_o"))
    entries = F.array_sort(F.collect_list(F.struct("_o", F.col(key).alias("k"), F.col("_v").alias("v"))))
    pairs = F.transform(entries, lambda e: F.struct(e["k"].alias("key"), e["v"].alias("value")))
    return last.groupBy(by).agg(F.to_json(F.map_from_entries(pairs)).alias("content"))


def script_exports(tracks: DataFrame, raw: DataFrame) -> DataFrame:
    """K8: files(work, path, content): the raw text, the map of tracks as JSON, one text per track.

    tracks(work, track, lines), raw(work, content).  Works without any line export nothing.
    """
    full = tracks.groupBy("work").agg(F.sum(F.size("lines")).alias("n"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("track", "lines"))))).alias("json")).filter("n > 0")
    source = raw.join(full, "work", "left_semi").select("work", F.lit("_scriptbook_export.txt").alias("path"), "content")
    clean = full.select("work", F.lit("_scriptbook_clean.json").alias("path"), F.col("json").alias("content"))
    name = F.regexp_replace("track", r"[/\\]", "_")
    single = tracks.filter(F.size("lines") > 0).select("work", F.concat(F.lit("_split_tracks/"), name, F.lit(".txt")).alias("path"), F.array_join("lines", "\n").alias("content"))
    return source.unionByName(clean).unionByName(single)


def work_logs(runs: DataFrame) -> DataFrame:
    """files(work, path, content): a log of all attempts per work, and one per file.

    runs(work, file, attempt, status, elapsed, reason); attempt 0 is the first round.
    """
    tag = F.when(F.col("attempt") <= 0, "first round").otherwise(F.format_string("retry %d", F.col("attempt").cast("int")))
    reason = F.when(F.coalesce("reason", F.lit("")) != "", F.concat(F.lit("  reason: "), "reason")).otherwise("")
    line = F.concat(F.lit("---- "), tag, F.lit(" ("), "status", F.format_string(", %.1fs)", F.col("elapsed")), reason)
    per_file = runs.groupBy("work", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("attempt", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"), F.max_by("status", "attempt").alias("status"))
    folder = safe_file_name(short_id(F.col("work")))
    each = per_file.select("work", F.concat(folder, F.lit("/"), safe_file_name(F.regexp_replace("file", r"\.[^.]*$", "")), F.lit(".log")).alias("path"), F.concat(F.lit("track: "), "file", F.lit("\n"), "body", F.lit("\n")).alias("content"))
    rows = F.array_sort(F.collect_list(F.struct("file", F.concat("file", F.lit("  status: "), "status", F.lit("\n"), "body").alias("t"))))
    whole = per_file.groupBy("work").agg(F.array_join(F.transform(rows, lambda x: x["t"]), "\n").alias("body"), F.count("*").alias("n"), F.count_if(F.col("status") == "success").alias("ok"))
    return whole.select("work", F.concat(folder, F.lit(".log")).alias("path"), F.concat(F.format_string("work: %s  tracks: %d  succeeded: %d\n", "work", "n", "ok"), "body", F.lit("\n")).alias("content")).unionByName(each)


def clean_blank_cues(files: DataFrame, originals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files to rewrite, with their backup content, and counters; only those with an original.

    originals(file).  A dry run reads the counters and leaves the files.
    """
    mine = files.join(originals.select("file"), "file", "left_semi")
    cleaned = without_blank_cues(mine).withColumnRenamed("content", "new_content").join(mine.select("file", F.col("content").alias("backup")), "file")
    changed = cleaned.filter((F.col("removed") > 0) & (F.col("new_content") != F.col("backup")))
    counters = cleaned.agg(F.count("*").alias("seen"), F.count_if(F.col("removed") > 0).alias("changed"), F.coalesce(F.sum("removed"), F.lit(0)).alias("removed"))
    return changed.select("file", "ext", F.col("new_content").alias("content"), "backup"), counters


def write_files(files: DataFrame, folder: str, by: str = "work") -> None:
    """Content by group: ``folder/by=.../part-*``, one row (path, content) per file, as Parquet."""
    files.write.mode("overwrite").partitionBy(by).parquet(folder)
