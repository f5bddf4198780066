"""From subtitle files to translated subtitle files (M8, C14, C19, the run of a work)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.align import align_script
from ..operators.matching import cue_words
from ..operators.model import translate_with_retries
from ..operators.segment import apply_cuts, pieces_of, plan_cuts, stats_by_file
from ..operators.windows import fixed_chunks
from ..sources.subtitles import language_of_files, lrc_items, render_items, replace_texts, structure


def resegment(files: DataFrame, segments: DataFrame, max_seconds: float = 8.0, max_chars: int = 40) -> tuple[DataFrame, DataFrame]:
    """C14: files(file, content, lossless) with over-long cues split by word timing, and figures per file.

    Files without word timing, or whose text would change, keep their content.
    """
    items = lrc_items(files)
    lyrics = items.filter("item_type = 'lyric'").withColumn("seq", F.expr("row_number() over (partition by file order by line_no) - 1"))
    tokens = lyrics.select("file", "seq", "time_ms", "text").join(cue_words(lyrics, segments), ["file", "seq"])
    plans = plan_cuts(tokens, max_seconds, max_chars)
    pieces = pieces_of(plans)
    new = apply_cuts(items, pieces)
    rendered = render_items(new.filter("lossless")).withColumnRenamed("content", "new_content")
    out = files.join(rendered, "file", "left").select("file", "ext", F.coalesce("new_content", "content").alias("content"), F.col("new_content").isNotNull().alias("lossless"))
    return out, stats_by_file(items, plans, pieces)


def translate_files(files: DataFrame, models: list[Callable[[pd.Series], pd.Series]], script: DataFrame | None = None, lines_per_request: int = 100, drop_empty: bool = False) -> DataFrame:
    """M8: files(file, ext, content) that are not Chinese yet, with their texts replaced by a model's.

    Parse, leave out what is done, align with script(track, line_no, text) if given (track = file),
    drop blank rows, cut into requests, call with retries, put blanks back and render.
    """
    todo = files.join(language_of_files(files).filter("language = 'chinese'"), "file", "left_anti")
    lines = structure(todo)
    rows = lines.filter("kind = 'text'").select("file", F.col("slot").alias("seq"), "text").filter(strip("text") != "")
    if script is not None:
        hints = align_script(rows.select(F.col("file").alias("track"), "seq", "text"), script)
        rows = rows.join(hints.select(F.col("track").alias("file"), "seq", "sb", "conf"), ["file", "seq"], "left")
    answered = translate_with_retries(fixed_chunks(rows, lines_per_request), ["file", "chunk"], models)
    return replace_texts(lines, answered.select("file", F.col("seq").alias("slot"), "new_text").unionByName(
        lines.filter("kind = 'text'").filter(strip("text") == "").select("file", "slot", F.lit("").alias("new_text"))), drop_empty)
