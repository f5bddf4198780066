"""Order-based operators (W1-W15, C17 numbering, U2, A9).

Order is a column (``seq``); ``by`` names the group, a file or track.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.text import compact_length, has_kana, strip
from .cut import checkpointed


def _w(by: str, order: str = "seq"):
    return Window.partitionBy(by).orderBy(order)


def numbered(rows: DataFrame, by: str = "file", width: int = 4, separator: str = ": ") -> DataFrame:
    """1-based numbers and the line with its zero-padded number in front."""
    n = F.row_number().over(_w(by))
    shown = F.when(F.length(F.col("n").cast("string")) >= width, F.col("n").cast("string")).otherwise(F.lpad(F.col("n").cast("string"), width, "0"))
    return rows.withColumn("n", n).withColumn("numbered", F.concat(shown, F.lit(separator), F.coalesce("text", F.lit(""))))


def gaps(tokens: DataFrame, by: str = "cue") -> DataFrame:
    """Silence before each token; 0 for the first."""
    return tokens.withColumn("gap", F.coalesce(F.col("start") - F.lag("end").over(_w(by)), F.lit(0)))


def gap_groups(rows: DataFrame, by: list[str], order: str, gap: float) -> DataFrame:
    """A new group wherever the order column jumps by more than ``gap``."""
    w = Window.partitionBy(*by).orderBy(order)
    jump = (F.col(order) - F.lag(order).over(w) > gap).cast("int")
    return rows.withColumn("_jump", F.coalesce(jump, F.lit(0))).withColumn("gap_group", F.sum("_jump").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_jump")


def collapse_clears(items: DataFrame, by: str = "file", order: str = "seq") -> DataFrame:
    """Of adjacent clear items at one time, the first."""
    w = _w(by, order)
    same = (F.col("item_type") == "clear") & (F.lag("item_type").over(w) == "clear") & (F.lag("time_ms").over(w) == F.col("time_ms"))
    return items.withColumn("_same", F.coalesce(same, F.lit(False))).filter("not _same").drop("_same")


def position_share(rows: DataFrame, by: str = "file") -> DataFrame:
    """Place in the group from 1/n to 1."""
    return rows.withColumn("position", F.row_number().over(_w(by)) / F.count("*").over(Window.partitionBy(by)))


def neighbours(rows: DataFrame, by: str = "file", text: str = "text") -> DataFrame:
    """W7."""
    return rows.withColumns({"previous": F.lag(text).over(_w(by)), "next": F.lead(text).over(_w(by))})


def context(rows: DataFrame, n: int = 10, by: str = "file", text: str = "text") -> DataFrame:
    """Up to n texts before and after each row."""
    return rows.withColumns({"before": F.collect_list(text).over(_w(by).rowsBetween(-n, -1)), "after": F.collect_list(text).over(_w(by).rowsBetween(1, n))})


def progress(tokens: DataFrame, by: str = "cue") -> DataFrame:
    """Characters and time up to the end of each token."""
    w = _w(by).rowsBetween(Window.unboundedPreceding, 0)
    return tokens.withColumns({"chars_to": F.sum(compact_length("word")).over(w), "elapsed": F.col("end") - F.first("start").over(w)})


def within_budget(rows: DataFrame, budget: int, by: str = "work", size: Column | None = None) -> DataFrame:
    """Rows up to the first that would pass the budget; nothing after it."""
    size = F.length("text") if size is None else size
    return rows.withColumn("used", F.sum(size).over(_w(by).rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("used") <= budget)


def budget_chunks(costs: Column, budget: int) -> Column:
    """Chunk numbers for an array of costs: a new chunk when a started one would pass the budget."""
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(acc, c):
        full = (acc["used"] > 0) & (acc["used"] + c > budget)
        chunk = acc["chunk"] + full.cast("int")
        return F.struct(chunk.alias("chunk"), F.when(full, c).otherwise(acc["used"] + c).cast("long").alias("used"), F.concat(acc["out"], F.array(chunk)).alias("out"))

    return F.when(F.lit(budget <= 0), F.transform(costs, lambda _: F.lit(0))).otherwise(F.aggregate(costs, start, step, lambda acc: acc["out"]))


def pack_by_budget(rows: DataFrame, budget: int, by: str = "file", size: str = "size") -> DataFrame:
    """W11 over rows: add ``chunk``.  The costs of a group are folded in order on the JVM."""
    item = F.struct(F.col("seq"), F.col(size).cast("long").alias("size"))
    folded = rows.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    chunks = folded.withColumn("chunks", budget_chunks(F.transform("items", lambda i: i["size"]), budget))
    each = chunks.select(by, F.posexplode("items").alias("at", "item"), "chunks")
    numbers = each.select(by, F.col("item.seq").alias("seq"), F.get("chunks", F.col("at")).alias("chunk"))
    return rows.join(numbers, [by, "seq"])


def fixed_chunks(rows: DataFrame, n: int, by: str = "file") -> DataFrame:
    """N rows to a chunk; one chunk if n is 0."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(_w(by)) - 1) / n) if n > 0 else F.lit(0).cast("long"))


def stride_sample(rows: DataFrame, n: int = 40, by: str = "file") -> DataFrame:
    """Every k-th row, k = max(1, rows // n), at most n."""
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy(by)) / n))
    out = rows.withColumns({"_at": F.row_number().over(_w(by)) - 1, "_step": step}).filter(F.col("_at") % F.col("_step") == 0)
    return out.filter(F.col("_at") / F.col("_step") < n).drop("_at", "_step")


def trailing_blanks(rows: DataFrame, by: str = "file") -> DataFrame:
    """Length of the run of blank rows at the end of each group."""
    last = F.max(F.when(strip(F.coalesce("text", F.lit(""))) != "", F.col("_n")))
    return rows.withColumn("_n", F.row_number().over(_w(by))).groupBy(by).agg((F.count("*") - F.coalesce(last, F.lit(0))).alias("blank_tail"))


def first_distinct(rows: DataFrame, most: int = 500, by: str = "file") -> DataFrame:
    """Distinct trimmed texts in order of first occurrence, at most so many."""
    seen = rows.select(by, "seq", strip("text").alias("text")).filter("text <> ''").groupBy(by, "text").agg(F.min("seq").alias("seq"))
    return seen.withColumn("n", F.row_number().over(_w(by))).filter(F.col("n") <= most)


def first_rows(rows: DataFrame, n: int, by: str) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("_n", F.row_number().over(_w(by))).filter(F.col("_n") <= n).drop("_n")


WORD_BREAKS = r"(?U)[\s,.\!?、。！？…　]+"


def text_statistics(lines: DataFrame, by: str) -> DataFrame:
    """Rows, characters without blanks, kana rows and distinct words of two letters and more."""
    words = F.filter(F.split(strip("text"), WORD_BREAKS), lambda w: F.length(w) >= 2)
    per_line = lines.select(by, compact_length("text").alias("chars"), F.coalesce(has_kana("text"), F.lit(False)).alias("kana"), words.alias("words"))
    base = per_line.groupBy(by).agg(F.count("*").alias("total_lines"), F.sum("chars").cast("long").alias("total_chars"), F.count_if("kana").alias("japanese_lines"))
    distinct = per_line.select(by, F.explode("words").alias("w")).groupBy(by).agg(F.count_distinct("w").alias("unique_words"))
    return base.join(distinct, by, "left").withColumn("unique_words", F.coalesce("unique_words", F.lit(0)))


def frequent_words(lines: DataFrame, by: str, most: int = 50, least: int = 2) -> DataFrame:
    """The most frequent words; of equals, those seen first.  lines(by, seq, text).

    Words are counted with the least first part of their ``seq``, which a hash aggregate can hold; where exactly
    those words that may be among the most frequent are seen first is read from the lines of these parts alone.
    """
    words = F.filter(F.split(strip("text"), WORD_BREAKS), lambda w: F.length(w) >= 2)
    each = lambda rows: rows.select(by, "seq", F.posexplode(words).alias("at", "word"))
    kind = lines.schema["seq"].dataType
    lead = F.col("seq").getField(kind.names[0]) if isinstance(kind, StructType) else F.col("seq")
    counted = each(lines).groupBy(by, "word").agg(F.count("*").alias("n"), F.bool_or(lead.isNull()).alias("none"), F.min(lead).alias("lead")).filter(F.col("n") >= least)
    counted = counted.select(F.col(by).alias("_by"), F.col("word").alias("_word"), "n", F.when(~F.col("none"), F.col("lead")).alias("lead"))
    nth = F.rank().over(Window.partitionBy("_by").orderBy(F.desc("n"), "lead"))
    likely = checkpointed(counted.withColumn("nth", nth).filter(F.col("nth") <= most).drop("nth"))
    few = F.broadcast if likely.count() <= 1000 * most else lambda df: df  # most of each group, and ties
    here = F.col(by).eqNullSafe(F.col("_by")) & lead.eqNullSafe(F.col("lead"))
    some = lines.join(few(likely.select("_by", "lead").distinct()), here, "left_semi")
    first = each(some).join(few(likely), here & (F.col("word") == F.col("_word"))).groupBy(by, "word", "n").agg(F.min(F.struct("seq", "at")).alias("first"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "first"))
    return first.withColumn("rank", rank).filter(F.col("rank") <= most).select(by, "word", "n", "rank")
