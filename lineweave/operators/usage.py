"""Token usage and run logs.

usage(seq, request_type, label, work_key, prompt_tokens, hit_tokens, miss_tokens, completion_tokens,
cost, elapsed, reasoning_tokens); track_runs(work, file, attempt, status, elapsed, reason).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timing import PRICES, cost, hit_rate

# Display names of request types.
TYPES = {"translate": "翻译", "scriptbook_id": "台本识别", "scriptbook_split": "台本分割", "worldview": "世界观", "terms": "术语", "resegment": "字幕重排", "track_names": "标题"}
TOKENS = ("prompt_tokens", "hit_tokens", "miss_tokens", "completion_tokens", "reasoning_tokens")


def type_name(request_type):
    names = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, request_type), request_type)


def totals(usage: DataFrame) -> DataFrame:
    """A1: calls and sums, zero without rows."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in TOKENS]
    return usage.agg(F.count("*").alias("calls"), *sums, F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))


def with_rates(usage: DataFrame, prices: tuple[float, float, float] = PRICES) -> DataFrame:
    """A2, A3 for each row."""
    return usage.withColumns({"computed_cost": cost(F.col("hit_tokens"), F.col("miss_tokens"), F.col("completion_tokens"), prices), "hit_rate": hit_rate(F.col("hit_tokens"), F.col("miss_tokens"))})


def type_counts(usage: DataFrame) -> DataFrame:
    """A4."""
    return usage.groupBy(type_name(F.col("request_type")).alias("type")).agg(F.count("*").alias("n"))


def work_summaries(usage: DataFrame) -> DataFrame:
    """A5: one row per work: short name, calls, ``type xN`` list, token sums, cost."""
    by_type = usage.groupBy("work_key", type_name(F.col("request_type")).alias("type")).agg(
        F.count("*").alias("n"), *[F.sum(c).alias(c) for c in TOKENS], F.sum("cost").alias("cost")
    )
    name = F.element_at(F.split("work_key", "/"), -1)
    shown = F.when(F.length(name) > 50, F.concat(F.substring(name, 1, 47), F.lit("..."))).otherwise(name)
    part = F.struct(F.col("type"), F.concat("type", F.lit(" x"), F.col("n").cast("string")).alias("text"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]), " + ")
    out = by_type.groupBy("work_key").agg(F.sum("n").alias("calls"), listed.alias("types"), *[F.sum(c).cast("long").alias(c) for c in TOKENS], F.sum("cost").alias("cost"))
    return out.withColumn("name", shown)


def reconcile(usage: DataFrame, by: str = "work_key", tolerance: float = 1e-4) -> DataFrame:
    """Groups whose booked cost differs from the cost of their sums."""
    sums = usage.groupBy(by).agg(F.sum("cost").alias("booked"), *[F.sum(c).alias(c) for c in ("hit_tokens", "miss_tokens", "completion_tokens")])
    return sums.select(by, "booked", cost(F.col("hit_tokens"), F.col("miss_tokens"), F.col("completion_tokens")).alias("computed")).filter(F.abs(F.col("booked") - F.col("computed")) > tolerance)


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last attempt of each file."""
    last = F.max_by(F.struct("status", "elapsed", "reason"), "attempt")
    return runs.groupBy("work", "file").agg(last.alias("last"), F.count("*").alias("attempts")).select("work", "file", "attempts", "last.*")


def manifest(runs: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Per work the files by latest status, elapsed time, and whether all are done (T4).

    ``expected(work, n)`` gives the number of files of a work; without it the files seen count.
    """
    counts = latest_runs(runs).groupBy("work").agg(
        F.count_if(F.col("status") == "success").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"), F.count("*").alias("seen"), F.round(F.sum("elapsed"), 1).alias("elapsed"),
    )
    if expected is None:
        return counts.withColumns({"total": F.col("seen"), "complete": F.lit(True)})
    joined = counts.join(expected.select("work", F.col("n").alias("_n")), "work", "left")
    return joined.withColumns({"total": F.coalesce(F.when(F.col("_n") > 0, F.col("_n")), "seen"), "complete": F.col("seen") >= F.coalesce("_n", F.lit(0))}).drop("_n")


def manifest_json(manifest_rows: DataFrame) -> DataFrame:
    """K9: each work as a JSON line."""
    return manifest_rows.select("work", F.to_json(F.struct(*manifest_rows.columns)).alias("json"))


def expected_tracks(files: DataFrame) -> DataFrame:
    """Rows (work, n) with the distinct tracks of files(work, track), what ``manifest`` expects of a work."""
    return files.groupBy("work").agg(F.count_distinct("track").alias("n"))


def batch_totals(manifest_rows: DataFrame) -> DataFrame:
    """K9: the totals of a batch over its works, elapsed time to one digit."""
    counts = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "succeeded", "failed", "skipped")]
    return manifest_rows.agg(F.count("*").alias("works"), F.count_if("complete").alias("complete"), *counts, F.round(F.coalesce(F.sum("elapsed"), F.lit(0.0)), 1).alias("elapsed"))


def work_deltas(runs: DataFrame) -> DataFrame:
    """Files, lines and time per work of a run log with a column lines."""
    return runs.groupBy("work").agg(F.count_distinct("file").alias("files"), F.sum("lines").alias("lines"), F.sum("elapsed").alias("elapsed"))


def normal_usage(raw: DataFrame) -> DataFrame:
    """Hit and miss as a provider names them, else from cached tokens; reasoning from either place.

    raw has a JSON column ``usage``.
    """
    number = lambda path: F.get_json_object("usage", path).try_cast("long")
    prompt, hit = F.coalesce(number("$.prompt_tokens"), F.lit(0)), number("$.prompt_cache_hit_tokens")
    cached = F.coalesce(number("$.prompt_tokens_details.cached_tokens"), F.lit(0))
    miss = F.when(hit.isNotNull(), F.coalesce(number("$.prompt_cache_miss_tokens"), F.lit(0))).when(prompt > 0, prompt - cached).otherwise(0)
    reasoning = F.coalesce(F.nullif(number("$.reasoning_tokens"), F.lit(0)), number("$.completion_tokens_details.reasoning_tokens"), F.lit(0))
    return raw.withColumns({
        "prompt_tokens": prompt, "hit_tokens": F.coalesce(hit, cached), "miss_tokens": miss,
        "completion_tokens": F.coalesce(number("$.completion_tokens"), F.lit(0)), "reasoning_tokens": reasoning,
    })


def chunk_usage(attempts: DataFrame, chunked: bool) -> DataFrame:
    """Tokens of a file over all attempts of its chunks, or of the last attempt if it is not chunked."""
    if chunked:
        return attempts.groupBy("file").agg(*[F.sum(c).alias(c) for c in TOKENS])
    return attempts.groupBy("file").agg(F.max_by(F.struct(*TOKENS), "attempt").alias("u")).select("file", "u.*")
