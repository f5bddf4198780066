"""Packing documents into batches of near-equal length with optimal length buckets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, quoted, repeated, row_key, running_sum, shuffle_key, whole_row


def _best_starts(before: np.ndarray, ends: np.ndarray, cost: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """For every j > low the i in [low, j) with the least cost[i] + ends[j] * (before[j] - before[i]).

    The least i grows with j, so the middle of a range of j bounds the i of both halves; all ranges of
    one depth are searched together.  Ties go to the smaller i.
    """
    n = len(ends)
    best, choice = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    a, b = np.array([low + 1]), np.array([n])  # ranges of j, and of i below
    first, last = np.array([low]), np.array([n - 2])
    while len(a):
        j = (a + b) // 2
        size = np.minimum(last, j - 1) - first + 1
        at = np.cumsum(size) - size
        i = np.arange(int(size.sum())) - np.repeat(at - first, size)
        value = cost[i] - np.repeat(ends[j], size) * before[i]
        least = np.minimum.reduceat(value, at)
        hits = np.flatnonzero(value == np.repeat(least, size))
        chosen = i[hits[np.searchsorted(hits, at)]]
        best[j], choice[j] = least + ends[j] * before[j], chosen
        a, b = np.concatenate([a, j + 1]), np.concatenate([j, b])
        first, last = np.concatenate([first, chosen]), np.concatenate([chosen, last])
        keep = a < b
        a, b, first, last = a[keep], b[keep], first[keep], last[keep]
    return best, choice


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets that minimise the padding, by dynamic programming.

    ``lengths`` ascend.  All documents of a bucket are padded to its end, so minimising padding is
    minimising the padded total.  The earliest boundary wins ties, and the fewest buckets.  The optimum
    is exact; n lengths take n log n steps for each bucket.
    """
    n = len(lengths)
    if not n:
        return []
    ends, before = np.array(lengths, np.int64), np.cumsum(np.array(counts, np.int64))
    cost = ends * before
    totals, choices = [int(cost[-1])], []
    for k in range(1, min(buckets, n)):
        cost, choice = _best_starts(before, ends, cost, k - 1)
        totals.append(int(cost[-1]))
        choices.append(choice)
    at, out = n - 1, [lengths[-1]]
    for choice in reversed(choices[: int(np.argmin(totals))]):
        at = int(choice[at])
        out.append(lengths[at])
    return out[::-1]


def length_buckets(lengths: DataFrame, length: str = "length", buckets: int = 8, times: str | None = None) -> list[int]:
    """Boundaries from the histogram of all rows, each counted ``times`` times if given.

    One row for each length that occurs reaches the driver: at most the longest length, and at most the
    square root of twice the sum of all lengths.
    """
    many = F.count("*") if times is None else F.sum(times)
    histogram = lengths.groupBy(F.greatest(F.lit(1), F.coalesce(length, F.lit(0))).alias("g")).agg(many.alias("n")).orderBy("g").collect()
    return best_boundaries([r.g for r in histogram], [r.n for r in histogram], buckets)


def pack_batches(docs: DataFrame, scratch: Scratch, length: Column, budget: int = 65536, buckets: int = 8, seed: str = "pack", carry: bool = False) -> DataFrame:
    """Batches of at most ``budget`` padded tokens, each of documents from one length bucket.

    Rows (doc_id, length, bucket, bucket_length, batch, slot, padding); with ``carry`` all columns of docs
    in place of doc_id (one of the other names is then replaced).  Bucket ends minimise padding over the
    global histogram; inside a bucket, documents stand in a pseudo-random order and each
    ``budget // bucket_length`` of them (one at least) form a batch.  (bucket, batch, slot) names a row.

    Null and negative lengths count 0; a length of 0 takes one place.  A document longer than the budget
    is a batch of its own.  Repeated rows are packed each, one after another; they are counted, not
    gathered.  An empty table gives no rows.  Positions are summed in slices of the shuffled order, so a
    bucket holding most rows is numbered by many tasks.
    """
    places = ("length", "bucket", "bucket_length", "batch", "slot", "padding")
    columns = [c for c in docs.columns if c not in places] if carry else ["doc_id"]
    size = F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).cast("long")
    key = row_key(docs, seed) if carry else F.concat(shuffle_key(F.col("doc_id"), F.col("text"), seed), F.lpad(size.cast("string"), 20, "0"))
    rows = docs.select(key.alias("key"), size.alias("length"), whole_row(docs.select(*map(quoted, columns))))
    rows = scratch.save(rows.groupBy("key", "length").agg(F.first("row").alias("row"), F.count("*").alias("of")), "lengths")
    ends = length_buckets(rows, "length", buckets, "of")
    ends = ends or [1]  # an empty table has no rows to place
    bucket = sum((F.when(F.col("length") > e, 1).otherwise(0) for e in ends), F.lit(0)).cast("long")
    rows = rows.withColumn("bucket", bucket)
    rows = rows.withColumn("bucket_length", F.element_at(F.array(*[F.lit(e).cast("long") for e in ends]), (F.col("bucket") + 1).cast("int")))
    cell = F.conv(F.substring("key", 1, 3), 16, 10).cast("long")
    rows = repeated(running_sum(rows, ["bucket"], cell, [F.col("key")], "of", "to"), F.col("of"), "nth")
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("bucket_length")))
    at = F.col("to") - F.col("of") + F.col("nth")
    return rows.select("row.*", "length", "bucket", "bucket_length", F.floor(at / room).alias("batch"), F.pmod(at, room).alias("slot"), (F.col("bucket_length") - F.col("length")).alias("padding"))
