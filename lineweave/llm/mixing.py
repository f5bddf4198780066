"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, count_words, in_ranges, repeated, row_key, running_sum, whole_row

#: A source's documents are taken this many times at most.
REPEATS = 3
#: Slices of a source's shuffled order, and of virtual time, that are summed on their own.
CELLS = 4096


def source_targets(sizes: DataFrame, scratch: Scratch, weights: tuple[int, ...] = (1, 2, 3), repeats: int = REPEATS) -> DataFrame:
    """Targets for rows (source, source_size): weights repeat over sources by code point, null last.

    The targets share the sum of all sizes by weight, but none exceeds ``repeats`` times its source's
    size; the excess goes to the others by weight.  With the sources in the order of
    ``repeats * size / weight``, those that reach their limit come first, so one water level holds.
    There is one row per source; as there may be as many sources as hosts, both orders are cut into
    ranges that tasks number and sum on their own.
    """
    by_name = [F.col("source").asc_nulls_last()]
    rows = in_ranges(sizes, by_name, scratch, "sources").withColumn("one", F.lit(1))
    rows = running_sum(rows, [], F.col("cell"), by_name, "one", "nth").drop("cell", "one")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = rows.withColumn("weight", weight).withColumn("most", F.col("source_size") * repeats)
    by_level = [F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()]
    rows = in_ranges(rows, by_level, scratch, "levels")
    rows = running_sum(rows, [], F.col("cell"), by_level, "most", "most_to")
    rows = running_sum(rows, [], F.col("cell"), by_level, "weight", "weight_to")
    # Two sums over all sources: one row.
    whole = rows.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weights")).first()
    total, all_weight = (F.lit(x or 0) for x in whole)
    level = (total - (F.col("most_to") - F.col("most"))) / (all_weight - F.col("weight_to") + F.col("weight"))
    rows = rows.withColumn("level", F.when(level <= F.col("most") / F.col("weight"), level))
    water = rows.agg(F.max("level")).first()[0]
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.lit(water).cast("double"))
    return rows.select("source", "source_size", F.col("weight").cast("double").alias("weight"), target.alias("target"))


def fair_queue_mix(docs: DataFrame, scratch: Scratch, seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Times each document is taken when sources are mixed to their targets.

    The documents of a source stand in a pseudo-random order and queue up to three times.  A copy's
    virtual finish time is the source's words up to its end over the source's target; copies of all
    sources are ranged by that time and taken while the words so far stay within the total of all
    sizes.  Returns rows (doc_id, source, row_key, size, source_size, target, copies, taken), one for
    each row of docs; row_key is equal for equal rows only.

    Null texts and texts without words have size 0 and are never taken.  Null sources form one source,
    last in order.  Repeated rows are documents of their own that stand one after another; they are
    counted, not gathered.  Rows that share a doc_id are told apart by their text, then by their other
    columns, so reruns agree.  A very long text is one document like any other; if it is larger than
    what the budget has left, the mix ends before it.  An empty table gives an empty result.
    """
    rows = docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), row_key(docs, seed).alias("row_key"))
    rows = rows.groupBy("source", "row_key").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.count("*").alias("of"))
    rows = scratch.save(rows.withColumn("all", F.col("size") * F.col("of")), "sizes")
    targets = source_targets(rows.groupBy("source").agg(F.sum("all").alias("source_size")), scratch, weights)
    cell = F.conv(F.substring("row_key", 1, 3), 16, 10).cast("long")
    rows = running_sum(rows, ["source"], cell, [F.col("row_key")], "all", "to")
    left, right = rows.alias("r"), targets.alias("t")
    rows = left.join(right, F.col("r.source").eqNullSafe(F.col("t.source")), "left").select("r.*", "t.source_size", "t.target")
    rows = repeated(rows, F.col("of"), "nth").withColumn("source_to", F.col("to") - F.col("all") + (F.col("nth") + 1) * F.col("size"))
    rows = scratch.save(rows.drop("of", "all", "to"), "queued")

    copies = rows.filter("size > 0 and target > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1)))).drop("doc_id")
    finish = (F.col("copy") * F.col("source_size") + F.col("source_to")) / F.col("target")
    copies = copies.withColumn("finish", finish)
    # Virtual time ends near 1, until where slices hold about equally many words; later ones, which the
    # budget cuts off, get slices by the logarithm of the time.
    late = CELLS * (2 + F.log2(F.greatest(F.col("finish") / 2, F.lit(1.0))))
    slice_of = F.floor(F.when(F.col("finish") < 2, F.col("finish") * CELLS).otherwise(late)).cast("long")
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("row_key"), F.col("copy"), F.col("nth")]
    queue = running_sum(copies, [], slice_of, order, "size", "all_to")
    budget = rows.agg(F.sum("size")).first()[0] or 0
    taken = queue.filter(F.col("all_to") <= budget).groupBy("row_key", "nth").agg(F.count("*").alias("copies"))
    joined = rows.join(taken, ["row_key", "nth"], "left").withColumn("copies", F.coalesce("copies", F.lit(0)).cast("long"))
    return joined.select("doc_id", "source", "row_key", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, scratch: Scratch, seed: str = "mix") -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken (see ``fair_queue_mix``).

    Equal rows share a key, by which they meet their copies; rows that differ in any column do not.  Other
    columns pass through, whatever their names and types.
    """
    copies = fair_queue_mix(docs, scratch, seed).groupBy("row_key").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    one = docs.select(row_key(docs, seed).alias("row_key"), whole_row(docs)).dropDuplicates(["row_key"])
    return repeated(one.join(copies, "row_key"), F.col("copies"), "copy").select("row.*")
