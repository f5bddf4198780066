"""MinHash near-duplicates with tensored banding.

Table keys pair one key of collection A with one of collection B.  Each collection holds ``m`` keys of
ROWS minhashes, so ``m * m`` tables cost only ``2 * m * ROWS`` minhashes.  Documents meet where an A key
and a B key agree; rows are only spread over the B keys once their A key has met another document.
Every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import SPACE, WORD, Scratch, components, mix, pieces, powers, row_key, span_hashes, spans_where, text_bytes, window_hashes, whole_row

ROWS = 4  # minhashes in a half key
MISS = 1e-4  # chance that a pair at the threshold meets in no table
BLOCK_DOCS = 1024  # documents compared in one task at a time
BLOCK_SHINGLES = 1_000_000
HUBS = 4  # documents of a large cluster that all its blocks share

FEATURES = "doc_id long, n_shingles long, s1 long, s2 long, keys_a array<long>, keys_b array<long>, sketch binary"


def half_keys(num: int, den: int) -> int:
    """Keys in each collection so that a pair at the threshold is missed with chance MISS."""
    return math.ceil(math.log(MISS / 2) / math.log(1 - (num / den) ** ROWS))


def shingle_sets(text: pa.Array, n: int) -> list[np.ndarray]:
    """For each row, the sorted distinct 64-bit hashes of its n-word shingles.

    Words are lower-cased in A-Z.  A text of fewer words has one shingle, the whole sequence; a text
    without words has none.
    """
    data, off = text_bytes(text)
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + 32, data).astype(np.uint8)
    start, end = spans_where(~SPACE[data], off)
    h = span_hashes(data, start, end)
    first = np.searchsorted(start, off)
    windows = window_hashes(h, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(windows[a : b - n + 1]))
        elif b > a:
            out.append(window_hashes(h[a:b], b - a) ^ mix(np.array([b - a], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:k] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[k:] >> np.uint64(32)).astype(np.uint32)


def minhashes(sets: list[np.ndarray], k: int) -> np.ndarray:
    """k minhashes (32 bits) of each set that is not empty: rows of a (sets, k) array."""
    full = np.array([len(s) > 0 for s in sets], bool)
    out = np.zeros((len(sets), k), np.uint32)
    if full.any():
        values = np.concatenate([s for s in sets if len(s)])
        values = ((values >> np.uint64(32)) ^ (values & np.uint64(0xFFFFFFFF))).astype(np.uint32)
        sizes = np.array([len(s) for s in sets if len(s)])
        first = np.cumsum(sizes) - sizes
        for f, (a, b) in enumerate(zip(*_coefficients(k), strict=True)):
            out[full, f] = np.minimum.reduceat((values ^ b) * a, first)
    return out


def features(docs: DataFrame, shingle: int, m: int) -> DataFrame:
    """Set size, set hash, half keys and a sketch of each row of docs (doc_id, text)."""
    k = 2 * m * ROWS

    def run(batches):
        spread = powers(ROWS, np.uint64(0xE7037ED1A0B428DB))
        side = mix(np.arange(1, 2 * m + 1, dtype=np.uint64))
        for batch in batches:
            for part in pieces(batch):
                sets = shingle_sets(part.column("text"), shingle)
                low = minhashes(sets, k)
                keys = mix((low.reshape(-1, 2 * m, ROWS) * spread).sum(2, dtype=np.uint64) ^ side).view(np.int64)
                n = len(sets)
                where = pa.array(np.arange(n + 1, dtype=np.int32) * m)
                lists = [pa.ListArray.from_arrays(where, pa.array(np.ascontiguousarray(x).ravel())) for x in (keys[:, :m], keys[:, m:])]
                sums = [np.array([int(mix(s + np.uint64(c)).sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64) for c in (1, 7)]
                sketch = np.ascontiguousarray((low & 0xFF).astype(np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, sums), *lists, pa.array([r.tobytes() for r in sketch], pa.binary())],
                    ["doc_id", "n_shingles", "s1", "s2", "keys_a", "keys_b", "sketch"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, FEATURES)


def _linker(shingle: int, num: int, den: int, exact: bool = False):
    """Links inside one block: a forest of pairs (a, b) confirmed on the full sets.

    Each row that asks is compared with all others.  Unless ``exact``, sketches leave out pairs five
    deviations below the threshold; pairs that are connected already need no look; the sets of all
    others are compared with one set in one pass.
    """
    t = num / den

    def link(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("ask", ascending=False, kind="stable")
        rep, known = block["rep"].to_numpy(np.int64), block["known"].to_numpy(np.int64)
        sets = shingle_sets(pa.array(block["text"], pa.large_string()), shingle)
        sketch = np.stack([np.frombuffer(s, np.uint8) for s in block["sketch"]])
        size, k = np.array([len(s) for s in sets]), sketch.shape[1]
        least = 0 if exact else k * (t - 5 * math.sqrt(t * (1 - t) / k))
        flat = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)[1]
        start = np.cumsum(size) - size
        label = np.unique(known, return_inverse=True)[1]  # what is connected, by the rows at hand
        mask, out = np.zeros(int(flat.max(initial=0)) + 1, bool), []
        for i in range(min(int(block["ask"].sum()), len(rep) - 1)):
            after = slice(i + 1, None)
            small, large = np.minimum(size[after], size[i]), np.maximum(size[after], size[i])
            open_ = np.flatnonzero((label[after] != label[i]) & (den * small >= num * large))
            open_ = open_[(sketch[open_ + i + 1] == sketch[i]).sum(1) >= least] + i + 1
            if not len(open_):
                continue
            n = size[open_]
            to = np.cumsum(n) - n
            mask[flat[start[i] : start[i] + size[i]]] = True
            both = np.add.reduceat(mask[flat[np.arange(int(n.sum())) + np.repeat(start[open_] - to, n)]].astype(np.int64), to)
            mask[flat[start[i] : start[i] + size[i]]] = False
            near = open_[den * both >= num * (size[i] + n - both)]
            for lab, j in zip(*np.unique(label[near], return_index=True), strict=True):
                out.append((rep[i], rep[near[j]]))
                label[label == lab] = label[i]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return link


def near_duplicate_classes(docs: DataFrame, scratch: Scratch, shingle: int = 5, num: int = 80, den: int = 100, exact: bool = False) -> DataFrame:
    """Classes of documents linked at ``den * |A & B| >= num * |A | B|`` on sets of word shingles.

    Rows (doc_id, n_shingles, component_id, kept): component_id is the smallest doc_id reachable by
    links, kept marks it.  Documents with equal sets count once from the start, so copies are never
    spread into pairs.  Table buckets give candidate clusters; a cluster is compared in blocks of
    bounded size that share a few hubs.  Where documents of different blocks meet in a table and are still
    apart, they are compared once for their A key, block by block: those outside its largest class with all.
    ``exact`` compares the sets of all candidates, without the look at their sketches first.

    Null and empty texts have no shingles and link with nothing.  Rows with a null doc_id link with
    nothing, have a null component_id and are kept.  Rows that share a doc_id are one document, linked
    by each of its texts; repeated rows repeat in the result.  Very long texts are compared by all their
    shingles, in blocks of fewer documents.  An empty table gives no rows; other columns are not read.
    """
    m = half_keys(num, den)
    link = _linker(shingle, num, den, exact)
    all_rows = scratch.save(features(docs, shingle, m), "features")
    same = ["n_shingles", "s1", "s2"]
    linkable = all_rows.filter("n_shingles > 0 and doc_id is not null")
    reps = scratch.save(linkable.groupBy(*same).agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("keys_a", "keys_b", "sketch")]), "reps")

    # Tables: spread over A keys, keep the keys that meet, then pair them with the B keys.
    by_a = reps.select("rep", F.explode("keys_a").alias("a"))
    met = by_a.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a")
    met = scratch.save(by_a.join(met, "a", "left_semi"), "met")
    tables = met.join(reps.select("rep", "keys_b"), "rep").select("rep", "a", F.explode("keys_b").alias("b"))
    hubs = tables.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("rep").alias("hub")).filter("n > 1")
    star = scratch.save(tables.join(hubs, ["a", "b"]).filter("rep <> hub").select("hub", "rep").distinct(), "star")

    # Candidate clusters, cut into blocks.
    clusters = components(star, scratch, "clusters").select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    clusters = clusters.join(reps.groupBy("rep").agg(F.max("n_shingles").alias("n_shingles"), F.max("sketch").alias("sketch")), "rep")
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("n_shingles") / BLOCK_SHINGLES)).alias("blocks"))
    clusters = clusters.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    clusters = scratch.save(clusters, "blocks")
    degree = star.groupBy(F.col("hub").alias("rep")).agg(F.count("*").alias("degree"))
    large = clusters.filter("blocks > 1")
    hub_rows = large.join(degree, "rep").withColumn("nth", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("degree"), "rep"))).filter(F.col("nth") <= HUBS)
    hub_rows = hub_rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = clusters.select("rep", "cluster", "block", "sketch").unionByName(hub_rows.select("rep", "cluster", "block", "sketch")).distinct()

    # Sorted merge at every size: the members grow with the corpus.
    member_texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(clusters.select("rep").hint("merge"), "rep", "left_semi")
    member_texts = scratch.save(member_texts, "texts")
    grouped = placed.join(member_texts, "rep").withColumns({"known": F.col("rep"), "ask": F.lit(True)}).groupBy("cluster", "block")
    links = scratch.save(grouped.applyInPandas(link, "a long, b long"), "links")
    found = scratch.save(components(links, scratch, "found"), "classes")

    # Documents that meet in a table, lie in different blocks and are still apart.
    label = large.select("rep", "block").join(found, F.col("rep") == F.col("node"), "left").select("rep", "block", F.coalesce("component", "rep").alias("known"))
    cells = met.join(label, "rep")
    apart = lambda df, *key: df.groupBy(*key).agg(F.min("known").alias("k0"), F.max("known").alias("k1"), F.min("block").alias("b0"), F.max("block").alias("b1")).filter("k0 < k1 and b0 < b1").select(*key)
    cells = cells.join(apart(cells, "a"), "a", "left_semi").join(reps.select("rep", F.col("keys_b").alias("b")), "rep").withColumn("b", F.explode("b"))
    cells = scratch.save(cells.join(apart(cells, "a", "b"), ["a", "b"], "left_semi"), "cells")
    if not cells.isEmpty():
        part = cells.groupBy("a", "rep", "known").agg(F.count("*").alias("tables"))
        largest = part.groupBy("a", "known").agg(F.count("*").alias("n")).groupBy("a").agg(F.max_by("known", F.struct("n", "known")).alias("largest"))
        part = scratch.save(part.join(largest, "a").select("a", "rep", "known", (F.col("known") != F.col("largest")).alias("ask")), "part")
        # A keys with the same documents are one; the largest class of a key need not ask.
        who = F.sum(F.xxhash64("rep", "ask").cast("decimal(38,0)")).alias("who")
        keys = part.groupBy("a").agg(F.count("*").alias("n"), F.count_if("ask").alias("asking"), who).groupBy("n", "asking", "who").agg(F.min("a").alias("a"))
        keys = keys.select("a", F.ceil(F.col("n") / BLOCK_DOCS).alias("parts"), F.ceil(F.col("asking") / BLOCK_DOCS).alias("askers"))
        rest = part.join(keys, "a")
        asks = rest.filter("ask").withColumn("x", F.pmod(F.xxhash64("rep", F.lit(2)), F.col("askers")))
        asks = asks.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        told = rest.withColumns({"y": F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")), "ask": F.lit(False)})
        told = told.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("askers") - 1)))
        both = asks.select("a", "x", "y", "rep", "known", "ask").unionByName(told.select("a", "x", "y", "rep", "known", "ask"))
        both = both.groupBy("a", "x", "y", "rep", "known").agg(F.max("ask").alias("ask"))
        both = both.join(reps.groupBy("rep").agg(F.max("sketch").alias("sketch")), "rep").join(member_texts, "rep")
        more = both.groupBy("a", "x", "y").applyInPandas(link, "a long, b long")
        links = scratch.save(links.unionByName(more).unionByName(label.select(F.col("rep").alias("a"), F.col("known").alias("b"))), "more")
        found = scratch.save(components(links, scratch, "again"), "classes2")

    scratch.drop("met", "star", "blocks", "texts", "links", "cells", "part", "more")  # the result reads features, reps and classes

    class_of = reps.select(*same, "rep").join(found, F.col("rep") == F.col("node"), "left").select(*same, F.coalesce("component", "rep").alias("component"))
    f, c = all_rows.select("doc_id", *same).alias("f"), class_of.alias("c")
    on = (F.col("f.n_shingles") == F.col("c.n_shingles")) & (F.col("f.s1") == F.col("c.s1")) & (F.col("f.s2") == F.col("c.s2")) & F.col("f.doc_id").isNotNull()
    out = f.join(c, on, "left").select("f.doc_id", "f.n_shingles", F.coalesce("c.component", "f.doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame, scratch: Scratch, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Rows of docs without near copies: the smallest doc_id of each class stays, once.

    Of rows that share a doc_id one stays, the first by a digest of all columns.  Rows without a doc_id
    stay, all of them.  Other columns pass through, whatever their names and types.
    """
    classes = near_duplicate_classes(docs, scratch, shingle, num, den)
    gone = classes.filter("not kept").select("doc_id").distinct()
    rows = docs.select("doc_id", row_key(docs, "near").alias("key"), whole_row(docs))
    kept = rows.filter("doc_id is not null").join(gone, "doc_id", "left_anti")
    kept = kept.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("key"))).filter("nth = 1")
    return kept.select("row.*").unionByName(docs.filter("doc_id is null"))


def audit_recall(docs: DataFrame, classes: DataFrame, scratch: Scratch, shingle: int = 5, num: int = 80, den: int = 100, every: int = 100) -> DataFrame:
    """One row (links, found, recall): of the links of every doc_id divisible by ``every``, how many are in ``classes``.

    The links are found without minhashes, among all documents: a linked document holds one of the rarest
    n - need + 1 of a text's n shingles, need being the fewest that a link shares; those that do are compared
    as whole sets.  A link is found if both ends have one component.  Shingles are told apart by 64 bits.
    Null, empty and wordless texts have no links; of rows that share a doc_id the first text is taken.
    """
    words = F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD), F.lit(0))
    texts = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text")).select("doc_id", words.alias("w")).filter("size(w) > 0")
    at = F.sequence(F.lit(1), F.greatest(F.size("w") - (shingle - 1), F.lit(1)))
    codes = F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice("w", i, shingle), " "))))
    sets = scratch.save(texts.select("doc_id", codes.alias("codes")).withColumn("n", F.size("codes")), "audit")
    each = sets.select("doc_id", "n", F.explode("codes").alias("code"))
    asked = sets.filter(F.col("doc_id") % every == 0)
    counts = each.join(asked.select(F.explode("codes").alias("code")).distinct(), "code", "left_semi").groupBy("code").agg(F.count("*").alias("places"))
    ranked = asked.select(F.col("doc_id").alias("q"), F.explode("codes").alias("code")).join(counts, "code").groupBy("q").agg(F.array_sort(F.collect_list(F.struct("places", "code"))).alias("c"))
    fewest = F.ceil(F.size("c") * F.lit(num) / den).cast("int")
    index = ranked.select("q", F.size("c").alias("m"), F.explode(F.slice("c", F.lit(1), F.size("c") - fewest + 1)).alias("c")).select("q", "m", "c.code")
    near = (F.col("n") * den >= F.col("m") * num) & (F.col("m") * den >= F.col("n") * num) & (F.col("doc_id") != F.col("q"))
    met = each.join(index, "code").filter(near).select("q", "doc_id").distinct()
    both = met.join(sets, "doc_id").join(sets.select(F.col("doc_id").alias("q"), F.col("codes").alias("mine")), "q").select("q", "doc_id", F.size(F.array_intersect("codes", "mine")).alias("both"), F.size("codes").alias("n"), F.size("mine").alias("m"))
    links = both.filter(F.col("both") * den >= (F.col("n") + F.col("m") - F.col("both")) * num)
    of = classes.filter("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    ends = links.join(of, "doc_id").join(of.select(F.col("doc_id").alias("q"), F.col("component_id").alias("own")), "q")
    found = F.count_if(F.col("component_id") == F.col("own"))
    return ends.agg(F.count("*").alias("links"), found.alias("found"), (found / F.nullif(F.count("*"), F.lit(0))).alias("recall"))
