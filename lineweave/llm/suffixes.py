"""Repeated byte strings by longest-previous-factor arrays over partial suffix arrays.

Every window of ``length`` bytes is routed by its minimiser, the least hash of the shorter strings in
it, so equal windows meet.  Consecutive windows with one minimiser travel together as one context.
Windows whose minimiser occurs once in the corpus are gone after a count.  Of what is left, the bytes of
each context are sorted into suffix arrays of bounded size: the first occurrence of a context, and its
last one, which stands for all later ones.  Their longest-previous-factor arrays, from the previous and
next smaller text positions in suffix order and the common prefixes between, give the length of the
longest earlier match at every place; matches of ``length`` bytes or more are repeats.  Where too many
contexts share a minimiser, those of their windows that occur again are sorted in its place, each as a
context of its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import BASE, BYTE_CODE, SPACE, Scratch, mix, pieces, spans_where, text_bytes, whole_row

RUN = 128  # windows in a context, at most
BUCKET = 6_000  # contexts sorted in one suffix array, about
HOT = 4_000  # contexts with one minimiser beyond which its windows are sorted one by one

RUN_SCHEMA = "did long, th long, m long, ch long, at int, n int, w int"


def gram_bytes(length: int) -> int:
    """Length of the strings that minimisers are taken from: a power of two up to 2 / 3 of a window.

    Longer ones leave fewer windows that share a minimiser and still differ, shorter ones fewer runs.
    """
    return 1 << ((2 * length // 3).bit_length() - 1)


def _grams(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all strings of gram_bytes and of ``length`` bytes (by start; the last ones are void)."""
    n, gram_size = len(data), gram_bytes(length)
    level, size, power = BYTE_CODE[data], 1, BASE
    whole, done = np.zeros(n, np.uint64), 0
    gram = level
    bits = length
    while True:
        if bits & size:  # append this block to the hash of the whole
            shifted = np.zeros(n, np.uint64)
            shifted[: max(0, n - done)] = level[done:] if done else level
            whole = whole * power + shifted
            done += size
        if size == gram_size:
            gram = level
        if size * 2 > length:
            return mix(gram), mix(whole)
        longer = level * power
        longer[: n - size] += level[size:]
        level, size = longer, size * 2
        power = power * power


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values, by start."""
    out, size = x, 1
    while size * 2 <= width:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def contexts(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimiser: row, start in the row, windows, minimiser, hash of the bytes, weight.

    The weight is 2 where the minimiser may stand twice in the run, so that its windows can repeat
    each other, else 1.
    """
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int32),)
    if len(data) < length:
        return none
    with np.errstate(over="ignore"):
        gram, whole = _grams(data, length)
        least = _sliding_least(gram, length - gram_bytes(length) + 1)[: len(data) - length + 1]
    n = len(least)
    inside, edge = np.zeros(n + 1, np.int32), np.zeros(n + 1, bool)
    long_rows = off[1:] - off[:-1] >= length
    begin, stop = off[:-1][long_rows], off[1:][long_rows] - length + 1
    if not len(begin):
        return none
    inside[begin] += 1
    inside[stop] -= 1
    valid = np.cumsum(inside[:n]) > 0
    edge[begin] = True
    fresh = np.ones(n, bool)
    fresh[1:] = (least[1:] != least[:-1]) | ~valid[:-1] | edge[1:n]
    starts = np.flatnonzero(valid & fresh)
    ends = np.minimum(np.append(starts[1:], n), stop[np.searchsorted(begin, starts, "right") - 1])
    cuts = -(-(ends - starts) // RUN)  # repetitive texts have long runs
    nth = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    at = np.repeat(starts, cuts) + nth * RUN
    size = np.minimum(np.repeat(ends, cuts) - at, RUN)
    row = np.searchsorted(off, at, "right") - 1
    identity = mix(whole[at] * np.uint64(0x9FB21C651E98DF25) + whole[at + size - 1] + size.astype(np.uint64))
    ordered = np.sort(gram[: len(data) - gram_bytes(length) + 1])
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    weight = np.ones(len(at), np.int32)
    if len(twice):
        weight += twice[np.minimum(np.searchsorted(twice, least[at]), len(twice) - 1)] == least[at]
    return row, at - off[row], size, least[at], identity, weight


def _with_key(docs: DataFrame, *more: str) -> DataFrame:
    """Rows (doc_id, did, th, text, *more): did and th name a document; equal ones are equal rows."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("did"), F.xxhash64("text").alias("th"), "text", *more)


def _runs(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                row, at, n, m, ch, w = contexts(*text_bytes(part.column("text")), length)
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("did").take(rows), part.column("th").take(rows), pa.array(m.view(np.int64)), pa.array(ch.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(w)],
                    ["did", "th", "m", "ch", "at", "n", "w"],
                )

    return _with_key(docs).select("did", "th", "text").mapInArrow(run, RUN_SCHEMA)


# --- suffix arrays --------------------------------------------------------------------------------------

_TOP = np.array([(0xFFFFFFFFFFFFFFFF << (64 - 8 * k)) & 0xFFFFFFFFFFFFFFFF if k else 0 for k in range(8)], np.uint64)


def suffix_array(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the strings data[at : at + size] as indices into ``at``, and common prefix lengths.

    The second array holds the length of the prefix that each string shares with the one before it.  The
    order is refined seven bytes at a time; the eighth byte of a key counts how many of them the string
    has, so an end sorts before any byte.  A string that is told apart takes no further part; strings
    that are equal to their end keep their order.
    """
    wide = np.zeros(len(data) + 8, np.uint64)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    for j in range(7):
        wide |= padded[j : j + len(wide)].astype(np.uint64) << np.uint64(56 - 8 * j)
    order, common = np.arange(len(at)), np.zeros(len(at), np.int64)
    place, group, depth = np.arange(len(at)), np.zeros(len(at), np.int64), 0
    while len(place):
        own = order[place]
        left = np.minimum(size[own] - depth, 7)
        key = (wide[at[own] + depth] & _TOP[left]) | left.astype(np.uint64)
        split = np.zeros(len(own), bool)
        split[1:] = (key[1:] != key[:-1]) & (group[1:] == group[:-1])
        if split.any():
            touched = np.zeros(int(group[-1]) + 1, bool)
            touched[group[split]] = True
            some = np.flatnonzero(touched[group])
            by = some[np.lexsort((key[some], group[some]))] if depth else np.argsort(key, kind="stable")
            own[some], key[some], left[some] = own[by], key[by], left[by]
            order[place] = own
        fresh = np.ones(len(own), bool)
        fresh[1:] = group[1:] != group[:-1]
        here = np.flatnonzero(~fresh)
        differ = key[here] ^ key[here - 1]
        # Equal leading bytes of two keys: where the counts alone differ, all bytes of the shorter one.
        shared = np.minimum(np.minimum(left[here], left[here - 1]), _leading(differ))
        told = (differ != 0) | (left[here] < 7)
        common[place[here[told]]] = depth + shared[told]
        # A new class starts where keys differ; equal strings that ended are settled, too.
        start = fresh.copy()
        start[here[told]] = True
        alone = start.copy()
        alone[:-1] &= start[1:]
        group = np.cumsum(start) - 1
        place, group = place[~alone], group[~alone]
        depth += 7
    return order, common


def _leading(differ: np.ndarray) -> np.ndarray:
    """Number of leading zero bytes of 64-bit integers."""
    out = np.full(len(differ), 8, np.int64)
    for k in range(8):
        out[differ >> np.uint64(8 * k) != 0] = 7 - k
    return out


def longest_previous(text_position: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest-previous-factor values of suffixes given in suffix order.

    ``lcp[i]`` is the common prefix of suffixes i - 1 and i (``lcp[0]`` = 0).  The best earlier match of
    a suffix is its previous or next smaller text position in suffix order; both are found by pointer
    jumping, each jump carrying the least common prefix on the way.
    """

    def nearest_smaller(pos: np.ndarray, common: np.ndarray) -> np.ndarray:
        n = len(pos)
        back, least = np.arange(n, dtype=np.int64) - 1, common.copy()
        back[common == 0] = -1
        active = np.flatnonzero(back >= 0)
        active = active[pos[back[active]] > pos[active]]
        while len(active):
            to = back[active]
            least[active] = np.minimum(least[active], least[to])
            back[active] = back[to]
            active = active[back[active] >= 0]
            active = active[pos[back[active]] > pos[active]]
        return np.where(back >= 0, least, 0)

    if not len(lcp):
        return lcp
    after = np.append(lcp[1:], 0)[::-1]
    return np.maximum(nearest_smaller(text_position, lcp), nearest_smaller(text_position[::-1], after)[::-1])


def _twins(data: np.ndarray, base: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the bytes of contexts a[i] and b[i] are equal."""
    same = size[a] == size[b]
    rows = np.flatnonzero(same)
    if len(rows):
        n = size[a[rows]]
        to = np.cumsum(n) - n
        inner = np.arange(int(n.sum())) - np.repeat(to, n)
        equal = data[np.repeat(base[a[rows]], n) + inner] == data[np.repeat(base[b[rows]], n) + inner]
        same[rows] = np.logical_and.reduceat(equal, to)
    return same


SPANS = "array<struct<a:int,b:int>>"
FOUND_SCHEMA = f"m long, ch long, did long, th long, at int, firsts {SPANS}, laters {SPANS}"


def _repeats(length: int, keep_first: bool):
    """Repeated bytes of one bucket of contexts.

    Rows (m, ch, place of the first occurrence, firsts, laters): the spans of the first occurrence of a
    context, and those of its later ones, in bytes from the start of the context.
    """

    def run(bucket: pa.Table) -> pa.Table:
        column = lambda c: bucket.column(c).to_numpy()
        bucket = bucket.take(pa.array(np.lexsort([column(c) for c in ("rep", "at", "th", "did")])))
        m, ch, rep, n = column("m"), column("ch"), column("rep"), column("n").astype(np.int64)
        data, base = text_bytes(bucket.column("bytes"))
        base, size = base[:-1], n + length - 1
        # The suffixes of a context with equal bytes stand next to those of its twin, so they need no sorting.
        by = np.lexsort((rep, ch, m))
        pair = np.flatnonzero((m[by[1:]] == m[by[:-1]]) & (ch[by[1:]] == ch[by[:-1]]))
        one, two = by[pair], by[pair + 1]
        equal = _twins(data, base, size, one, two)
        twin, sorted_ = np.full(len(n), -1), np.ones(len(n), bool)
        twin[one[equal]] = two[equal]
        sorted_[two[equal]] = False
        own = np.flatnonzero(sorted_)
        owner = np.repeat(own, n[own])
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(n[own]) - n[own], n[own])
        left = size[owner] - inner
        order, lcp = suffix_array(data, base[owner] + inner, left)
        owner, inner, left = owner[order], inner[order], left[order]
        has = twin[owner] >= 0
        times = 1 + has
        last = (np.cumsum(times) - 1)[has]
        # Contexts stand in the order of their occurrence, so places in the data order text positions.
        place, lcp = np.repeat(base[owner] + inner, times), np.repeat(lcp, times)
        place[last], lcp[last] = base[twin[owner[has]]] + inner[has], left[has]
        match = longest_previous(place, lcp)
        if not keep_first:
            match = np.maximum(match, longest_previous(-place, lcp))
        hit = match >= length
        cover = np.zeros(len(data) + 1, np.int64)
        np.add.at(cover, place[hit], 1)
        np.add.at(cover, place[hit] + match[hit], -1)
        inside = np.cumsum(cover[:-1]) > 0
        a, b = spans_where(inside, np.append(base, len(data)))
        whose = np.searchsorted(base, a, "right") - 1
        first_of = np.arange(len(n))  # the context that names the class of each one
        first_of[two] = one
        classes = np.flatnonzero(first_of == np.arange(len(n)))
        nth = np.searchsorted(classes, first_of[whose])
        lists = []
        for later in (False, True):
            mine = np.flatnonzero((first_of[whose] != whose) == later)
            mine = mine[np.argsort(nth[mine], kind="stable")]
            to = np.concatenate([[0], np.cumsum(np.bincount(nth[mine], minlength=len(classes)))])
            spans = pa.StructArray.from_arrays([pa.array((x[mine] - base[whose[mine]]).astype(np.int32)) for x in (a, b)], ["a", "b"])
            lists.append(pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), spans))
        kept = bucket.take(pa.array(classes))
        return pa.Table.from_arrays([*(kept.column(c).combine_chunks() for c in ("m", "ch", "did", "th", "at")), *lists], ["m", "ch", "did", "th", "at", "firsts", "laters"])

    return run


CONTEXT_SCHEMA = "m long, ch long, rep int, did long, th long, at int, n int, hot boolean, bytes binary"


def _fetch(length: int):
    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                data, off = text_bytes(part.column("text"))
                raw, wants = data.tobytes(), part.column("wants")
                row = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(wants.offsets)))
                want = wants.flatten()
                at, n = (np.asarray(want.field(c)).astype(np.int64) for c in ("at", "n"))
                begin = off[row] + at
                end = begin + n + length - 1
                rows = pa.array(row)
                for k in range(0, len(row), 4096):
                    some = slice(k, k + 4096)
                    cut = pa.array([raw[a:b] for a, b in zip(begin[some].tolist(), end[some].tolist(), strict=True)], pa.binary())
                    own = [want.field(c).slice(k, 4096) for c in ("m", "ch", "rep")]
                    keys = [part.column(c).take(rows.slice(k, 4096)) for c in ("did", "th")]
                    yield pa.RecordBatch.from_arrays([*own, *keys, *(want.field(c).slice(k, 4096) for c in ("at", "n", "hot")), cut], ["m", "ch", "rep", "did", "th", "at", "n", "hot", "bytes"])

    return run


def _windows(length: int):
    """Windows of contexts, each once, named by a digest of 128 bits in two integers."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                n = np.asarray(part.column("n")).astype(np.int64)
                off = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                rows = pa.array(np.repeat(np.arange(len(n)), n))
                keys = b"".join(hashlib.blake2b(raw[i : i + length], digest_size=16).digest() for raw, many in zip(part.column("bytes").to_pylist(), n.tolist(), strict=True) for i in range(many))
                key = np.frombuffer(keys, np.int64).reshape(-1, 2)
                at = pa.array((np.asarray(part.column("at").take(rows)) + off).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(rows) for c in ("m", "ch", "rep", "did", "th")), at, pa.array(off.astype(np.int32)), pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy())], ["m", "ch", "rep", "did", "th", "at", "off", "k1", "k2"])

    return run


def _cut_windows(length: int):
    """Bytes of the wanted windows of contexts, as contexts of one window."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                wants = part.column("wants")
                rows = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(wants.offsets)))
                want, raw = wants.flatten(), part.column("bytes").to_pylist()
                off = np.asarray(want.field("off"))
                cut = [raw[r][o : o + length] for r, o in zip(rows.tolist(), off.tolist(), strict=True)]
                keys = [part.column(c).take(pa.array(rows)) for c in ("did", "th")]
                yield pa.RecordBatch.from_arrays([*(want.field(c) for c in ("k1", "k2", "nth")), *keys, want.field("at"), pa.array(np.ones(len(off), np.int32)), pa.array(np.zeros(len(off), bool)), pa.array(cut, pa.binary())], ["m", "ch", "rep", "did", "th", "at", "n", "hot", "bytes"])

    return run


def _sorted(sliced: DataFrame, key: list[str], buckets: int, length: int, keep_first: bool) -> DataFrame:
    together = sliced.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    return together.groupBy("bucket").applyInArrow(_repeats(length, keep_first), FOUND_SCHEMA)


def _window_by_window(hot: DataFrame, scratch: Scratch, length: int, keep_first: bool) -> DataFrame:
    """What ``_repeats`` gives, for minimisers with any number of contexts.

    Windows that occur once are gone after a count of digests; the first and the last occurrence of the
    others are sorted, in buckets by their digest.
    """
    windows = "m long, ch long, rep int, did long, th long, at int, off int, k1 long, k2 long"
    windows = scratch.save(hot.select("m", "ch", "rep", "did", "th", "at", "n", "bytes").mapInArrow(_windows(length), windows), "windows")
    place, key = F.struct("did", "th", "at", "rep", "m", "ch", "off"), ["k1", "k2"]
    again = windows.groupBy(*key).agg(F.count("*").alias("c"), F.min(place).alias("x"), F.max(place).alias("y")).filter("c > 1")
    again = scratch.save(again, "again")
    both = again.select(*key, F.posexplode(F.array("x", "y")).alias("nth", "w")).select(*key, "nth", "w.*")
    wants = both.groupBy("m", "ch", "rep").agg(F.collect_list(F.struct(*key, "nth", "at", "off")).alias("wants"))  # RUN windows at most, twice
    cut = hot.select("m", "ch", "rep", "did", "th", "bytes").join(wants, ["m", "ch", "rep"]).select("did", "th", "bytes", "wants")
    cut = scratch.save(cut.mapInArrow(_cut_windows(length), CONTEXT_SCHEMA), "cut")
    found = _sorted(cut, ["m", "ch"], max(1, -(-again.count() * 2 // BUCKET)), length, keep_first)
    found = found.select(F.col("m").alias("k1"), F.col("ch").alias("k2"), "firsts", "laters")
    hit = windows.join(again.select(*key, "x"), key).join(found, key)
    hit = hit.filter(F.size(F.when(place == F.col("x"), F.col("firsts")).otherwise(F.col("laters"))) > 0)
    run = F.col("off") - F.row_number().over(Window.partitionBy("m", "ch", "rep").orderBy("off"))
    spans = hit.select("m", "ch", "rep", "off", run.alias("run")).groupBy("m", "ch", "rep", "run").agg(F.struct(F.min("off").alias("a"), (F.max("off") + length).alias("b")).alias("span"))
    each = [F.collect_list(F.when(F.col("rep") == r, F.col("span"))).cast(SPANS).alias(name) for r, name in ((0, "firsts"), (1, "laters"))]
    named = hot.filter("rep = 0").select("m", "ch", "did", "th", "at")
    return named.join(spans.groupBy("m", "ch").agg(*each), ["m", "ch"])


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = 200, keep_first: bool = False) -> DataFrame:
    """Byte spans of windows that repeat: rows (did, th, spans array<struct<a,b>>), spans unmerged.

    Without ``keep_first`` every occurrence is named; with it the first one in the order of (doc_id,
    text hash, position) is left out.  Texts are judged as they come, overlaps count.  A context is told
    apart by two 64-bit hashes of its bytes; the bytes of its first and last occurrence are compared.
    """
    runs = _runs(docs, length)
    often = runs.groupBy("m").agg(F.sum("w").alias("c")).filter("c > 1").select("m")
    runs = scratch.save(runs.join(often, "m", "left_semi"), "runs")
    place = F.struct("did", "th", "at")
    distinct = runs.groupBy("m", "ch").agg(F.count("*").alias("c"), F.min(place).alias("first"), F.max(place).alias("last"), F.first("n").alias("n"))
    again = F.col("first") != F.col("last") if keep_first else F.col("c") > 1
    distinct = scratch.save(distinct.withColumn("reps", 1 + again.cast("int")), "distinct")
    hot = distinct.groupBy("m").agg(F.sum("reps").alias("contexts")).filter(F.col("contexts") > HOT).select("m", F.lit(True).alias("hot"))
    asked = distinct.join(hot, "m", "left").select("m", "ch", "n", F.coalesce("hot", F.lit(False)).alias("hot"), F.posexplode(F.expr("slice(array(first, last), 1, reps)")).alias("rep", "w"))
    wants = asked.groupBy("w.did", "w.th").agg(F.collect_list(F.struct("m", "ch", "rep", F.col("w.at").alias("at"), "n", "hot")).alias("wants"))
    # Equal rows give equal contexts; only one of them is cut up and sorted.
    texts = _with_key(docs).select("did", "th", "text").dropDuplicates(["did", "th"])
    sliced = texts.join(wants, ["did", "th"]).select("did", "th", "text", "wants").mapInArrow(_fetch(length), CONTEXT_SCHEMA)
    sliced = scratch.save(sliced, "contexts")
    many = sliced.agg(F.count_if(~F.col("hot")).alias("cold"), F.count_if("hot").alias("hot")).first()
    # A minimiser's contexts stay together, if they are not too many.
    found = _sorted(sliced.filter("not hot"), ["m"], max(1, -(-many.cold // BUCKET)), length, keep_first)
    if many.hot:
        found = found.unionByName(_window_by_window(sliced.filter("hot"), scratch, length, keep_first))
    found = scratch.save(found.filter("size(firsts) > 0 or size(laters) > 0"), "found")
    scratch.drop("contexts", "distinct", *["windows", "again", "cut"] * bool(many.hot))

    r, f = runs.alias("r"), found.alias("f")
    first = (F.col("r.did") == F.col("f.did")) & (F.col("r.th") == F.col("f.th")) & (F.col("r.at") == F.col("f.at"))
    own = F.when(first, F.col("f.firsts")).otherwise(F.col("f.laters"))
    spans = r.join(f, (F.col("r.m") == F.col("f.m")) & (F.col("r.ch") == F.col("f.ch"))).select("r.did", "r.th", F.col("r.at").alias("at"), F.explode(own).alias("own"))
    span = F.struct((F.col("at") + F.col("own.a")).cast("long").alias("a"), (F.col("at") + F.col("own.b")).cast("long").alias("b"))
    return spans.groupBy("did", "th").agg(F.collect_set(span).alias("spans"))


def _merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, scratch: Scratch, length: int = 200, keep_first: bool = False, with_text: bool = False) -> DataFrame:
    """Documents without the bytes of repeated ``length``-byte strings.

    Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans[, text]): spans are the maximal
    removed byte runs, the sha256 is that of the remaining bytes, ``text`` holds what remains, without
    the broken pieces of characters at cuts.

    Null and empty texts have no bytes and nothing to remove.  Rows with a null doc_id take part like
    others.  Repeated rows repeat each other, so without ``keep_first`` all of a text of ``length`` bytes
    or more goes; with it, equal rows count as one document and stay together, and of equal strings the one
    of the smallest doc_id, then of the smallest hash of the text, then the first in its text is kept.
    Matches never cross documents.  A very long text is read whole, by one task at a time.  Other columns
    are ignored, an empty table gives no rows.
    """
    spans = scratch.save(repeated_spans(docs, scratch, length, keep_first), "spans")
    scratch.drop("runs", "found")
    joined = _with_key(docs).join(spans, ["did", "th"], "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a:long,b:long>>" + ", text string" * with_text

    def cut(batches):
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                raw, at, kept = (text.as_py() or "").encode(), 0, []
                merged = _merged(spans)
                for a, b in merged:
                    kept.append(raw[at:a])
                    at = b
                rest = b"".join([*kept, raw[at:]])
                row = {"doc_id": doc_id, "n_bytes": len(raw), "n_removed": len(raw) - len(rest), "n_spans": len(merged), "kept_sha256": hashlib.sha256(rest).hexdigest(), "spans": [{"a": a, "b": b} for a, b in merged]}
                if with_text:
                    row["text"] = None if not text.is_valid else rest.decode("utf-8", "ignore")
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(ARROW[: 6 + with_text]))

    return joined.mapInArrow(cut, schema)


def strip_repeats(docs: DataFrame, scratch: Scratch, length: int = 200) -> DataFrame:
    """Rows of docs with the later copies of repeated strings cut out of their text, all columns kept.

    The first copy of a string stays (see ``repeated_spans``).  A document of which no word is left
    goes; one that nothing was cut from stays as it is.  Null and empty texts stay, equal rows stay
    together, an empty table gives no rows; other columns pass through, whatever their names and types.
    """
    spans = scratch.save(repeated_spans(docs, scratch, length, True), "spans")
    scratch.drop("runs", "found")
    joined = _with_key(docs.select("doc_id", "text", whole_row(docs)), "row").join(spans, ["did", "th"], "left").select("row", "spans")
    names = docs.columns

    def cut(batches):
        for batch in batches:
            columns, texts, kept = batch.column("row").flatten(), [], []
            at = names.index("text")
            for text, spans in zip(columns[at], batch.column("spans").to_pylist(), strict=True):
                text = text.as_py()
                if spans:
                    raw, done, parts = text.encode(), 0, []
                    for a, b in _merged(spans):
                        parts.append(raw[done:a])
                        done = b
                    text = b"".join([*parts, raw[done:]]).decode("utf-8", "ignore")
                texts.append(text)
                kept.append(not spans or any(not SPACE[min(ord(c), 255)] for c in text))
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(kept))

    return joined.mapInArrow(cut, docs.schema)


ARROW = [
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
    ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("text", pa.string()),
]
