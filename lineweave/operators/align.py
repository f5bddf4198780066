"""Aligning recognised lines with script lines.

Both sides of a track are joined to one text each and matched character by character; the spans of
matches map lines to closed ranges of script lines.  The longest common string of both texts is matched
first, then what is left of it with what is left, and so on.

A track of up to ``limit`` letters is matched by one task.  For longer ones, strings of ``seed`` letters
that both sides share are joined and merged to maximal matches, rounds of joins split the track at its
longest ones, and the parts between are matched by a task each.  As long matches are chosen before short
ones in any case, the result is the same.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import align_normal
from .cut import checkpointed

JOINT = "␟"


def _blocks_by_rank(a: str, b: str) -> list[tuple[int, int, int]]:
    """Blocks of texts that repeat themselves much, in no order.

    Ranks of all strings of 2, 4, 8... characters are made once; two of them tell any length apart exactly,
    so a split costs some sorts of its range in place of a walk over all pairs of places.
    """
    n = len(a)
    both = np.frombuffer((a + b).encode("utf-32-le", "surrogatepass"), np.uint32)
    ranks = [np.unique(both, return_inverse=True)[1].astype(np.int64)]
    while (width := 1 << len(ranks)) <= min(n, len(b)):
        last, half = ranks[-1], width // 2
        longer = np.unique(last[:-half] * len(both) + last[half:], return_inverse=True)[1].astype(np.int64)
        ranks.append(longer)
        if not np.isin(longer[: n - width + 1], longer[n:]).any():
            break

    def keys(lo: int, hi: int, size: int) -> np.ndarray:
        rank, rest = ranks[size.bit_length() - 1], size - (1 << (size.bit_length() - 1))
        return rank[lo : hi - size + 1] * len(both) + rank[lo + rest : hi - size + 1 + rest]

    found, todo = [], [(0, n, 0, len(b), (1 << len(ranks)) - 1)]
    while todo:
        a0, a1, b0, b1, most = todo.pop()
        least, most = 0, min(most, a1 - a0, b1 - b0)
        where = None
        while least < most:
            size = (least + most + 1) // 2
            left, right = keys(a0, a1, size), keys(n + b0, n + b1, size)
            shared = np.isin(left, right)
            if shared.any():
                least, i = size, int(shared.argmax())
                where = i, int((right == left[i]).argmax())
            else:
                most = size - 1
        if where:
            i, j = a0 + where[0], b0 + where[1]
            found.append((i, j, least))
            todo += [(a0, i, b0, j, least), (i + least, a1, j + least, b1, least)]
    return found


#: Lengths of common strings that are looked for in one go, in what longer ones have left.
STEPS = (16, 6, 2, 1)


def _common(a: str, b: str, size: int) -> list[tuple[int, int, int]] | None:
    """Maximal common strings of ``size`` letters and more: (-length, i, j); None if places of equal letters are too many pairs."""
    places: dict[str, list[int]] = {}
    for j in range(len(b) - size + 1):
        places.setdefault(b[j : j + size], []).append(j)
    left, begun, runs = 4096 + 8 * (len(a) + len(b)), {}, []
    for i in range(len(a) - size + 1):
        met = places.get(a[i : i + size])
        if met:
            left -= len(met)
            if left < 0:
                return None
            for j in met:
                if i and j and a[i - 1] == b[j - 1]:
                    begun[j - i][1] = i
                else:
                    begun[j - i] = run = [i, i, j]
                    runs.append(run)
    return [(first - last - size, first, j) for first, last, j in runs]


def _free_blocks(a: str, b: str, step: int = 0) -> list[tuple[int, int, int]]:
    """Blocks in no order: common strings from the longest on, cut to what the chosen ones leave free; then shorter ones between."""
    if set(a).isdisjoint(b):
        return []
    size = STEPS[step]
    heap = _common(a, b, size)
    if heap is None:
        return _blocks_by_rank(a, b)
    heapq.heapify(heap)
    # Free parts in order, each as large as what stands between two chosen strings: where they start and end in a and b.
    starts, free, found = [0], [(0, len(a), 0, len(b))], []
    while heap:
        n, i, j = heapq.heappop(heap)
        end, k = i - n, max(0, bisect_right(starts, i) - 1)
        a0, a1, b0, b1 = free[k]
        if i >= a0 and j >= b0 and end <= a1 and j - n <= b1:
            found.append((i, j, -n))
            starts[k : k + 1] = [a0, end]
            free[k : k + 1] = [(a0, i, b0, j), (end, a1, j - n, b1)]
            continue
        while k < len(free) and free[k][0] < end:
            a0, a1, b0, b1 = free[k]
            skip, stop = max(0, a0 - i, b0 - j), min(-n, a1 - i, b1 - j)
            if stop - skip >= size:
                heapq.heappush(heap, (skip - stop, i + skip, j + skip))
            k += 1
    if step + 1 < len(STEPS):
        for a0, a1, b0, b1 in free:
            if a0 < a1 and b0 < b1:
                found += [(a0 + i, b0 + j, n) for i, j, n in _free_blocks(a[a0:a1], b[b0:b1], step + 1)]
    return found


def matching_blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """What difflib's ``get_matching_blocks`` gives without junk: (place in a, place in b, size), no empty one.

    The longest common string, the earliest in a and then in b, splits both sides, and so on.  Common strings
    are found once for each of a few lengths and taken from a heap, which costs some steps a letter; where a
    text repeats itself so much that they are too many, ranks of strings are compared instead.
    """
    out: list[tuple[int, int, int]] = []
    for i, j, size in sorted(_free_blocks(a, b)):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + size)
        else:
            out.append((i, j, size))
    return out


def spans(spoken: list[str], script: list[str]) -> dict[int, tuple[int, int]]:
    """Closed range of script lines for each spoken line that has letters."""
    a, s = JOINT.join(spoken), JOINT.join(script)
    if not a or not s:
        return {}
    s_line = np.repeat(np.arange(len(script)), [len(line) + 1 for line in script])[: len(s)]
    s_line[np.cumsum([len(line) + 1 for line in script])[:-1] - 1] = -1
    found = matching_blocks(a, s)
    begin = np.array([m[0] for m in found])
    place = lambda p: between(p, found, begin, (0, 0), (len(a), len(s)), False, not found)

    def line_at(x: float, step: int) -> int:
        p = max(0, min(len(s_line) - 1, int(x)))
        while s_line[p] < 0 and 0 < p < len(s_line) - 1:
            p += step
        return int(s_line[p])

    out, at = {}, 0
    for i, line in enumerate(spoken):
        if line:
            lo, hi = line_at(place(at), 1), line_at(place(at + len(line) - 1), -1)
            lo, hi = max(lo, 0), hi if hi >= 0 else len(script) - 1
            if lo <= hi:
                out[i] = (lo, hi)
        at += len(line) + 1
    return out


def _align(spoken: pa.Table, script: pa.Table) -> pa.Table:
    spoken, script = spoken.sort_by("seq"), script.sort_by("line_no")
    letters = lambda rows: [x or "" for x in rows.column("norm").to_pylist()]
    got, lines = spans(letters(spoken), letters(script)), script.column("text").to_pylist()
    said = ["｜".join(x for x in lines[lo : hi + 1][:6] if x is not None) for lo, hi in got.values()]
    out = spoken.select(["track", "seq", "norm"]).take(pa.array(list(got), pa.int64()))
    for name, values, kind in (("lo", [lo for lo, _ in got.values()], pa.int32()), ("hi", [hi for _, hi in got.values()], pa.int32()), ("sb", said, pa.string())):
        out = out.append_column(name, pa.array(values, kind))
    return out


def _likeness(batches):
    """Dice of ``norm`` and ``other``, as ``dice`` has it, by sets of bigrams."""
    pairs = lambda x: {x[i : i + 2] for i in range(len(x) - 1)}
    for batch in batches:
        conf = []
        for one, other in zip(batch.column("norm").to_pylist(), batch.column("other").to_pylist(), strict=True):
            x, y = pairs(one), pairs(other)
            conf.append(2.0 * len(x & y) / (len(x) + len(y)) if x and y else 0.0)
        names = ["track", "seq", "sb", "conf", "lo", "hi"]
        yield pa.RecordBatch.from_arrays([pa.array(conf, pa.float64()) if c == "conf" else batch.column(c) for c in names], names)


# --- long tracks ---------------------------------------------------------------------------------------

BLOCK = 1 << 15  # letters in a block of text, and in a bucket of places


def _placed(lines: DataFrame, order: str) -> DataFrame:
    """Lines with ``at``, where they start in their track's joined text; sums of 1,024 numbers first, then inside."""
    size = F.length("norm") + 1
    cut = lines.withColumns({"part": F.floor(F.col(order) / 1024), "size": F.length("norm").cast("long")})
    sums = cut.groupBy("track", "part").agg(F.sum(size).alias("letters"))
    before = sums.select("track", "part", (F.sum("letters").over(Window.partitionBy("track").orderBy("part")) - F.col("letters")).alias("before"))
    inside = F.sum(size).over(Window.partitionBy("track", "part").orderBy(order)) - size
    return cut.join(before, ["track", "part"]).withColumn("at", F.col("before") + inside).drop("before")


def _neighbours(lines: DataFrame) -> DataFrame:
    """Lines with letters, and ``before`` and ``after``: where the last such line ends and the next one starts."""
    letters, end = lines.filter("size > 0"), F.col("at") + F.col("size")
    parts, by = letters.groupBy("track", "part").agg(F.max(end).alias("ends"), F.min("at").alias("starts")), Window.partitionBy("track").orderBy("part")
    parts = parts.select("track", "part", F.lag("ends").over(by).alias("ends"), F.lead("starts").over(by).alias("starts"))
    inside = Window.partitionBy("track", "part").orderBy("at")
    return letters.join(parts, ["track", "part"]).withColumns({"before": F.coalesce(F.lag(end).over(inside), "ends"), "after": F.coalesce(F.lead("at").over(inside), "starts")})


def _blocks(lines: DataFrame, more: int) -> DataFrame:
    """Rows (track, block, text): the joined text in blocks, each with ``more`` letters of the next one."""
    end = F.col("at") + F.col("size") + 1
    first = F.greatest(F.lit(0), F.floor((F.col("at") - more) / BLOCK)).cast("long")
    each = lines.withColumn("block", F.explode(F.sequence(first, F.floor((end - 1) / BLOCK).cast("long"))))
    low, high = F.greatest(F.col("at"), F.col("block") * BLOCK), F.least(end, F.col("block") * BLOCK + BLOCK + more)
    text = F.concat("norm", F.lit(JOINT))
    part = F.substring(text, (low - F.col("at") + 1).cast("int"), (high - low).cast("int"))
    pieces = each.filter(low < high).select("track", "block", F.struct(low.alias("low"), part.alias("part")).alias("piece"))
    return pieces.groupBy("track", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda x: x["part"]), "").alias("text"))


def _seeds(lines: DataFrame, seed: int) -> DataFrame:
    """Rows (track, at, code): 64-bit codes of all strings of ``seed`` letters."""
    kind = dict(lines.dtypes)["track"]
    power = np.cumprod(np.full(seed, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)

    def run(batches):
        for batch in batches:
            for track, block, text in zip(batch.column("track"), batch.column("block").to_pylist(), batch.column("text").to_pylist(), strict=True):
                letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
                n = min(BLOCK, len(letters) - seed + 1)
                if n > 0:
                    code = np.zeros(n, np.uint64)
                    for k in range(seed):
                        code += letters[k : k + n] * power[k]
                    code ^= code >> np.uint64(29)
                    yield pa.RecordBatch.from_arrays([pa.array([track.as_py()] * n, batch.column("track").type), pa.array(np.arange(n) + block * BLOCK), pa.array(code.view(np.int64))], ["track", "at", "code"])

    return _blocks(lines, seed - 1).mapInArrow(run, f"track {kind}, at long, code long")


def _matches(a: DataFrame, s: DataFrame, seed: int) -> DataFrame:
    """Rows (track, i, j, size): all maximal common strings of ``seed`` letters and more."""
    met = _seeds(a, seed).withColumnRenamed("at", "i").join(_seeds(s, seed).withColumnRenamed("at", "j"), ["track", "code"])
    met = met.select("track", "i", (F.col("j") - F.col("i")).alias("shift"), F.floor(F.col("i") / BLOCK).alias("part"))
    run = F.col("i") - F.row_number().over(Window.partitionBy("track", "shift", "part").orderBy("i"))
    runs = met.withColumn("run", run).groupBy("track", "shift", "part", "run").agg(F.min("i").alias("i"), F.max("i").alias("last"))
    by = Window.partitionBy("track", "shift").orderBy("i")  # runs that go on in the next part
    fresh = F.coalesce(F.col("i") != F.lag("last").over(by) + 1, F.lit(True))
    runs = runs.withColumn("run", F.sum(fresh.cast("int")).over(by))
    runs = runs.groupBy("track", "shift", "run").agg(F.min("i").alias("i"), F.max("last").alias("last"))
    return runs.select("track", "i", (F.col("i") + F.col("shift")).alias("j"), (F.col("last") - F.col("i") + seed).alias("size"))


def _split(matches: DataFrame, rects: DataFrame, limit: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rectangles (track, a0, a1, b0, b1) of ``limit`` letters a side at most, and the matches between them.

    A round splits every larger rectangle at its longest match, the earliest of equals; a rectangle that
    shares no ``seed`` letters stays as it is.  a0 names a rectangle of a track.
    """
    # A line's mark stands after the last one too, beyond the text.
    inside = F.least("size", F.col("a1") - F.col("i"), F.col("b1") - F.col("j"))
    matches = checkpointed(matches.join(rects, "track").select("track", "a0", "i", "j", inside.alias("size")).filter(F.col("size") >= seed))
    done, chosen = None, None
    while True:
        best = matches.groupBy("track", "a0").agg(F.max(F.struct("size", (-F.col("i")).alias("i"), (-F.col("j")).alias("j"))).alias("m"))
        best = best.select("track", "a0", (-F.col("m.i")).alias("x"), (-F.col("m.j")).alias("y"), F.col("m.size").alias("n"))
        large = (F.col("a1") - F.col("a0") > limit) | (F.col("b1") - F.col("b0") > limit)
        marked = checkpointed(rects.join(best, ["track", "a0"], "left").withColumn("split", large & F.col("n").isNotNull()))
        small, cut = marked.filter("not split").select(*rects.columns), marked.filter("split")
        done = small if done is None else done.unionByName(small)
        if cut.isEmpty():
            return done, chosen
        block = cut.select("track", F.col("x").alias("i"), F.col("y").alias("j"), F.col("n").alias("size"))
        chosen = block if chosen is None else chosen.unionByName(block)
        sides = F.explode(F.array(
            F.struct(F.col("a0"), F.col("x").alias("a1"), F.col("b0"), F.col("y").alias("b1")),
            F.struct((F.col("x") + F.col("n")).alias("a0"), F.col("a1"), (F.col("y") + F.col("n")).alias("b0"), F.col("b1")),
        ))
        rects = checkpointed(cut.select("track", sides.alias("r")).select("track", "r.*").filter("a0 < a1"))
        inner = matches.join(cut.select("track", "a0", "x", "y", "n"), ["track", "a0"])
        skip = F.greatest(F.lit(0).cast("long"), F.col("x") + F.col("n") - F.col("i"), F.col("y") + F.col("n") - F.col("j"))
        left = F.struct(F.col("a0"), F.col("i"), F.col("j"), F.least(F.col("size"), F.col("x") - F.col("i"), F.col("y") - F.col("j")).alias("size"))
        right = F.struct((F.col("x") + F.col("n")).alias("a0"), (F.col("i") + skip).alias("i"), (F.col("j") + skip).alias("j"), (F.col("size") - skip).alias("size"))
        matches = checkpointed(inner.select("track", F.explode(F.array(left, right)).alias("m")).select("track", "m.*").filter(F.col("size") >= seed))


def _buckets(df: DataFrame, low: Column, high: Column) -> DataFrame:
    """A row for each bucket that a half-open range touches."""
    return df.withColumn("bucket", F.explode(F.sequence(F.floor(low / BLOCK).cast("long"), F.floor((high - 1) / BLOCK).cast("long"))))


def _part(rows: pd.DataFrame) -> pd.DataFrame:
    """Places in the script of the places asked for in one rectangle."""
    head = rows.iloc[0]
    a0, a1, b0, b1, whole = (int(head[c]) for c in ("a0", "a1", "b0", "b1", "whole"))
    text = lambda kind: "".join(rows[rows["kind"] == kind].sort_values("pos")["text"])
    found = [(i + a0, j + b0, n) for i, j, n in matching_blocks(text("a"), text("s"))] if b1 > b0 else []
    asked, begin = rows[rows["kind"] == "q"], np.array([m[0] for m in found])
    at = [between(int(p), found, begin, (a0, b0), (a1, b1), bool(a0), bool(whole and not found)) for p in asked["pos"]]
    return pd.DataFrame({"track": asked["track"], "seq": asked["seq"], "side": asked["side"], "x": at})


def between(p: int, found: list[tuple[int, int, int]], begin: np.ndarray, start: tuple[int, int], stop: tuple[int, int], led: bool, nothing: bool) -> float:
    """Place in the script of place p: one to one inside a match, on a line between matches.

    The matches begin at ``begin`` and lie between start and stop; ``led`` says that a match ends at start, ``nothing`` that the
    track has no match at all.
    """
    k = int(np.searchsorted(begin, p, "right")) - 1
    if nothing:
        return 0.0
    if k >= 0 and p < found[k][0] + found[k][2]:
        return float(found[k][1] + (p - found[k][0]))
    x1, y1 = found[k + 1][:2] if k + 1 < len(found) else stop
    if k < 0 and not led:
        return y1 * (p / x1) if x1 else 0.0
    x0, y0 = (found[k][0] + found[k][2], found[k][1] + found[k][2]) if k >= 0 else start
    return y0 + (p - x0) * (y1 - y0) / (x1 - x0) if x1 > x0 else 0.0


def _long_spans(a: DataFrame, s: DataFrame, ends: DataFrame, limit: int, seed: int) -> DataFrame:
    """Rows (track, seq, norm, lo, hi, sb) of long tracks; ends(track, a1, b1) names them and their lengths."""
    kinds = dict(a.dtypes)
    a, s = checkpointed(_placed(a.join(ends.select("track"), "track"), "seq")), checkpointed(_placed(s.join(ends.select("track"), "track"), "line_no"))
    zero = F.lit(0).cast("long")
    rects = ends.select("track", zero.alias("a0"), "a1", zero.alias("b0"), "b1")
    parts, chosen = _split(_matches(a, s, seed), rects, limit, seed)
    parts = parts.join(ends.select("track", F.col("a1").alias("all")), "track").select("track", "a0", "a1", "b0", "b1", ((F.col("a0") == 0) & (F.col("a1") == F.col("all"))).cast("int").alias("whole"))
    spoken = a.filter("size > 0")
    asked = spoken.select("track", "seq", F.posexplode(F.array("at", F.col("at") + F.col("size") - 1)).alias("side", "pos")).withColumn("bucket", F.floor(F.col("pos") / BLOCK))

    def pieces(lines: DataFrame, kind: str, low: str, high: str) -> DataFrame:
        """The text of each rectangle's side, block by block."""
        cut = _buckets(parts.filter(F.col(low) < F.col(high)), F.col(low), F.col(high)).join(_blocks(lines, 0).withColumnRenamed("block", "bucket"), ["track", "bucket"])
        first = F.greatest(F.col(low), F.col("bucket") * BLOCK)
        text = F.substring("text", (first - F.col("bucket") * BLOCK + 1).cast("int"), (F.least(F.col(high), (F.col("bucket") + 1) * BLOCK) - first).cast("int"))
        return cut.select(*parts.columns, F.lit(kind).alias("kind"), first.alias("pos"), text.alias("text"), F.lit(None).cast(kinds["seq"]).alias("seq"), F.lit(None).cast("int").alias("side"))

    inside = _buckets(parts, F.col("a0"), F.col("a1")).join(asked, ["track", "bucket"]).filter("pos >= a0 and pos < a1")
    questions = inside.select(*parts.columns, F.lit("q").alias("kind"), "pos", F.lit("").alias("text"), "seq", "side")
    rows = pieces(a, "a", "a0", "a1").unionByName(pieces(s, "s", "b0", "b1")).unionByName(questions)
    found = rows.groupBy("track", "a0").applyInPandas(_part, f"track {kinds['track']}, seq {kinds['seq']}, side int, x double")
    if chosen is not None:
        end = F.col("i") + F.col("size")
        held = _buckets(chosen, F.col("i"), end).join(asked, ["track", "bucket"]).filter((F.col("pos") >= F.col("i")) & (F.col("pos") < end))
        found = found.unionByName(held.select("track", "seq", "side", (F.col("j") + F.col("pos") - F.col("i")).cast("double").alias("x")))

    # From places to lines: a first place that is no letter moves on to the next line with letters, a last one back.
    letters, end = _neighbours(s), F.col("at") + F.col("size")
    lines = letters.select("track", "line_no", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.coalesce("before", F.lit(1)).alias("low"), end.alias("high")),
        F.struct(F.lit(1).alias("side"), F.col("at").alias("low"), F.coalesce("after", F.lit(2**62)).alias("high")),
    )).alias("r")).select("track", "line_no", "r.*")
    lines = lines.join(ends.select("track", "b1"), "track").withColumn("high", F.least("high", F.col("b1") - 1 + (F.col("side") == 0).cast("int")))
    # Places 0 and the last one stay where they are, and count only if a letter stands there.
    still = letters.select("track", "line_no", F.col("at").alias("low"), end.alias("high"))
    found = found.join(ends.select("track", "b1"), "track").withColumn("p", F.greatest(F.lit(0), F.least(F.col("b1") - 1, F.col("x").cast("long")))).withColumn("bucket", F.floor(F.col("p") / BLOCK))
    fixed = (F.col("p") == 0) | (F.col("p") == F.col("b1") - 1)
    one = _buckets(still, F.col("low"), F.col("high")).join(found.filter(fixed), ["track", "bucket"]).filter("p >= low and p < high").select("track", "seq", "side", "line_no")
    two = _buckets(lines.filter("low < high"), F.col("low"), F.col("high")).join(found.filter(~fixed), ["track", "bucket", "side"]).filter("p >= low and p < high").select("track", "seq", "side", "line_no")
    at = one.unionByName(two).groupBy("track", "seq").agg(F.min(F.when(F.col("side") == 0, F.col("line_no"))).alias("lo"), F.max(F.when(F.col("side") == 1, F.col("line_no"))).alias("hi"))
    last = s.groupBy("track").agg(F.max("line_no").alias("last"))
    at = spoken.select("track", "seq", "norm").join(at, ["track", "seq"], "left").join(last, "track")
    at = at.select("track", "seq", "norm", F.coalesce("lo", F.lit(0)).cast("int").alias("lo"), F.coalesce("hi", "last").cast("int").alias("hi")).filter("lo <= hi")
    shown = at.select("track", "seq", F.explode(F.sequence("lo", F.least(F.col("hi"), F.col("lo") + 5))).alias("line_no")).join(s.select("track", "line_no", "text"), ["track", "line_no"])
    said = shown.groupBy("track", "seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "｜").alias("sb"))
    return at.join(said, ["track", "seq"]).select("track", "seq", "norm", "lo", "hi", "sb")


def align_script(spoken: DataFrame, script: DataFrame, reading=None, limit: int = 1 << 19, seed: int = 32) -> DataFrame:
    """Rows (track, seq, sb, conf, lo, hi).

    spoken(track, seq, text), script(track, line_no, text), each line_no dense from 0.  ``sb`` joins at
    most six script lines, ``conf`` is their Dice similarity to the spoken line (Q20).  Tracks are
    independent; one whose sides have up to ``limit`` letters is matched by one task, a longer one by many
    (see the head of this module).  Seeds are told apart by 64 bits.
    """
    a = spoken.select("track", "seq", align_normal("text", reading).alias("norm"))
    s = script.select("track", "line_no", "text", align_normal("text", reading).alias("norm"))
    kinds = dict(a.dtypes)
    schema = f"track {kinds['track']}, seq {kinds['seq']}, norm string, lo int, hi int, sb string"

    def long_tracks(spoken: DataFrame, script: DataFrame, text: str) -> DataFrame:
        length = (F.sum(F.coalesce(F.length(text), F.lit(0)) + 1) - 1).cast("long")
        ends = spoken.groupBy("track").agg(length.alias("a1")).join(script.groupBy("track").agg(length.alias("b1")), "track").filter("a1 > 0 and b1 > 0")
        return ends.filter((F.col("a1") > limit) | (F.col("b1") > limit))  # a row for each long track

    # Normal forms are no longer than the texts (readings may be), which tells without making them.
    if reading is None and long_tracks(spoken, script, "text").isEmpty():
        ends = None
    else:
        ends = checkpointed(long_tracks(a, s, "norm"))
    if ends is None or ends.isEmpty():
        got = a.groupBy("track").cogroup(s.groupBy("track")).applyInArrow(_align, schema)
    else:
        short = [df.join(ends.select("track"), "track", "left_anti") for df in (a, s)]
        got = short[0].groupBy("track").cogroup(short[1].groupBy("track")).applyInArrow(_align, schema).unionByName(_long_spans(a, s, ends, limit, seed))
    scored = got.select("track", "seq", "sb", "norm", align_normal("sb", reading).alias("other"), "lo", "hi")
    scored = scored.mapInArrow(_likeness, f"track {kinds['track']}, seq {kinds['seq']}, sb string, conf double, lo int, hi int")
    return scored.withColumn("conf", F.bround("conf", 3))
