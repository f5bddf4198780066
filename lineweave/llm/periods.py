"""Periodic runs of words: stretches that repeat one phrase four times and more.

Re-Pair turns the word ids of a text into a grammar: the most frequent pair of neighbours becomes a
nonterminal, again and again.  A run lies in the derivation of some lowest nonterminal, whose boundary
it crosses, so every nonterminal is searched once for runs across its boundary; they are translated to
all positions where it is derived, and overlapping ones of one period are merged to maximal runs.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import SPACE, mix, pieces, span_hashes, spans_where, text_bytes, window_hashes

#: A run has this many words, and this many periods, at least.
WORDS, TIMES = 6, 4

#: A three-word window of a run occurs this often in it, at least; six words hold four such windows.
WINDOW, OFTEN = 3, 3

OUT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])


# --- grammar -----------------------------------------------------------------------------------------


class Grammar:
    """A binary grammar of one sequence: symbols below ``base`` are ids, others have ``rules``.

    ``size`` and ``first`` hold the length of every symbol's derivation and one position of it.
    """

    def __init__(self, ids: list[int]):
        self.base = max(ids) + 1
        self.rules: list[tuple[int, int]] = []
        self.size, self.first = [1] * self.base, [0] * self.base
        for i in range(len(ids) - 1, -1, -1):
            self.first[ids[i]] = i
        row = self._re_pair(list(ids))
        while len(row) > 1:  # what no longer repeats becomes one tree of neighbours
            at, made = 0, []
            for left, right in zip(row[::2], row[1::2], strict=False):
                made.append(self._rule(left, right, at))
                at += self.size[made[-1]]
            row = made + row[len(made) * 2 :]
        self.root = row[0]

    def _rule(self, left: int, right: int, at: int) -> int:
        self.rules.append((left, right))
        self.size.append(self.size[left] + self.size[right])
        self.first.append(at)
        return len(self.size) - 1

    def _re_pair(self, sym: list[int]) -> list[int]:
        """Replace the pair that occurs most often until none occurs twice.

        Places of a pair are all noted in one ascending pass, when its newer symbol is made, and checked
        when the pair's turn comes; a pair that has lost places waits for its new turn.
        """
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i in range(n - 1):
            places[sym[i], sym[i + 1]].append(i)
        turns = [(-len(at), pair) for pair, at in places.items() if len(at) > 1]
        heapq.heapify(turns)
        while turns:
            count, pair = heapq.heappop(turns)
            left, right = pair
            at, free = [], -1
            for i in places.pop(pair):
                j = after[i]
                if sym[i] == left and j < n and sym[j] == right and i >= free:
                    at.append(i)
                    free = j + 1 if left == right else -1
            if len(at) < 2:
                continue
            if len(at) < -count:
                places[pair] = at
                heapq.heappush(turns, (-len(at), pair))
                continue
            made = self._rule(left, right, at[0])
            for i in at:
                j = after[i]
                sym[i], sym[j], after[i] = made, -1, after[j]
                if after[j] < n:
                    before[after[j]] = i
            fresh = set()
            for i in sorted({x for i in at for x in (before[i], i) if x >= 0 and after[x] < n}):
                places[sym[i], sym[after[i]]].append(i)
                fresh.add((sym[i], sym[after[i]]))
            for key in fresh:
                if len(places[key]) > 1:
                    heapq.heappush(turns, (-len(places[key]), key))
        return [s for s in sym if s >= 0]


# --- runs --------------------------------------------------------------------------------------------


def _prefix_lengths(x: list[int]) -> list[int]:
    """For every position the length of the longest prefix of x that starts there."""
    n = len(x)
    z, left, right = [n] * n, 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def _to_the_right(x: list[int], b: int) -> list[tuple[int, int, int]]:
    """Stretches (period, start, end) with x[i] == x[i + period], across b, that hold b + period."""
    ahead = _prefix_lengths(x[b:])
    back = _prefix_lengths([*x[:b][::-1], -1, *x[::-1]])
    n, out = len(x), []
    for q in range(1, (n - b) // 2 + 1):
        start, end = b - back[b + 1 + n - b - q], b + q + ahead[q]
        if start < b and end - start >= max(WORDS, TIMES * q):
            out.append((q, start, end))
    return out


def runs_across(x: list[int], b: int) -> list[tuple[int, int, int]]:
    """Runs (period, start, end) of x that hold x[b - 1] and x[b], each with its smallest period.

    A run of four periods holds two of them on one side of b at least.
    """
    n = len(x)
    mirrored = [(q, n - end, n - start) for q, start, end in _to_the_right(x[::-1], n - b)]
    out: list[tuple[int, int, int]] = []
    for q, start, end in sorted({*_to_the_right(x, b), *mirrored}):
        if not any(s <= start and end <= e for _, s, e in out):  # else a multiple of a smaller period
            out.append((q, start, end))
    return out


def grammar_runs(ids: list[int]) -> list[tuple[int, int, int]]:
    """Maximal runs (period, start, end) of a sequence, by its grammar."""
    if len(ids) < WORDS:
        return []
    g, seq = Grammar(ids), np.array(ids, np.int64)
    pair = seq[:-1] * g.base + seq[1:]
    own: dict[int, list[tuple[int, int, int]]] = {}
    for k, (left, _) in enumerate(g.rules):
        x = g.base + k
        at, size, b = g.first[x], g.size[x], g.size[left]
        # The pair of words at the boundary occurs again in each of a run's periods.
        if size >= WORDS and np.count_nonzero(pair[at : at + size - 1] == pair[at + b - 1]) >= TIMES - 1:
            found = runs_across(ids[at : at + size], b)
            if found:
                own[x] = found
    if not own:
        return []
    needed = set(own)
    for k, (left, right) in enumerate(g.rules):
        if left in needed or right in needed:
            needed.add(g.base + k)
    at: dict[int, list[int]] = defaultdict(list, {g.root: [0]})
    out = set()
    for k in range(len(g.rules) - 1, -1, -1):
        x, (left, right) = g.base + k, g.rules[k]
        if x not in needed:
            continue
        here = at.pop(x, [])
        out.update((q, p + start, p + end) for p in here for q, start, end in own.get(x, ()))
        if left in needed:
            at[left] += here
        if right in needed:
            at[right] += [p + g.size[left] for p in here]
    merged: list[tuple[int, int, int]] = []
    for q, start, end in sorted(out):
        if merged and merged[-1][0] == q and start + q <= merged[-1][2]:
            merged[-1] = (q, merged[-1][1], max(end, merged[-1][2]))
        else:
            merged.append((q, start, end))
    return merged


def _stretches(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in words, of the stretches in which runs can lie.

    Every window of three words in a run occurs three times in its text, so words outside such windows
    stand in no run and need no grammar.  Equal words have equal hashes: no stretch is missed.
    """
    n = len(h) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = doc[:n] == doc[WINDOW - 1 :]
    key = window_hashes(h, WINDOW) ^ mix(doc[:n].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    fresh = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    often = np.empty(n, bool)
    often[order] = np.repeat(np.diff(np.append(fresh, n)) >= OFTEN, np.diff(np.append(fresh, n)))
    edges = np.concatenate([[0], np.flatnonzero(np.diff(doc[:n])) + 1, [n]])
    start, end = spans_where(often & inside, edges)
    long = end - start + WINDOW - 1 >= WORDS
    return start[long], end[long] + WINDOW - 1


def _runs_of(words: list[bytes], stretches: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of a text, from one grammar of its stretches, with marks between."""
    number: dict[bytes | int, int] = {}
    row, where = [], []
    for a, b in stretches:
        row += [number.setdefault(w, len(number)) for w in words[a:b]]
        row.append(number.setdefault(a, len(number)))  # the mark, of which there is one only
        where += range(a, b + 1)
    return sorted((where[start], end - start, q) for q, start, end in grammar_runs(row[:-1]))


def _measured(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, off = text_bytes(batch.column("text"))
    start, end = spans_where(~SPACE[data], off)
    doc = np.searchsorted(off, start, "right") - 1
    upto = np.searchsorted(doc, np.arange(len(off)))
    first, last = _stretches(span_hashes(data, start, end), doc)
    owner = doc[first] if len(first) else first
    rows = []
    for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
        a, b = int(upto[i]), int(upto[i + 1])
        raw = data[off[i] : off[i + 1]].tobytes()
        base = int(off[i])
        words = [raw[s - base : e - base] for s, e in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)]
        lo, hi = np.searchsorted(owner, [i, i + 1])
        runs = _runs_of(words, [(int(f) - a, int(t) - a) for f, t in zip(first[lo:hi], last[lo:hi], strict=True)]) if hi > lo else []
        keep = words
        if runs:
            step = np.zeros(len(words) + 1, np.int64)
            for s, length, q in runs:
                step[s + q] += 1
                step[s + length] -= 1
            keep = [w for w, d in zip(words, np.cumsum(step).tolist(), strict=False) if not d]
        rows.append({"doc_id": doc_id, "n_words": b - a, "runs": [{"start": s, "length": n, "period": q} for s, n, q in runs], "collapsed": b" ".join(keep).decode()})
    return pa.RecordBatch.from_pylist(rows, schema=ARROW)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): its words, its periodic runs and the text without their repeats.

    Rows (doc_id, n_words, runs, collapsed); runs (start, length, period) are counted in words and
    ordered by start, then period: stretches of six words and four smallest periods at least that no
    neighbouring word extends.  ``collapsed`` leaves out the words that a run holds after its first
    period, joined by one space.

    Null and empty texts have no words, no runs and an empty ``collapsed``.  Runs of different periods
    may overlap; both are listed.  Repeated rows, null and shared doc_ids each give a row of their own.
    Other columns are ignored, an empty table gives no rows.  Texts are whole: one pass, no shuffle;
    memory is bounded by one slice of a batch, or the longest text if larger.
    """

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                yield _measured(part)

    return docs.select("doc_id", "text").mapInArrow(run, OUT)
