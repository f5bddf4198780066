import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from fixtures import SF, frame, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from lineweave.llm import suffixes
from lineweave.llm.shared import Scratch
from lineweave.llm.suffixes import contexts, longest_previous, remove_repeats, strip_repeats, suffix_array


def brute(data, length):
    """data: rows with doc_id and text first."""
    where = Counter()
    raws = [(r[1] or "").encode() for r in data]
    for raw in raws:
        where.update(raw[i : i + length] for i in range(len(raw) - length + 1))
    for r, raw in zip(data, raws, strict=True):
        hit = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if where[raw[i : i + length]] > 1:
                hit[i : i + length] = True
        rest = bytes(b for b, h in zip(raw, hit, strict=False) if not h)
        spans = int((np.diff(np.concatenate([[0], hit.astype(int)])) > 0).sum())
        yield r[0], len(raw), len(raw) - len(rest), spans, hashlib.sha256(rest).hexdigest()


def run(spark, docs, length, keep_first=False):
    return [tuple(r)[:5] for r in remove_repeats(docs, Scratch(spark, "t"), length, keep_first).collect()]


@pytest.mark.parametrize("length", [70, 200])
def test_against_brute_force(spark, length):
    assert Counter(run(spark, frame(spark), length)) == Counter(brute(rows(), length))


@pytest.mark.parametrize("hot", [50_000, 2])
def test_edges_periods_and_many_contexts(spark, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "BUCKET", 20)
    r = random.Random(1)
    s = lambda n, of="abcdefghij é": "".join(r.choice(of) for _ in range(n))
    common = s(300)
    data = [(i, s(r.randint(0, 150)) + common[r.randint(0, 120) : r.randint(180, 300)] + s(r.randint(0, 150))) for i in range(60)]
    data += [(100, "ab" * 400), (101, "x" * 500), (102, "ab" * 90), (103, s(199)), (107, common[:77] * 4), (104, s(5000)), (105, None), (106, "")]
    data += [(200 + i, data[65][1][:2000] + s(40) + data[65][1][2010:]) for i in range(3)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert Counter(run(spark, docs, 100)) == Counter(brute(data, 100))


def test_keep_first(spark):
    r = random.Random(2)
    s = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    p, q = s(400), s(260)
    texts = [s(100) + p + s(50), q + s(30), s(20) + p[50:350] + s(90) + q, p + p, s(300), "z" * 700]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in remove_repeats(docs, Scratch(spark, "t"), 200, True, with_text=True).collect()}
    seen = set()
    for i, text in enumerate(texts):
        hit = [False] * len(text)
        for a in range(len(text) - 199):
            window = text[a : a + 200]
            if window in seen:
                hit[a : a + 200] = [True] * 200
            seen.add(window)
        assert got[i].text == "".join(c for c, h in zip(text, hit, strict=True) if not h), i


def test_keep_first_of_repeated_rows(spark):
    r = random.Random(3)
    s = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    p = s(400)
    a, b, c = s(150) + p + s(150), s(170) + p + s(100), s(90) + p[20:380] + s(250)
    for key in (None, 1):
        docs = spark.createDataFrame([(key, a), (key, a), (key, a), (5, b), (6, c)], "doc_id long, text string")
        got = sorted((x.doc_id or 0, x.text) for x in strip_repeats(docs, Scratch(spark, "t"), 200).collect())
        assert [x for _, x in got] == [a, a, a, b.replace(p, ""), c.replace(p[20:380], "")], key


def test_cut_characters_are_dropped_whole(spark):
    p = "é" * 5 + "".join(chr(97 + i * i % 23) for i in range(210))
    docs = spark.createDataFrame([(1, "é" + p + "1"), (2, "ĩ" + p + "2")], "doc_id long, text string")
    got = remove_repeats(docs, Scratch(spark, "t"), 200, False, with_text=True).collect()
    assert sorted(r.text for r in got) == ["1", "2"]


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert Counter(run(spark, docs, 200)) == Counter(brute([tuple(r) for r in docs.collect()], 200))


def test_empty(spark):
    assert run(spark, frame(spark, []), 200) == []


def plain_common(x, y):
    return next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))


@given(st.lists(st.binary(max_size=3).map(lambda b: bytes(c % 3 for c in b) * 7), min_size=1, max_size=8), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_arrays(texts, least):
    """Suffix order, common prefixes and longest previous factors of a few texts, all by comparison."""
    data = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts])
    at = np.array([e - len(t) + i for t, e in zip(texts, ends, strict=True) for i in range(len(t) - least + 1)], np.int64)
    size = ends[np.searchsorted(ends, at, "right")] - at if len(at) else at
    order, lcp = suffix_array(np.frombuffer(data, np.uint8), at, size)
    own = [data[a : a + n] for a, n in zip(at.tolist(), size.tolist(), strict=True)]
    assert [own[i] for i in order] == sorted(own) and sorted(order) == list(range(len(at)))
    assert lcp.tolist() == [0 if not i else plain_common(own[order[i - 1]], own[order[i]]) for i in range(len(order))]
    factor = dict(zip(order.tolist(), longest_previous(at[order], lcp).tolist(), strict=True))
    assert factor == {i: max((plain_common(own[j], own[i]) for j in range(len(own)) if at[j] < at[i]), default=0) for i in range(len(own))}


@pytest.mark.parametrize("keep_first", [False, True])
def test_hashes_that_collide(keep_first):
    """Contexts taken for equal by their hashes are told apart by the bytes of the first and the last one."""
    r = random.Random(9)
    s = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    bucket = pa.table({"m": [1, 1], "ch": [1, 1], "rep": pa.array([0, 1], pa.int32()), "did": [1, 2], "th": [0, 0], "at": pa.array([0, 0], pa.int32()), "n": pa.array([11, 11], pa.int32()), "bytes": [s(110).encode(), s(110).encode()]})
    got = suffixes._repeats(100, keep_first)(bucket).to_pylist()
    assert [(x["firsts"], x["laters"]) for x in got] == [([], [])]


def test_equal_windows_share_a_minimiser():
    r = np.random.default_rng(0)
    piece = r.integers(97, 103, 260).astype(np.uint8)
    data = np.concatenate([r.integers(97, 103, 77), piece, r.integers(97, 103, 50), piece[3:250]]).astype(np.uint8)
    row, at, n, m, _, _ = contexts(data, np.array([0, 387 - 3, len(data)]), 200)
    keys = {}
    for d, a, k, v in zip(row, at + np.array([0, 384])[row], n, m, strict=True):
        for p in range(a, a + k):
            keys.setdefault(data[p : p + 200].tobytes(), set()).add(int(v))
    assert all(len(v) == 1 for v in keys.values())


class Counting(Scratch):
    """Keeps the number of rows of each table."""

    def save(self, df, name):
        out = super().save(df, name)
        self.__dict__.setdefault("rows", {})[name] = out.count()
        groups = self.__dict__.setdefault("groups", [])
        if name in ("contexts", "cut"):
            key = ["m"] if name == "contexts" else ["m", "ch"]
            cold = out.filter("not hot")
            buckets = max(1, -(-cold.count() // suffixes.BUCKET))
            groups += [r["count"] for r in cold.groupBy(F.pmod(F.xxhash64(*key), F.lit(buckets))).count().collect()]
        return out


@pytest.mark.parametrize("keep_first", [False, True])
def test_windows_of_a_hot_minimiser_travel_once(spark, keep_first, monkeypatch):
    """A common passage in 120 texts: a row for each window, and suffix arrays no larger than the bound."""
    monkeypatch.setattr(suffixes, "HOT", 10)
    monkeypatch.setattr(suffixes, "BUCKET", 40)
    r = random.Random(4)
    s = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    common, again = s(90), s(150)
    data = [(i, s(120) + common + s(120)) for i in range(120)] + [(200 + i, s(40) + common + again + s(30)) for i in range(40)]
    docs, scratch = spark.createDataFrame(data, "doc_id long, text string"), Counting(spark, "t")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs, scratch, 100, keep_first).collect()}
    assert 1000 < scratch.rows["windows"] <= sum(len(t) - 99 for _, t in data)
    # Contexts are dealt out by minimiser, a hot one's windows by their own hash.
    assert scratch.groups and max(scratch.groups) <= 40 + 4 * 10
    seen, want = Counter(), {}
    for _, t in data:
        seen.update(t[i : i + 100] for i in range(len(t) - 99) if not keep_first)
    for i, t in data:
        hit = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 99):
            hit[k : k + 100] |= seen[t[k : k + 100]] > (not keep_first)
            seen[t[k : k + 100]] += keep_first
        rest = "".join(c for c, h in zip(t, hit, strict=False) if not h)
        want[i] = len(t), len(t) - len(rest), int((np.diff(np.concatenate([[0], hit.astype(int)])) > 0).sum()), hashlib.sha256(rest.encode()).hexdigest()
    assert got == want
