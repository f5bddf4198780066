"""Greedy and as-of matching against plain walks."""

import random

from pyspark.sql import functions as F

from lineweave.operators import matching

WORDS = "array<struct<start:bigint,end:bigint,word:string>>"


def walked(pairs):
    used, out, done = set(), set(), set()
    for file, seq, _, seg in sorted(pairs):
        if (file, seq) not in done and (file, seg) not in used:
            used.add((file, seg))
            done.add((file, seq))
            out.add((file, seq, seg))
    return out


def test_first_free(spark):
    r = random.Random(4)
    pairs = {(f"f{i % 7}", i // 7, r.randint(0, 2), r.randint(0, 60)) for i in range(500) for _ in range(r.randint(0, 4))}
    pairs |= {("chain", i, k, i + k) for i in range(12) for k in (0, 1)} | {("late", i, 0, 0) for i in range(9)} | {("late", 8, 1, 5)}
    pairs = list({(f, q, s): (f, q, k, s) for f, q, k, s in sorted(pairs)}.values())
    got = matching.first_free(spark.createDataFrame(pairs, "file string, seq int, rank int, seg int"))
    assert sorted(map(tuple, got.collect())) == sorted(walked(pairs))
    assert matching.first_free(spark.createDataFrame([], "file string, seq int, rank int, seg int")).count() == 0


def test_segments_each_once(spark):
    r = random.Random(6)
    cues = [(f"f{i % 5}", i // 5, 1000 * (i // 50) + r.randint(0, 200), r.choice(["a b", "ab", "", "c"])) for i in range(400)]
    segs = [(f"f{i % 5}", i // 5, 1000 * (i // 50) + r.randint(-5, 200), r.choice(["ab", "a  b", "c", ""])) for i in range(400)]
    pairs, near = [], matching.NEAR_MS
    for f, q, t, x in cues:
        for g, s, at, y in segs:
            if f == g and at >= 0 and x.replace(" ", "") == y.replace(" ", "") and abs(at - t) <= near:
                pairs.append((f, q, at // near - t // near, s))
    got = matching.match_segments(spark.createDataFrame(cues, "file string, seq int, time_ms bigint, text string"), spark.createDataFrame(segs, "file string, seg int, start bigint, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(walked(pairs))


def run_of(words, at, text):
    """The first words that start near a time and spell a text."""
    for a in range(len(words)):
        for b in range(a, len(words)):
            if abs(words[a][0] - at) <= 80 and text and "".join("".join((w[2] or "").split()) for w in words[a : b + 1]) == text:
                return words[a : b + 1]
    return None


def test_cues_inside_segments(spark):
    r, segs, cues = random.Random(2), [], []
    for s in range(120):
        at, words = r.randint(0, 200_000), []
        for _ in range(r.randint(0, 9)):
            n = r.randint(20, 200)
            words.append((at, at + n, r.choice(["a", "b", "ab", " b ", "", None, "é"])))
            at += n
        segs.append((f"f{s % 3}", s, words[0][0] if words else at, at, words))
        for i in range(3):
            if words:
                a, b = sorted((r.randrange(len(words)), r.randrange(len(words))))
                cues.append((f"f{s % 3}", s * 3 + i, words[a][0] + r.choice([0, 0, 70, -80, 90]), " ".join(w or "" for _, _, w in words[a : b + 1])))
    want = {}
    for f, q, t, x in cues:
        inside = [(s[2], s[1], run_of(s[4], t, "".join(x.split()))) for s in segs if s[0] == f and t - 60_000 <= s[2] <= t and s[3] >= t - 80]
        found = max(((at, seg, run) for at, seg, run in inside if run), default=None, key=lambda m: m[:2])
        if found:
            want[f, q] = (found[1], found[2])
    got = matching.as_of_segments(spark.createDataFrame(cues, "file string, seq int, time_ms bigint, text string"), spark.createDataFrame(segs, f"file string, seg int, start bigint, end bigint, words {WORDS}"))
    assert {(r.file, r.seq): (r.seg, [tuple(w) for w in r.words]) for r in got.collect()} == want and len(want) > 100


def test_no_python_in_plans(spark):
    cues = spark.createDataFrame([("f", 0, 0, "a")], "file string, seq int, time_ms bigint, text string")
    segs = spark.createDataFrame([("f", 0, 0, 9, [(0, 9, "a")])], f"file string, seg int, start bigint, end bigint, words {WORDS}")
    for df in (matching.as_of_segments(cues, segs), matching.match_segments(cues, segs.withColumn("text", F.lit("a")))):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString() and "Pandas" not in df._jdf.queryExecution().toString()


def test_anchors(spark):
    """Dice of every pair, sample groups of any size, numbers of lines inside each script."""
    r = random.Random(1)
    line = lambda n: "".join(r.choice("abcdefé😀 ") for _ in range(n))
    texts = [line(r.randint(0, 40)) for _ in range(60)]
    samples = [(t, i, r.choice(texts) if r.random() < 0.7 else line(20)) for t in range(9) for i in range(7)]
    script = [(d, i, x if r.random() < 0.5 else x[: len(x) // 2] + line(6)) for d in range(3) for i, x in enumerate(r.sample(texts, 40))]
    grams = lambda x: {x[i : i + 2] for i in range(len(x) - 1)}
    want = {}
    for t in range(9):
        mine = [x.strip() for k, _, x in samples if k == t and len(x.strip()) > 8][:5]
        for d in range(3):
            places = []
            for a in map(grams, mine):
                scores = [(2.0 * len(a & grams(x.strip())) / (len(a) + len(grams(x.strip()))), -i) for k, i, x in script if k == d and len(x.strip()) > 1]
                if max(scores)[0] >= 0.5:
                    places.append(-max(scores)[1])
            if places:
                places.sort()
                want[t, d] = int((places[(len(places) - 1) // 2] + places[len(places) // 2]) / 2)
    a, s = spark.createDataFrame(samples, "track int, seq int, text string"), spark.createDataFrame(script, "script int, line_no int, text string")
    for group in (2048, 4):
        assert {(x.track, x.script): x.anchor for x in matching.anchors(a, s, by=("script",), group=group).collect()} == want
    assert matching.anchors(a.limit(0), s, by=("script",)).count() == 0 and len(want) > 20
