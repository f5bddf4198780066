"""Steps that once cost far more than their tables are large, by query."""

import difflib
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from lineweave.functions import text
from lineweave.operators import align, matching, scripts, windows

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def by_difflib(a, b):
    return [tuple(m) for m in difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_matching_blocks() if m.size]


def test_alignment_takes_common_strings_once(monkeypatch):
    """ranks of strings are compared only for texts that repeat themselves; blocks are difflib's either way."""
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 9))) for _ in range(200)]
    b = [r.choice(words) for _ in range(500)]
    a = ["xx" if i % 5 == 2 else w for i, w in enumerate(b)]
    a, b = "".join(a[300:] + a[:250]), "".join(b)
    ranked = ("ab" * 200 + "c" + "ba" * 150, "ba" * 180 + "d" + "ab" * 190)
    assert align._common(*ranked, 16) is None and align.matching_blocks(*ranked) == by_difflib(*ranked)

    def never(*_):
        raise AssertionError("prose was split by sorts of whole ranges")

    monkeypatch.setattr(align.np, "isin", never)
    assert align.matching_blocks(a, b) == by_difflib(a, b)


def test_turns_are_spread_before_they_are_changed(spark):
    """turns are dealt over all tasks, and likeness is no fold of columns."""
    from lineweave.queries import align_spans

    plan = plan_of(align_spans(spark, SF))
    assert "RepartitionByExpression" in plan and "array_intersect" not in plan


def test_form_of_a_line_is_made_once(spark):
    """a line is cut and lower-cased once, not again for each phrase; reasons are those of a plain walk."""
    lines = ["12: Thank You all", "hello", " GoodBye. ", "", "aaaaaa", "ab", "12 - 34", "plain words", "かな です", "ようこそ", "123: ", "Bye", None]
    rows = spark.createDataFrame([(i, x, p) for i, x in enumerate(lines) for p in (0.05, 0.5, 0.95)], "i int, text string, position double")
    got = rows.withColumn("reason", text.drop_reason("text", F.col("position")))
    assert plan_of(got).count("regexp_replace(") <= 3
    seen = {(r.text, r.position): r.reason for r in got.collect()}
    assert [seen["12: Thank You all", p] for p in (0.05, 0.5, 0.95)] == ["mid_file_ending:thank you", "mid_file_ending:thank you", "no_script"]
    assert [seen["hello", p] for p in (0.05, 0.5, 0.95)] == ["short_ending_pattern", "late_file_opening:hello", "late_file_opening:hello"]
    assert [seen["ようこそ", p] for p in (0.05, 0.5)] == [None, "late_file_opening:ようこそ"] and seen[" GoodBye. ", 0.5] == "mid_file_ending:goodbye"
    assert [seen[x, 0.95] for x in ("", "aaaaaa", "ab", "12 - 34", "plain words", "かな です", "123: ", None)] == [None, "repetition", "short", "symbols", "no_script", None, None, None]


def test_best_lines_leave_a_task(spark):
    """whole documents are dealt out, both groupings share a shuffle, scores are Dice whichever way bigrams are counted."""
    from lineweave.queries import anchor_match

    plan = plan_of(anchor_match(spark, SF))
    assert "RepartitionByExpression [doc_id" in plan and "RepartitionByExpression [track" in plan
    r = random.Random(2)
    grams = lambda x: {x[i : i + 2] for i in range(len(x) - 1)}
    for letters, n in (("abc é😀", 30), ([chr(0x4E00 + i) for i in range(900)], 8)):
        line = lambda k: "".join(r.choice(letters) for _ in range(k))  # noqa: E731, B023
        samples = [line(r.randint(2, 40)) for _ in range(n)]
        index = matching._Samples([Row(grams=sorted(grams(x))) for x in samples])
        lines = [line(r.randint(2, 40)) for _ in range(40)] + samples
        want = [[2.0 * len(grams(a) & grams(b)) / (len(grams(a)) + len(grams(b))) for b in samples] for a in lines]
        assert index.scores(lines).tolist() == want


def test_words_are_counted_by_hash(spark, monkeypatch):
    """no task sorts the words of its lines to count them; ranks are those of a plain walk, null parts first."""
    r, plans = random.Random(5), []
    rows = [(r.choice(["a", "b", None]), r.choice([None, *range(12)]), k, " ".join(r.choice("abcdefghijkl") * 2 for _ in range(r.randint(0, 5)))) for k in range(150)]
    lines = spark.createDataFrame(rows, "lang string, doc int, k int, text string").select("lang", F.struct("doc", "k").alias("seq"), "text")
    keep = windows.checkpointed
    monkeypatch.setattr(windows, "checkpointed", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(df))[1])
    got = {(x.lang, x.word, x.n, x["rank"]) for x in windows.frequent_words(lines, "lang", 5).collect()}
    seen = {}
    for lang, doc, k, x in rows:
        for at, word in enumerate(x.split()):
            n, first = seen.get((lang, word), (0, None))
            here = (doc is not None, doc or 0, k, at)
            seen[lang, word] = n + 1, min(first or here, here)
    want = set()
    for lang in ("a", "b", None):
        best = sorted((-n, first, word) for (of, word), (n, first) in seen.items() if of == lang and n >= 2)
        want |= {(lang, word, -n, i + 1) for i, (n, _, word) in enumerate(best[:5])}
    assert got == want and len(got) == 15
    assert len(plans) == 1 and "HashAggregate" in plans[0] and "SortAggregate" not in plans[0]


def test_marks_are_looked_for_once(spark):
    """a script is read by the pattern of marks once for places and once for parts; sections leave it, not copies of it."""
    s = spark.createDataFrame([("w", "intro\nトラック2\nb\n※ no\nTrack 1\na\n【x】\nトラック３"), ("v", "one\n※ no\n\n two "), ("u", ""), ("n", None)], "work string, content string")
    t = spark.createDataFrame([(w, f"tr0{i}", i) for w in ("w", "v", "u", "n", "none") for i in (1, 2, 3)], "work string, track string, seq int")
    got = scripts.split_by_marks(s, t)
    plan = plan_of(got)
    assert plan.count("regexp_extract_all(") == 1 and plan.count("explode") == 1
    lines = {(r.work, r.track): r.lines for r in got.collect()}
    want = {("w", "tr02"): ["トラック2", "b", "Track 1", "a"], ("w", "tr03"): ["トラック３"], ("v", "tr01"): ["one", "two"]}
    assert len(lines) == 15 and {k: v for k, v in lines.items() if v} == want
