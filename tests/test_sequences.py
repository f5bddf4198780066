"""Segmentation, alignment and layout."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from segment_model import Cue as _Cue
from segment_model import best_cuts, cut_errors, feasible, plan, without_redundant

from lineweave.operators import align, layout, segment
from lineweave.plans.tracks import resegment
from lineweave.sources.subtitles import lrc_items

WORDS = "array<struct<start:bigint,end:bigint,word:string>>"
X19 = [(0, 1000, "aaaa。"), (1000, 2000, "bbbb"), (2400, 3000, "cccc")]


def as_cue(words):
    return _Cue([len("".join(w["word"].split())) for w in words], [w["start"] for w in words], [w["end"] for w in words])


def cue(spark, words, seq=0):
    return spark.createDataFrame([("f", seq, "".join(w for _, _, w in words), words)], f"file string, seq int, text string, words {WORDS}")


def as_dicts(words):
    return [{"start": a, "end": b, "word": w} for a, b, w in words]


def test_levels_and_plan(spark):  # X19
    legal = cue(spark, X19).select(segment.legal_cuts(F.col("words")).alias("c")).first().c
    assert [(c.k, c.level) for c in legal] == [(1, "S"), (2, "P")]
    plan = segment.plan_cuts(cue(spark, X19), 8.0, 10).first().plan
    assert plan.cuts == [1] and plan.how == "searched"
    files = spark.createDataFrame([("f", ".lrc", "[00:00.00]aaaa。bbbbcccc\n")], "file string, ext string, content string")
    seg = spark.createDataFrame([("f", 0, 0, 3000, "aaaa。bbbbcccc", X19)], f"file string, seg int, start bigint, end bigint, text string, words {WORDS}")
    out, stats = resegment(files, seg, 8.0, 10)
    assert out.first().content == "[00:00.00]aaaa。\n[00:01.00]bbbbcccc\n[00:03.00]\n"
    assert tuple(stats.first()) == ("f", 1, 1, 2)


def test_validation(spark):  # X20
    c = as_cue(as_dicts(X19))
    assert cut_errors(c, [], {1, 2}, 10) == ["empty"]
    assert cut_errors(c, [3], {1, 2}, 10) == ["out_of_range:3"]
    assert cut_errors(c, [1], {1, 2}, 10) == []
    assert cut_errors(c, [1], {2}, 10) == ["illegal:1"]
    df = cue(spark, X19).withColumn("proposed", F.array(F.lit(1), F.lit(2)))
    assert segment.plan_cuts(df, 8.0, 10).first().plan.how == "proposed"


def test_morphemes(spark):
    morph = "array<struct<surface:string,start:int,end:int,pos1:string,pos2:string,lemma:string>>"
    words = [(0, 100, "行って"), (100, 200, "から"), (600, 700, "空"), (700, 800, "を")]
    ms = [("行っ", 0, 2, "動詞", "", "行く"), ("て", 2, 3, "助詞", "接続助詞", "て"), ("から", 3, 5, "助詞", "格助詞", "から"), ("空", 5, 6, "名詞", "", "空"), ("を", 6, 7, "助詞", "格助詞", "を")]
    df = spark.createDataFrame([(words, ms)], f"words {WORDS}, morphemes {morph}")
    assert [(c.k, c.level) for c in df.select(segment.legal_cuts(F.col("words"), F.col("morphemes")).alias("c")).first().c] == [(2, "P")]
    close = [(a, 599 if b == 200 else b, w) for a, b, w in words]
    df = spark.createDataFrame([(close, ms)], f"words {WORDS}, morphemes {morph}")
    table = segment.cut_table(F.col("words"), F.col("morphemes"))
    assert [c.k for c in df.select(segment.weak_of(table).alias("c")).first().c] == [2]


MORPHEMES = "array<struct<surface:string,start:int,end:int,pos1:string,pos2:string,lemma:string>>"


def tagged(r, words):
    """Morphemes that tile the words' text, at times with a gap or across two words."""
    text, out, at = "".join(w for _, _, w in words), [], 0
    while at < len(text):
        n = r.randint(1, 3)
        if r.random() < 0.9:
            out.append((text[at : at + n], at, min(len(text), at + n), r.choice(["名詞", "助詞", "動詞", "助動詞", "接頭辞"]), r.choice(["一般", "終助詞", "助数詞", "数詞"]), r.choice(["x-y", "の", None])))
        at += n
    return out


def by_hand(words, ms):
    """Numbers of legal, weak and long-gap cuts, place by place."""
    legal, weak, gap = [], [], []
    content = {"名詞", "動詞"}
    for k in range(1, len(words)):
        offset = len("".join(w for _, _, w in words[:k]))
        left, right = next((m for m in ms if m[2] == offset), None), next((m for m in ms if m[1] == offset), None)
        stop, opens, pause = words[k - 1][2][-1:] in list("。、"), words[k][2][:1] in list("。、"), words[k][0] - words[k - 1][1]
        lemma = lambda m: (m[5] or "").split("-")[0]
        fine = bool(left and right) and right[3] in content and left[3] not in ("接頭辞", "助動詞") and left[0] != "の" and lemma(left) != "の"
        fine = fine and right[0] != "ん" and not (right[0] == left[0] and len(right[0]) >= 2) and not (left[4] in ("数詞", "助数詞") and right[4] == "助数詞")
        clause = bool(left) and left[3] == "助詞" and left[4] == "終助詞"
        if right and (not opens if stop else fine and (pause >= 300 or clause)):
            legal.append(k)
        if fine and not stop and pause < 300 and not clause:
            weak.append(k)
        if fine and pause >= 800 and not stop and not opens and offset >= 3 and len("".join(w for _, _, w in words[k:])) >= 3:
            gap.append(k)
    return legal, weak, gap


def random_words(r):
    at, words = r.randint(0, 500), []
    for _ in range(r.randint(1, 30)):
        n = r.randint(50, 3000)
        words.append((at, at + n, r.choice(["あ", "ab", "cde", "f。", "、gh", "のん", "ijklmno", "ab"])))
        at += n + r.choice([0, 0, 100, 299, 300, 400, 800, 1000])
    return words


def test_plans_against_plain_python(spark):
    """Cuts by morphemes, the search, its ladder, proposals and what is dropped again, on random cues."""
    r, rows = random.Random(11), []
    for i in range(400):
        words = random_words(r)
        ks = [r.randint(-1, len(words) + 1) for _ in range(r.randint(0, 4))]
        legal = [k for k in range(1, len(words)) if words[k - 1][2].endswith("。") or words[k][0] - words[k - 1][1] >= 300]
        wish = r.choice([None, [], ks, ks, [k for k in legal if r.random() < 0.6]])
        rows.append((str(i), i, "".join(w for _, _, w in words), words, tagged(r, words) if i % 2 else None, wish))
    cues = spark.createDataFrame(rows, f"file string, seq int, text string, words {WORDS}, morphemes {MORPHEMES}, proposed array<int>")
    kinds = set()
    for seconds, chars in ((8.0, 12), (3.0, 7), (20.0, 25), (8.0, 4)):
        for tags, wishes in ((True, True), (False, False), (True, False), (False, True)):
            some = cues.drop(*(["morphemes"] if not tags else []), *(["proposed"] if not wishes else []))
            got = {x.seq: (list(x.plan.cuts), x.plan.how, list(x.plan.errors)) for x in segment.plan_cuts(some, seconds, chars).collect()}
            assert len(got) > 100
            for seq, found in got.items():
                _, _, _, words, ms, wish = rows[seq]
                plain = [k for k in range(1, len(words)) if (words[k - 1][2][-1] in "。、" and words[k][2][0] not in "。、") or (words[k - 1][2][-1] not in "。、" and words[k][0] - words[k - 1][1] >= 300)]
                legal, weak, gap = by_hand(words, ms) if tags and ms is not None else (plain, [], [])
                want = plan(as_dicts(words), legal, weak, gap, wish if wishes else None, seconds, chars)
                assert found == (list(want[0]), want[1], list(want[2])), (seq, words, legal, weak, gap, wish)
                kinds.add(want[1])
    assert kinds == {"proposed", "searched", "rejected", "kept"}


def brute(c, cuts, max_chars):
    """All choices of cuts that satisfy the letter limits, cheapest first."""
    ks, found = sorted(cuts), []
    for bits in range(1 << len(ks)):
        some = [k for i, k in enumerate(ks) if bits >> i & 1]
        pieces = list(zip([0, *some], [*some, c.n], strict=True))
        if all(2 <= c.size(a, b) <= max_chars for a, b in pieces):
            found.append((sum(1000 * max(0.0, c.seconds(a, b) - 8.5) + 1000 for a, b in pieces), some))
    return found


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000))
def test_search_is_optimal(seed):
    r = random.Random(seed)
    at, words = 0, []
    for _ in range(r.randint(2, 9)):
        n = r.randint(100, 4000)
        words.append({"start": at, "end": at + n, "word": "x" * r.randint(1, 9)})
        at += n + r.randint(0, 900)
    c = as_cue(words)
    cuts = {k for k in range(1, c.n) if r.random() < 0.7}
    options, got = brute(c, cuts, 15), best_cuts(c, cuts, 8.0, 15)
    assert feasible(c, cuts, 15) == bool(options)
    if options and cuts:
        cost = sum(1000 * max(0.0, c.seconds(a, b) - 8.5) + 1000 for a, b in zip([0, *got], [*got, c.n], strict=True))
        assert abs(cost - min(o[0] for o in options)) < 1e-6
        lean = without_redundant(c, got, 8.0, 15)
        assert set(lean) <= set(got) and all(2 <= c.size(a, b) <= 15 for a, b in zip([0, *lean], [*lean, c.n], strict=True))
    else:
        assert got == []


def test_splits_are_lossless(spark):
    r = random.Random(1)
    lines, segs, at = [], [], 0
    for i in range(12):
        words = []
        for _ in range(r.randint(1, 25)):
            n = r.randint(100, 900)
            words.append((at, at + n, r.choice(["ab", "cde", "f。", "gh、"])))
            at += n + r.choice([0, 0, 400, 1000])
        lines.append(f"[{words[0][0] // 60000:02d}:{words[0][0] % 60000 / 1000:06.3f}]" + "".join(w for _, _, w in words))
        segs.append(("f", i, words[0][0], words[-1][1], "".join(w for _, _, w in words), words))
    files = spark.createDataFrame([("f", ".lrc", "[ti:x]\n" + "\n".join(lines) + "\n")], "file string, ext string, content string")
    out, _ = resegment(files, spark.createDataFrame(segs, f"file string, seg int, start bigint, end bigint, text string, words {WORDS}"), 8.0, 20)
    spoken = lambda f: "".join(r.text for r in lrc_items(f).filter("item_type = 'lyric'").orderBy("line_no").collect())
    assert spoken(out) == spoken(files) and lrc_items(out).filter("item_type = 'lyric'").count() > 12
    assert out.first().lossless


def test_preview(spark):
    assert cue(spark, X19).select(segment.cut_preview(F.col("words"), F.lit(1), 3)).first()[0] == "aa。|bbb"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcdé", max_size=8), max_size=6), st.lists(st.text("abcdé", max_size=8), max_size=6))
def test_spans_in_range(spoken, script):
    for lo, hi in align.spans(spoken, script).values():
        assert 0 <= lo <= hi < len(script)


def test_alignment(spark):
    spoken = spark.createDataFrame([("t", 0, "こんにちは世界"), ("t", 1, "それでは"), ("t", 2, "始めます")], "track string, seq int, text string")
    script = spark.createDataFrame([("t", 0, "コンニチハ、世界！"), ("t", 1, "それでは始めます。")], "track string, line_no int, text string")
    got = {r.seq: r for r in align.align_script(spoken, script).collect()}
    assert (got[0].lo, got[0].hi, got[0].conf) == (0, 0, 1.0) and (got[1].lo, got[2].hi) == (1, 1)


def boxes(spark, *rows):
    return spark.createDataFrame([(1, *map(float, r[:4]), r[4]) for r in rows], "page int, cx double, cy double, w double, h double, text string")


def test_boxes(spark):  # X13, X14, A18, O3
    b = boxes(spark, (45, 0, 10, 10, "a"), (75, 50, 10, 10, "b"), (60, 151, 10, 10, "c"), (300, 0, 10, 60, "r"), (10, 700, 900, 20, "a wide line of some length"), (10, 700, 1200, 20, "dropped since it is too wide"))
    assert [r.text for r in layout.vertical_order(b).orderBy("nth").collect()] == ["r", "ab", "c", "a wide line of some length"]
    assert [r.text for r in layout.horizontal_order(boxes(spark, (9, 44, 1, 1, "z"), (9, 0, 1, 1, "x"), (1, 14, 1, 1, "w"))).orderBy("nth").collect()] == ["w", "x", "z"]
    assert layout.vertical_pages(b).first().vertical and not layout.vertical_pages(boxes(spark, (1, 1, 9, 1, "a"))).first().vertical


def test_glyphs(spark):  # O5, O6, J17, A13, A16
    rows = [("d", 1, 100.0, float(i * 10), "あ", i) for i in range(6)] + [("d", 1, 50.0, float(i * 10), "い", 10 + i) for i in range(6)] + [("d", 1, 122.0, 55.0, "う", 20)]
    g = spark.createDataFrame(rows, "doc string, page int, x double, y double, text string, seq int")
    assert [r.text for r in layout.glyph_lines(g).orderBy("line").collect()] == ["ああああああう", "いいいいいい"]
    assert layout.pages_to_text(layout.glyph_lines(g)).first().text == "<!-- page 1 -->\nああああああう\nいいいいいい\n"
    assert layout.histograms(g).filter("axis = 'x'").count() == 3
    quality = {r.doc: r.quality for r in layout.text_quality(spark.createDataFrame([("a", "漢字かな"), ("b", "♡♡ab"), ("a", "12")], "doc string, text string"), ["doc"]).collect()}
    assert quality == {"a": 1.0, "b": -1.0}
    assert layout.is_horizontal(g).first().horizontal is False
    files = spark.createDataFrame([("g", "p", 1, 5), ("g", "q", 2, 9), ("g", "r", 3, 9)], "grp string, path string, seq int, n int")
    assert layout.representative(files).first().path == "q"
