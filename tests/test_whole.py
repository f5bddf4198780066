"""Queries read whole turns and all documents."""

import difflib
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lineweave.functions.text import align_normal
from lineweave.operators import align
from lineweave.operators.align import matching_blocks
from lineweave.queries import QUERIES

WORDS = [str(i) for i in range(150)]


@pytest.fixture(scope="module")
def turns(spark, tmp_path_factory):
    """Three conversations of two turns; 150 words and over 600 characters each."""
    top = str(tmp_path_factory.mktemp("turns"))
    rows = [(c, t, "user", " ".join(f"{'abc'[c]}{'xy'[t]}{w}" for w in WORDS)) for c in range(3) for t in range(2)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{top}/conversations.parquet")
    return top, rows


def test_cuts_of_whole_turns(spark, turns):
    top, rows = turns
    whole = {(str(c), t): text.replace(" ", "") for c, t, _, text in rows}
    spelled = {}
    for r in QUERIES["resegment_local"](spark, top).orderBy("file", "seq", "piece").collect():
        spelled[r.file, r.seq] = spelled.get((r.file, r.seq), "") + r.text
    assert spelled == whole
    # A pause of 400 ms and more after every seventh word is a place to cut.
    places = {(r.file, r.seq): (r.pauses, r.places) for r in QUERIES["legal_cut_levels"](spark, top).collect()}
    assert places == {key: (21, sum(range(7, 150, 7))) for key in whole}
    pieces = {}
    for r in QUERIES["resegment_local"](spark, top).collect():
        pieces[r.file] = pieces.get(r.file, 0) + 1
    assert {r.file: (r.lyrics, r.lossless) for r in QUERIES["split_and_render"](spark, top).collect()} == {f: (n, True) for f, n in pieces.items()}


def test_alignment_of_whole_turns(spark, turns):
    top, rows = turns
    got = {(r.track, r.seq): r for r in QUERIES["align_spans"](spark, top).collect()}
    assert {k: (r.lo, r.hi, r.sb) for k, r in got.items()} == {(str(c), t): (t, t, text) for c, t, _, text in rows}


def by_difflib(said, script):
    """Closed ranges of script lines by difflib's own matcher, walking the marks between lines."""
    a, s = "␟".join(said), "␟".join(script)
    blocks = [m for m in difflib.SequenceMatcher(a=a, b=s, autojunk=False).get_matching_blocks() if m.size]
    owner = [i for i, x in enumerate(script) for _ in (*x, *("-" if i < len(script) - 1 else ""))]
    marks = [c == "␟" for c in s]

    def line(p, step):
        before, after = [m for m in blocks if m.a <= p], [m for m in blocks if m.a > p]
        if before and p < before[-1].a + before[-1].size:
            x = before[-1].b + p - before[-1].a
        else:
            x1, y1 = (after[0].a, after[0].b) if after else (len(a), len(s))
            if before:
                x0, y0 = before[-1].a + before[-1].size, before[-1].b + before[-1].size
                x = y0 + (p - x0) * (y1 - y0) / (x1 - x0)
            else:
                x = y1 * (p / x1) if x1 else 0
        q = max(0, min(len(s) - 1, int(x)))
        while marks[q] and 0 < q < len(s) - 1:
            q += step
        return None if marks[q] else owner[q]

    out, at = {}, 0
    for i, x in enumerate(said):
        if x and s:
            lo, hi = line(at, 1), line(at + len(x) - 1, -1)
            lo, hi = lo or 0, len(script) - 1 if hi is None else hi
            if lo <= hi:
                out[i] = (lo, hi)
        at += len(x) + 1
    return out


def test_alignment_of_all_conversations(spark):
    """The query over its whole table against difflib."""
    rows, norm = {}, {}
    c = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    changed = F.array_join(F.transform(F.split("text", " "), lambda w, i: F.when(i % 5 == 2, "xx").otherwise(w)), " ")
    for r in c.select("conv_id", "turn", "text", align_normal("text").alias("script"), align_normal(changed).alias("said")).orderBy("conv_id", "turn").collect():
        rows.setdefault(str(r.conv_id), []).append((r.turn, r.text))
        norm.setdefault(str(r.conv_id), []).append((r.said, r.script))
    want = {}
    for track, pairs in norm.items():
        for i, (lo, hi) in by_difflib([a for a, _ in pairs], [s for _, s in pairs]).items():
            want[track, rows[track][i][0]] = (lo, hi, "｜".join(t for _, t in rows[track][lo : hi + 1][:6]))
    assert {(r.track, r.seq): (r.lo, r.hi, r.sb) for r in QUERIES["align_spans"](spark, "/root/testdata/sf0.001").collect()} == want


def test_answers_hold_whole_turns(spark, turns):
    top, rows = turns
    want = {str(c): hashlib.md5("|".join(text.upper() for k, _, _, text in rows if k == c).encode()).hexdigest() for c in range(3)}
    got = {r.file: (r.parsed, r.texts) for r in QUERIES["json_ladder"](spark, top).collect()}
    assert got["0"] == (2, want["0"]) and got["2"] == (2, want["2"])


@settings(max_examples=200, deadline=None)
@given(st.text("abé😀", max_size=40), st.text("abé😀", max_size=40))
def test_blocks_are_those_of_difflib(a, b):
    want = [tuple(m) for m in difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_matching_blocks() if m.size]
    assert matching_blocks(a, b) == want


def test_blocks_of_long_texts():
    r = random.Random(5)
    b = [r.choice(WORDS) for _ in range(400)]
    a, b = " ".join("xx" if i % 5 == 2 else w for i, w in enumerate(b)), " ".join(b)
    assert matching_blocks(a, b) == [tuple(m) for m in difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_matching_blocks() if m.size]


def test_long_tracks_are_split_alike(spark, monkeypatch):
    """Tracks cut at their seeds into many small parts give the lines that one task gives for each."""
    monkeypatch.setattr(align, "BLOCK", 64)
    r, spoken, script = random.Random(8), [], []
    for track in range(12):
        lines = [" ".join(r.choice(WORDS[: 10 + 30 * (track % 3)]) for _ in range(r.randint(0, 9))) for _ in range(r.randint(1, 60))]
        lines = [x for x in lines for _ in range(r.choice([1, 1, 1, 2 if track % 2 else 1]))]
        said = [x if r.random() < 0.7 else x.replace("1", "7") if r.random() < 0.7 else "" for x in lines if r.random() < 0.9] + ["", "and this"] * (track % 2)
        if track == 3:
            said, lines = ["", *said[::-1]], ["", "", *lines, ""]
        spoken += [(track, i, x) for i, x in enumerate(said)]
        script += [(track, i, x) for i, x in enumerate(lines)]
    spoken += [(20, 0, "only spoken " * 30), (21, 0, "quite different"), (22, 0, "x" * 300)]
    script += [(21, 0, "ABCDEFGH" * 40), (22, 0, ""), (22, 1, "x" * 300), (22, 2, "")]
    a, s = spark.createDataFrame(spoken, "track int, seq int, text string"), spark.createDataFrame(script, "track int, line_no int, text string")
    whole = sorted(map(tuple, align.align_script(a, s).collect()))
    for limit, seed in ((40, 6), (150, 12), (400, 5)):
        assert sorted(map(tuple, align.align_script(a, s, limit=limit, seed=seed).collect())) == whole
    assert len(whole) > 200


def test_every_document_stands_in_a_script(spark, tmp_path):
    docs = [(i, f"first of {i}\nsecond of {i}", "de" if i % 3 else "en") for i in range(60)] + [(7, "again\nof seven\nonce more", "de")]
    spark.createDataFrame([*docs, (None, "no id", "de")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["script_marks"](spark, str(tmp_path)).collect()
    want = {(f"{lang}/{i // 9}", f"tr0{i % 9 + 1}"): [f"トラック{i % 9 + 1}", *(["again", "of seven", "once more"] if i == 7 else []), *text.split("\n")] for i, text, lang in docs[:60]}
    assert {(r.work, r.track): (r.n_lines, r.lines) for r in got} == {k: (len(v), hashlib.md5("\n".join(v).encode()).hexdigest()) for k, v in want.items()}
    assert len(got) == 60


def test_glyph_columns_by_hand(spark):
    """Every line item as a glyph: columns of 24 points, and small ones with their nearest, walked in plain Python."""
    sf = "/root/testdata/sf0.001"
    pages, moved = {}, 0
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect():
        seq = (r.l_orderkey, r.l_partkey, r.l_suppkey, r.l_extendedprice)
        pages.setdefault((str(r.l_orderkey // 128), r.l_linenumber), []).append((r.l_extendedprice % 90, seq, round(r.l_quantity * 5 / 24) * 24.0, r.l_returnflag))
    want = {}
    for key, glyphs in pages.items():
        size, seen = {}, {}
        for _, seq, x, _ in glyphs:
            size[x], seen[x] = size.get(x, 0) + 1, min(seq, seen.get(x, seq))
        large, target = {x: n for x, n in size.items() if n >= 5}, {}
        for x in sorted(size, key=lambda x: (seen[x], x)):
            target[x] = x
            if size[x] < 5 and large and len(size) > 1:
                target[x] = min(sorted(large), key=lambda b: (abs(x - b), -large[b]))
                large[target[x]] += size[x]
                moved += 1
        columns = {}
        for _, _, x, flag in sorted(glyphs, key=lambda g: g[:2]):
            columns[target[x]] = columns.get(target[x], "") + flag
        for line, x in enumerate(sorted(columns, reverse=True)):
            want[(*key, line + 1)] = hashlib.md5(columns[x].encode()).hexdigest()
    assert {(r.doc, r.page, r.line): r.text for r in QUERIES["layout_glyphs"](spark, sf).collect()} == want and moved > 100
