import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lineweave.sources import files as listings
from lineweave.sources import subtitles as subs

SCHEMA = "file string, ext string, content string"


def files(spark, *rows):
    return spark.createDataFrame([(f"f{i}{e}", e, c) for i, (e, c) in enumerate(rows)], SCHEMA)


def test_lrc_cues(spark):  # X1
    f = files(spark, (".lrc", "[01:02.345]hello\n\n[ti:x]\n[00:02.01]b"))
    assert [tuple(r)[1:] for r in subs.lrc_cues(f).orderBy("seq").collect()] == [(0, 62345, "hello"), (1, 2009, "b")]
    assert subs.lrc_cues(f, "round").filter("seq = 1").first().time_ms == 2010


def test_items_and_rendering(spark):  # X2, X3
    f = files(spark, (".lrc", "[00:02.01]b\n[00:03.00]\n# note\n"))
    items = subs.lrc_items(f)
    assert [(r.item_type, r.time_ms) for r in items.orderBy("line_no").collect()] == [("lyric", 2010), ("clear", 3000), ("raw", None)]
    assert subs.render_items(items).first().content == "[00:02.01]b\n[00:03.00]\n# note\n"


def test_lrc_structure(spark):  # X4
    f = files(spark, (".lrc", "[00:01.00]a\ntail\n[ar:z]\n"), (".lrc", "[ar:z]\nno text"))
    got = subs.structure(f).orderBy("line_no").collect()
    assert [(r.kind, r.text or r.verbatim, r.tag) for r in got] == [("text", "a tail", "[00:01.00]"), ("verbatim", "[ar:z]", None)]


SRT = "1\n00:00:01,000 --> 00:00:02,000\nhi\n2\n\n2\n00:00:03,000 --> 00:00:04,000\n\nstray\n00:00 --> x\ny\n"
VTT = "WEBVTT\n\nNOTE a --> b\n\n00:00:01.000 --> 00:00:02.000\none\ntwo\n00:00:02.000 --> 00:00:03.000\nNOTE inside\n\nSTYLE\n"


def test_blocks(spark):
    got = subs.structure(files(spark, (".srt", SRT), (".vtt", VTT))).filter("kind = 'text'").orderBy("file", "slot").collect()
    assert [(r.file, r.text, r.slot) for r in got] == [("f0.srt", "hi", 0), ("f0.srt", "2", 1), ("f1.vtt", "one", 0), ("f1.vtt", "two", 1), ("f1.vtt", "NOTE inside", 2)]


def test_rewriting_keeps_structure(spark):  # K1
    f = files(spark, (".srt", SRT), (".vtt", VTT), (".lrc", "[ti:x]\n[00:01.00]a\n[00:02.00]b\n"))
    lines = subs.structure(f)
    same = subs.replace_texts(lines, lines.filter("slot is not null").selectExpr("file", "slot", "text new_text"))
    assert {r.file: r.content for r in same.collect()} == {r.file: r.content for r in f.collect()}
    one = spark.createDataFrame([("f2.lrc", 0, "Z"), ("f2.lrc", 1, " "), ("f0.srt", 0, "Z")], "file string, slot int, new_text string")
    assert {r.file: r.content for r in subs.replace_texts(lines, one, True).collect()}["f2.lrc"] == "[ti:x]\n[00:01.00]Z\n"
    assert {r.file: r.content for r in subs.replace_texts(lines, one).collect()}["f2.lrc"] == "[ti:x]\n[00:01.00]Z\n[00:02.00] \n"


def test_spoken_texts(spark):  # S5, Q4
    f = files(spark, (".lrc", "[00:01.00] a\n[ti:x]b\nc"), (".srt", SRT), (".vtt", VTT), (".vtt", "WEBVTT\n\n01:00:00.000 --> 01:00:01.000\nlate\n"))
    got = [(r.file, r.text) for r in subs.spoken_texts(f).orderBy("file", "line_no").collect()]
    assert got == [("f0.lrc", "a"), ("f1.srt", "hi"), ("f1.srt", "2"), ("f2.vtt", "one"), ("f2.vtt", "two"), ("f2.vtt", "NOTE inside")]
    assert subs.spoken_texts(f, True).filter("file = 'f3.vtt'").first().text == "late"
    assert {r.language for r in subs.language_of_files(files(spark, (".lrc", "[ti:x]"))).collect()} == {"empty"}


def test_blank_cues(spark):  # X27
    f = files(spark, (".lrc", "[00:01.00]a\n[00:02.00]\n\n[ti:x]\n"), (".srt", "1\n0 --> 1\n\n2\n1 --> 2\nb\n"), (".lrc", ""), (".vtt", "WEBVTT\n\n0 --> 1\n"))
    got = {r.file: (r.content, r.removed) for r in subs.without_blank_cues(f).collect()}
    assert got == {"f0.lrc": ("[00:01.00]a\n[ti:x]\n", 2), "f1.srt": ("2\n1 --> 2\nb\n", 1), "f2.lrc": ("", 0), "f3.vtt": ("WEBVTT\n", 1)}


def test_siblings(spark):  # K4
    lines = subs.structure(spark.createDataFrame([("a/x.srt", ".srt", "1\n0 --> 1\nq\n\n2\n1 --> 2\nr\n"), ("a/y.srt", ".srt", "1\n0 --> 1\nq\n")], SCHEMA))
    texts = spark.createDataFrame([("a/x.lrc", 0, "A"), ("a/x.lrc", 1, ""), ("a/x.lrc", 2, "B"), ("a/y.lrc", 0, "A"), ("a/y.lrc", 1, "B")], "file string, seq int, new_text string")
    assert sorted(map(tuple, subs.sibling_texts(lines, texts).collect())) == [("a/x.srt", 0, "A"), ("a/x.srt", 1, "B")]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5_000_000), st.text("abcあ漢 ", max_size=6).map(str.strip)), min_size=1, max_size=5))
def test_items_round_trip(spark, rows):
    items = spark.createDataFrame([("f", i, "lyric" if t else "clear", ms, t, None) for i, (ms, t) in enumerate(rows)], "file string, line_no int, item_type string, time_ms long, text string, raw string")
    back = subs.lrc_items(subs.render_items(items).selectExpr("file", "'.lrc' ext", "content")).orderBy("line_no").collect()
    assert [(r.time_ms, r.text) for r in back] == [((ms + 5) // 10 * 10, t) for ms, t in rows]


@pytest.fixture()
def listing(spark):
    paths = ["w/RJ123456/a.lrc", "w/RJ123456/a.ja.lrc", "w/RJ123456/b.ja.srt", "w/bug_collection/c.lrc", "w/RJ123456/d.mp3", "w/RJ123456/a.mp3", "w/RJ123456/raw/a.words.jsonl", "w/x/s.txt", "w/x/s.pdf", "w/x/t.pdf", "w/x/台本/01.txt", "w/x/readme.txt"]
    return spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, i int").selectExpr("path", "timestamp_seconds(100 - i) mtime")


def test_listing_rules(spark, listing):  # S1, S7, S12, S13, S20-S23, J1-J4, K5
    live, archived, restore = listings.subtitles(listing)
    assert [(r.path, r.nth) for r in listings.in_time_order(live).orderBy("nth").collect()] == [("w/RJ123456/b.srt", 1), ("w/RJ123456/a.lrc", 2)]
    assert archived.count() == 2 and [r.target for r in restore.collect()] == ["w/RJ123456/b.srt"]
    assert [r.path for r in listings.untranscribed(listing).collect()] == ["w/RJ123456/d.mp3"]
    assert [r.path for r in listings.with_original(listing).collect()] == ["w/RJ123456/a.lrc"]
    assert [r.target for r in listings.to_archive(listing).collect()] == ["w/bug_collection/c.ja.lrc"]
    kept = {r.path for r in listings.prefer_txt(listing.filter("path like 'w/x/%'")).collect()}  # X30
    assert "w/x/s.pdf" not in kept and {"w/x/s.txt", "w/x/t.pdf"} <= kept
    assert [r.path for r in listings.discover_scripts(listing, listings.work_root(listing["path"])).collect()] == ["w/x/台本/01.txt"]
    root = {r.path: r.root for r in listing.select("path", listings.work_root(listing["path"]).alias("root")).collect()}
    assert root["w/RJ123456/raw/a.words.jsonl"] == "w/RJ123456" and root["w/x/s.txt"] == "w/x"
    words = listings.words_file(spark.createDataFrame([("w/RJ123456/a.lrc",), ("w/x/q.lrc",)], "path string"), listing).collect()
    assert [tuple(r) for r in words] == [("w/RJ123456/a.lrc", "w/RJ123456/raw/a.words.jsonl")]
    assert sorted(r.stem for r in listings.track_stems(listing).collect()) == ["a", "c", "d"]
    assert listings.script_candidates(listing).count() == 5


def test_listing_of_a_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.lrc").write_text("[00:01.00]a")
    assert [r.path.rsplit("/", 1)[1] for r in listings.listing(spark, str(tmp_path), "*.lrc").collect()] == ["x.lrc"]
