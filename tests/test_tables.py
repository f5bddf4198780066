"""Usage, windows, matching, scripts, the model interface, JSON answers and streams."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lineweave.functions import jsonrepair as jr
from lineweave.operators import asof, matching, model, scripts, usage, windows
from lineweave.plans.tracks import translate_files

WORDS = "array<struct<start:bigint,end:bigint,word:string>>"


def test_json_ladder():  # X21-X24, X31, F26
    assert jr.extract_texts('{"translations":[{"index":2,"text":"b"},{"index":1,"text":"a"}]}') == ["a", "b"]
    assert jr.extract_texts('{"translations":[{"index":1,"text":"a"}},{"index":2,"text":"b"}]}') == ["a", "b"]
    assert jr.aligned(["1", "2", "3"], '{"translations":[{"index":1,"text":"a"},{"index":3,"text":"c"}]}')[0] == ["a", "c", ""]
    assert jr.aligned(["q", "z"], 'x {"index":1,"text":"a"} y {"index":9,"text":"z"}') == (["a", ""], 1, "salvage")
    assert jr.extract_texts('{"translations": [{"index": 1, "text": "a"}, {"index": 2, "text": "b') == ["a"]
    compact = '{"translations":[{"index":1,"text":"a"},{"index":2,"text":"b'
    assert jr.extract_texts(compact) is None and jr.salvage(compact, ["x", "y"]) == {1: "a"}
    assert jr.extract_texts('{"translations":[{"index":1,"text":"say "hi" now"}]}') == ['say "hi" now']
    assert jr.extract_texts('{"index":1,"text":"say "hi" now"}') is None
    assert jr.extract_texts('["a","b"]') == ["a", "b"] and jr.extract_texts('so: ["a"]!') == ["a"] and jr.extract_texts('{"zh":["a"]}') == ["a"]
    assert jr.extract_texts('{"index":2,"text":"b"},\n{"index":1,"text":"a"}') == ["a", "b"]
    assert jr.extract_texts("nothing") is None and jr.aligned(["a"], "") == ([""], 0, "none")
    assert jr.salvage('{"index":1,"text":"「x」"}', ["0001: x"]) == {}


def test_json_columns(spark):
    df = spark.createDataFrame([(["a", "b"], '{"translations":[{"index":2,"text":"B"}]}', "C:\\dir \\n")], "o array<string>, raw string, s string")
    r = jr.with_answer_texts(df, "o", "raw", "p").select("p", jr.answers_by_index(F.col("o"), F.col("raw")).alias("i"), jr.repair_backslashes(F.col("s")).alias("s")).first()
    assert r.p.texts == ["B", ""] and r.i == ["", "B"] and r.s == "C:\\\\dir \\n"


def test_usage(spark):
    raw = spark.createDataFrame([('{"prompt_tokens": 10, "prompt_cache_hit_tokens": 4, "prompt_cache_miss_tokens": 6, "completion_tokens": 2}',), ('{"prompt_tokens": 10, "prompt_tokens_details": {"cached_tokens": 3}, "completion_tokens_details": {"reasoning_tokens": 7}}',), ("{}",)], "usage string")
    got = [(r.hit_tokens, r.miss_tokens, r.completion_tokens, r.reasoning_tokens) for r in usage.normal_usage(raw).collect()]
    assert got == [(4, 6, 2, 0), (3, 7, 0, 7), (0, 0, 0, 0)]
    runs = spark.createDataFrame([("w", "a", 1, "failed", 1.0, "x"), ("w", "a", 2, "success", 2.0, ""), ("w", "b", 1, "failed", 0.25, "y")], "work string, file string, attempt int, status string, elapsed double, reason string")
    m = usage.manifest(runs, spark.createDataFrame([("w", 3)], "work string, n int")).first()
    assert (m.succeeded, m.failed, m.total, m.complete, m.elapsed) == (1, 1, 3, False, 2.3)
    assert '"succeeded":1' in usage.manifest_json(usage.manifest(runs)).first().json
    tokens = spark.createDataFrame([("f", 1, 1, 1, 0, 1, 0), ("f", 2, 5, 5, 0, 5, 0)], "file string, attempt int, prompt_tokens int, hit_tokens int, miss_tokens int, completion_tokens int, reasoning_tokens int")
    assert usage.chunk_usage(tokens, True).first().prompt_tokens == 6 and usage.chunk_usage(tokens, False).first().prompt_tokens == 5


def test_budget_chunks(spark):  # X12
    got = spark.createDataFrame([([5, 6, 3, 9],)], "c array<bigint>").select(windows.budget_chunks(F.col("c"), 10)).first()[0]
    assert got == [0, 1, 1, 2]
    rows = spark.createDataFrame([("f", i, s) for i, s in enumerate([5, 6, 3, 9])], "file string, seq int, size int")
    assert [r.chunk for r in windows.pack_by_budget(rows, 10).orderBy("seq").collect()] == [0, 1, 1, 2]


def test_windows(spark):
    rows = spark.createDataFrame([(1, 0.0), (1, 50.0), (1, 151.0)], "page int, y double")
    assert [r.gap_group for r in windows.gap_groups(rows, ["page"], "y", 100).orderBy("y").collect()] == [0, 0, 1]  # X13
    items = spark.createDataFrame([("f", i, t, ms) for i, (t, ms) in enumerate([("clear", 1), ("clear", 1), ("clear", 1), ("lyric", 1), ("clear", 1)])], "file string, seq int, item_type string, time_ms int")
    assert [r.seq for r in windows.collapse_clears(items).orderBy("seq").collect()] == [0, 3, 4]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(["a", " ", "b", "a", "", ""])], "file string, seq int, text string")
    assert windows.trailing_blanks(lines).first().blank_tail == 2
    assert [r.text for r in windows.first_distinct(lines).orderBy("n").collect()] == ["a", "b"]
    assert [r.numbered for r in windows.numbered(lines).orderBy("seq").collect()][:2] == ["0001: a", "0002:  "]


def test_segment_matching(spark):  # X16, J6
    cues = spark.createDataFrame([("f", 0, 1000, "ab"), ("f", 1, 5000, "cd"), ("f", 2, 1000, "ab"), ("f", 3, 70_000, "zz")], "file string, seq int, time_ms long, text string")
    segs = spark.createDataFrame([("f", 0, 1080, 1500, "a b", [(1080, 1500, "ab")]), ("f", 1, 1081, 1500, "ab", []), ("f", 2, 4000, 6000, "xcdy", [(4000, 4900, "x"), (5000, 5100, "c"), (5100, 5200, "d"), (5300, 6000, "y")])], f"file string, seg int, start long, end long, text string, words {WORDS}")
    assert sorted(map(tuple, matching.match_segments(cues, segs).collect())) == [("f", 0, 0)]
    got = {r.seq: [w.word for w in r.words] for r in matching.cue_words(cues, segs).collect()}
    assert got == {0: ["ab"], 1: ["c", "d"]}
    assert matching.segments_fit(cues.limit(1), segs.filter("seg = 0")).first().fits


def test_names_and_terms(spark):  # X17, X18, X28, J16
    e = spark.createDataFrame([("gpt", "a"), ("gpt-5", "b")], "key string, entry string")
    rows = spark.createDataFrame([("GPT-5-mini",), ("other",)], "model string")
    assert {r.model: r.entry for r in matching.longest_prefix(rows, "model", e).collect()} == {"GPT-5-mini": "b", "other": None}
    t = lambda *p: spark.createDataFrame([("w", *x) for x in p], "work string, src string, tgt string")
    assert {r.src: r.tgt for r in matching.merge_terms(t(("a", "1")), t(("a", "9"), ("b", "2"))).collect()} == {"a": "1", "b": "2"}
    tracks = spark.createDataFrame([("w", "song（room ver）", []), ("w", "song", ["a", "b", "c"])], "work string, track string, lines array<string>")
    assert {r.track: len(r.lines) for r in matching.inherit_variants(tracks).collect()} == {"song（room ver）": 3, "song": 3}
    p = spark.createDataFrame([("w", "1", ["x"]), ("w", "2", []), ("w", "3", [])], "work string, track string, lines array<string>")
    o = spark.createDataFrame([("w", "1", ["o"]), ("w", "2", ["o"])], "work string, track string, lines array<string>")
    assert {r.track: r.lines for r in matching.fill_missing(p, o, p.select("work", "track")).collect()} == {"1": ["x"], "2": ["o"], "3": []}
    have = spark.createDataFrame([("Track 01 Intro", 0), ("Intro", 1)], "match string, match_seq int")
    want = spark.createDataFrame([("intro", 0), ("01", 1), ("none", 2)], "name string, seq int")
    assert {r.name: (r.match, r.tier) for r in matching.tiered_names(want, have).collect()} == {"intro": ("Intro", 1), "01": ("Track 01 Intro", 2), "none": (None, None)}
    same = matching.same_reading(spark.createDataFrame([("w", "a", "1", 0), ("w", "b", "2", 1), ("w", "c", "3", 2)], "work string, src string, tgt string, line_no int"), F.when(F.col("src") == "b", "x").otherwise("y"))
    assert [len(r.members) for r in same.collect()] == [2, 1]
    stems = spark.createDataFrame([("トラック３",), ("#2 x",), ("05_a",), ("none",)], "stem string")
    assert [r[0] for r in stems.select(matching.track_number(F.col("stem"))).collect()] == [3, 2, 5, None]
    files = spark.createDataFrame([("w", "p1", "track1"), ("w", "p2", "x")], "work string, path string, stem string")
    assert [tuple(r) for r in matching.files_to_tracks(files, spark.createDataFrame([("w", "Tr.1 a", 0), ("w", "Tr.2 b", 1)], "work string, track string, seq int")).collect()] == [("w", "p1", "Tr.1 a")]
    assert matching.presplit_works(files).first().presplit


def test_as_of_and_intervals(spark):
    left = spark.createDataFrame([(1, "a", 10.0), (2, "a", 5.0), (3, "b", 10.0)], "id int, k string, t double").withColumn("t", F.timestamp_seconds("t"))
    right = spark.createDataFrame([("a", 8.0, 7), ("a", 9.0, 8), ("b", 1.0, 9)], "k string, u double, v int").withColumn("u", F.timestamp_seconds("u"))
    assert {r.id: r.v for r in asof.as_of(left, right, "k", "t", "u", ["v"], 3).collect()} == {1: 8, 2: None, 3: None}


def test_scripts(spark):
    t = scripts.read_terms(spark.createDataFrame([("w", "# c\na→b\nc: d\na→e"), ("v", '{"x": "y", "z": ""}')], "work string, content string"))  # X29
    assert {(r.work, r.src): r.tgt for r in t.collect()} == {("w", "a"): "e", ("w", "c"): "d", ("v", "x"): "y"}
    s = spark.createDataFrame([("w", "pre\nトラック１\na\n※n\n《t》\nTrack 2\nb\nc"), ("v", "x\n\n※y\nz")], "work string, content string")
    tracks = spark.createDataFrame([("w", "tr1", 0), ("w", "tr2", 1), ("w", "tr3", 2), ("v", "only", 0)], "work string, track string, seq int")
    got = {(r.work, r.track): r.lines for r in scripts.split_by_marks(s, tracks).collect()}
    assert got == {("w", "tr1"): ["トラック１", "a"], ("w", "tr2"): ["Track 2", "b", "c"], ("w", "tr3"): [], ("v", "only"): ["x", "z"]}
    back = spark.createDataFrame([("w", "Track 2\nb\nTrack 1\na")], "work string, content string")  # Q8: order of numbers, not of places
    assert {r.track: r.lines for r in scripts.split_by_marks(back, tracks.filter("work = 'w'")).collect()}["tr1"] == []
    answers = spark.createDataFrame([("w", '```json\n{"tracks": {"TR 1": [2, 9], "tr2": ["x", "※n"], "zzz": ["q"]}}\n```')], "work string, raw string")
    lines = spark.createDataFrame([("w", ["l1", "l2", "12", "l4"])], "work string, lines array<string>")
    assert {r.track: r.lines for r in scripts.tracks_from_answer(answers, tracks.filter("work = 'w'"), lines).collect()} == {"tr1": ["l2", "l4"], "tr2": ["x"], "tr3": []}
    assert spark.createDataFrame([("a\nb",)], "c string").select(scripts.number_lines(F.col("c"))).first()[0] == "00001|a\n00002|b"
    raw = spark.createDataFrame([("日本".encode("shift-jis"),), (b"abc",), (b"  ",), (None,)], "b binary")
    assert [r[0] for r in raw.select(scripts.decode_udf()("b")).collect()] == ["日本", "abc", None, None]
    c = spark.createDataFrame([("w", '{"characters": [{"name": "A", "role": "r"}]}'), ("v", '{"characters": {"B": {"role": "q"}}}')], "work string, content string")
    assert {(r.work, r.name, r.role) for r in scripts.characters(c).collect()} == {("w", "A", "r"), ("v", "B", "q")}
    cover = scripts.coverage(spark.createDataFrame([("w", "1", ["a"]), ("w", "2", [])], "work string, track string, lines array<string>")).first()
    assert (cover.matched, cover.total, cover.accepted) == (1, 1, True)
    m = scripts.raw_script(spark.createDataFrame([("w", 0, "a\n\n b"), ("w", 1, "c")], "work string, seq int, content string"))
    assert sorted(map(tuple, m.collect())) == [("w", 1, 0, "a"), ("w", 1, 1, "b"), ("w", 2, 0, "c")]


def test_model(spark):
    rows = spark.createDataFrame([("f", 0, i, t) for i, t in enumerate(["a", "b", "c"])], "file string, chunk int, seq int, text string")
    assert {r.seq: r.new_text for r in model.translate(rows, ["file", "chunk"], model.echo_model).collect()} == {0: "» a", 1: "» b", 2: "» c"}
    broken = lambda p: pd.Series(["sorry"] * len(p))
    assert {r.how for r in model.translate_with_retries(rows, ["file", "chunk"], [broken, model.echo_model]).collect()} == {"json"}
    assert {r.new_text for r in model.translate_with_retries(rows, ["file", "chunk"], [broken]).collect()} == {""}
    texts = rows.select("file", "seq", "text")
    new = model.polish(texts, spark.createDataFrame([("f", '{"2": "B!", "3": " ", "x": "y"}')], "file string, raw string"))
    assert [r.text for r in new.orderBy("seq").collect()] == ["a", "B!", "c"]
    named = spark.createDataFrame([("w", 1, "n1"), ("w", 2, "n2")], "work string, seq int, name string")
    assert [r.title for r in model.titles(named, spark.createDataFrame([("w", '{"1": " t1 ", "9": "q"}')], "work string, raw string")).orderBy("seq").collect()] == ["t1", "n2"]
    cuts = model.cut_answers(spark.createDataFrame([('{"s1": ["3", "x"], "s9": ["1"]}',)], "raw string"), spark.createDataFrame([("s1",)], "id string"))
    assert [tuple(r) for r in cuts.collect()] == [("s1", [3])]


def test_whole_track(spark):
    files = spark.createDataFrame([("a", ".lrc", "[00:01.00]こんにちは\n[00:02.00]\n[00:03.00]さようなら\n"), ("b", ".lrc", "[00:01.00]中文字幕\n")], "file string, ext string, content string")
    script = spark.createDataFrame([("a", 0, "コンニチハ"), ("a", 1, "サヨウナラ")], "track string, line_no int, text string")
    out = translate_files(files, [model.echo_model], script).collect()
    assert [(r.file, r.content) for r in out] == [("a", "[00:01.00]» こんにちは\n[00:02.00]\n[00:03.00]» さようなら\n")]


@pytest.mark.filterwarnings("ignore")
def test_streams(spark, tmp_path):
    from lineweave.streaming import runs as streams

    rows = [("2024-01-01 00:00:00", "w", "a", "failed"), ("2024-01-01 00:01:00", "w", "a", "failed"), ("2024-01-01 00:02:00", "w", "b", "success"), ("2024-01-01 00:07:00", "w", "a", "failed")]
    schema = "ts timestamp, work string, file string, status string"
    df = spark.createDataFrame(rows, "ts string, work string, file string, status string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, frame, mode in (("progress", streams.progress(stream), "update"), ("queue", streams.retry_queue(stream), "update")):
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert {(r.status, r.n) for r in spark.table("progress").collect()} == {("failed", 2), ("success", 1), ("failed", 1)}
    assert {(r.file, r.attempts, r.status, r.retry) for r in spark.table("queue").collect()} == {("a", 3, "failed_for_good", False), ("b", 1, "success", False)}
    assert [r.work for r in streams.completed_works(df, spark.createDataFrame([("w", 2)], "work string, n int")).collect()] == ["w"]


def test_works_complete_on_a_stream_when_their_last_file_arrives(spark, tmp_path):
    """Exact: the same file twice is one file, and a work is named once."""
    from lineweave.streaming import runs as streams

    schema = "ts timestamp, work string, file string, status string"
    rows = [("2024-01-01 00:00:00", "w", "a", "success"), ("2024-01-01 00:01:00", "w", "a", "failed"), ("2024-01-01 00:02:00", "v", "x", "success")]
    more = [("2024-01-01 00:03:00", "w", "b", "success"), ("2024-01-01 00:04:00", "v", "x", "success"), ("2024-01-01 00:05:00", "w", "c", "success")]
    for part in (rows, more):
        spark.createDataFrame(part, "ts string, work string, file string, status string").selectExpr("cast(ts as timestamp) ts", "work", "file", "status").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    expected = spark.createDataFrame([("w", 2), ("v", 2)], "work string, n int")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streams.completed_works(stream, expected).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(120)
    assert [r.work for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["w"]
    batch = spark.read.parquet(str(tmp_path / "in"))
    assert [r.work for r in streams.completed_works(batch, expected).collect()] == ["w"]
    rows_held = lambda q: [x for p in q.recentProgress for o in p["stateOperators"] for x in [o["numRowsTotal"]]]
    assert rows_held(query)[-1] > 0
    # Days later only runs of other works arrive: the marks and the work that never ended leave the state.
    for day in (4, 5):
        row = [(f"2024-01-0{day} 00:00:00", "other", "x", "success")]
        spark.createDataFrame(row, "ts string, work string, file string, status string").selectExpr("cast(ts as timestamp) ts", "work", "file", "status").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = streams.completed_works(stream, expected).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(120)
    assert rows_held(query)[-1] == 0 and spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_retry_table_is_what_the_stream_leaves(spark, tmp_path):
    from lineweave.streaming import runs as streams

    rows = [(f"2024-01-01 00:{i:02d}:00", "w", "abc"[i % 3], "success" if i == 6 else "failed") for i in range(11)]
    log = spark.createDataFrame(rows, "ts string, work string, file string, status string").selectExpr("cast(ts as timestamp) ts", "work", "file", "status")
    log.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    query = streams.retry_queue(stream).writeStream.format("memory").queryName("retries").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = {tuple(r) for r in streams.retry_table(log).collect()}
    assert want == {("w", "a", 3, "success", False), ("w", "b", 4, "failed_for_good", False), ("w", "c", 3, "failed_for_good", False)}
    assert want <= {tuple(r) for r in spark.table("retries").collect()}
