import json

from lineweave.plans import config, works
from lineweave.sources import writers


def test_settings():
    assert config.with_defaults({"a": {"x": 1}}, {"a": {"x": 2, "y": 3}, "b": 4}) == {"a": {"x": 1, "y": 3}, "b": 4}
    assert config.fill({"k": "", "m": {"a": 1}, "n": "u"}, {"k": "p", "m": {"a": 2, "b": 3}, "n": "q"}) == {"k": "p", "m": {"a": 1, "b": 3}, "n": "u"}
    assert config.overlay({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": None, "e": 4}, "d": None}) == {"a": {"c": 2, "e": 4}}
    assert config.set_path({"r": {"x": 1}, "s": 5}, "r.e.f", "low") == {"r": {"x": 1, "e": {"f": "low"}}, "s": 5}
    assert config.set_path({"s": 5}, "s.t", 1) == {"s": {"t": 1}} and config.set_path({"a": 1}, "", 2) == {"a": 1}
    assert config.from_environment({"api": {"key": "a", "model": "m"}}, "APP", env={"APP_KEY": " b ", "APP_MODEL": " "})["api"] == {"key": "b", "model": "m"}
    assert config.registry_entry("GPT-5-mini", {"gpt": "openai", "gpt-5": {"protocol": "responses"}}) == ({"protocol": "responses"}, "gpt-5")
    assert config.protocol("x", {}) == "openai" and config.protocol("claude-x", {}) == "anthropic" and config.protocol("q", {"protocol": "Responses"}) == "responses"
    assert config.protocol("gpt", {"base_url": "https://zen.host", "models": {"gpt": {"protocol": "openai", "variants": {"zen": {"protocol": "responses"}}}}}) == "responses"
    assert config.terms({"terms": {" a ": "b", "c": ""}}) == {"a": "b"} == config.terms({"terms": [{"ja": "a", "zh": "b"}]})
    assert config.title_requests('{"works": [{"t": 1}]}') == [{"t": 1}] == config.title_requests('{"t": 1}') == config.title_requests('[{"t": 1}]')


def test_writers(spark):
    t = spark.createDataFrame([("w", "b", "2", 0), ("w", "a", "1", 1), ("w", "b", "3", 2)], "work string, src string, tgt string, n int")
    assert json.loads(writers.json_map(t, "work", "src", "tgt", "n").first().content) == {"a": "1", "b": "3"}
    tracks = spark.createDataFrame([("w", "t/1", ["a", "b"]), ("w", "t2", []), ("v", "x", [])], "work string, track string, lines array<string>")
    raw = spark.createDataFrame([("w", "raw"), ("v", "raw")], "work string, content string")
    got = {(r.work, r.path): r.content for r in writers.script_exports(tracks, raw).collect()}
    assert set(got) == {("w", "_scriptbook_export.txt"), ("w", "_scriptbook_clean.json"), ("w", "_split_tracks/t_1.txt")} and got["w", "_split_tracks/t_1.txt"] == "a\nb"
    runs = spark.createDataFrame([("w/RJ123456", "a.lrc", 0, "failed", 1.0, "x"), ("w/RJ123456", "a.lrc", 1, "success", 2.0, "")], "work string, file string, attempt int, status string, elapsed double, reason string")
    logs = {r.path: r.content for r in writers.work_logs(runs).collect()}
    assert set(logs) == {"RJ123456.log", "RJ123456/a.log"} and "---- retry 1 (success, 2.0s)" in logs["RJ123456/a.log"] and "succeeded: 1" in logs["RJ123456.log"]
    f = spark.createDataFrame([("a", ".lrc", "[00:01.00]x\n[00:02.00]\n"), ("b", ".lrc", "[00:01.00]x\n")], "file string, ext string, content string")
    changed, counters = writers.clean_blank_cues(f, f)
    assert [r.file for r in changed.collect()] == ["a"] and tuple(counters.first()) == (2, 1, 1)


def test_write_files(spark, tmp_path):
    f = spark.createDataFrame([("w", "p", "c")], "work string, path string, content string")
    writers.write_files(f, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).first().content == "c"


def test_works(spark):
    tracks = spark.createDataFrame([("w", "t1", 0), ("w", "t2", 1), ("v", "abcd x", 0), ("u", "q", 0)], "work string, track string, seq int")
    caches = spark.createDataFrame([("w", '{"t1": ["a"], "zz": []}'), ("v", '{"other": ["a"]}'), ("u", '{"q": []}')], "work string, content string")
    split = spark.createDataFrame([("v", "abcdef", "l1\n\nl2")], "work string, stem string, content string")
    assert {(r.work, r.track): r.lines for r in works.cached_scripts(caches, split, tracks).collect()} == {("w", "t1"): ["a"], ("w", "t2"): [], ("v", "abcd x"): ["l1", "l2"]}
    assert works.accepted_cache(works.cached_scripts(caches, split, tracks)).count() == 3
    cues = spark.createDataFrame([("t", 0, " a "), ("t", 1, ""), ("t", 2, "b")], "track string, seq int, text string")
    assert works.asr_samples(cues, 2).first().text == "a\nb"
    lines = spark.createDataFrame([("w", "f", i, "x" * 10) for i in range(100)], "work string, file string, seq int, text string")
    assert works.world_sample(lines, 40, 95).count() == 9
    files = spark.createDataFrame([("w", "worldview.json", 0, '{"worldview": "A"}'), ("w", "worldview.txt", 5, "B"), ("w", ".worldview.json", 9, '{"worldview": "C"}'), ("w", "scene.txt", 0, "S"), ("v", ".worldview.json", 9, '{"worldview": "C"}')], "work string, name string, priority int, content string")
    assert {r.work: (r.worldview, r.scene) for r in works.world_of_files(files).collect()} == {"w": ("B", "S"), "v": ("C", None)}
    own = spark.createDataFrame([("w", "a", "1")], "work string, src string, tgt string")
    world = spark.createDataFrame([("w", '{"characters": [{"name": "a", "name_cn": "x"}, {"name": "b", "name_cn": "y（note）"}], "special_terms": {"c": "z"}}')], "work string, content string")
    shared = spark.createDataFrame([("c", "global"), ("d", "g")], "src string, tgt string")
    terms = works.work_terms(own, world, shared, shared.selectExpr("'w' work", "src"))
    assert {r.src: r.tgt for r in terms.collect()} == {"a": "1", "b": "y", "c": "z", "d": "g"}
    assert works.with_context(spark.createDataFrame([("w",)], "work string"), terms, 2).first().terms == ["a→1", "b→y"]
    paths = spark.createDataFrame([("w", "x/a free talk"), ("v", "x/main")], "work string, path string")
    assert [r.work for r in works.needs_world(paths).collect()] == ["v"]
    answers = spark.createDataFrame([("d", '{"f": [{"index": 2, "text": "B"}]}')], "dir string, raw string")
    got = works.directory_answers(answers, spark.createDataFrame([("d", "f", 2)], "dir string, file string, n int"))
    assert [r.text for r in got.orderBy("seq").collect()] == ["", "B"]
