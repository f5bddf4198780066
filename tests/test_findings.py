"""Steps that once grew faster than their tables, skipped work or differed from their SQL."""

import random

from pyspark.sql import functions as F

from lineweave.operators import matching, model, scripts


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_files_meet_folded_tracks(spark):
    """A work of many files and tracks of one number makes no pairs of all: tracks are folded before the join."""
    n = 2000
    files = spark.range(n).select(F.lit("w").alias("work"), F.col("id").cast("string").alias("path"), F.lit("track 1").alias("stem"))
    tracks = spark.range(n).select(F.lit("w").alias("work"), F.concat(F.lit("Tr.1 "), F.col("id").cast("string")).alias("track"), (n - F.col("id")).alias("seq"))
    got = matching.files_to_tracks(files, tracks)
    assert plan_of(got).count("Aggregate") == 2
    assert got.count() == n and [r[0] for r in got.select("track").distinct().collect()] == [f"Tr.1 {n - 1}"]


def test_names_without_broadcasts(spark):
    """No table of names or of their parts goes through the driver, and rows are those of a plain walk."""
    r = random.Random(3)
    word = lambda k: "".join(r.choice("abé😀") for _ in range(k))
    have = [(word(r.randint(0, 5)), i) for i in range(80)]
    want = [(word(r.randint(0, 7)), i) for i in range(200)] + [(None, 200)]
    walked = {}
    for name, seq in want:
        met = [(1 if m == name else 2, k, m) for m, k in have if name and m and (m in name or name in m)]
        walked[seq] = min(met)[::2] if met else (None, None)
    got = matching.tiered_names(spark.createDataFrame(want, "name string, seq int"), spark.createDataFrame(have, "match string, match_seq int"))
    assert {x.seq: (x.tier, x.match) for x in got.collect()} == walked and len({t for t, _ in walked.values()}) == 3
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_works_of_cached_scripts_are_whole(spark):
    """Parts are dealt over 91 works, which grow with the table."""
    from lineweave.work_queries import cached_script_reuse

    got = cached_script_reuse(spark, "/root/testdata/sf0.001").select("work").distinct().collect()
    assert len(got) > 20 and {r.work % 3 for r in got} == {0, 1}


def test_pages_of_boxes_are_whole(spark):
    """Orders stand on 40 pages, which grow with the table, and no page pairs all of its boxes."""
    from lineweave.queries import box_reading_order

    got = box_reading_order(spark, "/root/testdata/sf0.001")
    pages = {r.page for r in got.select("page").distinct().collect()}
    assert pages <= {1, 2, *range(100, 140)} and len(pages) > 30
    assert "contains(" not in plan_of(got).lower()


def test_nearest_run_of_words(spark):
    """A word of the line before that spells the next line and starts within 80 ms is not that line."""
    cues = spark.createDataFrame([("f", 0, 100, "of")], "file string, seq int, time_ms long, text string")
    segs = spark.createDataFrame([("f", 0, 0, 200, [(0, 1, "a"), (44, 45, "of"), (100, 101, "of"), (102, 103, "b")])], "file string, seg int, start long, end long, words array<struct<start:bigint,end:bigint,word:string>>")
    starts = lambda **how: [w.start for w in matching.as_of_segments(cues, segs, **how).first().words]
    assert starts() == [44] and starts(nearest=True) == [100]


def test_models_are_given_few_requests_at_once(spark):
    """Python's values of a batch do not grow with the table: a model sees AT_ONCE prompts of a batch at a time."""
    sizes = lambda prompts: prompts.map(lambda p: f"{p} {len(prompts)}")
    requests = spark.range(1000).coalesce(1).select(F.when(F.col("id") != 7, F.col("id").cast("string")).alias("prompt"), F.array("id").alias("seqs"))
    got = model.call(requests.na.fill("none", ["prompt"]), sizes).collect()
    assert [r.raw.split()[0] for r in got] == [r.prompt for r in got] and [r.seqs for r in got] == [[i] for i in range(1000)]
    assert max(int(r.raw.split()[1]) for r in got) == model.AT_ONCE


def test_files_of_a_work_are_numbered_by_many_tasks(spark):
    """The place of a file in its work, blank files counted, with no task that reads a whole work."""
    files = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "v").when(F.col("id") % 2 == 0, "w").alias("work"), (F.col("id") * 7919 % 3001).alias("seq"), F.when(F.col("id") % 5 > 0, F.concat(F.lit(" "), F.col("id").cast("string"), F.lit("\n\nx"))).otherwise(" ").alias("content"))
    places, want = {}, set()
    for r in files.orderBy("seq").collect():
        places[r.work] = places.get(r.work, 0) + 1
        want |= {(r.work, places[r.work], k, x) for k, x in enumerate(x.strip() for x in r.content.split("\n") if x.strip())}
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        got = scripts.raw_script(files).withColumn("p", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset(key)
    assert {(r.work, r.track, r.line_no, r.text) for r in got} == want and len(got) == len(want)
    assert len({r.p for r in got if r.work == "v"}) > 1


def test_documents_of_one_row_group_are_spread(spark):
    """Work on each text is dealt over all tasks, however few row groups the file has."""
    from lineweave.queries import line_explode_stats, pre_clean_merge

    for query in (line_explode_stats, pre_clean_merge):
        assert "RepartitionByExpression" in plan_of(query(spark, "/root/testdata/sf0.001"))
