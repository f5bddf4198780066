from pyspark.sql import functions as F

from lineweave.functions import names, text, timing


def one(spark, values, column, kind="string"):
    """Results of a column over t, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r[0] for r in df.orderBy("i").select(column.alias("x")).collect()]


def test_scripts_and_languages(spark):  # X5, P1, P2
    assert one(spark, ["あ", "ｱ", "ㇰ", "漢", "a"], text.has_kana("t")) == [True, True, True, False, False]
    assert one(spark, ["漢a", "あ"], text.has_han("t")) == [True, False]
    han = "一二三四五六七八九十"
    kana, hans = text.count_class("t", text.KANA_LETTERS), text.count_class("t", text.HAN)
    got = one(spark, [han + "あ", han + "ああ", "", "abc", "ー"], text.file_language(kana, hans, F.when(F.col("t") == "", 0).otherwise(1)))
    assert got == ["chinese", "japanese", "empty", "unknown", "unknown"]
    got = one(spark, ["[00:01.00]hello there", "[00:01.00]漢字", "[00:01.00]漢字かな", "[ti:x]", "かabcdef", "漢abc", "12 34"], text.content_language("t"))
    assert got == ["en", "zh", "ja", "unknown", "mixed", "mixed", "unknown"]


def test_is_chinese(spark):  # P5
    df = spark.createDataFrame([(0, 5, None), (1, 20, None), (5, 20, None), (5, 20, 10), (0, 0, 3)], "k int, h int, s int")
    c = text.is_chinese(F.col("k"), F.col("h"), F.col("s"))
    assert [r[0] for r in df.select(c).collect()] == [True, True, False, True, False]
    assert [r[0] for r in df.select(text.is_chinese(F.col("k"), F.col("h"), strict=True)).collect()] == [True, False, False, False, False]


def test_page_noise(spark):  # X6
    assert one(spark, ["12", "3/57", "22222x", "2222あ", "12345678 body", "製作 a", "123456789", " line "], text.page_noise("t")) == [None, None, None, "2222あ", "body", None, None, " line "]
    assert one(spark, ["a\n12\n３４\nb"], text.filter_page_noise("t")) == ["a\nb"]


def test_noise_line(spark):  # P9
    assert one(spark, ["", "※x", "あっ……", "ああああああああ", "漢"], text.is_noise_line("t")) == [True, True, True, False, False]


def test_boilerplate(spark):  # X7
    df = spark.createDataFrame([("thank you", 0.5), ("thank you", 0.95), ("hello world", 0.5), ("hello world", 0.05), ("", 0.5), ("感谢收", 0.5)], "t string, p double")
    got = [r[0] for r in df.select(text.boilerplate_kind("t", F.col("p"))).collect()]
    assert got == ["mid_file_ending:thank you", None, "late_file_opening:hello", None, None, "short_ending_pattern"]


def test_repetition_and_drop(spark):  # X8, P13
    assert one(spark, ["aaaaa", "aaaa", "ababab", "abcabd"], text.repeats_too_much("t")) == [True, False, True, False]
    got = one(spark, ["", "01: aaaaaaa", "ab", "12 !?", "hm hm plain", "そうだね", "漢字です"], text.drop_reason("t", F.lit(0.95)))
    assert got == [None, "repetition", "short", "symbols", "no_script", None, None]


def test_rewrites(spark):
    assert one(spark, ["アイ、う！", "「a b」"], text.align_normal("t")) == ["あいう", "ab"]
    assert one(spark, ["0001: a b"], text.without_number("t")) == ["a b"]
    assert one(spark, ["<!-- page 2 -->\nSE: x\n12\na\n\n\n\nb"], text.pre_clean("t")) == ["a\n\nb"]
    assert one(spark, ["長い行長い行長い行長い\n短い\n◆印\n\n次"], text.merge_short_lines("t")) == ["長い行長い行長い行長い短い\n◆印\n次"]
    assert one(spark, ["漢 字\nか a"], text.join_cjk("t")) == ["漢字か a"]
    assert one(spark, ["漢 字\nか a"], text.join_cjk("t", True)) == ["漢字\nか a"]
    assert one(spark, ["12abc\n12\n\n<!-- x\n1234a"], text.clean_number_lines("t")) == ["abc\n12\n\n<!-- x\n1234a"]
    assert one(spark, ["名（注）末(x", None], text.without_brackets("t")) == ["名末", ""]


def test_dice(spark):  # X11
    df = spark.createDataFrame([("abcd", "abce"), ("a", "ab"), ("aaaa", "aa"), ("", "")], "a string, b string")
    got = [r[0] for r in df.select(text.dice("a", "b")).collect()]
    assert [round(x, 6) for x in got] == [0.666667, 0.0, 1.0, 0.0]


def test_times(spark):  # X9, X10, X26, F6
    ts = ["2024-01-01 01:00:00", "2024-01-01 04:00:00", "2024-01-01 05:59:59", "2024-01-01 10:00:00", "2024-01-01 09:59:59"]
    df = spark.createDataFrame([(t,) for t in ts], "s string").select(F.col("s").cast("timestamp_ntz").alias("ts"))
    assert [tuple(r) for r in df.select(timing.is_peak(F.col("ts")), timing.seconds_until_idle(F.col("ts"))).collect()] == [(True, 10800), (False, 0), (False, 0), (False, 0), (True, 1)]
    assert one(spark, [59, 60, 3661, 0], timing.hms(F.col("t")), "int") == ["59s", "1m0s", "1h1m1s", "0s"]
    assert one(spark, [62345, 2005, -5, 59999], timing.ms_to_stamp(F.col("t")), "int") == ["[01:02.35]", "[00:02.01]", "[00:00.00]", "[01:00.00]"]
    r = spark.range(1).select(timing.cost(F.lit(1e6), F.lit(2e6), F.lit(3e6)), timing.hit_rate(F.lit(1e6), F.lit(2e6)), timing.hit_rate(F.lit(0), F.lit(0))).first()
    assert abs(r[0] - 8.02) < 1e-12 and abs(r[1] - 100 / 3) < 1e-9 and r[2] == 0
    assert one(spark, [0.00005, 0.005, 1.5], timing.show_cost(F.col("t")), "double") == ["¥0.000050", "¥0.0050", "¥1.50"]
    assert one(spark, [9999, 10000], timing.show_tokens(F.col("t")), "int") == ["9999", "10,000"]


def test_names(spark):  # X15, X25
    assert one(spark, [0, 25, 26, 701, 702], names.sheet_label(F.col("t")), "int") == ["A", "Z", "AA", "ZZ", "AAA"]
    df = spark.createDataFrame([(s,) for s in ("tr10", "tr2", "intro", "Tr３")], "stem string").withColumn("d", F.lit("x"))
    assert [r.stem for r in df.orderBy(*names.natural_order(F.col("d"), F.col("stem"))).collect()] == ["tr2", "Tr３", "tr10", "intro"]
    assert one(spark, ["トラック・プ_1", "A b-C"], names.name_key(F.col("t"), True)) == ["トラックプ1", "abc"]
    assert one(spark, ["プ"], names.nfc_udf("t")) == ["プ"]
    assert one(spark, ["a/RJ123456/x", "a/b"], names.short_id(F.col("t"))) == ["RJ123456", "b"]
    assert one(spark, ["a b/c", "::"], names.safe_file_name(F.col("t"))) == ["a_b_c", "track"]
    df = spark.createDataFrame([("abc", "xabcx"), ("abcd", "abxd"), ("ab", "cd"), ("", "a")], "a string, b string")
    assert [r[0] for r in df.select(names.similar_names(F.col("a"), F.col("b"))).collect()] == [True, True, False, False]
    m = spark.range(1).select(names.fill_blank(F.create_map(F.lit("a"), F.lit(""), F.lit("b"), F.lit("u")), F.create_map(F.lit("a"), F.lit("p"), F.lit("c"), F.lit("q")))).first()[0]
    assert m == {"a": "p", "b": "u", "c": "q"}
    df = spark.createDataFrame([(400, "x"), (None, "Unknown field"), (429, "slow"), (429, "timed out"), (None, "quota gone"), (500, "boom")], "s int, m string")
    got = [tuple(r) for r in df.select(names.is_unsupported_parameter(F.col("s"), F.col("m")), names.is_quota_exhausted(F.col("s"), F.col("m"))).collect()]
    assert got == [(True, False), (True, False), (False, True), (False, False), (False, True), (False, False)]
