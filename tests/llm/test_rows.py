"""Rows that differ only in the last digit of some column, and columns with any name, in the stages that carry rows."""

import datetime as dt
from collections import Counter
from decimal import Decimal

import corpus_pipeline
import pytest
from fixtures import SF
from pyspark.sql import functions as F

from lineweave.llm.minhash import keep_one_of_each
from lineweave.llm.mixing import mixed_documents
from lineweave.llm.packing import pack_batches
from lineweave.llm.shared import Scratch, count_words, row_key
from lineweave.llm.suffixes import strip_repeats

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, _n timestamp, `a.b` double, _did decimal(38,18), _th binary, _spans array<struct<x:int,`y.z`:string>>, "
    "row map<string,timestamp>, key float, nth timestamp_ntz, `q``r` date, spans boolean, did string"
)
AT = dt.datetime(2024, 3, 31, 1, 59, 59, 1)
PLAIN = ("en", "s", 3, AT, 0.1, Decimal("1.000000000000000001"), b"\x00\xff", [(1, "a"), None, (None, None)], {"k": AT}, 1.5, AT, dt.date(1, 1, 1), True, "x")
OTHERS = {
    3: [None, AT + dt.timedelta(microseconds=1)],
    4: [None, float("nan"), -0.0, 0.0, 0.1 + 2**-56, float("inf")],
    5: [None, Decimal("1.000000000000000002")],
    6: [None, b"", b"\x00\xfe", b"\x00\xff\x00"],
    7: [None, [], [None], [(1, "a")], [(1, "a"), (None, None), None], [(1, None), None, (None, "a")], [(1, "a:1"), None, (None, None)]],
    8: [None, {}, {"k": None}, {"k": AT + dt.timedelta(microseconds=1)}, {"l": AT}],
    9: [None, 1.5000001],
    10: [None, AT + dt.timedelta(microseconds=1)],
    11: [None, dt.date(9999, 12, 31)],
    12: [None, False],
    13: [None, "", "n", "1:x"],
}


def rows(one_id=True):
    out = [PLAIN] + [(*PLAIN[:c], v, *PLAIN[c + 1 :]) for c, values in OTHERS.items() for v in values]
    return [(7 if one_id else i, "some words of one text", *r) for i, r in enumerate(out)]


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA).withColumn("more", F.struct(F.col("doc_id"), F.col("_n").alias("in.side")))


def counted(df, columns):
    return Counter(repr([r[df.columns.index(c)] for c in columns]) for r in df.collect())


def test_keys_tell_rows_apart(spark):
    docs = frame(spark, rows())
    keys = docs.unionByName(docs).groupBy(row_key(docs, "x").alias("k")).count().collect()
    assert len(keys) == len(rows()) and {r["count"] for r in keys} == {2}


def test_mix_and_pack_lose_no_row(spark):
    docs = frame(spark, rows())
    taken = counted(mixed_documents(docs, Scratch(spark, "t")), docs.columns)
    assert taken == counted(docs, docs.columns)  # one source, whose target is its size
    packed = pack_batches(docs.unionByName(docs), Scratch(spark, "t"), count_words(F.col("text")), carry=True)
    assert counted(packed, docs.columns) == counted(docs.unionByName(docs), docs.columns)
    assert packed.columns == [*docs.columns, "length", "bucket", "bucket_length", "batch", "slot", "padding"]


def test_near_duplicates_keep_columns(spark):
    docs = frame(spark, rows(False))
    assert counted(keep_one_of_each(docs, Scratch(spark, "t")), docs.columns) == counted(docs.filter("doc_id = 0"), docs.columns)
    docs = frame(spark, [(None, *r[1:]) for r in rows()] + [(i, f"text {i} of its own", *PLAIN) for i in range(5)])
    assert counted(keep_one_of_each(docs, Scratch(spark, "t")), docs.columns) == counted(docs, docs.columns)


def test_repeats_keep_columns(spark):
    long = " ".join(f"word{i}" for i in range(80))
    data = [(i, f"own {chr(0x4E00 + i)} {long}", *r[2:]) for i, r in enumerate(rows(False))]
    docs = frame(spark, data)
    got = strip_repeats(docs, Scratch(spark, "t"))
    rest = [c for c in docs.columns if c != "text"]
    assert got.columns == docs.columns and counted(got, rest) == counted(docs, rest)
    assert {r.doc_id: r.text for r in got.collect()} == {r[0]: r[1] if not r[0] else f"own {chr(0x4E00 + r[0])}" for r in data}


@pytest.mark.parametrize("k", range(5))
def test_stages_take_any_column(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    words = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    docs = frame(spark, [(i, words(i), *r[2:4], len(words(i)), *r[5:]) for i, r in enumerate(rows(False))])
    assert counted(stage(spark, docs, SF), docs.columns) == counted(docs, docs.columns)
