import re
from collections import Counter, defaultdict

from fixtures import SF, frame, rows

from lineweave.llm.mixing import fair_queue_mix, mixed_documents
from lineweave.llm.shared import Scratch


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(data):
    size = defaultdict(int)
    for r in data:
        size[r[3]] += words(r[1])
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, sum(size.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * size[s]}
        if not over:
            return size, target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = 3 * size[s]
            left -= target[s]
        open_ -= over
    return size, target


def check(got, data):
    size, target = brute_targets(data)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], words(r[1])) for r in data)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[r.source] += r.taken
    longest = max((r.size for r in got), default=0)
    assert all(abs(taken[s] - target[s]) <= longest for s in size)
    assert sum(taken.values()) <= sum(size.values())


def test_against_brute_force(spark):
    got = fair_queue_mix(frame(spark), Scratch(spark, "t")).collect()
    check(got, rows())
    again = fair_queue_mix(frame(spark).repartition(3), Scratch(spark, "t")).collect()
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in again)


def test_documents_and_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = fair_queue_mix(docs, Scratch(spark, "t")).collect()
    check(got, [tuple(r) for r in docs.collect()])
    out = mixed_documents(docs, Scratch(spark, "t"))
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({r.doc_id: r.taken // r.size for r in got if r.taken})


def test_equal_rows_and_one_tiny_source(spark):
    data = [(1, "a b c", None, "x", 0)] * 3 + [(2, "d " * 500, None, "y", 0), (3, "e " * 400, None, "y", 0), (4, "f", None, None, 0)]
    got = fair_queue_mix(frame(spark, data), Scratch(spark, "t")).collect()
    check(got, data)
    out = mixed_documents(frame(spark, data), Scratch(spark, "t"))
    assert sum(words(r.text) for r in out.collect()) == sum(r.taken for r in got)


def test_rows_that_share_id_and_text(spark):
    """Copies go to the rows of the source that the queue took them for."""
    big = [(100 + i, "w " * 50, None, "big", 0) for i in range(20)]
    data = [(1, "the same text", None, "big", 0), (1, "the same text", None, "small", 0), (1, "the same text", "xx", "small", 0), *big]
    got = fair_queue_mix(frame(spark, data), Scratch(spark, "t")).collect()
    check(got, data)
    want = Counter()
    for r in got:
        want[r.doc_id, r.source] += r.copies
    out = mixed_documents(frame(spark, data), Scratch(spark, "t")).collect()
    again = mixed_documents(frame(spark, data).repartition(3), Scratch(spark, "t")).collect()
    assert Counter((r.doc_id, r.source) for r in out) == +want
    assert Counter(out) == Counter(again)


def test_one_row_repeated_and_many_sources(spark):
    data = [(7, "x y", "en", "hot", 3)] * 9000 + [(None, None, None, None, None)] * 50 + [(i, "a b c d", "en", f"host{i}", 7) for i in range(600)]
    got = fair_queue_mix(frame(spark, data), Scratch(spark, "t")).collect()
    check(got, data)
    assert len(got) == len(data)
    out = mixed_documents(frame(spark, data), Scratch(spark, "t"))
    assert Counter(r.source for r in out.select("source").collect()) == Counter({s: sum(r.copies for r in got if r.source == s) for s in {r.source for r in got if r.copies}})


def test_empty(spark):
    assert fair_queue_mix(frame(spark, []), Scratch(spark, "t")).count() == 0
    assert mixed_documents(frame(spark, []), Scratch(spark, "t")).count() == 0
