import itertools
import re
from collections import Counter, defaultdict

from fixtures import frame, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lineweave.llm.packing import best_boundaries, pack_batches
from lineweave.llm.shared import Scratch, count_words


def test_boundaries_are_optimal():
    lengths, counts = [1, 3, 4, 9, 10, 30, 31, 90], [5, 1, 7, 2, 9, 1, 1, 1]

    def padded(ends):
        return sum(c * min(e for e in ends if e >= x) for x, c in zip(lengths, counts, strict=True))

    for k in range(1, 9):
        best = min(padded((*s, 90)) for n in range(k) for s in itertools.combinations(lengths[:-1], n))
        ends = best_boundaries(lengths, counts, k)
        assert len(ends) <= k and ends[-1] == 90 and padded(ends) == best
    assert best_boundaries([], [], 3) == []


def plain_optimum(lengths, counts, buckets):
    """Ends by the textbook recursion; ties go to the earliest boundary and the fewest buckets."""
    n, before = len(lengths), [0, *itertools.accumulate(counts)]
    cost = [{j: (lengths[j] * before[j + 1], None) for j in range(n)}]
    for k in range(1, min(buckets, n)):
        cost.append({j: min((cost[-1][i][0] + lengths[j] * (before[j + 1] - before[i + 1]), i) for i in range(k - 1, j)) for j in range(k, n)})
    k = min(range(len(cost)), key=lambda x: (cost[x][n - 1][0], x))
    j, out = n - 1, []
    while j is not None:
        out.append(lengths[j])
        j, k = cost[k][j][1], k - 1
    return out[::-1]


@given(st.dictionaries(st.integers(1, 30_000), st.integers(1, 50), min_size=1, max_size=60), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_exact_on_raw_lengths(histogram, buckets):
    lengths = sorted(histogram)
    counts = [histogram[x] for x in lengths]
    assert best_boundaries(lengths, counts, buckets) == plain_optimum(lengths, counts, buckets)


def test_ends_of_the_documents_are_the_optimum(spark):
    """No grid: lengths far above 256 are told apart."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = Counter(max(1, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.select("text").collect())
    lengths = sorted(sizes)
    got = pack_batches(docs, Scratch(spark, "t"), count_words(F.col("text"))).select("bucket_length").distinct().collect()
    assert sorted(r.bucket_length for r in got) == plain_optimum(lengths, [sizes[x] for x in lengths], 8)


def test_many_lengths():
    n = 200_000
    assert len(best_boundaries(list(range(1, n + 1)), [1] * n, 8)) == 8


def test_repeated_rows_and_carried_columns(spark):
    data = [(1, "a b c", "en", "x", 5)] * 5000 + [(None, None, None, None, None)] * 300 + [(2, "w " * 70_000, "en", "y", 1), (1, "a b c", "en", "z", 5)]
    got = pack_batches(frame(spark, data).withColumn("length", F.lit("clash")), Scratch(spark, "t"), count_words(F.col("text")), budget=300, carry=True).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(data)
    assert len({(r.bucket, r.batch, r.slot) for r in got}) == len(got) and {r.node for r in got} == {None}
    assert all(r.length == len((r.text or "").split()) <= r.bucket_length for r in got)


def test_batches(spark):
    docs = frame(spark)
    got = pack_batches(docs, Scratch(spark, "t"), count_words(F.col("text")), budget=500, buckets=4).collect()
    assert len(got) == len(rows())
    batches = defaultdict(list)
    for r in got:
        assert r.padding == r.bucket_length - r.length >= 0
        batches[r.bucket, r.batch].append(r)
    ends = {r.bucket: r.bucket_length for r in got}
    for (bucket, batch), members in batches.items():
        room = max(1, 500 // ends[bucket])
        assert len(members) <= room and sorted(m.slot for m in members) == list(range(len(members)))
        assert len(members) == room or (bucket, batch + 1) not in batches
    for r in got:
        assert all(e >= ends[r.bucket] or e < r.length for e in ends.values())
    again = pack_batches(docs.repartition(3), Scratch(spark, "t"), count_words(F.col("text")), budget=500, buckets=4).collect()
    assert Counter(got) == Counter(again)


def test_null_lengths_and_empty(spark):
    docs = frame(spark)
    assert pack_batches(docs, Scratch(spark, "t"), F.lit(None).cast("long")).filter("length = 0 and bucket_length = 1").count() == len(rows())
    assert pack_batches(docs.limit(0), Scratch(spark, "t"), F.col("n_chars")).collect() == []
