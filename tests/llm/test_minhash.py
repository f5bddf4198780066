import random
import re
from collections import Counter

import pytest
from fixtures import SF, frame, rows

from lineweave.llm import minhash
from lineweave.llm.minhash import half_keys, keep_one_of_each, near_duplicate_classes
from lineweave.llm.shared import Scratch


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or {tuple(words)}


def brute(data, n, num, den):
    sets = [shingles(r[1], n) for r in data]
    parent = {r[0]: r[0] for r in data if r[0] is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    both = Counter()
    for ids in where.values():
        both.update((i, j) for a, i in enumerate(ids) for j in ids[a + 1 :])
    for (i, j), k in both.items():
        if data[i][0] is not None and data[j][0] is not None and den * k >= num * (len(sets[i]) + len(sets[j]) - k):
            a, b = find(data[i][0]), find(data[j][0])
            parent[max(a, b)] = min(a, b)
    for r, s in zip(data, sets, strict=True):
        root = None if r[0] is None else find(r[0])
        yield r[0], len(s), root, root is None or root == r[0]


@pytest.mark.parametrize(("n", "num", "den"), [(3, 85, 100), (5, 80, 100)])
def test_against_brute_force(spark, n, num, den):
    got = Counter(map(tuple, near_duplicate_classes(frame(spark), Scratch(spark, "t"), n, num, den).collect()))
    assert got == Counter(brute(rows(), n, num, den))


def test_blocks_of_a_large_cluster(spark, monkeypatch):
    """Near copies in a chain and a star, cut into blocks of a few documents."""
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 5)
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(150)]
    data = []
    for i in range(60):
        copy = list(base)
        for _ in range(r.randint(0, 5)):
            copy[r.randrange(150)] = word()
        data.append((i, " ".join(copy), None, None, 0))
    chain = [word() for _ in range(120)]
    for i in range(60, 90):
        chain = [*chain[2:], word(), word()]
        data.append((i, " ".join(chain), None, None, 0))
    got = Counter(map(tuple, near_duplicate_classes(frame(spark, data), Scratch(spark, "t"), 3, 85, 100).collect()))
    assert got == Counter(brute(data, 3, 85, 100))


@pytest.mark.parametrize("exact", [False, True])
def test_a_hot_half_key(spark, monkeypatch, exact):
    """Many documents around one template meet in tables; most are linked, some only to a few, some to none."""
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 8)
    monkeypatch.setattr(minhash, "HUBS", 1)
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base, data = [word() for _ in range(140)], []
    for i in range(160):
        copy = list(base)
        for _ in range((1, 4, 9, 14)[i % 4]):
            copy[r.randrange(140)] = word()
        data.append((i, " ".join(copy), None, None, 0))
    data += [(1000 + i, data[i][1] + " " + word(), None, None, 0) for i in range(0, 160, 7)]
    scratch = Scratch(spark, "t")
    got = Counter(map(tuple, near_duplicate_classes(frame(spark, data), scratch, 3, 85, 100, exact).collect()))
    want = Counter(brute(data, 3, 85, 100))
    assert got == want and 3 < len({w[2] for w in want}) < len(data)


def test_one_row_of_a_doc_id_stays_whatever_the_order(spark):
    data = [(1, "a b c d e f g", "en", "x", 1), (1, "q r s t u v w", "en", "y", 2), (1, "a b c d e f g", "fr", "x", 1), (None, None, None, None, None), (None, None, None, None, None), (2, "long " * 40_000, "en", "z", 3)]
    one = Counter(keep_one_of_each(frame(spark, data), Scratch(spark, "t")).collect())
    assert one == Counter(keep_one_of_each(frame(spark, data[::-1]).repartition(3), Scratch(spark, "t")).collect())
    assert sorted((r.doc_id or 0) for r in one.elements()) == [0, 0, 1, 2]


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    data = [tuple(r) for r in docs.collect()]
    want = list(brute(data, 5, 80, 100))
    assert Counter(map(tuple, near_duplicate_classes(docs, Scratch(spark, "t")).collect())) == Counter(want)
    kept = keep_one_of_each(docs, Scratch(spark, "t"))
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(w[0] for w in want if w[3])


def test_repeated_rows_and_empty(spark):
    kept = keep_one_of_each(frame(spark), Scratch(spark, "t"))
    ids = Counter(r.doc_id for r in kept.collect())
    assert max(ids.values()) == 1 and set(ids) == {r[0] for r in brute(rows(), 5, 80, 100) if r[3]}
    assert near_duplicate_classes(frame(spark, []), Scratch(spark, "t")).collect() == []


def test_recall_parameters():
    for num in (80, 85, 95):
        m, p = half_keys(num, 100), (num / 100) ** minhash.ROWS
        assert (1 - (1 - p) ** m) ** 2 >= 1 - minhash.MISS


def test_audit(spark):
    """The audit counts the links of its ids by brute force, and notices a class that is torn apart."""
    r = random.Random(7)
    base = [[f"{k}w{r.randrange(10**6)}" for _ in range(120)] for k in range(30)]
    data = [(i, " ".join(w if r.random() < 0.995 else "x" for w in base[i % 30]), None, None, 0) for i in range(300)] + [(None, "a b c", None, None, 0), (301, None, None, None, 0), (310, " ", None, None, 0)]
    docs = frame(spark, data)
    classes = near_duplicate_classes(docs, Scratch(spark, "t"), 3, 85, 100)
    sets = {d[0]: shingles(d[1], 3) for d in data if d[0] is not None}
    want = sum(a % 10 == 0 and a != b and bool(x) and 100 * len(x & y) >= 85 * len(x | y) for a, x in sets.items() for b, y in sets.items())
    row = minhash.audit_recall(docs, classes, Scratch(spark, "t"), 3, 85, 100, every=10).first()
    assert (row.links, row.found, row.recall) == (want, want, 1.0) and want > 50
    torn = classes.selectExpr("doc_id", "if(doc_id < 150, component_id, doc_id) component_id")
    assert minhash.audit_recall(docs, torn, Scratch(spark, "t"), 3, 85, 100, every=10).first().recall < 0.8
    assert minhash.audit_recall(docs.limit(0), classes.limit(0), Scratch(spark, "t"), 3, 85, 100).first().links == 0
