import math
from collections import defaultdict

import numpy as np
from fixtures import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from lineweave.llm import hnsw
from lineweave.llm.hnsw import Graph, _units, forest, linked, near_vectors, recall_audit
from lineweave.llm.shared import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, t=0.93):
    fit = [i for i, (v, e, lab) in enumerate(rows) if v is not None and lab is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    parent, links = {r[0]: r[0] for r in rows if r[0] is not None}, defaultdict(int)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    groups = defaultdict(list)
    for i in fit:
        groups[rows[i][2], len(rows[i][1])].append(i)
    for ids in groups.values():
        m = np.array([rows[i][1] for i in ids], np.float32).astype(float)
        m /= np.sqrt((m * m).sum(1, keepdims=True))
        for a, b in zip(*np.nonzero(m @ m.T >= t), strict=True):
            if a < b:
                i, j = ids[a], ids[b]
                links[i] += 1
                links[j] += 1
                x, y = find(rows[i][0]), find(rows[j][0])
                parent[max(x, y)] = min(x, y)
    for i, (v, _, _) in enumerate(rows):
        root = None if v is None else find(v)
        yield v, links[i], root, root is None or root == v


def sample():
    r = np.random.default_rng(0)
    out = []
    for i in range(260):
        v = r.normal(size=16) if i % 3 or not i else out[max(0, i - 9)][1] + r.normal(size=16) * 0.12
        out.append([i, np.asarray(v), i % 2])
    rows = [(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in out]
    rows += [(300 + i, rows[5][1], rows[5][2]) for i in range(6)]  # copies
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 16, 1), (403, [float("nan")] * 16, 1), (404, [float("inf")] + [0.0] * 15, 0), (405, [1.0] * 15 + [None], 0)]
    rows += [(406, rows[5][1], None), (407, rows[5][1][:8], 1), (None, rows[5][1], rows[5][2]), (408, [x * 1e-30 for x in rows[5][1]], rows[5][2]), (409, [-0.0, 1.0] + [0.0] * 14, 0), (410, [0.0, 1.0] + [0.0] * 14, 0)]
    return rows


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' rep", "1 shard")
    got = {r.vec_id: tuple(r) for r in near_vectors(df, Scratch(spark, "t")).collect()}
    assert got == {w[0]: w for w in brute(rows)}


def test_against_brute_force(spark):
    check(spark, sample())


def test_many_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD", 50)
    monkeypatch.setattr(hnsw, "BLOCK", 40)
    check(spark, sample())


def test_graph_recall_and_widening():
    r = np.random.default_rng(1)
    near = r.normal(size=32) + r.normal(size=(700, 32)) * 0.1  # one tight group larger than any first beam
    u = _units(np.concatenate([r.normal(size=(1500, 32)), near]).astype(np.float32))
    g = Graph(u)
    a, b, (audited, recall, beam) = linked(g, u, u, np.arange(len(u)), 0.93)
    true = int((u @ u.T >= 0.93).sum())
    assert audited >= 64 and recall == 1.0 and (beam == 0 or len(a) >= 0.99 * true)
    assert (np.einsum("ij,ij->i", u[a], u[b]) >= 0.93).all()


def test_a_failed_audit_compares_all_pairs():
    """Nodes without a path from the entry are found by the exact way."""
    r = np.random.default_rng(2)
    u = _units((r.normal(size=16) + r.normal(size=(300, 16)) * 0.05).astype(np.float32))
    g = Graph(u)
    for layer in g.near:
        layer[:] = -1
    a, b, (_, recall, beam) = linked(g, u, u, np.arange(300), 0.93)
    assert beam == 0 and recall < 1 and set(zip(a.tolist(), b.tolist(), strict=True)) == set(zip(*map(list, np.nonzero(u @ u.T >= 0.93)), strict=True))


@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), max_size=40))
@settings(max_examples=100, deadline=None)
def test_forest(pairs):
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for x, y in pairs:
            root[x] = root[y] = min(root[x], root[y])
    a, b = forest(np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {x: m for x, m in root.items() if m != x}


def test_double_precision(spark):
    """Vectors of doubles within 1e-9 of the threshold are judged as they are, not rounded."""
    r, rows, want = np.random.default_rng(3), [], {}
    for k in range(60):
        x = r.normal(size=8)
        y = r.normal(size=8)
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        c = 0.93 + (1e-9 if k % 2 else -1e-9) * r.uniform(0.1, 1)
        rows += [(2 * k, x.tolist(), k), (2 * k + 1, (c * x + math.sqrt(1 - c * c) * y).tolist(), k)]
        want[2 * k] = want[2 * k + 1] = k % 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {x.vec_id: x.n_links for x in near_vectors(df, Scratch(spark, "t")).collect()} == want


def test_links_of_a_dense_group_leave_as_counts_and_forest(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "BLOCK", 200)
    monkeypatch.setattr(hnsw, "BLOCKS", 4)
    r = np.random.default_rng(4)
    rows = [(i, (np.ones(8) + r.normal(size=8) * 0.02).tolist(), 0) for i in range(1200)]
    scratch = Scratch(spark, "t")
    got = near_vectors(spark.createDataFrame(rows, SCHEMA), scratch).collect()
    assert {x.n_links for x in got} == {1199} and {x.component_id for x in got} == {0}
    assert spark.read.parquet(f"{scratch.root}/links").count() < 10 * len(rows)
    audit = recall_audit(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t")).collect()
    assert len(audit) >= 4 and all(x.audited >= 12 and (x.recall == 1.0 or x.beam == 0) for x in audit)


def test_table_and_empty(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(spark, rows)
    assert near_vectors(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).collect() == []
