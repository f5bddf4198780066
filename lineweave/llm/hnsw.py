"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Every shard of a label is queried with all vectors of the label.  Beams widen until an audit of each
block of queries against brute force reaches the wanted recall, and a block that fails at the widest beam
is compared with the whole shard; cosines are verified in double precision on vectors as they came;
links leave a task as counts and as a forest, which are united into components.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, components

THRESHOLD = 0.93
SHARD = 20_000  # vectors in a graph, about
BLOCK = 2048  # queries searched and audited at once, and in a task, about; where there are more
BLOCKS = 32  # than so many blocks of a label, tasks take more queries, up to SHARD, and graphs travel less
LINKS = 12  # neighbours kept on upper layers, twice as many on the lowest
BUILD_BEAM, QUERY_BEAM = 48, 96
#: A block's audit takes the ids divisible by EVERY, and AUDIT queries at least; share of their links to find.
EVERY, AUDIT, RECALL = 100, 64, 1.0


class Graph:
    """A navigable small-world graph over unit vectors, built and searched in batches of numpy rows."""

    def __init__(self, unit: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 5):
        self.unit, self.links, n = np.ascontiguousarray(unit, np.float32), links, len(unit)
        r = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - r.random(n)) / np.log(links)).astype(int), 6)
        self.top = int(level.max(initial=0))
        self.near = [np.full((n, links if k else 2 * links), -1, np.int32) for k in range(self.top + 1)]
        self.entry = int(level.argmax()) if n else 0
        rest = r.permutation(n)
        rest = rest[rest != self.entry]
        at, step = 0, 1
        while at < len(rest):
            self._insert(rest[at : at + step], level, beam)
            at, step = at + step, min(256, step * 2)

    def _insert(self, batch: np.ndarray, level: np.ndarray, beam: int) -> None:
        q = self.unit[batch]
        entry = np.full((len(batch), 1), self.entry)
        mutual = q @ q.T
        np.fill_diagonal(mutual, -np.inf)
        for k in range(self.top, -1, -1):
            inside = level[batch] >= k
            if k == 0 or inside.any():
                ids, sims = self._beam(k, q, entry, beam)
                rows = np.flatnonzero(inside)
                own = np.where(inside[None, :], mutual[rows], -np.inf)
                ids_ = np.concatenate([ids[rows], np.broadcast_to(batch, own.shape)], 1)
                sims_ = np.concatenate([sims[rows], own], 1)
                best = np.argsort(-sims_, 1, kind="stable")[:, :beam]
                ids_, sims_ = np.take_along_axis(ids_, best, 1), np.take_along_axis(sims_, best, 1)
                ids_ = np.where(np.isfinite(sims_), ids_, -1)
                chosen = self._diverse(ids_, sims_, self.links)
                self.near[k][batch[rows], : chosen.shape[1]] = chosen
                self._back(k, batch[rows], chosen)
            else:
                ids, sims = self._beam(k, q, entry, 4)
            entry = np.where(ids[:, :4] >= 0, ids[:, :4], entry[:, :1])

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of candidates in falling similarity, those nearer to the node than to any chosen one; then the nearest."""
        v = self.unit[np.maximum(ids, 0)]
        among = v @ v.transpose(0, 2, 1)
        kept = np.zeros(ids.shape, bool)
        for j in range(ids.shape[1]):
            close = ((among[:, j, :] >= sims[:, j, None]) & kept).any(1)
            kept[:, j] = (ids[:, j] >= 0) & ~close & (kept.sum(1) < most)
        rank = np.where(kept, 0, np.where(ids >= 0, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
        first = np.argsort(rank, 1)[:, :most]
        return np.take_along_axis(ids, first, 1).astype(np.int32)

    def _back(self, k: int, nodes: np.ndarray, chosen: np.ndarray) -> None:
        """Add the reverse links; full lists are chosen anew."""
        near, most = self.near[k], self.near[k].shape[1]
        a, b = np.repeat(nodes, chosen.shape[1]), chosen.ravel()
        a, b = a[b >= 0], b[b >= 0]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        touched, first, count = np.unique(b, return_index=True, return_counts=True)
        for at in range(0, len(touched), 256):
            t, f, c = touched[at : at + 256], first[at : at + 256], count[at : at + 256]
            width = min(int(c.max()), 2 * most)
            new = np.full((len(t), width), -1, np.int64)
            for j in range(width):
                has = c > j
                new[has, j] = a[f[has] + j]
            ids = np.concatenate([near[t].astype(np.int64), new], 1)
            ids.sort(1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            ids[ids == t[:, None]] = -1
            sims = np.where(ids >= 0, np.matmul(self.unit[np.maximum(ids, 0)], self.unit[t][:, :, None])[:, :, 0], -np.inf)
            best = np.argsort(-sims, 1, kind="stable")[:, : 2 * most]
            ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
            near[t] = np.where((ids >= 0).sum(1, keepdims=True) > most, self._diverse(ids, sims, most), ids[:, :most])

    def _beam(self, k: int, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` best nodes of layer k for each query, from its entries, in falling similarity."""
        n, near = len(self.unit), self.near[k]
        rows = len(q)
        entry = np.sort(entry, 1)
        twin = np.zeros(entry.shape, bool)
        twin[:, 1:] = entry[:, 1:] == entry[:, :-1]
        ids, sims = np.full((rows, width), -1, np.int64), np.full((rows, width), -np.inf, np.float32)
        e = min(width, entry.shape[1])
        ids[:, :e] = np.where(twin, -1, entry)[:, :e]
        sims[:, :e] = np.where(ids[:, :e] >= 0, np.matmul(self.unit[entry[:, :e]], q[:, :, None])[:, :, 0], -np.inf)
        done = ids < 0
        seen = np.zeros((rows, n), bool)
        np.put_along_axis(seen, entry, True, 1)
        active, turn = np.arange(rows), max(2, width // 12)
        while len(active):
            open_ = np.where(done[active], -np.inf, sims[active])
            pick = np.argpartition(-open_, min(turn, width) - 1, 1)[:, :turn] if turn < width else np.broadcast_to(np.arange(width), open_.shape)
            good = np.isfinite(np.take_along_axis(open_, pick, 1))
            alive = good.any(1)
            active, pick, good = active[alive], pick[alive], good[alive]
            if not len(active):
                break
            chosen = np.where(good, ids[active[:, None], pick], 0)
            done[active[:, None], pick] = True
            ids_ = np.where(good[:, :, None], near[chosen], -1).reshape(len(active), -1).astype(np.int64)
            ids_.sort(1)
            void = (ids_ < 0) | seen[active[:, None], np.maximum(ids_, 0)]
            void[:, 1:] |= ids_[:, 1:] == ids_[:, :-1]
            width_ = int((~void).sum(1).max(initial=0))
            if not width_:
                continue
            front = np.argsort(void, 1, kind="stable")[:, :width_]
            ids_, void = np.take_along_axis(ids_, front, 1), np.take_along_axis(void, front, 1)
            r, c = np.nonzero(~void)
            seen[active[r], ids_[r, c]] = True
            s = np.full(ids_.shape, -np.inf, np.float32)
            s[r, c] = np.einsum("ij,ij->i", self.unit[ids_[r, c]], q[active[r]])
            all_ids, all_sims = np.concatenate([ids[active], ids_], 1), np.concatenate([sims[active], s], 1)
            all_done = np.concatenate([done[active], void], 1)
            best = np.argpartition(-all_sims, width - 1, 1)[:, :width]
            ids[active], sims[active], done[active] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_sims, all_done))
        order = np.argsort(-sims, 1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        return np.where(np.isfinite(sims), ids, -1), sims

    def at_least(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) found with similarity of ``least`` or more; a full beam is widened."""
        n, out = len(self.unit), []
        todo, width = np.arange(len(q)), min(beam, n)
        while len(todo) and n:
            again = []
            rows = max(8, min(256, (1 << 23) // max(n, width * 2 * self.links)))
            for at in range(0, len(todo), rows):
                some = todo[at : at + rows]
                entry = np.full((len(some), 1), self.entry)
                for k in range(self.top, 0, -1):
                    ids, _ = self._beam(k, q[some], entry, 4)
                    entry = np.where(ids >= 0, ids, entry[:, :1])
                ids, sims = self._beam(0, q[some], entry, width)
                full = (sims[:, -1] >= least) & (width < n)
                again.append(some[full])
                r, c = np.nonzero((sims >= least) & ~full[:, None])
                out.append(np.stack([some[r], ids[r, c]], 1))
            todo, width = np.concatenate(again), min(n, width * 4)
        pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        return pairs[:, 0], pairs[:, 1]


def _units(raw: np.ndarray) -> np.ndarray:
    wide = raw.astype(np.float64)
    wide /= np.abs(wide).max(1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(1, keepdims=True))


def _verified(unit: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    ok = [np.einsum("ij,ij->i", q[a[i : i + 65536]], unit[b[i : i + 65536]]) >= threshold for i in range(0, len(a), 65536)]
    ok = np.concatenate(ok) if ok else np.zeros(0, bool)
    return a[ok], b[ok]


def _every_link(unit: np.ndarray, q: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) by comparing all, a few queries at a time."""
    parts = []
    for i in range(0, len(q), 128):
        r, c = np.nonzero(q[i : i + 128] @ unit.T >= threshold - 1e-9)
        parts.append(_verified(unit, q, r + i, c, threshold))
    return tuple(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))


def linked(graph: Graph, unit: np.ndarray, q: np.ndarray, ids: np.ndarray, threshold: float, beam: int = QUERY_BEAM, recall: float = RECALL) -> tuple[np.ndarray, np.ndarray, tuple[int, float, int]]:
    """Verified pairs (query, node) with cosine >= threshold, and the audit: queries, recall, beam.

    Recall is the mean over audited queries with a link, so that no dense group hides the others.  Beams
    double until it is reached.  If the widest one, as large as the graph, does not reach it, all pairs
    are compared and the audit notes beam 0.
    """
    least, q32 = threshold - 1e-4, q.astype(np.float32)
    checked = np.union1d(np.flatnonzero(ids % EVERY == 0), np.arange(0, len(q), max(1, -(-len(q) // AUDIT))))
    i, j = _every_link(unit, q[checked], threshold)
    true = np.unique(checked[i] * len(unit) + j)
    links = np.bincount(true // len(unit), minlength=len(q))
    while True:
        a, b = _verified(unit, q, *graph.at_least(q32, least, beam), threshold)
        hits = np.bincount(true[np.isin(true, a * len(unit) + b)] // len(unit), minlength=len(q))
        share = float((hits[links > 0] / links[links > 0]).mean()) if len(true) else 1.0
        if share >= recall:
            return a, b, (len(checked), share, beam)
        if beam >= len(unit):
            return *_every_link(unit, q, threshold), (len(checked), share, 0)
        beam *= 2


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) that connect what the pairs (a, b) connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        least, new = np.minimum(label[x], label[y]), label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _pack(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _raw(rows: pd.DataFrame) -> np.ndarray:
    """The vectors in the element type of the column: single precision, or double for anything wider."""
    raw = np.stack(rows["embedding"].to_numpy())
    return raw if raw.dtype == np.float32 else raw.astype(np.float64)


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("rep")
    raw = _raw(rows)
    g = Graph(_units(raw))
    data = _pack(ids=rows["rep"].to_numpy(np.int64), copies=rows["copies"].to_numpy(np.int64), raw=raw, entry=np.array(g.entry), **{f"near{k}": x for k, x in enumerate(g.near)})
    first = rows.iloc[0]
    return pd.DataFrame({"label": [first["label"]], "dim": [first["dim"]], "shard": [first["shard"]], "blocks": [first["blocks"]], "graph": [data]})


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    first = rows.iloc[0]
    data = _pack(ids=rows["rep"].to_numpy(np.int64), raw=_raw(rows))
    return pd.DataFrame({"label": [first["label"]], "dim": [first["dim"]], "block": [first["block"]], "shards": [first["shards"]], "queries": [data]})


def _load(data: bytes) -> dict:
    return dict(np.load(io.BytesIO(data)))


FOUND = "what string, a long, b long, n long, recall double, beam int"


def _search(threshold: float):
    """Rows of one graph and one block: edges (a, b) of a forest, the copies ``n`` that query ``a`` links with,
    and audits of ``n`` queries (a: shard, b: block)."""

    def run(graphs: pa.Table, blocks: pa.Table) -> pa.Table:
        out = []
        if graphs.num_rows and blocks.num_rows:
            g, block = _load(graphs.column("graph")[0].as_py()), _load(blocks.column("queries")[0].as_py())
            graph, unit = Graph.__new__(Graph), _units(g["raw"])
            near = [g[f"near{k}"] for k in range(sum(x.startswith("near") for x in g))]
            graph.unit, graph.links, graph.near, graph.top, graph.entry = unit.astype(np.float32), near[0].shape[1] // 2, near, len(near) - 1, int(g["entry"])
            a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for at in range(0, len(block["ids"]), BLOCK):
                ids = block["ids"][at : at + BLOCK]
                i, j, (audited, recall, beam) = linked(graph, unit, _units(block["raw"][at : at + BLOCK]), ids, threshold)
                other = ids[i] != g["ids"][j]
                i, j = i[other], j[other]
                copies = np.zeros(len(ids), np.int64)
                np.add.at(copies, i, g["copies"][j])
                out += [("count", int(x), None, int(n), None, None) for x, n in zip(ids[copies > 0], copies[copies > 0], strict=True)]
                out.append(("audit", graphs.column("shard")[0].as_py(), blocks.column("block")[0].as_py(), audited, recall, beam))
                a, b = forest(np.concatenate([a, ids[i]]), np.concatenate([b, g["ids"][j]]))
            out += [("edge", x, y, None, None, None) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        names = ["what", "a", "b", "n", "recall", "beam"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32()]
        columns = zip(*out, strict=True) if out else [[]] * 6
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)

    return run


def _representatives(vectors: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    reps = rows.filter("fit").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    return rows, scratch.save(reps.withColumn("dim", F.size("embedding")), "reps")


def _found(reps: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    each = F.least(F.greatest(F.lit(BLOCK), F.col("n") / BLOCKS), F.lit(SHARD))
    counts = reps.groupBy("label", "dim").agg(F.count("*").alias("n")).select("label", "dim", F.ceil(F.col("n") / SHARD).alias("shards"), F.ceil(F.col("n") / each).alias("blocks"))
    spread = reps.join(counts, ["label", "dim"]).withColumns({"shard": F.pmod(F.xxhash64("rep"), F.col("shards")), "block": F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks"))})
    kind = dict(reps.dtypes)["label"]
    graphs = spread.groupBy("label", "dim", "shard").applyInPandas(_build, f"label {kind}, dim int, shard long, blocks long, graph binary")
    graphs = scratch.save(graphs, "graphs").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    blocks = spread.groupBy("label", "dim", "block").applyInPandas(_block, f"label {kind}, dim int, block long, shards long, queries binary")
    blocks = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    keys = ["label", "dim", "shard", "block"]
    found = graphs.select(*keys, "graph").groupBy(*keys).cogroup(blocks.select(*keys, "queries").groupBy(*keys)).applyInArrow(_search(threshold), FOUND)
    found = scratch.save(found, "links")
    scratch.drop("graphs")
    return found


def recall_audit(vectors: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (shard, block, audited, recall, beam): what the audit of each block of queries found.

    Audited are the vec_ids divisible by 100, and at least 64 queries a block.  beam is the one that the
    block's links were searched with, 0 where all pairs were compared since ``recall`` was too low.
    """
    _, reps = _representatives(vectors, scratch)
    return _found(reps, scratch, threshold).filter("what = 'audit'").select(F.col("a").alias("shard"), F.col("b").alias("block"), F.col("n").alias("audited"), "recall", "beam")


def near_vectors(vectors: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """Links and components of rows (vec_id, embedding, label) with equal labels and cosine >= threshold.

    Rows (vec_id, n_links, component_id, kept): n_links counts the other vectors linked directly,
    component_id is the smallest vec_id reachable, kept marks it.  Equal vectors of a label count once
    in the graphs and keep their number, so copies are never spread into pairs.

    A vector links with nothing if it or its label is null, it is empty or zero, or a component is null
    or not finite; so do vectors of different length.  Elements of any number type are compared in double
    precision as they are; a cosine equal to the threshold is a link.  A null vec_id has a null
    component_id and is kept.  Repeated rows are vectors of their own.  Very long vectors make larger
    graphs, of as many vectors.  An empty table gives no rows; other columns are not read.
    """
    rows, reps = _representatives(vectors, scratch)
    found = _found(reps, scratch, threshold)
    n_links = found.filter("what = 'count'").groupBy("a").agg(F.sum("n").alias("others"))
    classes = components(found.filter("what = 'edge'").select("a", "b"), scratch)
    named = reps.select("label", "embedding", "rep", "copies").join(n_links, F.col("rep") == F.col("a"), "left").join(classes, F.col("rep") == F.col("node"), "left")
    named = named.select("label", "embedding", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    linked_rows = rows.filter("fit").join(named, ["label", "embedding"]).select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = rows.filter("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
