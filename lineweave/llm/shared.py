"""Scratch tables, prefix sums over skewed groups and connected components on DataFrames."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: One word of the whitespace definition used here: anything but space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Parquet tables in the shared folder of ``spark.checkpoint.dir``, used to cut lineage.

    Written tables survive the loss of executors.  A local session without the setting, as in tests,
    gets a temporary folder; on a cluster, whose machines share no such folder, a missing setting is an
    error.  A result may read tables of its scratch until it is written; ``close`` then deletes them all.
    """

    _lock, _writers, _before = threading.Lock(), 0, "false"

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            base = f"file://{tempfile.gettempdir()}/lineweave-scratch"
        self.spark, self.root = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        for made in getattr(_LOCAL, "made", []):
            made.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        self._cleaning(1)  # the shuffle files of the write go when it ends
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            self._cleaning(-1)
        return self.spark.read.schema(df.schema).parquet(path)

    def _cleaning(self, step: int) -> None:
        """Turn the setting on with the first writer of the process and back with the last."""
        conf = self.spark.conf
        with Scratch._lock:
            if step > 0 and not Scratch._writers:
                Scratch._before = conf.get(CLEANUP, "false")
                conf.set(CLEANUP, "true")
            Scratch._writers += step
            if step < 0 and not Scratch._writers:
                conf.set(CLEANUP, Scratch._before)

    def drop(self, *names: str) -> None:
        """Delete tables that no returned DataFrame reads any more."""
        for name in names:
            self._delete(f"{self.root}/{name}")

    def close(self) -> None:
        """Delete all tables; nothing that reads them can be used any more."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_LOCAL = threading.local()


@contextlib.contextmanager
def passing():
    """Close every scratch that is opened inside, once what reads it has been written elsewhere."""
    outer, made = getattr(_LOCAL, "made", []), []
    _LOCAL.made = [*outer, made]
    try:
        yield
    finally:
        _LOCAL.made = outer
        for scratch in made:
            scratch.close()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def count_words(text: Column) -> Column:
    """Number of words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, text: Column, seed: str) -> Column:
    """A hexadecimal pseudo-random sort key that any SQL engine with md5 reproduces.

    The text takes part, so rows that share a doc_id, or have none, spread like others.
    """
    own = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), own).cast("binary"))


def quoted(name: str) -> Column:
    """A column by its whole name, which may hold dots and backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(docs: DataFrame) -> Column:
    """All columns of docs in one, so that no name of theirs meets one of an operator's; ``row.*`` gives them back."""
    return F.struct(*[quoted(c).alias(c) for c in docs.columns]).alias("row")


def exact_form(value: Column, kind: T.DataType) -> Column:
    """Text that differs wherever values of a type do: timestamps to the microsecond, binaries as hex, nested
    values part by part with their lengths.  Null gives null; maps are read in the order they are stored."""

    def part(x: Column, of: T.DataType) -> Column:
        text = exact_form(x, of)
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("n"))

    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, T.BinaryType):
        return F.hex(value)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("string")
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(value, lambda x: part(x, kind.elementType)), "")
    if isinstance(kind, T.MapType):
        return F.array_join(F.transform(F.map_entries(value), lambda x: F.concat(part(x["key"], kind.keyType), part(x["value"], kind.valueType))), "")
    if isinstance(kind, T.StructType):
        inner = F.concat(F.lit(""), *[part(value.getField(f.name), f.dataType) for f in kind])
        return F.when(value.isNotNull(), inner)
    return F.to_json(value) if isinstance(kind, T.VariantType) else value.cast("string")


def row_key(docs: DataFrame, seed: str) -> Column:
    """``shuffle_key`` followed by 128 bits of the SHA-256 of all columns: equal for equal rows only."""
    parts = [exact_form(quoted(f.name), f.dataType) for f in docs.schema]
    whole = [F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("n")) for x in parts]
    return F.concat(shuffle_key(F.col("doc_id"), F.col("text"), seed), F.left(F.sha2(F.concat(*whole), 256), F.lit(32)))


def repeated(df: DataFrame, times: Column, out: str, step: int = 4096) -> DataFrame:
    """Each row ``times`` times, numbered from 0 in ``out``; no array holds more than ``step`` numbers or blocks of them."""
    counted = df.withColumn("_times", times.cast("long")).filter("_times > 0")
    blocks = counted.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_times - 1) div {step}"))))
    first = F.col("_block") * step
    return blocks.withColumn(out, F.explode(F.sequence(first, F.least(F.col("_times") - 1, first + (step - 1))))).drop("_times", "_block")


def running_sum(df: DataFrame, group: list[str], cell: Column, order: list[Column], value: str, out: str) -> DataFrame:
    """Add ``out``, the running sum of the whole numbers ``value`` in each group, in cells of bounded size.

    ``cell`` is monotone in ``order`` and cuts a group into slices, so that a group holding a third of
    all rows is summed by many tasks: slices are summed first, their sums are accumulated (a small
    table), and each slice is accumulated on its own from there.
    """
    cut = df.withColumn("_cell", cell)
    keys = [*group, "_cell"]
    sums = cut.groupBy(*keys).agg(F.sum(value).alias("_in"))
    over = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = sums.withColumn("_before", F.sum("_in").over(over.orderBy("_cell")) - F.col("_in")).drop("_in")
    mine, theirs = cut.alias("m"), before.alias("b")
    same = [F.col(f"m.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    on = same[0]
    for c in same[1:]:
        on = on & c
    local = F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = mine.join(theirs, on, "left").select("m.*", "b._before")
    return joined.withColumn(out, (F.col("_before") + local).cast("long")).drop("_cell", "_before")


def in_ranges(df: DataFrame, order: list[Column], scratch: Scratch, name: str, out: str = "cell") -> DataFrame:
    """A table of df with ``out``, the number of its range in ``order``: a cell for ``running_sum``."""
    return scratch.save(df.repartitionByRange(*order).withColumn(out, F.spark_partition_id()), name)


def _contract(batches):
    """Replace the edges of a partition by a spanning forest of stars."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["a", "b"])


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, component), component the smallest node.

    Large-star and small-star steps alternate until nothing changes, each on a written table; edges of
    a partition are first contracted to a forest, so cliques of copies shrink before any shuffle.
    Nodes without an edge are absent.
    """
    pairs = edges.select(F.col(edges.columns[0]).cast("long").alias("a"), F.col(edges.columns[1]).cast("long").alias("b"))
    pairs = pairs.filter("a is not null and b is not null and a <> b")
    now = scratch.save(pairs.mapInArrow(_contract, "a long, b long"), f"{name}0")

    def star(e: DataFrame, large: bool) -> DataFrame:
        """Edges (node, smaller node) after linking the neighbours of each node to its smallest one."""
        if large:
            e = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        linked = e.join(least, "a")
        if large:
            return linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        to_least = linked.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return to_least.unionByName(least.select("a", F.col("m").alias("b"))).distinct()

    seen, step = None, 0
    while True:
        step += 1
        after = scratch.save(star(star(now, True), False), f"{name}{step}")
        scratch.drop(f"{name}{step - 1}")
        now = after
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    # Every node now points at the root of its star.
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


# --- bytes of Arrow string columns in numpy ---------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = np.uint64(0xD1342543DE82EF95)


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def pieces(batch: pa.RecordBatch, limit: int = 2 << 20):
    """Slices of a batch of at most ``limit`` bytes of its column ``text`` (one row at least)."""
    ends = np.cumsum(np.diff(text_bytes(batch.column("text"))[1]))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the row offsets in them; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, where, data = col.buffers()
    off = np.frombuffer(where, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def spans_where(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of True that do not cross row offsets: their starts and ends."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that are sorted, disjoint and not empty."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    inner = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    value = BYTE_CODE[data[inner + np.repeat(start, size)]] * powers(int(size.max()))[inner]
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive values (one result for each start that has n)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    p = powers(n, np.uint64(0xA0761D6478BD642F))
    out = h[: len(h) - n + 1] * p[0]
    for j in range(1, n):
        out = out + h[j : len(h) - n + 1 + j] * p[j]
    return mix(out)
