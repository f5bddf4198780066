"""Token ids in a compact binary form: static-range asymmetric numeral systems over shared tables.

All ids of a corpus share one frequency table.  Ids stand in ascending doc_id order, in blocks of
whole documents.  A block is coded by interleaved 64-bit states (lanes) that emit 32-bit words; every
STRIDE steps the encoder notes all states and the word position, so a block decodes from each
checkpoint at once.  Blocks are rows of a Parquet dataset beside the table, each with checksums, so
any store and any Spark reader serves them and a lost task rewrites only its blocks.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, pieces, running_sum

SCALE = 20  # frequencies sum to 2 ** SCALE
LANES = 1024
STRIDE = 256  # steps between checkpoints
BLOCK = LANES * STRIDE * 4  # ids in a block, at least
LOW = np.uint64(1 << 31)

BLOCK_SCHEMA = (
    "part int, block long, n_ids long, crc32 long, doc_ids array<long>, doc_sizes array<long>, "
    "states binary, positions array<long>, words binary"
)


# --- coder -------------------------------------------------------------------------------------------


def scaled(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2 ** scale, at least 1 for every symbol that occurs."""
    total, size = int(counts.sum()), 1 << scale
    if not total:
        return np.zeros(len(counts), np.uint32)
    freq = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) * size / total), 0).astype(np.int64)
    rest = size - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    if rest > 0:
        freq[order[0]] += rest
    while rest < 0:
        cut = order[freq[order] > 1]
        if not len(cut):
            raise ValueError("more symbols than the table has room for")
        take = np.minimum(freq[cut] - 1, np.maximum(1, -rest * freq[cut] // size))
        fits = np.cumsum(take) <= -rest
        freq[cut[fits]] -= take[fits]
        rest = size - int(freq.sum())
    return freq.astype(np.uint32)


def encode_block(ids: np.ndarray, freq: np.ndarray, first: np.ndarray) -> tuple[bytes, list[int], bytes]:
    """States at the checkpoints, word positions there, and the words.  ids: one block."""
    steps = -(-len(ids) // LANES)
    grid = np.full(steps * LANES, -1, np.int64)
    grid[: len(ids)] = ids
    grid = grid.reshape(steps, LANES)
    state = np.full(LANES, LOW, np.uint64)
    out, states, positions, n = [], [], [], 0
    shift, word = np.uint64(63 - SCALE), np.uint64(32)
    scale = np.uint64(1 << SCALE)
    for low in range((steps - 1) // STRIDE * STRIDE, -1, -STRIDE):
        top = min(low + STRIDE, steps)
        syms = grid[low:top]
        f_ = freq[syms]
        full_at, jump, start = f_ << shift, scale - f_, first[syms]
        for t in range(top - low - 1, -1, -1):
            row = syms[t]
            live = slice(0, LANES) if row[-1] >= 0 else slice(0, int((row >= 0).sum()))
            x = state[live]
            full = x >= full_at[t, live]
            words = x[full]
            if len(words):
                out.append(words.astype(np.uint32))  # the lower half
                n += len(words)
                x[full] = words >> word
            # (q << SCALE) + (x - q * f) + first
            q = x // f_[t, live]
            q *= jump[t, live]
            x += q
            x += start[t, live]
        states.append(state.copy())
        positions.append(n)
    stream = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
    # The decoder reads forward: positions from the front, checkpoints in step order.
    return np.array(states[::-1], np.uint64).tobytes(), [n - p for p in positions[::-1]], stream.astype("<u4").tobytes()


def decode_block(n_ids: int, states: bytes, positions: list[int], words: bytes, freq: np.ndarray, first: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The ids of a block; all its checkpoints are decoded side by side."""
    if not n_ids:
        return np.zeros(0, np.uint32)
    x = np.frombuffer(states, np.uint64).reshape(-1, LANES).copy()
    stream = np.frombuffer(words, "<u4").astype(np.uint64)
    stream = np.concatenate([stream, np.zeros(LANES, np.uint64)])
    parts, at = len(x), np.array(positions, np.int64)
    grid = np.zeros((parts, STRIDE, LANES), np.uint32)
    places = np.arange(parts)[:, None] * STRIDE * LANES + np.arange(LANES)[None, :]
    word, scale, mask = np.uint64(32), np.uint64(SCALE), np.uint64((1 << SCALE) - 1)
    for t in range(STRIDE):
        slot = x & mask
        sym = symbol[slot]
        grid[:, t, :] = sym
        new = freq[sym]
        new *= x >> scale
        new += slot
        new -= first[sym]
        low = new < LOW
        if int(places[-1, -1]) + t * LANES >= n_ids:
            live = places + t * LANES < n_ids
            new, low = np.where(live, new, x), low & live
        x = new
        # lanes of a step were emitted together, in lane order
        count = low.sum(1)
        before = np.cumsum(count) - count
        where = np.arange(int(count.sum())) + np.repeat(at - before, count)
        x[low] = (x[low] << word) | stream[np.minimum(where, len(stream) - 1)]
        at += count
    return grid.reshape(-1)[:n_ids]


@functools.lru_cache(2)
def _tables(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    freq = np.frombuffer(data, np.uint32).astype(np.uint64)
    first = np.cumsum(freq) - freq
    return freq, first, np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))


# --- tokenizer ---------------------------------------------------------------------------------------

#: Bytes of text that a worker encodes at once (one text at least).
ENCODE_BYTES = 1 << 20


#: Longer texts are left to the tokenizer's own cut: one queue of merges would take too much memory.
WHOLE_CHARS = 1 << 17

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")


@functools.lru_cache(1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Merger:
    """The tokenizer of a byte-level file without its cut into words: merges run over the whole text.

    The library copies each word of a text with all its offsets before it merges it, which costs more than
    the merges.  Merges go by rank, so words have the same ids in a merged text as alone if no merge went
    across a word's end.  Pieces only grow: none did if every word's end is the end of an id.  Texts for
    which this does not hold are left to the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Regex, normalizers, pre_tokenizers

        own = _tokenizer(path)
        self.tokenizer = type(own).from_str(own.to_str())
        # Of several white space characters the last stands apart; vocabularies hold them together.
        gaps, self.whole = pre_tokenizers.Split(Regex(r"\s+(?!\S)"), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.gaps = pre_tokenizers.Sequence([gaps, self.whole])
        self.added = [t.content for t in own.get_added_tokens_decoder().values()]
        vocab = own.get_vocab()
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of an id: one character each
        for token, i in vocab.items():
            self.width[i] = len(token)
        # Classes of code points are the library's own.
        self.kinds = [(kind, normalizers.Replace(Regex(p), "\0")) for kind, p in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s"))]
        self.known = np.zeros(0x110000, np.uint8)
        self.known[0] = OTHER
        self._learn(np.arange(1, 128, dtype=np.uint32))

    @staticmethod
    def fits(path: str) -> bool:
        """Whether the file has byte-level words by the library's own pattern and plain merges."""
        d = json.loads(_tokenizer(path).to_str())
        cut, model = d["pre_tokenizer"] or {}, d["model"]
        odd = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        return (
            (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) == ("ByteLevel", False, True)
            and model["type"] == "BPE" and not any(model.get(k) for k in odd)
            and not any(d[k] for k in ("normalizer", "post_processor", "truncation", "padding"))
        )

    def _learn(self, points: np.ndarray) -> None:
        text = points.astype("<u4").tobytes().decode("utf-32-le")
        self.known[points] = OTHER
        for kind, mark in self.kinds:
            hit = np.frombuffer(mark.normalize_str(text).encode("utf-32-le"), "<u4") == 0
            self.known[points[hit]] = kind

    def word_starts(self, points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a word of the library's byte-level pattern starts at a code point, and whether inside white space; first: a text does."""
        kind = self.known[points]
        if not kind.all():
            self._learn(np.unique(points[kind == 0]))
            kind = self.known[points]
        gap, blank = kind == SPACE, points == 32
        out = first.copy()
        out[1:] |= kind[1:] != kind[:-1]
        out[1:] &= first[1:] | gap[1:] | ~blank[:-1]  # a blank goes with what follows
        apart = np.zeros(len(points), bool)
        apart[1:-1] = gap[1:-1] & gap[:-2] & ~gap[2:] & ~first[1:-1] & ~first[2:]
        out |= apart
        at = np.flatnonzero(points == 39)
        if len(at):
            texts = np.append(np.flatnonzero(first), len(points))
            end = texts[np.searchsorted(texts, at, "right")]
            alone = first[at] | ~((kind[at - 1] == OTHER) | blank[at - 1])
            for i, to in zip(at[alone].tolist(), end[alone].tolist(), strict=True):
                tail = "".join(map(chr, points[i + 1 : min(i + 3, to)].tolist()))
                size = next((len(c) for c in CONTRACTIONS if tail.startswith(c)), 0)
                if size:
                    out[i + 1 : i + 1 + size] = False
                    out[i + 1 + size : i + 2 + size] = True
        return out, apart

    def ids(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of each text, None where they are not certain to be the tokenizer's."""
        points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        chars = np.cumsum([0, *map(len, texts)])
        first = np.zeros(len(points), bool)
        first[chars[:-1][np.diff(chars) > 0]] = True
        starts, apart = self.word_starts(points, first)

        def texts_at(places):
            return np.unique(np.searchsorted(chars, places, "right") - 1)

        out: list = [None] * len(texts)
        gapped = texts_at(np.flatnonzero(apart))
        for cut, some in ((self.gaps, gapped), (self.whole, np.setdiff1d(np.arange(len(texts)), gapped))):
            self.tokenizer.pre_tokenizer = cut
            for i, own in zip(some.tolist(), _ids(self.tokenizer, [texts[i] for i in some]), strict=True):
                out[i] = own
        at = np.zeros(len(points) + 1, np.int64)  # of each code point in bytes
        np.cumsum(1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000), out=at[1:])
        ends = np.append(0, np.cumsum(self.width[np.concatenate(out)]))
        if (ends[np.cumsum([0, *map(len, out)])] != at[chars]).any():
            return [None] * len(texts)  # some byte has no id
        cut = np.zeros(len(at) + int(at[-1]), bool)
        cut[ends] = True
        for i in texts_at(np.flatnonzero(starts & ~cut[at[:-1]])).tolist():
            out[i] = None
        return out


@functools.lru_cache(1)
def _merger(path: str) -> Merger | None:
    return Merger(path) if Merger.fits(path) else None


def _ids(tokenizer, texts: list[str]) -> list[np.ndarray]:
    return [np.array(array("I", e.ids), np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def encode_texts(path: str, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text, encoded whole by the tokenizer; see `Merger`."""
    merger = _merger(path)
    if merger is None:
        return _ids(_tokenizer(path), texts)
    out: list = [None] * len(texts)
    plain = [i for i, x in enumerate(texts) if len(x) <= WHOLE_CHARS and not any(a in x for a in merger.added)]
    for i, own in zip(plain, merger.ids([texts[i] for i in plain]) if plain else [], strict=True):
        out[i] = own
    rest = [i for i, x in enumerate(out) if x is None]
    for i, own in zip(rest, _ids(_tokenizer(path), [texts[i] for i in rest]) if rest else [], strict=True):
        out[i] = own
    return out


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Rows (doc_id, n_tokens, width, ids): ids as little-endian binary of 2 bytes each if all fit, else 4.

    The tokenizer reads every text whole, without special tokens added; ``end_id`` follows each text.
    """

    def run(batches):
        for batch in batches:
            for part in pieces(batch, ENCODE_BYTES):
                ids = [np.append(x, np.uint32(end_id)) for x in encode_texts(tokenizer_path, [text or "" for text in part.column("text").to_pylist()])]
                wide = [int(x.max()) >= 65536 for x in ids]
                data = [x.astype("<u4" if w else "<u2").tobytes() for x, w in zip(ids, wide, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([4 if w else 2 for w in wide], pa.int32()), pa.array(data, pa.binary())],
                    ["doc_id", "n_tokens", "width", "ids"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, width int, ids binary")


def _unpack(ids: bytes, width: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if width == 2 else "<u4").astype(np.uint32)


# --- writing and reading -------------------------------------------------------------------------------


def write_ans(docs: DataFrame, path: str, tokenizer_path: str, scratch: Scratch, end_id: int = 0) -> None:
    """Encode docs (doc_id, text) to ``path``: datasets ``table`` (symbol, count) and ``blocks``.

    Ids stand in ascending doc_id order, null doc_ids first; rows with equal doc_ids are ordered by
    their ids' bytes.  Null and empty texts hold the end id alone.  An empty input gives empty datasets.
    Special tokens inside a text become their ids, as the tokenizer does by default.  A text is never cut:
    a very long one is encoded in one call and makes one block larger than the others.  Other columns of
    docs, whatever their names, are not read.
    """
    spark = docs.sparkSession
    rows = scratch.save(token_table(docs, tokenizer_path, end_id), "tokens")

    def tally(batches):
        count = np.zeros(1 << 16, np.int64)
        for batch in batches:
            data, width = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for w in (2, 4):
                own = np.bincount(_unpack(b"".join(data[i] for i in np.flatnonzero(width == w)), w))
                if len(own) > len(count):
                    count = np.concatenate([count, np.zeros(len(own) - len(count), np.int64)])
                count[: len(own)] += own
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(count[seen])], ["symbol", "count"])

    # One row per symbol of the vocabulary: bounded by the tokenizer, not by the corpus.
    rows.select("ids", "width").mapInArrow(tally, "symbol long, count long").groupBy("symbol").agg(F.sum("count").alias("count")).coalesce(1).write.parquet(f"{path}/table")
    freq = _frequencies(spark, path)

    def encode(batches):
        freq_, first, _ = _tables(freq)
        part, block, held, n = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            ids = np.concatenate([x for _, x in held])
            states, positions, words = encode_block(ids.astype(np.int64), freq_, first)
            row = {
                "part": part, "block": block, "n_ids": len(ids), "crc32": zlib.crc32(ids.astype("<u4").tobytes()), "doc_ids": [d for d, _ in held],
                "doc_sizes": [len(x) for _, x in held], "states": states, "positions": positions, "words": words,
            }
            return pa.RecordBatch.from_pylist([row], schema=BLOCK_ARROW)

        for batch in batches:
            for d, data, width in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "width")), strict=True):
                held.append((d, _unpack(data, width)))
                n += len(held[-1][1])
                if n >= BLOCK:
                    yield flush()
                    block, held, n = block + 1, [], 0
        if held:
            yield flush()

    by_id = F.col("doc_id").asc_nulls_first()
    ordered = rows.repartitionByRange(by_id).sortWithinPartitions(by_id, "n_tokens", "ids")
    ordered.select("doc_id", "ids", "width").mapInArrow(encode, BLOCK_SCHEMA).write.parquet(f"{path}/blocks")
    scratch.drop("tokens")


def read_ans(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) and, if asked for, ``ids array<int>``, decoded from the files.

    ``start`` counts the ids of all documents before.  A block whose checksum differs raises.
    """
    freq = _frequencies(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = running_sum(blocks.select("part", "block", "n_ids"), [], F.col("part"), [F.col("block")], "n_ids", "to")
    blocks = blocks.join(sizes.select("part", "block", (F.col("to") - F.col("n_ids")).alias("start")), ["part", "block"])

    def decode(batches):
        tables = _tables(freq)
        for batch in batches:
            for row in range(batch.num_rows):
                r = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                ids = decode_block(r["n_ids"], r["states"], r["positions"], r["words"], *tables).astype("<u4")
                if zlib.crc32(ids.tobytes()) != r["crc32"]:
                    raise ValueError(f"block {r['part']}/{r['block']} is damaged")
                ends = np.cumsum(r["doc_sizes"])
                own = np.split(ids, ends[:-1])
                columns = [
                    pa.array(r["doc_ids"], pa.int64()), pa.array(r["start"] + ends - np.array(r["doc_sizes"]), pa.int64()),
                    pa.array(r["doc_sizes"], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return blocks.mapInArrow(decode, schema)


BLOCK_ARROW = pa.schema([
    ("part", pa.int32()), ("block", pa.int64()), ("n_ids", pa.int64()), ("crc32", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("doc_sizes", pa.list_(pa.int64())), ("states", pa.binary()), ("positions", pa.list_(pa.int64())), ("words", pa.binary()),
])


def _frequencies(spark, path: str) -> bytes:
    table = spark.read.parquet(f"{path}/table").collect()
    counts = np.zeros(max((r.symbol for r in table), default=0) + 1, np.int64)
    for r in table:
        counts[r.symbol] = r["count"]
    return scaled(counts).tobytes()
