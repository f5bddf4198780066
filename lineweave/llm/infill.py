"""Fill-in-middle: texts cut into prefix, middle and suffix and put together for infilling.

A unit is a run of ASCII letters or any other code point.  UTF-8 is viewed as 64-bit words: arithmetic
on whole words marks the bytes that end a unit, ``bitwise_count`` counts them, a search in the running
counts finds the word of the k-th mark, and a select inside the word finds its byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import pieces, text_bytes

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

HIGH = np.uint64(0x8080808080808080)
LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)
ONES = np.uint64(0x0101010101010101)
CASE = np.uint64(0x2020202020202020)
FROM_A = np.uint64(0x1F1F1F1F1F1F1F1F)  # 0x80 - ord("a"): lifts the letters from "a" on into the high bit
PAST_Z = np.uint64(0x0505050505050505)  # 0x80 - ord("z") - 1
ONE, SEVEN, EIGHT, TOP = np.uint64(1), np.uint64(7), np.uint64(8), np.uint64(56)


class Marks:
    """Marked bytes of 64-bit words (high bit of each byte), with counts up to each word."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.upto = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks before byte ``at``."""
        word, inner = at >> 3, (at & 7).astype(np.uint64)
        below = (ONE << (inner * EIGHT)) - ONE
        part = np.bitwise_count(self.words[np.minimum(word, len(self.words) - 1)] & below)
        return self.upto[word] + np.where(inner > 0, part, 0)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte of the k-th mark, k from 1."""
        word = np.searchsorted(self.upto, k, "left") - 1
        left = (k - self.upto[word]).astype(np.uint64)
        # Byte j of the product counts the marks in bytes 0 to j; those below ``left`` come before the byte.
        reached = (((self.words[word] >> SEVEN) * ONES) | HIGH) - left * ONES
        return word * 8 + 8 - np.bitwise_count(reached & HIGH).astype(np.int64)


def unit_marks(data: np.ndarray, off: np.ndarray) -> tuple[Marks, Marks]:
    """Marks of the bytes that end a unit, and of the first bytes of code points; rows end at ``off``."""
    padded = np.zeros(-(-len(data) // 8) * 8 + 8, np.uint8)
    padded[: len(data)] = data
    w = padded.view("<u8")
    low = (w | CASE) & LOW7
    letter = (low + FROM_A) & ~(low + PAST_Z) & ~w & HIGH
    inner = w & ~(w << ONE) & HIGH  # 10xxxxxx
    following = lambda m: (m >> EIGHT) | np.concatenate([m[1:] << TOP, np.zeros(1, np.uint64)])
    ends = ~((letter & following(letter)) | following(inner)) & HIGH
    last = off[1:][off[1:] > off[:-1]] - 1
    np.bitwise_or.at(ends, last >> 3, np.uint64(0x80) << ((last & 7).astype(np.uint64) * EIGHT))
    return Marks(ends), Marks(~inner & HIGH)


def _cuts(text: pa.Array, draws: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """For each row: units, bytes where prefix and middle end (from the row's start), their code points."""
    data, off = text_bytes(text)
    ends, chars = unit_marks(data, off)
    before = ends.rank(off)
    n = np.diff(before)
    a, b = (d % (n + 1) for d in draws)
    byte_of = lambda k: np.where(k > 0, ends.select(np.maximum(before[:-1] + k, 1)) + 1, off[:-1])
    one, two = byte_of(np.minimum(a, b)), byte_of(np.maximum(a, b))
    first, second = chars.rank(one) - chars.rank(off[:-1]), chars.rank(two) - chars.rank(one)
    return n, one - off[:-1], two - off[:-1], first, second


OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def _arranged(batch: pa.RecordBatch, plain_from: int, spm_below: int) -> pa.RecordBatch:
    h = [np.array(batch.column(f"h{i}"), np.int64) for i in (1, 2, 3, 4)]
    n, one, two, first, second = _cuts(batch.column("text"), h[:2])
    plain = (h[2] % 100 >= plain_from) | (n == 0)
    suffix_first = h[3] % 100 < spm_below
    forms, outputs = [], []
    for i, text in enumerate(batch.column("text")):
        text = text.as_py() or ""
        if plain[i] or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
            plain[i] = True
            forms.append("plain")
            outputs.append(text)
            continue
        raw = text.encode()
        prefix, middle, suffix = (x.decode() for x in (raw[: one[i]], raw[one[i] : two[i]], raw[two[i] :]))
        forms.append("spm" if suffix_first[i] else "psm")
        outputs.append(f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}" if suffix_first[i] else f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")
    counts = [pa.array(x, pa.int64(), mask=plain) for x in (first, second)]
    return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(forms, pa.string()), *counts, pa.array(outputs, pa.string())], schema=ARROW)


def fill_in_middle(docs: DataFrame, seed: str = "1", plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """Each row of docs (doc_id, text) arranged for infilling: (doc_id, n, form, prefix_chars, middle_chars, output).

    The first four 8-digit groups of the sha256 of ``seed:doc_id`` draw the two cuts, whether the text
    stays plain, and whether the suffix comes first (``spm``, else ``psm``).  n counts units; the prefix
    ends after the smaller draw modulo n + 1, the middle after the larger, so any part may be empty.
    ``restored`` is the way back.

    Null and empty texts are plain, with n = 0 and an empty output; texts that hold a mark are plain.
    A null doc_id draws as an empty one.  Repeated rows and rows that share a doc_id each give one row,
    with equal draws.  Other columns are ignored, an empty table gives no rows.  One pass, no shuffle;
    memory is bounded by one slice of a batch, or the longest text if larger.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select("doc_id", "text", *draws)

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                yield _arranged(part, 100 - plain_percent, spm_percent)

    return rows.mapInArrow(run, OUT)


def restored(form: Column, output: Column) -> Column:
    """The exact text of an output of ``fill_in_middle``; null texts come back empty.

    Parts hold no mark, and no mark can straddle the seam of a part and a mark, so the output splits at
    its three marks.
    """
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    prefix, suffix = F.when(form == "spm", part[2]).otherwise(part[1]), F.when(form == "spm", part[1]).otherwise(part[2])
    return F.when(form == "plain", output).otherwise(F.concat(prefix, part[3], suffix))
