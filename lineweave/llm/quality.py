"""Quality rules: repetition coverage.

Rolling hashes of several n-gram lengths, in numpy over Arrow batches, measure how many characters of
a text stand inside n-grams or lines that it repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import SPACE, mix, pieces, span_hashes, spans_where, text_bytes, whole_row, window_hashes

#: Largest share of word characters inside later occurrences of n-grams, by n, and of lines.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.30
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_share double, dup_ngram_shares array<double>"
)


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys


def _covered(start: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n items lie in a window of ``width`` items from any of ``start``."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, start + width, -1)
    return np.cumsum(step[:n]) > 0


def measure(ids: pa.Array, text: pa.Array, ngram_limits: dict[int, float], line_limit: float) -> pa.RecordBatch:
    data, off = text_bytes(text)
    rows = len(off) - 1
    total = lambda per_row, where: np.bincount(where, per_row, rows).astype(np.int64)
    row_of = lambda at: np.searchsorted(off, at, "right") - 1
    first = (data & 0xC0) != 0x80  # first bytes of code points
    chars_to = np.concatenate([[0], np.cumsum(first & ~SPACE[data])])

    start, end = spans_where(~SPACE[data], off)
    doc = row_of(start)
    n_words, chars = np.bincount(doc, minlength=rows), chars_to[end] - chars_to[start]
    word_chars = total(chars, doc)
    n_symbols = np.bincount(row_of(np.flatnonzero(SYMBOLS[data])), minlength=rows)

    lines, line_ends = spans_where(data != 10, off)
    line_chars = chars_to[line_ends] - chars_to[lines]
    lines, line_ends, line_chars = (x[line_chars > 0] for x in (lines, line_ends, line_chars))
    line_doc = row_of(lines)
    key = span_hashes(data, lines, line_ends) ^ mix(line_doc.astype(np.uint64))
    later = np.ones(len(key), bool)
    later[np.unique(key, return_index=True)[1]] = False
    n_dup_lines = np.bincount(line_doc[later], minlength=rows)
    line_share = total(line_chars[later], line_doc[later]) / np.maximum(word_chars, 1)

    h, salt = span_hashes(data, start, end), mix(doc.astype(np.uint64) + np.uint64(1))
    candidates, shares, n_repeat = None, [], np.zeros(rows, np.int64)
    for n in sorted({5, *ngram_limits}):
        whole = doc[: max(0, len(doc) - n + 1)] == doc[n - 1 :]
        at = np.flatnonzero(whole) if candidates is None else candidates[candidates < len(whole)]
        at = at[whole[at]] if candidates is not None else at
        key_of = window_hashes(h, n)[at] ^ salt[at] if len(at) else np.zeros(0, np.uint64)
        again = _repeated(key_of)
        twice, key_of = at[again], key_of[again]
        if n == 5:
            n_repeat = np.bincount(doc[_covered(twice, n, len(h))], minlength=rows)
        not_first = np.ones(len(twice), bool)
        not_first[np.unique(key_of, return_index=True)[1]] = False
        inside = _covered(twice[not_first], n, len(h))
        if n in ngram_limits:
            shares.append(total(chars[inside], doc[inside]) / np.maximum(word_chars, 1))
        if n >= 5:
            candidates = twice  # a repeated n-gram starts with a repeated shorter one
    share = np.stack(shares, 1) if shares else np.zeros((rows, 0))
    limits = np.array([ngram_limits[n] for n in sorted(ngram_limits)])
    base_failed = (n_words < 10) | (100 * n_repeat > 20 * n_words)
    kept = ~(base_failed | (share > limits).any(1) | (line_share > line_limit))
    longs = [pa.array(x.astype(np.int64)) for x in (n_words, word_chars, n_symbols, n_dup_lines, n_repeat)]
    nested = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * share.shape[1]), pa.array(share.ravel()))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *longs, pa.array(base_failed), pa.array(kept), pa.array(line_share), nested], names)


def repetition_coverage(docs: DataFrame, ngram_limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """Repetition figures and a verdict for each row of docs (doc_id, text); one pass, no shuffle.

    A document is kept unless the base rule fails it (under 10 words, or over 20 % of its words in
    repeated 5-word windows), n-grams that occurred before hold more of its characters than
    ``ngram_limits`` allow, or lines equal to earlier ones hold more than ``line_limit``.

    Null and empty texts have no words and fail the base rule.  Rows stay as they are: null or repeated
    doc_ids and repeated rows each give one result row.  Other columns are ignored, an empty table gives no rows.  Texts are whole:
    memory is bounded by one slice of a batch, or the longest text if larger.
    """
    limits = dict(NGRAM_LIMITS if ngram_limits is None else ngram_limits)
    if any(n < 5 for n in limits):
        raise ValueError("n-grams of at least 5 words are expected")

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                yield measure(part.column("doc_id"), part.column("text"), limits, line_limit)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def keep_unrepetitive(docs: DataFrame, ngram_limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """The rows of docs that ``repetition_coverage`` keeps, with all their columns; one pass, no shuffle.

    Other columns pass through, whatever their names and types; an empty table gives no rows.
    """
    limits, names = dict(NGRAM_LIMITS if ngram_limits is None else ngram_limits), docs.columns

    def run(batches):
        for batch in batches:
            for part in pieces(pa.RecordBatch.from_arrays(batch.column("row").flatten(), names)):
                yield part.filter(measure(part.column("doc_id"), part.column("text"), limits, line_limit).column("kept"))

    return docs.select(whole_row(docs)).mapInArrow(run, docs.schema)
