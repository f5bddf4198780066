import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from fixtures import SF, frame, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lineweave.llm import tokens
from lineweave.llm.shared import Scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")
OTHERS = sorted(x.name for x in Path(PATH).parent.glob("*.json") if x.name != "byte_bpe_50k.json")[:1]


@given(st.lists(st.integers(0, 300), max_size=3000), st.integers(1, 40))
@settings(max_examples=30, deadline=None)
def test_block_round_trip(ids, times):
    ids = np.array(ids * times, np.int64)
    freq = tokens.scaled(np.bincount(ids, minlength=1)).tobytes()
    tables = tokens._tables(freq)
    states, positions, words = tokens.encode_block(ids, *tables[:2])
    assert (tokens.decode_block(len(ids), states, positions, words, *tables) == ids).all()


def test_scaled_sums_up():
    counts = np.array([10**12, *[1] * 50000])
    freq = tokens.scaled(counts)
    assert freq.sum() == 1 << tokens.SCALE and freq.min() == 1


def encoded(spark, texts, path=PATH):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [tokens._unpack(r.ids, r.width).tolist() for r in tokens.token_table(docs, path).orderBy("doc_id").collect()]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", *OTHERS])
def test_texts_are_encoded_whole(spark, name):
    """Any tokenizer file does, since nothing is assumed about how it cuts words."""
    path = public_tokenizers.path(name)
    odd = ["a  b", " a", "a ", "tab\there", "x\u00a0y", "don't  'll", "a\n\nb", "<|endoftext|> x", "é\x1cb", "a\x85 b", "", "\n", "漢字 🙂 e\u0301", "1,000 don't_do 42nd"]
    texts = [*odd, *(x + " word's " + x for x in odd), "long " * 50_000, "x" * 20_000]
    t = Tokenizer.from_file(path)
    assert encoded(spark, texts, path) == [[*t.encode(x, add_special_tokens=False).ids, 0] for x in texts]


_kept = []


def Tokenizer_():
    if not _kept:
        _kept.append(Tokenizer.from_file(PATH))
    return _kept[0]


def check(spark, docs, data, name):
    scratch = Scratch(spark, name)
    tokens.write_ans(docs, f"{scratch.root}/out", PATH, scratch)
    got = sorted((tuple(r) for r in tokens.read_ans(spark, f"{scratch.root}/out").collect()), key=lambda r: r[1])
    t = Tokenizer_()
    ids = [(r[0], [*t.encode(r[1] or "", add_special_tokens=False).ids, 0]) for r in data]
    ids.sort(key=lambda x: (x[0] is not None, x[0] or 0, len(x[1]), np.array(x[1], "<u2").tobytes()))
    at, want = 0, []
    for d, x in ids:
        want.append((d, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert got == want


def test_table(spark):
    check(spark, frame(spark), rows(), "t")


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(spark, docs.repartition(5), [tuple(r) for r in docs.collect()], "t")


def test_empty(spark):
    check(spark, frame(spark, []), [], "t")


def test_awkward_rows(spark):
    """Nulls, repeated rows, a very long text and columns with clashing names."""
    data = [(None, None), (None, "a"), (3, "b"), (3, "b"), (2, ""), (1, "word " * 30_000)]
    docs = spark.createDataFrame([(*r, 7, "x") for r in data], "doc_id long, text string, ids long, width string")
    check(spark, docs, data, "t")


PIECES = ["a", "the", " ", "  ", "\n", "'", "s", "'t", "re", "'ve", "'ll", "'d", "m", "S", "\u00e9", "\u6f22", "\u00a0", "\u2028", "\x85", "\x1c", "\0", "1", "\u00b2", "!", "(", "\u2019", "\U0001f642", "\u0301", "_"]


@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), min_size=1, max_size=40))
@settings(max_examples=200, deadline=None)
def test_op3_words_start_where_the_library_starts_them(texts):
    """op3 of round 3: word ends that no merge may cross are those of the library's own pattern."""
    merger, t = tokens._merger(PATH), Tokenizer_()
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    at = np.cumsum([0, *map(len, texts)])
    first = np.zeros(len(points), bool)
    first[[a for a, x in zip(at, texts) if x]] = True
    starts, _ = merger.word_starts(points, first)
    assert [np.flatnonzero(starts[a:b]).tolist() for a, b in zip(at, at[1:])] == [[o[0] for _, o in t.pre_tokenizer.pre_tokenize_str(x)] for x in texts]
    assert [x.tolist() for x in tokens.encode_texts(PATH, texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_op3_only_crossed_texts_are_cut_by_the_library(monkeypatch):
    """op3 of round 3: a text is cut into words by the library only if a merge crossed a word's end."""
    cut, own = [], tokens._ids
    monkeypatch.setattr(tokens, "_ids", lambda t, texts: (cut.extend(texts if t is tokens._tokenizer(PATH) else []), own(t, texts))[1])
    texts = ["The end, of. It.\nThen\n\n  caf\u00e9 don't", " 'so it's", "", "x" * (tokens.WHOLE_CHARS + 1), "a<|endoftext|>"]
    got = [x.tolist() for x in tokens.encode_texts(PATH, texts)]
    assert got == [Tokenizer_().encode(x, add_special_tokens=False).ids for x in texts]
    assert texts[0] not in cut and "" not in cut and texts[3] in cut and texts[4] in cut


def test_op3_files_that_cut_otherwise_are_left_alone():
    assert tokens._merger(PATH) is not None
    for name in OTHERS:
        d = Tokenizer.from_file(public_tokenizers.path(name)).pre_tokenizer
        assert type(d).__name__ == "ByteLevel" or not tokens.Merger.fits(public_tokenizers.path(name))
