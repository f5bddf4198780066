import hashlib
import random
import re
import zlib
from collections import Counter

from fixtures import SF, frame, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from lineweave.llm import queries
from lineweave.llm.periods import Grammar, grammar_runs, periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """All runs (start, length, period), period by period."""
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(s <= i and i + length <= s + m for s, m, _ in out):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


def collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def by_grammar(ids):
    return sorted((s, e - s, q) for q, s, e in grammar_runs(ids))


def derived(g, x):
    return [x] if x < g.base else [w for y in g.rules[x - g.base] for w in derived(g, y)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 7)), max_size=8))
def test_grammar_against_brute_force(blocks):
    ids = [x for block, times in blocks for x in block * times]
    assert by_grammar(ids) == brute(ids)
    if ids:
        g = Grammar(ids)
        assert derived(g, g.root) == ids
        for k in range(len(g.rules)):
            x = g.base + k
            assert derived(g, x) == ids[g.first[x] : g.first[x] + g.size[x]]


def test_pairs_are_replaced_by_number():
    g = Grammar([1, 2, 3, 9, 1, 2, 3, 8, 1, 2, 4])
    assert g.rules[0] == (1, 2) and g.rules[1] == (g.base, 3)


def test_long_sequences():
    r = random.Random(1)
    phrase = [r.randrange(50) for _ in range(300)]
    for ids in ([7] * 4_000, [1, 2] * 2_000 + [1], phrase * 9, ([5] * 40 + [6]) * 60, [r.randrange(2) for _ in range(3000)]):
        assert by_grammar(ids) == brute(ids)


def shaped():
    r = random.Random(9)
    word = lambda: r.choice(["a", "b", "ab", "é", "漢字", "x-y"])
    texts = ["a " * 5, "a " * 6, "a b " * 4, "a b " * 3 + "a", "\n".join(["one two three"] * 4), "a" * 5000 + " b", "a b c d " * 30_000, " ".join(word() for _ in range(4_000))]
    texts += [" ".join(" ".join(word() for _ in range(r.randint(1, 6))) + " " for _ in range(3)) * r.randint(1, 9) for _ in range(90)]
    return rows() + [(5000 + i, t, "en", None, None) for i, t in enumerate(texts)]


def test_against_brute_force(spark):
    data, want = shaped(), Counter()
    for r in data:
        words = WORD.findall(r[1] or "")
        runs = by_grammar([ord(w) for w in words]) if len(words) > 50_000 else brute(words)
        want[r[0], len(words), tuple(runs), collapsed(words, runs)] += 1
    got = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic_runs(frame(spark, data)).collect())
    assert got == want
    assert sum(len(k[2]) * c for k, c in got.items()) > 40


def loop(doc_id, text):
    words, h = WORD.findall(text or ""), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    return words


def test_looped_words(spark):
    data = [(i, t, "en", None, None) for i in range(300) for t in (None, "", "one", "a b c\n d  e f g h")] + rows()
    got = Counter((r.doc_id, tuple(WORD.findall(r.text or ""))) for r in queries.looped(frame(spark, data)).collect())
    assert got == Counter((r[0], tuple(loop(r[0], r[1]))) for r in data)


def test_query(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = loop(r.doc_id, r.text)
        runs = brute(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        want[r.doc_id] = (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(collapsed(words, runs)))
    assert {r.doc_id: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, SF).collect()} == want


def test_empty(spark):
    assert periodic_runs(frame(spark, [])).count() == 0
