import re
from collections import Counter

from fixtures import frame, rows

from lineweave.llm.quality import LINE_LIMIT, NGRAM_LIMITS, repetition_coverage


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    chars = sum(map(len, words))

    def cover(n, later=False):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        twice = {g for g, c in Counter(grams).items() if c > 1}
        return {j for i, g in enumerate(grams) if g in twice and not (later and grams.index(g) == i) for j in range(i, i + n)}

    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        own = re.findall(r"[^\x20\x09-\x0D]+", line)
        if own and line in seen:
            dup, dup_chars = dup + 1, dup_chars + sum(map(len, own))
        seen.add(line)
    repeat = len(cover(5))
    base = len(words) < 10 or 100 * repeat > 20 * len(words)
    bad = any(sum(len(words[i]) for i in cover(n, True)) / max(chars, 1) > x for n, x in NGRAM_LIMITS.items()) or dup_chars / max(chars, 1) > LINE_LIMIT
    return len(words), chars, sum(c in "#*$%&|<>" for c in text), dup, repeat, base, not (base or bad)


def test_against_brute_force(spark):
    got = [tuple(r)[:8] for r in repetition_coverage(frame(spark)).collect()]
    assert Counter(got) == Counter((r[0], *brute(r[1])) for r in rows())


def test_empty(spark):
    assert repetition_coverage(frame(spark, [])).count() == 0


def test_documents(spark):
    from fixtures import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: tuple(r)[:8] for r in repetition_coverage(docs).collect()}
    assert got == {r.doc_id: (r.doc_id, *brute(r.text)) for r in docs.collect()}
