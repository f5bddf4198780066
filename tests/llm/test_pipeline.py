import re
from collections import Counter

import corpus_pipeline
from fixtures import SF, frame, rows
from test_minhash import brute as classes
from test_mixing import brute_targets, words
from test_quality import brute as quality

from lineweave.llm.shared import Scratch


def strip(data, length=200):
    """Later copies of strings go, in the order of doc_id."""
    seen, out = set(), []
    for r in sorted(data, key=lambda r: r[0]):
        raw = r[1].encode()
        hit = [False] * len(raw)
        own = [raw[i : i + length] for i in range(len(raw) - length + 1)]
        for i, window in enumerate(own):
            if window in seen:
                hit[i : i + length] = [True] * length
            seen.add(window)
        text = bytes(b for b, h in zip(raw, hit, strict=True) if not h).decode("utf-8", "ignore")
        if not any(hit) or re.search(r"[^\x20\x09-\x0D]", text):
            out.append((*r[:1], text, *r[2:4], len(text)))
    return out


def check(spark, docs, data):
    kept, read = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, read, SF)
        if name != "pack":
            assert df.columns == docs.columns
        read = Scratch(spark, "t").save(df, "stage")
        kept[name] = [tuple(r)[:5] if name != "pack" else r for r in read.collect()]
    data = [r for r in data if quality(r[1])[-1]]
    assert Counter(kept["quality rules"]) == Counter(data)
    numbered = [r for r in data if r[0] is not None]
    stay = {w[0] for w in classes(numbered, 5, 80, 100) if w[3]}
    data = [r for r in dict.fromkeys(numbered) if r[0] in stay] + [r for r in data if r[0] is None]
    assert Counter(kept["near duplicates"]) == Counter(data)
    data = strip(data)
    assert Counter(kept["repeated passages"]) == Counter(data)
    _, target = brute_targets(data)
    copies, whole = Counter(kept["mix"]), Counter(data)
    assert set(copies) <= set(whole) and all(c <= 3 for c in copies.values())
    longest = max((words(r[1]) for r in data), default=0)
    for source, want in target.items():
        assert abs(sum(words(r[1]) * c for r, c in copies.items() if r[3] == source) - want) <= longest
    packed = kept["pack"]  # the texts of every batch are in the table, each row with a key of its own
    assert Counter(tuple(r)[:5] for r in packed) == Counter(kept["mix"])
    assert len({(r.bucket, r.batch, r.slot) for r in packed}) == len(packed)
    for r in packed:
        assert r.length == words(r.text) and r.padding == r.bucket_length - r.length >= 0
    return kept


def test_stages_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = check(spark, docs, [tuple(r) for r in docs.collect()])
    run = corpus_pipeline.run(spark, SF)
    assert Counter(run.collect()) == Counter(kept["pack"])
    assert {"doc_id", "text", "source", "bucket", "batch", "slot"} <= set(run.columns)


def test_awkward_rows(spark):
    data = [r for r in rows() if r[0] is not None]
    check(spark, frame(spark, data), data)
    for _, stage in corpus_pipeline.STAGES:  # null doc_ids and clashing columns pass through
        stage(spark, frame(spark), SF).collect()


def test_empty(spark):
    docs = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []
