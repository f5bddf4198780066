import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from fixtures import SF, frame, rows
from pyspark.sql import functions as F

from lineweave.llm.infill import fill_in_middle, restored, unit_marks
from lineweave.llm.shared import text_bytes

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def brute(doc_id, text, plain_from=90, spm_below=20):
    text = text or ""
    units = UNIT.findall(text)
    s = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(s[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= plain_from:
        return doc_id, n, "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h4 % 100 < spm_below else "psm"
    return doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_marks_of_every_alignment():
    r = random.Random(3)
    alphabet = list("aZ@[`{09 \n<é漢😀z") + ["\x00", "\x7f", "\u0080", "߿", "￿"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(400)]
    data, off = text_bytes(pa.array(texts))
    ends, chars = unit_marks(data, off)
    want = []
    for text, at in zip(texts, off, strict=False):
        for u in UNIT.findall(text):
            at += len(u.encode())
            want.append(at - 1)
    assert ends.select(np.arange(1, len(want) + 1)).tolist() == want
    hit = np.zeros(len(data) + 1, int)
    hit[np.array(want) + 1] = 1
    assert ends.rank(np.arange(len(data) + 1)).tolist() == np.cumsum(hit).tolist()
    assert chars.rank(off).tolist() == np.cumsum([0, *map(len, texts)]).tolist()


AWKWARD = ["<P>", "a<S>b", "<M", "<<P", "P>a<", "<" * 50, "é" * 33, "ab漢字cd😀" * 40, "z" * 100_000, "a b\r\n" * 30_000, "\x00", "A" * 8, "A" * 7 + "é"]


def test_against_brute_force(spark):
    data = rows() + [(1000 + i, t, "en", None, None) for i, t in enumerate(AWKWARD * 6)]
    for plain, spm in ((10, 20), (0, 100), (0, 0), (100, 50)):
        made = fill_in_middle(frame(spark, data), plain_percent=plain, spm_percent=spm)
        assert Counter(map(tuple, made.collect())) == Counter(brute(r[0], r[1], 100 - plain, spm) for r in data)
        back = made.select("doc_id", restored(F.col("form"), F.col("output")).alias("text"))
        assert Counter(map(tuple, back.collect())) == Counter((r[0], r[1] or "") for r in data)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert Counter(map(tuple, fill_in_middle(docs).collect())) == Counter(brute(r.doc_id, r.text) for r in docs.collect())


def test_empty(spark):
    assert fill_in_middle(frame(spark, [])).count() == 0


def test_no_shuffle(spark):
    plan = fill_in_middle(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
