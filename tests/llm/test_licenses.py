import random
import re
from collections import Counter

from fixtures import SF, frame

from lineweave.llm.license_texts import BSD, ISC, MIT, TEMPLATES
from lineweave.llm.licenses import CONTAINMENT, PHRASES, license_scan
from lineweave.llm.shared import Scratch

SEP = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(SEP, re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def brute(text, templates=TEMPLATES):
    ws, places, base = words(text), [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(ws) - len(p) + 1):
            if ws[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
    labels, score = set(base), 0.0
    for label, t in templates:
        span, t = len(words(t)), set(words(t))
        for a in range(0, len(ws), span):
            own = set(ws[a : a + 2 * span])
            if len(own & t) >= CONTAINMENT * len(t) - 1e-9:
                labels.add(label)
                score = max(score, len(own & t) / len(t))
    return len(ws), len(places), min(places, default=None), max(places, default=None), tuple(sorted(base)), tuple(sorted(labels)), 1.0 if places else score


TEXTS = [
    None, "", " .,; ", "Under the MIT license under the mit-LICENSE!", "x\nApache License,\nVersion 2 and CC BY NC", "cc by nc cc by nc, under the mit license",
    *[t for _, t in TEMPLATES], "intro words " + TEMPLATES[8][1].upper() + " more", MIT.replace("free", "gratis"), MIT.replace("to deal in the Software without restriction", ""), MIT[: len(MIT) // 2], MIT.replace(" ", "\n"),
    "word " * 777 + BSD + " word" * 333 + ISC, ("rights " * 50 + "\n") * 300, "mit " * 30_000 + "released under the mit license", "this work is licensed\nunder the gnu general public license version 3", "under the mitt license", "é under the mit license é", "under\x00the\tmit\x7flicense", "license mit the under released",
]


def check(spark, docs, data):
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, tuple(r.base_labels), tuple(r.labels), r.score) for r in license_scan(docs, Scratch(spark, "t")).collect())
    assert got == Counter((i, *brute(t)) for i, t in data)


def test_against_brute_force(spark):
    data = [*enumerate(TEXTS), (None, TEXTS[3]), (3, TEXTS[3]), (3, "other"), (None, "cc by nc"), (None, None)]
    check(spark, frame(spark, [(i, t, None, None, 0) for i, t in data]), data)


def test_documents_and_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(spark, docs, [(r.doc_id, r.text) for r in docs.collect()])
    assert license_scan(frame(spark, []), Scratch(spark, "t")).collect() == []


def test_native_and_blocks(spark):
    out = license_scan(frame(spark, [(1, "a b\n\n" + TEMPLATES[0][1], None, None, 0)]), Scratch(spark, "t"))
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", out._jdf.queryExecution().toString())
    assert [tuple(b) for b in out.first().blocks] == [("mit", 0, 1.0)]


def test_a_notice_wrapped_over_lines_is_found(spark):
    docs = frame(spark, [(1, "Some code.\n# This work is licensed\n# under the GNU General\n# Public License, version 3.\nMore code.", None, None, 0), (2, "under work licensed version 3", None, None, 0)])
    assert {r.doc_id: r.labels for r in license_scan(docs, Scratch(spark, "t")).collect()} == {1: ["gpl-3"], 2: []}


def test_a_table_of_templates(spark):
    """Many generated templates with common and rare words, given as a DataFrame; nulls and repeats in it."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.choice((1, 1, 2, 3))))
    templates = [(f"t{k % 40}", " ".join(word() for _ in range(r.randint(1, 40)))) for k in range(120)]
    data = []
    for i in range(60):
        text = [word() for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 2)):
            own = r.choice(templates)[1].split()
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = word()
            text[r.randint(0, len(text)) : 0] = own
        data.append((i, " ".join(text)))
    table = spark.createDataFrame([*templates, templates[0], ("empty", ""), ("null", None)], "label string, text string")
    got = license_scan(frame(spark, [(i, t, None, None, 0) for i, t in data]), Scratch(spark, "t"), table).collect()
    assert {r.doc_id: (tuple(r.labels), r.score) for r in got} == {i: brute(t, templates)[-2:] for i, t in data}
