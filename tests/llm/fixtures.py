"""Small documents with every awkward case, and readers of the driver's tables."""

import random

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(80)
    base = [text(r.randint(1, 120)) for _ in range(30)]
    base += [None, "", " \n\t ", "one", "a b", "x" * 900, "a b c d e " * 60, passage, passage + "\n" + text(20), text(30) + " " + passage]
    long = text(4000)
    base += [long, long[:-40] + " changed tail", base[0], base[0], "line one\nline one\n\nline one\nother line", "#$% a | b <c> & d * e f g h i j"]
    near = text(200).split(" ")
    for i in range(12):
        copy = list(near)
        copy[i * 3] = "edit"
        base.append(" ".join(copy))
    out = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(base)]
    return out + [(None, "a row without id " * 4, None, "s1", None), out[3], out[41]]


def frame(spark, data=None):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows() if data is None else data, DOCS)
    return df.withColumns({"a": F.lit(1), "size": F.lit("clash"), "node": F.lit(None).cast("string"), "target": F.lit(2.0)})
