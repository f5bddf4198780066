from collections import Counter, defaultdict

from lineweave.llm.chat import rotate_perspectives

DATA = [
    (1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", "hé\nllo"), (1, 3, "cy", None), (1, 4, "ann", ""), (1, 4, "ann", "again"), (1, 4, "ann", "again"),
    (2, 0, "ann", "alone"), (3, None, "bob", "no turn"), (3, 5, None, "no role"), (None, 1, "bob", "no id"), (None, 2, "ann", "x"), (4, 0, "system", "only rules"),
    *[(5, i, "ab"[i % 2], f"t{i}") for i in range(200)],
]


def brute(data, part_turns):
    parts, speakers = defaultdict(list), defaultdict(set)
    for conv, turn, role, text in data:
        parts[conv, -1 if turn is None else turn // part_turns].append((-(2**62) if turn is None else turn, role or "", text or "", role is None))
        if role not in (None, "system"):
            speakers[conv].add(role)
    slices = [(conv, part, k // part_turns, sorted(turns)[k : k + part_turns]) for (conv, part), turns in parts.items() for k in range(0, len(turns), part_turns)]
    for conv, part, nth, turns in slices:
        for who in speakers[conv]:
            text, spans, own = "", [], 0
            for _, role, content, unknown in turns:
                mine = not unknown and role == who
                head = "assistant" if mine else "system" if role == "system" else f"user name={'unknown' if unknown else role}"
                text += f"<|im_start|>{head}\n"
                if mine:
                    spans.append((len(text), len(text) + len(content) + len("<|im_end|>")))
                    own += 1
                text += f"{content}<|im_end|>\n"
            yield conv, who, part, nth, len(turns), own, text, tuple(spans)


def run(spark, data, part):
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "'x' speaker")
    return rotate_perspectives(df, part)


def test_against_brute_force(spark):
    for part in (64, 3):
        out = run(spark, DATA, part)
        got = Counter((r.conv_id, r.speaker, r.part, r.slice, r.n_turns, r.n_trained, r.text, tuple(map(tuple, r.spans))) for r in out.collect())
        assert got == Counter(brute(DATA, part))


def test_hot_parts_and_long_texts(spark):
    """Many rows without a turn number, or with one number, and a very long turn: no row of the result holds more than a part."""
    data = [(1, None, "ab"[i % 2], f"x{i}") for i in range(500)] + [(1, 7, "a", f"y{i}") for i in range(300)] + [(2, 0, "a", "long " * 100_000), (2, 1, "b", "short")]
    out = run(spark, data, 64).collect()
    assert max(r.n_turns for r in out) == 64
    assert Counter((r.conv_id, r.speaker, r.part, r.slice, r.n_turns, r.n_trained, r.text, tuple(map(tuple, r.spans))) for r in out) == Counter(brute(data, 64))


def test_messages(spark):
    row = run(spark, DATA, 64).filter("conv_id = 1 and speaker = 'bob'").first()
    assert [(m.role, m.name, m.train) for m in row.messages][:3] == [("system", None, False), ("user", "ann", False), ("assistant", None, True)]


def test_empty_and_native(spark):
    out = run(spark, [], 64)
    assert out.collect() == []
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
