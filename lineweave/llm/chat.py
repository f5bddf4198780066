"""Chat formatting: one rendering of a dialogue from the perspective of each participant.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Turn numbers that share a part, so that no part grows with the dialogue.
PART = 64
#: Places in which the speakers of a conversation stand ready for its parts.
SALTS = 16
SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def rotate_perspectives(turns: DataFrame, part_turns: int = PART, system: str = SYSTEM) -> DataFrame:
    """For every participant of every conversation, its dialogue with that speaker as assistant.

    Rows (conv_id, speaker, part, slice, n_turns, n_trained, messages, text, spans).  A participant is a
    distinct role other than ``system``.  In its perspective its own turns are assistant messages
    (train = true), those of others are user messages with their name, and system turns stay system
    messages.  ``text`` renders the messages, ``spans`` holds the start and end of each trained
    content in it (end mark included), in code points.

    A dialogue is cut into parts of ``part_turns`` consecutive turn numbers, each rendered on its own;
    the parts of a perspective in order are the whole dialogue.  So a conversation that holds a third
    of all rows is rendered by many tasks.  Turn numbers are a key of a conversation in ordinary data;
    repeated rows, and ties of turn, role and text, are kept as turns of their own.  Where a part holds
    more rows than ``part_turns``, it is cut into slices of so many, numbered from 0.

    Null turns form a part of their own, numbered -1; a null role is a user named unknown and never a
    participant; a null text is empty; a null conv_id is a conversation of its own.  A very long text
    stays one message.  A conversation without a participant, and an empty table, give no rows; other
    columns are not read.
    """
    named = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("content"))
    speakers = named.filter(F.col("role").isNotNull() & (F.col("role") != system)).select("conv_id", F.col("role").alias("speaker")).distinct()
    part = F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("long")
    turn = F.struct(F.coalesce("turn", F.lit(-(2**62))).alias("turn"), F.coalesce("role", F.lit("")).alias("name"), "content", F.col("role").isNull().alias("unknown"))
    named = named.select("conv_id", part.alias("part"), turn.alias("t"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("t")) - 1
    parts = named.withColumn("slice", F.floor(nth / part_turns)).groupBy("conv_id", "part", "slice").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # The parts of a long dialogue meet its speakers in SALTS places.
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("part", "slice"), F.lit(SALTS)))
    speakers = speakers.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    p, s = parts.alias("p"), speakers.alias("s")
    views = p.join(s, F.col("p.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("p.salt") == F.col("s.salt"))).select("p.*", "s.speaker")

    def message(t):
        own = ~t["unknown"] & (t["name"] == F.col("speaker"))
        is_system = ~t["unknown"] & (t["name"] == system)
        role = F.when(own, "assistant").when(is_system, "system").otherwise("user")
        name = F.when(~own & ~is_system, F.when(t["unknown"], "unknown").otherwise(t["name"]))
        return F.struct(role.alias("role"), name.alias("name"), t["content"].alias("content"), own.alias("train"))

    views = views.withColumn("messages", F.transform("turns", message))
    head = lambda m: F.concat(F.lit(OPEN), m["role"], F.coalesce(F.concat(F.lit(" name="), m["name"]), F.lit("")), F.lit("\n"))
    views = views.withColumn("pieces", F.transform("messages", lambda m: F.struct(head(m).alias("head"), F.concat(m["content"], F.lit(CLOSE)).alias("body"), m["train"].alias("train"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc, m):
        begin = acc["at"] + F.length(m["head"])
        end = begin + F.length(m["body"])
        own = F.struct(begin.cast("long").alias("start"), (end - 1).cast("long").alias("end"))
        return F.struct(end.cast("long").alias("at"), F.when(m["train"], F.concat(acc["spans"], F.array(own))).otherwise(acc["spans"]).alias("spans"))

    return views.select(
        "conv_id", "speaker", "part", "slice", F.size("messages").cast("long").alias("n_turns"),
        F.size(F.filter("messages", lambda m: m["train"])).cast("long").alias("n_trained"), "messages",
        F.array_join(F.transform("pieces", lambda m: F.concat(m["head"], m["body"])), "").alias("text"),
        F.aggregate("pieces", start, step, lambda acc: acc["spans"]).alias("spans"),
    )
