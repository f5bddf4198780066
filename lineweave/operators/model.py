"""The place where an external model would be called.

A model is a function from prompts to answers; it is given, never built in.  Requests and answers are
tables, so retries are a second pass over the rows that failed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsonrepair import with_answer_texts
from ..functions.names import is_blank
from .cut import checkpointed
from .matching import merge_terms

CONFIDENCE = 0.3  # script hints above it are shown
AT_ONCE = 256  # requests that a model is given at once


def echo_model(prompts: pd.Series) -> pd.Series:
    """A deterministic stand-in: the texts of the request behind a mark, as indexed JSON."""
    import json

    def one(p: str) -> str:
        rows = json.loads(p)["lines"]
        return json.dumps({"translations": [{"index": r["index"], "text": "» " + r["text"]} for r in rows]}, ensure_ascii=False)

    return prompts.map(one)


def prompt(rows: DataFrame, chunk: list[str], max_terms: int = 30) -> DataFrame:
    """M4: requests(*chunk, prompt, originals): the lines of a chunk as JSON with hints and terms.

    rows(*chunk, seq, text[, sb, conf][, terms array]).  A script hint is shown if conf > 0.3.
    """
    hint = F.when(F.col("conf") > CONFIDENCE, F.col("sb")) if "conf" in rows.columns else F.lit(None).cast("string")
    line = F.struct("seq", F.col("text"), hint.alias("hint"))
    terms = F.slice(F.first("terms"), 1, max_terms) if "terms" in rows.columns else F.lit(None).cast("array<string>")
    grouped = rows.groupBy(*chunk).agg(F.array_sort(F.collect_list(line)).alias("lines"), terms.alias("terms"))
    shown = F.transform("lines", lambda x, i: F.struct((i + 1).alias("index"), x["text"].alias("text"), x["hint"].alias("hint")))
    return grouped.select(*chunk, F.to_json(F.struct(shown.alias("lines"), "terms")).alias("prompt"), F.transform("lines", lambda x: x["text"]).alias("originals"), F.transform("lines", lambda x: x["seq"]).alias("seqs"))


def call(requests: DataFrame, model: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Add ``raw``, the model's answer; AT_ONCE requests at a time, on the executors.

    Other columns pass as Arrow, so a worker holds one batch as it came and Python's values of a few prompts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(at, AT_ONCE)
                raw = pa.array(model(some.column("prompt").to_pandas()), pa.string(), from_pandas=True)
                yield pa.RecordBatch.from_arrays([*some.columns, raw], [*some.schema.names, "raw"])

    return requests.mapInArrow(run, T.StructType([*requests.schema.fields, T.StructField("raw", T.StringType())]))


def translate(rows: DataFrame, chunk: list[str], model: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Rows (*chunk, seq, new_text, how) aligned with the input rows."""
    answers = with_answer_texts(call(prompt(rows, chunk), model), "originals", "raw", "got")
    # Outer, as the filter that Spark infers for an inner one would read every answer twice.
    each = answers.select(*chunk, "seqs", "got", F.posexplode_outer("got.texts").alias("at", "new_text")).filter("at is not null")
    return each.select(*chunk, F.get("seqs", F.col("at")).alias("seq"), "new_text", F.col("got.how").alias("how"))


def translate_with_retries(rows: DataFrame, chunk: list[str], models: list[Callable[[pd.Series], pd.Series]]) -> DataFrame:
    """Chunks that give no texts go to the next model; what is left stays blank.

    Answers that are followed by another round are written before they are read twice, so a model is asked
    once for a chunk, and both readers see the same answer.
    """
    out = None
    for i, model in enumerate(models):
        got = translate(rows, chunk, model)
        if i == len(models) - 1:
            return got if out is None else out.unionByName(got)
        good = checkpointed(got).filter("how <> 'none'")
        out = good if out is None else out.unionByName(good)
        rows = rows.join(good.select(*chunk).distinct(), chunk, "left_anti")
    return out


def polish(texts: DataFrame, updates: DataFrame) -> DataFrame:
    """Sparse updates(file, raw JSON map of line numbers) over texts(file, seq, text); blanks are no update."""
    new = updates.select("file", F.explode(F.from_json("raw", "map<string,string>")).alias("k", "new")).withColumn("seq", F.col("k").try_cast("int") - 1).filter("seq is not null").filter(~is_blank(F.col("new")))
    return texts.join(new.select("file", "seq", "new"), ["file", "seq"], "left").select("file", "seq", F.coalesce("new", "text").alias("text"))


def titles(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows (work, seq, name) with titles from answers(work, raw ``{"1": title}``), else the name."""
    got = answers.select("work", F.explode(F.from_json("raw", "map<string,string>")).alias("k", "title")).withColumn("seq", F.col("k").try_cast("int")).filter(~is_blank(F.col("title")))
    return rows.join(got.select("work", "seq", F.trim("title").alias("title")), ["work", "seq"], "left").select("work", "seq", "name", F.coalesce("title", "name").alias("title"))


def cut_answers(answers: DataFrame, ids: DataFrame) -> DataFrame:
    """proposed cuts (id, cuts) from answers(raw ``{id: [label, ...]}``) for known ids."""
    each = answers.select(F.explode(F.from_json("raw", "map<string,array<string>>")).alias("id", "labels"))
    numbers = F.array_compact(F.transform("labels", lambda x: x.try_cast("int")))
    return each.join(ids.select("id"), "id", "left_semi").select("id", numbers.alias("cuts"))


def context_terms(worldview_terms: DataFrame, special: DataFrame, own: DataFrame) -> DataFrame:
    """A work's own terms, then names from its world, then special terms."""
    return merge_terms(own, worldview_terms, special)


def accepted_share(translated: DataFrame, by: list[str]) -> DataFrame:
    """Share of rows with text for each group, to gate a write."""
    has = (F.trim(F.coalesce("new_text", F.lit(""))) != "").cast("double")
    return translated.groupBy(*by).agg(F.avg(has).alias("share"))


def usage_of(requests: DataFrame, tokens: Column) -> DataFrame:
    """Usage rows from answered requests, for the usage mart."""
    return requests.select("*", tokens.alias("prompt_tokens"))
