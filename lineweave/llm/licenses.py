"""License scans: an exact set-similarity join of text blocks with a table of license templates.

DataFrame functions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import TEMPLATES
from .shared import Scratch

#: Word characters are a-z (after lower-casing A-Z), 0-9 and everything beyond ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
CONTAINMENT = 0.9
#: Words that a template's prefix has beyond those that every match must meet.
MORE = 2


def words_of(text: Column) -> Column:
    """The words of a text, in order; null and empty texts have none."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.filter(F.split(lower, SEPARATORS, -1), lambda w: w != "")


def _phrase(spaced: Column, phrase: str, n_words: Column) -> tuple[Column, Column, Column]:
    """Places of a phrase in a text whose words each have a blank on either side: count, first, last."""
    wide = "".join(f" {w} " for w in phrase.split())
    parts = F.split(spaced, re.escape(wide).replace("\\ ", " "), -1)
    words_in = lambda part: ((F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))) / 2).cast("long")
    has = F.contains(spaced, F.lit(wide))
    last = n_words - words_in(F.element_at(parts, -1)) - len(phrase.split())
    return F.when(has, F.size(parts) - 1).otherwise(0).cast("long"), F.when(has, words_in(parts[0])), F.when(has, last)


def ordered_templates(templates: DataFrame, rows: DataFrame, scratch: Scratch, containment: float) -> DataFrame:
    """Templates (label, text) with their distinct words by rising number of places in ``rows`` (words).

    Rows (template, label, size, need, span, prefix, tokens): a match holds ``need`` of the ``size`` words,
    blocks advance by ``span`` words, and the first ``prefix`` words are looked up.
    """
    sets = templates.select("label", "text", words_of(F.col("text")).alias("all")).filter("size(all) > 0").dropDuplicates(["label", "text"])
    sets = sets.select("label", F.xxhash64("label", "text").alias("template"), F.size("all").alias("span"), F.explode(F.array_distinct("all")).alias("word"))
    # Written first, so that its size is known: a small one is broadcast by Spark, a large one is not.
    sets = scratch.save(sets, "template_words")
    counts = rows.select(F.explode("words").alias("word")).join(sets.select("word").distinct(), "word").groupBy("word").agg(F.count("*").alias("places"))
    sets = sets.join(counts, "word", "left").withColumn("key", F.struct(F.coalesce("places", F.lit(0)).alias("places"), "word"))
    sets = sets.groupBy("template", "label", "span").agg(F.transform(F.sort_array(F.collect_list("key")), lambda k: k["word"]).alias("tokens"))
    sets = sets.withColumn("size", F.size("tokens")).withColumn("need", F.ceil(F.col("size") * containment - 1e-9).cast("int"))
    return sets.withColumn("prefix", F.least(F.col("size"), F.col("size") - F.col("need") + 1 + MORE))


def candidate_blocks(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """Blocks that pass all filters: rows (doc_id, row, template, block).

    The prefix words of all templates meet the words of all texts in one join.  A block with ``found`` of a
    template's ``prefix`` words holds at most those and what is left of the shorter of template and block.
    """
    prefix = templates.select("template", "span", "size", "need", "prefix", F.explode(F.slice("tokens", F.lit(1), F.col("prefix"))).alias("word"))
    places = rows.select("doc_id", "row", "n_words", F.posexplode("words").alias("place", "word"))
    block = F.floor(F.col("place") / F.col("span")).cast("int")
    hits = places.join(prefix, "word").select("doc_id", "row", "n_words", "template", "span", "size", "need", "prefix", "word", F.explode(F.array(block, block - 1)).alias("block")).filter("block >= 0")
    found = hits.groupBy("doc_id", "row", "template", "block", "n_words", "span", "size", "need", "prefix").agg(F.count_distinct("word").alias("found"))
    in_block = F.least(2 * F.col("span"), F.col("n_words") - F.col("block") * F.col("span"))
    found = found.filter(in_block >= F.col("need"))  # length filter
    most = F.col("found") + F.least(F.col("size") - F.col("prefix"), in_block - F.col("found"))  # positional filter
    return found.filter(most >= F.col("need")).select("doc_id", "row", "template", "block")


def license_scan(docs: DataFrame, scratch: Scratch, templates=TEMPLATES, phrases: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """Labels of the license notices in each row of docs (doc_id, text).

    Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks): labels
    are arrays; ``blocks`` lists the matches (label, first word of the block, containment).  ``phrases``
    are found as consecutive words anywhere.  ``templates`` is a DataFrame (label, text) of any size, or a
    list of such rows.  For a template of n words, the blocks of a text are its words n * b to
    n * (b + 2), whatever its lines; any n words in a row stand in one.  A block meets the template if it
    holds at least ``containment`` of the template's distinct words; ``score`` is the largest containment,
    1 where a phrase stands.

    The join is exact.  Template words are ordered by their number of places in all texts, rarest first.
    A block that meets a template holds one of its first ``size - need + 1`` words (prefix filter), has
    ``need`` words at all (length filter), and enough of a somewhat longer prefix that the words behind it
    can make up the rest (positional filter).  What survives is verified on the whole sets.

    Null and empty texts have no words, no labels and score 0.  Very long texts are looked at block by
    block, all of them.  Repeated rows, null and repeated doc_ids each give one row.  Templates with one
    label, or equal ones, count once.  An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    phrases = PHRASES if phrases is None else phrases
    if not isinstance(templates, DataFrame):
        given = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(text).alias("text")) for label, text in templates])
        templates = spark.range(1).select(F.inline(given))
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), words_of(F.col("text")).alias("words"))
    spaced = F.when(F.size("words") > 0, F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" "))).otherwise("")
    rows = rows.withColumns({"n_words": F.size("words").cast("long"), "spaced": spaced})
    found = {label: _phrase(F.col("spaced"), phrase, F.col("n_words")) for phrase, label in phrases.items()}
    rows = rows.select(
        "doc_id", "row", "words", "n_words", sum((c for c, _, _ in found.values()), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.array(*[a for _, a, _ in found.values()])).alias("first_word"), F.array_max(F.array(*[b for _, _, b in found.values()])).alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(c > 0, F.lit(label)) for label, (c, _, _) in found.items()])))).alias("base_labels"),
    )
    rows = scratch.save(rows, "rows")
    sets = scratch.save(ordered_templates(templates, rows, scratch, containment), "templates")

    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.row") == F.col(f"{b}.row"))
    asked = candidate_blocks(rows, sets).groupBy("doc_id", "row", "template").agg(F.sort_array(F.collect_set("block")).alias("blocks"))
    asked = scratch.save(asked, "asked")
    texts = rows.select("doc_id", "row", "words").alias("t").join(asked.select("doc_id", "row").alias("a"), same("t", "a"), "left_semi")
    texts = texts.dropDuplicates(["doc_id", "row"])  # repeated rows have one set of matches
    asked = asked.join(sets.select("template", "label", "span", "size", "need", "tokens"), "template")
    joined = asked.alias("a").join(texts.alias("t"), same("a", "t")).select("a.*", "t.words")
    shared = lambda b: F.size(F.array_intersect(F.slice("words", b * F.col("span") + 1, 2 * F.col("span")), "tokens"))
    met = F.filter(F.transform("blocks", lambda b: F.struct((b * F.col("span")).alias("word"), shared(b).alias("n"))), lambda x: x["n"] >= F.col("need"))
    met = joined.select("doc_id", "row", "label", "size", F.explode(met).alias("x"))
    match = F.struct("label", F.col("x.word").alias("word"), (F.col("x.n") / F.col("size")).alias("containment"))
    met = met.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set(match)).alias("matches"))

    out = rows.drop("words").alias("r").join(met.alias("m"), same("r", "m"), "left")
    none = F.array().cast("array<struct<label:string,word:int,containment:double>>")
    own = F.array_distinct(F.transform(F.coalesce("m.matches", none), lambda x: x["label"]))
    best = F.coalesce(F.array_max(F.transform("m.matches", lambda x: x["containment"])), F.lit(0.0))
    return out.select(
        "r.doc_id", "r.n_words", "r.n_base", "r.first_word", "r.last_word", "r.base_labels", F.array_sort(F.array_union("r.base_labels", own)).alias("labels"),
        F.when(F.col("r.n_base") > 0, 1.0).otherwise(best).alias("score"), F.coalesce("m.matches", none).alias("blocks"),
    )
