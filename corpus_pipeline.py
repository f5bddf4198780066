"""From raw documents to packed batches: five stages, each on all that the one before kept.

``run`` writes every stage as Parquet into the shared scratch folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm.minhash import keep_one_of_each
from lineweave.llm.mixing import mixed_documents
from lineweave.llm.packing import pack_batches
from lineweave.llm.quality import keep_unrepetitive
from lineweave.llm.shared import Scratch, count_words, passing, table
from lineweave.llm.suffixes import strip_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go.

    Null, empty and other texts of fewer than ten words go, whatever their doc_id; a very long text is
    judged whole.  Repeated rows are judged alike and stay or go together.
    """
    return keep_unrepetitive(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at 80 % of their five-word shingles, the smallest doc_id stays.

    Rows without a doc_id, and texts without a word, link with nothing and stay.  Rows that share a doc_id
    are one document, of which one row stays.  A very long text is compared by all its shingles.
    """
    return keep_one_of_each(docs, Scratch(spark, "near"), shingle=5, num=80, den=100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes keep their first copy; emptied documents go, n_chars follows the text.

    First is the smallest doc_id (none before all), then the text's hash, then the place.  Null and
    empty texts have nothing to cut and stay; equal rows count as one document and stay together.
    """
    return strip_repeats(docs, Scratch(spark, "repeats"), 200).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the weighted mix takes it, up to three times; copies are equal rows.

    Documents without a word weigh nothing and are not taken.  A null source is a source, last in order.
    """
    return mixed_documents(docs, Scratch(spark, "mix"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-budget batches inside optimal length buckets: all columns of docs and each row's place.

    The texts are in the table, in the state in which the earlier stages left them.  As the mix repeats
    documents, doc_id names no row here: (bucket, batch, slot) does.  Lengths are words; null and empty
    texts have length 0.  Columns named like a place (length, bucket, ...) are replaced by it.
    """
    return pack_batches(docs, Scratch(spark, "pack"), count_words(F.col("text")), carry=True)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("mix", mix_sources),
    ("pack", pack),
]

#: The suffix-array stage cuts byte spans, which SQL cannot express; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the last one's table, with the packed texts, stays and is returned.

    Every stage is written before the next one reads it; spent tables and the stages' own scratch are
    deleted.  Other columns of documents pass through all stages; an empty table gives an empty one.
    """
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        with passing():
            docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
