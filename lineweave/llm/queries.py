"""The queries of the operators of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .chat import rotate_perspectives
from .hnsw import near_vectors
from .infill import fill_in_middle, restored
from .licenses import license_scan
from .minhash import near_duplicate_classes
from .mixing import fair_queue_mix
from .packing import pack_batches
from .periods import periodic_runs
from .quality import repetition_coverage
from .shared import WORD, Scratch, count_words, table
from .suffixes import remove_repeats
from .tokens import read_ans, write_ans
from .urls import filter_urls
from .warc import read_pages, write_pages


def op1_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = rotate_perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return views.select("conv_id", "speaker", "part", "slice", "n_turns", "n_trained", "text", spans.alias("spans"))


def op2_hnsw_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), Scratch(spark, "op2"))


def op3_ans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    scratch = Scratch(spark, "op3")
    path = f"{scratch.root}/ans"
    write_ans(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), scratch)
    return read_ans(spark, path)


def op4_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_batches(table(spark, sf_dir, "documents"), Scratch(spark, "op4"), count_words(F.col("text")))


def op5_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = fair_queue_mix(table(spark, sf_dir, "documents"), Scratch(spark, "op5"))
    return mix.select("doc_id", "source", "size", "source_size", "target", "taken")


def op6_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_coverage(table(spark, sf_dir, "documents")).drop("dup_line_share", "dup_ngram_shares")


def op7_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"), Scratch(spark, "op7"))
    labels = {c: F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")}
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", labels["base_labels"], labels["labels"], "score")


def op8_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).drop("method")


def op9_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"), Scratch(spark, "op9"), shingle=3, num=85, den=100)


def op10_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), Scratch(spark, "op10"), length=200).drop("spans")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def looped(docs: DataFrame) -> DataFrame:
    """Documents of op12: where crc32(doc_id) ends in 0, the words from some place on repeat a phrase."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    docs = docs.select("doc_id", "text", h.alias("h"), F.expr("h div 10").alias("g"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w")
    docs = docs.select("doc_id", "text", "g", words).select("*", F.when(F.size("w") > 0, F.col("g") % F.size("w")).alias("a"))
    docs = docs.withColumn("p", F.expr("1 + (size(w) - a) div (3 + g % 8)"))
    tail = F.expr("slice(flatten(array_repeat(slice(w, int(a + 1), int(p)), int((size(w) - a) div p + 1))), 1, int(size(w) - a))")
    text = F.array_join(F.concat(F.expr("slice(w, 1, int(a))"), tail), " ")
    return docs.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = periodic_runs(looped(table(spark, sf_dir, "documents")))
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda best, r: F.when(best.isNull() | (r["length"] > best["length"]), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    runs = runs.select("*", best.alias("best"), F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").alias("lines"))
    longest = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    exponent = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *longest, exponent, F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'op13').root}/warc"
    write_pages(table(spark, sf_dir, "pages"), path)
    return read_pages(spark, path, payload=False).drop("url")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat_perspectives, op2_hnsw_vectors, op3_ans_tokens, op4_length_buckets, op5_fair_queue_mix, op6_repetition_coverage, op7_license_join, op8_url_trees, op9_tensored_minhash, op10_suffix_repeats, op11_fill_in_middle, op12_periodic_runs, op13_warc_zstd)
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_perspectives": sql.OP1,
    "op2_hnsw_vectors": sql.OP2,
    "op4_length_buckets": sql.op4(),
    "op5_fair_queue_mix": sql.OP5,
    "op6_repetition_coverage": sql.op6(),
    "op7_license_join": sql.op7(),
    "op9_tensored_minhash": sql.OP9,
    "op11_fill_in_middle": sql.OP11,
    "op12_periodic_runs": sql.op12(),
    "op13_warc_zstd": sql.OP13,
}
