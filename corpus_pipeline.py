"""A corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import bpe_codec, language_id, simhash, substring_recompression, template_decontamination
from quernstone.llm.common import may_be_in, settle, shared_dir, table
from quernstone.llm.repeats import with_part

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or without an n-gram of any language, go."""
    return language_id.keep_known(docs, language_id.fit(docs.filter(~language_id.held_out())))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near copies link (five-word shingles, Jaccard similarity 0.8 or more), the one with the smallest id stays.

    Rows with equal doc_id and text are one; rows without doc_id all stay.
    """
    goes = simhash.near_copies(docs, shared_dir(spark)).filter("doc_id <> component_id").select("doc_id")
    goes = settle(goes, shared_dir(spark))
    may_go = F.coalesce(may_be_in(goes)(F.col("doc_id")), F.lit(False))
    kept = docs.filter(~may_go).unionByName(docs.filter(may_go).join(goes, "doc_id", "left_anti").select(*docs.columns))
    sha = F.sha2(F.col("text").cast("binary"), 256)
    again = docs.filter("doc_id is not null").groupBy("doc_id", sha.alias("sha")).count().filter("count > 1").select("doc_id").distinct()
    if again.isEmpty():
        return kept
    return kept.join(again, "doc_id", "left_anti").unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that repeat an earlier window go; a text that loses none stays as it is."""
    key = ["doc_id", "part"]  # a doc_id may have several texts
    found = substring_recompression.remove_repeats(docs, shared_dir(spark)).filter("n_removed > 0").select(*key, F.col("kept").alias("kept_text")).dropDuplicates(key)
    out = with_part(docs).join(found, key, "left").withColumn("text", F.coalesce("kept_text", "text"))
    return out.withColumn("n_chars", F.when(F.col("kept_text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other values, go."""
    found = template_decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"), shared_dir(spark))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token ids (little-endian 32-bit) and digests of ids and decoded text."""
    return bpe_codec.encode_decode(docs, tokenizer("word_bpe_49k.json")).drop("decoded")


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("repeats", without_repeats),
    ("decontamination", uncontaminated),
    ("encoding", encoded),
]

#: Trained filters, n-fold word windows and subword merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what lies between them is in a shared folder."""
    base, docs = shared_dir(spark), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
