"""The registered query of each operator: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import bpe_codec, chroma, language_id, quality_gam, simhash, substring_recompression, suffix_dedup, template_decontamination, token_counts, warc
from quernstone.llm.common import shared_dir, table


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shared_dir(spark))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_codec.encode_decode(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), outputs=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("samples"))
    return chroma.align(media, shared_dir(spark), F.col("doc_id") % 50 == 0)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), shared_dir(spark), keep_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shared_dir(spark))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~language_id.held_out()))
    return language_id.identify(docs, model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_gam.fit(docs, table(spark, sf_dir, "labels").filter(~quality_gam.held_out()))
    return quality_gam.score(docs, model).select("doc_id", quality_gam.held_out().alias("held_out"), "score", "predicted")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_and_index(table(spark, sf_dir, "pages"), shared_dir(spark))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


def op10_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_recompression.remove_repeats(table(spark, sf_dir, "documents"), shared_dir(spark), keep_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_template_decontamination": op1_template_decontamination,
    "op2_bpe_codec": op2_bpe_codec,
    "op3_chroma": op3_chroma,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_simhash": op5_simhash,
    "op6_language_id": op6_language_id,
    "op7_token_counts": op7_token_counts,
    "op8_quality": op8_quality,
    "op9_warc": op9_warc,
    "op10_recompression": op10_recompression,
}

ORACLES: dict[str, str] = {}
