"""The registered queries of this subpackage: opN_<name>(spark, sf_dir) over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, jaccard, licenses, packing, quality_model, quality_rules, toxicity, url_filter, warc
from tidemark.llm.common import new_folder, read, remainder


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, "doc_id").select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = jaccard.link(read(spark, sf_dir, "documents"))
    return members.select("doc_id", "n_shingles", "component_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write(read(spark, sf_dir, "pages"), folder)
    return warc.scan(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(read(spark, sf_dir, "documents")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality_model.fit(docs, read(spark, sf_dir, "labels"))
    return quality_model.score(docs, model, "doc_id").select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


#: The rules of op9: host and path -> verdict.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 20 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op3_bpe": op3_bpe,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_warc": op5_warc,
    "op6_licenses": op6_licenses,
    "op7_packing": op7_packing,
    "op8_quality_model": op8_quality_model,
    "op9_url_filter": op9_url_filter,
    "op10_neighbours": op10_neighbours,
}

ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": quality_rules.sql(),
    "op4_ngram_jaccard": jaccard.sql(),
    "op5_warc": warc.sql(),
    "op10_neighbours": ann.sql(),
}
