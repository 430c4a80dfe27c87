"""The corpus queries by name: op1_ to op10_, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from firnspark.llm import bpe, jaccard_join, license_scan, nn_descent, oracles, packing, quality_model, quality_rules, suffix_dedup, url_filter, warc
from firnspark.llm.common import Scratch, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, read back; a record that isn't intact has a null digest."""
    scratch = Scratch(spark, "warc")
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), to := scratch.path("archives"), scratch)
    found = warc.read_archives(manifest, to, payload=False)
    return found.selectExpr("page_id", "payload_bytes", "CASE WHEN intact THEN payload_digest END AS payload_digest", "record_type", "refers_to")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"), Scratch(spark, "neighbours"))[0]


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"), Scratch(spark, "suffixes"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.joined(table(spark, sf_dir, "documents"), Scratch(spark, "jaccard"), jaccard_join.Similarity(85, 100, 4))
    return found.drop("row")


def op8_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """vocabulary: path of the tokenizer's JSON; the public one unless given."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return bpe.token_digests(table(spark, sf_dir, "documents"), vocabulary)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(license_scan.as_files(table(spark, sf_dir, "documents")), Scratch(spark, "licenses"), anchors=license_scan.ANCHORS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_url_filter": op2_url_filter,
    "op3_quality_model": op3_quality_model,
    "op4_nn_descent": op4_nn_descent,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_packing": op6_packing,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_bpe": op8_bpe,
    "op9_quality_rules": op9_quality_rules,
    "op10_license_scan": op10_license_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": oracles.WARC,
    "op4_nn_descent": oracles.NEIGHBOURS,
    "op5_suffix_dedup": oracles.SUFFIXES,
    "op7_jaccard_join": oracles.JACCARD,
    "op2_url_filter": url_filter.ORACLE_SQL,
    "op9_quality_rules": quality_rules.ORACLE_SQL,
    "op10_license_scan": license_scan.ORACLE_SQL,
}
