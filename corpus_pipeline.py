"""The corpus pipeline: five stages over documents, each reading what the one before has written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnspark.llm import jaccard_join, packing, quality_model, quality_rules, suffix_dedup
from firnspark.llm.common import Scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: What the stages have written for their own use, for run() to delete once their results are written.
_made: list[Scratch] = []


def _scratch(spark: SparkSession, label: str) -> Scratch:
    _made.append(found := Scratch(spark, label))
    found.free()
    return found


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def _judged(docs: DataFrame, name: str) -> DataFrame:
    """docs as they are, with a count of rows observed.

    The optimizer moves no filter below it, so what the filter reads isn't computed a second time
    for every place where it is used.
    """
    return docs.observe(f"{name}-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, trained on the labels, predicts to be good.

    Null and empty texts get the score of an empty text; null ids are never trained on, but judged like others.
    Repeated rows are judged one by one. Extra columns go; an empty table gives an empty one.
    """
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    return _columns(_judged(quality_model.scored(docs, model), "scored").where("predicted = 1"))


def quality_rule_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps. The verdict is read from the text in the same row, without a join.

    Null and empty texts have no words, so they go. Null ids and repeated rows are judged like any other, extra columns
    go, an empty table gives an empty one.
    """
    kept = _judged(quality_rules.with_bits(docs), "ruled")
    for policy in (quality_rules.BASE, quality_rules.POLICIES["v1"]):
        kept = kept.where(F.col("failed_bits").bitwiseAND(F.lit(quality_rules.mask(policy)).cast("long")) == 0)
    return _columns(kept)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 of shingles of five words.

    That of the least id stays, of repeated rows the first as read. Documents without words (null, empty) are linked
    with nothing and stay; a null id stays only where its group has no other. Extra columns go, an empty table gives
    an empty one. The result must be written before the next stage is called with it.
    """
    return _columns(jaccard_join.one_of_each(docs, _scratch(spark, "pipeline-jaccard")))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes or more that occur elsewhere; n_chars is counted anew.

    Null texts stay null, with null n_chars; short and empty ones stay as they are. Repeated rows lose what they share.
    Null ids stay, extra columns go, an empty table gives an empty one.
    """
    cut = suffix_dedup.without_repeats(_columns(docs), _scratch(spark, "pipeline-suffixes"))
    return _columns(cut.withColumn("n_chars", F.length("text").cast("long")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in a training sequence, by its words.

    Documents without words (null, empty) have one row of length 0 without a place. Null ids and repeated rows are packed
    like any other; an empty table gives an empty one.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rule_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("best-fit packing", pack),
]

#: The classifier and the packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each result written below the shared folder and read again.

    What a stage has written for itself and what it has read is deleted once its result is written, so
    the shared folder holds the last result alone in the end.
    """
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before = len(_made)
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{k}")
        for used in _made[before:]:
            used.drop()
        del _made[before:]
        if k:
            scratch.drop(f"stage-{k - 1}")
        scratch.free()
    return docs
