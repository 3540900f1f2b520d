"""A corpus from raw documents to tokens: quality, exact and near duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again for the next one.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridimpact.llm.bpe import bpe_digest
from gridimpact.llm.common import table, written
from gridimpact.llm.exact_dedup import exact_dedup
from gridimpact.llm.jaccard_join import near_duplicates
from gridimpact.llm.mixing import mixed
from gridimpact.llm.quality_classifier import quality_scores
from gridimpact.llm.queries import WORD_BPE
from gridimpact.session import ship


CORE = ("doc_id", "text", "lang", "source", "n_chars")


def carried(stage):
    """A stage under which further columns of docs have names that no operator uses; they come out as they went in."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: f"_carried_{k}" for k, c in enumerate(docs.columns) if c not in CORE}
        out = stage(spark, docs.withColumnsRenamed(names), sf_dir)
        return out.withColumnsRenamed({v: k for k, v in names.items()})

    return run_stage


@carried
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts are scored like any other; repeated rows get the same score, so all of them stay or go; with labels of one class only every
    score is the share of label 1, and without labels 0.5, which is below the threshold; an empty table stays empty.
    """
    scored = quality_scores(docs, table(spark, sf_dir, "labels"), keep=docs.columns).drop("held_out", "score")
    scored = written(scored, "scored")  # a filter on a computed score would be pushed down and compute it again
    return scored.where("predicted = 1").select(*docs.columns)


@carried
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest identifier.

    Null counts as empty, and of null and empty texts one stays; of repeated rows one stays; null identifiers lose against any other.
    """
    return exact_dedup(docs).where("kept").select(*docs.columns)


@carried
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest identifier of each group of near copies: shingles of five words, similarity of 0.8 or more.

    Texts without words are near nothing and stay; rows that repeat the smallest identifier stay with it (the stage before leaves none of equal texts);
    a document with a null identifier stays only where no document of its group has one.
    """
    found = near_duplicates(docs, width=5, percent=80)
    stay = found.where(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("stays")).distinct()
    return docs.join(stay, docs.doc_id.eqNullSafe(stay.stays), "left_semi")


@carried
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once, and those of domains below their target weight more often, up to 1.25 epochs in all.

    Null and empty texts have no tokens and come once; repeated rows are rated alike, each by itself; without labels all documents come once.
    """
    return mixed(docs, table(spark, sf_dir, "labels"), epochs=1.25, lowest=1.0)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text they decode to.

    Null and empty texts have no tokens and decode to an empty text; each row is encoded, repeated ones too; an empty table gives an empty table.
    """
    return bpe_digest(docs, WORD_BPE, with_ids=True)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("encoding", encoding)]

#: SQL can express neither the classifier nor the encoder; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
