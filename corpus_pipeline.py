"""Documents to packed training sequences, in stages.

quality -> exact deduplication -> near deduplication -> mixing -> packing. Each stage works on all that the one before
kept; all but the last return the columns of documents, whatever they are, so further columns and clashing names pass
through. A null or empty text, a null doc_id, repeated rows and an empty table are legal in every stage; what becomes of
them is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxframe.llm import exact_dedup, mixing, near_dedup, packing, quality
from voxframe.llm.shared import publish, scratch


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts: score at least quality.THRESHOLD.

    Null and empty texts are scored like others (and are mostly rejected); a null doc_id is no obstacle; rows that repeat
    are kept or go together; without labels of both classes every score is the share of label 1.
    """
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space: the longest, then the smallest doc_id.

    Null and empty texts are one group; a null doc_id ranks last; of repeated rows one stays. docs may be any frame; it
    is written first, as locators must be unique.
    """
    return exact_dedup.survivors(docs)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words a shingle, similarity of 0.8 or more.

    The smallest doc_id of a component stays. Texts without words have no links and stay, as do rows without a doc_id;
    rows that repeat a doc_id count as one document and stay or go together.
    """
    return near_dedup.survivors(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights (sizes to the power mixing.TEMPERATURE), shuffled globally.

    A document may come out several times or not at all: that is Poisson replication. A null source is a source of its
    own; a null text has size 0; a null doc_id is drawn by its text; rows of one doc_id get the same count.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, as token ids, placed in training sequences: the columns of packing.packed().

    A null or empty text is its end id alone; repeated rows are packed as often as they come.
    """
    return packing.packed(docs)


STAGES = [("quality", keep_quality), ("exact_dedup", keep_one_of_equal), ("near_dedup", keep_one_of_near), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Learned scores and packing can't be told in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = publish(stage(spark, docs, sf_dir), scratch(spark, f"stage-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)
