"""The corpus pipeline: documents of known language and good quality, without near duplicates, packed.

Every stage works on all that the one before it kept. Stages that filter return all columns of their
input, also extra ones; the last returns the pieces and their places in the sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadline.llm import langid, minhash, packing, quality
from threadline.llm.common import stage, table


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is undetermined or less sure than the calibrated threshold.

    Null and letterless texts go. Rows without a language to learn from are judged like all others.
    """
    return langid.accepted(docs, langid.fit(docs))


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score less than 0.7, by a classifier learned from the labels of the folder."""
    return quality.good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, percent: int = 80) -> DataFrame:
    """Keep the smallest id of every group of near duplicates: documents of a similarity of ``percent`` or more.

    Bands are narrower for a lower threshold, so that a pair just at it is hardly ever missed by all.

    Documents without words, and rows without id, are duplicates of nothing and stay. Rows that
    repeat one id are one document and stay together.
    """
    found = stage(minhash.near_duplicates(docs, percent=percent, band_rows=6 if percent >= 85 else 5), "dedup")
    dropped = found.where("NOT kept").select("doc_id").distinct()
    # A merge at every size: how many are dropped grows with the corpus, so they are never broadcast.
    return docs.join(dropped.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", keep_known_languages),
    ("quality", keep_good_quality),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]

#: Learned stages cannot be written in SQL; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
