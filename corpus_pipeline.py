"""A corpus pipeline: documents in, packed training pieces out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.  All but the last keep the columns of
documents as they are.  Rows are judged by their text alone: a null or empty text is
scored like any other, repeated rows are judged alike (and then deduplicated), null ids
pass the filters, an empty table gives empty results, and further columns are kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import jaccard, packing, quality, toxicity
from tidemark.llm.common import scratch_path, table
from tidemark.llm.folds import labelled

#: Documents of at least this toxicity score are rejected.
TOXIC = 0.5
#: Documents below this quality score are rejected.
GOOD = 0.3
#: Near duplicates share this many words in a row ...
SHINGLE_WORDS = 5
#: ... and this part of their shingles.
NEAR = jaccard.Threshold(80, 100)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC; learned from the labels of documents still here.

    A null or empty text has the model's bias for a score; null ids are judged by their
    text and not learned from, repeated rows alike; an empty table stays empty; without
    labels every score is 0.5, so all documents go; columns of any name are kept.
    """
    model = toxicity.fit(docs, labelled(table(spark, sf_dir, "labels"), "toxic"))
    return toxicity.keep_clean(docs, model, TOXIC)


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least GOOD; learned from the labels of documents still here.

    A null or empty text is scored by statistics of 0; null ids are judged by their text
    and not learned from, repeated rows alike; an empty table stays empty; without labels
    every score is 0.5, so all documents stay; columns of any name are kept.
    """
    model = quality.fit(quality.statistics(docs), labelled(table(spark, sf_dir, "labels"), "quality"))
    return quality.keep_good(docs, model, GOOD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that near-duplicate links connect: that of the least id.

    Texts without words are linked with nothing, so all of them stay; repeated rows are
    copies of each other; an empty table stays empty; columns of any name are kept.
    """
    return jaccard.keep_one(docs, SHINGLE_WORDS, NEAR)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths of every document, none crossing documents.

    A null or empty text is one piece of its end id; null ids and repeated rows are packed
    like any other row; an empty table gives no pieces; other columns are dropped.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


STAGES = [("toxicity", reject_toxic), ("quality", reject_poor), ("near_duplicates", drop_near_duplicates), ("packing", pack)]

#: SQL cannot express the classifiers or the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
