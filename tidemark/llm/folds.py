"""Learning from labels: folds by document id and bounded, repeatable samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, label of each labelled id once (1 if any of its rows says 1); null ids and labels go."""
    rows = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")).dropna()
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))


def in_fold(doc_id: Column, n: int, held: int) -> Column:
    """True for rows that may be learned from: a known id whose crc32 modulo n is not held."""
    return F.coalesce(bucket(doc_id, n) != held, F.lit(False))


def held_out(doc_id: Column, n: int, held: int) -> Column:
    return F.coalesce(bucket(doc_id, n) == held, F.lit(False))


def sample_by_class(rows: DataFrame, name: str, most: int) -> DataFrame:
    """At most `most` different (doc_id, name) of each class: those whose ids hash lowest, so the same at every run.

    Counts of different ids by class (one row each) set a bound on the hash that leaves
    about twice as many, so that no more than those are ever sorted, however large a class
    is and however often an id is repeated.
    """
    counts = rows.groupBy(name).agg(F.approx_count_distinct("doc_id", 0.02).alias("_count"))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) / (1 << 32)
    # One row for each class: small enough to broadcast.
    few = rows.select("doc_id", name).join(F.broadcast(counts), name).filter(share < 2 * most / F.col("_count")).select("doc_id", name).distinct()
    order = Window.partitionBy(name).orderBy(share, "doc_id")
    return few.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")
