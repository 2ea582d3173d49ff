"""Distinct counts by mergeable sketches, and by counting only where a sketch leaves a decision open.

A HyperLogLog sketch of each column takes a few kilobytes, whatever the column holds; the
sketches of partitions, files and runs merge into that of all their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .issues import ROW_ID

#: log2 of a sketch's registers.
REGISTERS = 12
#: A count lies within this share of its estimate, by four standard errors of a merged sketch.
ERROR = 4 * 1.04 / 2 ** (REGISTERS / 2)


def hashed(c: Column) -> Column:
    """64 bits that stand for a known value; null for null."""
    return F.when(c.isNotNull(), F.xxhash64(c.cast("string")))


def sketch(c: Column) -> Column:
    """Aggregate: the sketch of a column's known values (of their hashes, as sketches leave out empty texts)."""
    return F.hll_sketch_agg(hashed(c), F.lit(REGISTERS))


def estimate(c: Column) -> Column:
    """Aggregate: about how many different known values there are."""
    return F.hll_sketch_estimate(sketch(c))


def sketches(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """column, rows, known, sketch of each column: one pass for all, nothing but sketches is shuffled."""
    names = names if names is not None else [c for c in df.columns if c != ROW_ID]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, rows long, known long, sketch binary")
    parts = [F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count(F.col(f"`{c}`")).alias("known"), sketch(F.col(f"`{c}`")).alias("sketch")) for c in names]
    return df.agg(*[p.alias(f"c{i}") for i, p in enumerate(parts)]).select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(names))])).alias("s")).select("s.*")


def merge(parts: DataFrame) -> DataFrame:
    """One row for each column of sketches of several frames, as of all their rows together."""
    return parts.groupBy("column").agg(F.sum("rows").alias("rows"), F.sum("known").alias("known"), F.hll_union_agg("sketch").alias("sketch"))


def counts(parts: DataFrame) -> DataFrame:
    """column, rows, known, estimate, low, high: between low and high lies the number of different values, almost surely."""
    e = F.hll_sketch_estimate("sketch")
    out = merge(parts).select("column", "rows", "known", e.alias("estimate"))
    spread = F.ceil(F.col("estimate") * ERROR)
    # Small counts are kept value by value, so a sketch that says 0 or 1 is right.
    low = F.when(F.col("estimate") <= 1, F.col("estimate")).otherwise(F.col("estimate") - spread)
    return out.withColumns({"low": low, "high": F.least(F.col("known"), F.when(F.col("estimate") <= 1, F.col("estimate")).otherwise(F.col("estimate") + spread))})


def exact(df: DataFrame, names: list[str]) -> dict[str, int]:
    """Different known values of each column, counted: by 64-bit hashes, so that long values aren't shuffled."""
    if not names:
        return {}
    flat = df.select(*[hashed(F.col(f"`{c}`")).alias(c) for c in names]).unpivot([], names, "column", "value").filter(F.col("value").isNotNull())
    found = {r["column"]: r["n"] for r in flat.distinct().groupBy("column").agg(F.count("*").alias("n")).collect()}
    return {c: found.get(c, 0) for c in names}


def distinct(df: DataFrame, names: list[str], at_most: int | None = None, share: float | None = None, parts: DataFrame | None = None) -> dict[str, int]:
    """Different values of each column, exact wherever that decides about count <= at_most or count / known <= share.

    parts are sketches of the frame, where they are known already; columns whose bounds
    lie on one side of both limits keep their estimates, so that the comparisons come out
    as they would with exact counts.
    """
    rows = counts(sketches(df, names) if parts is None else parts.filter(F.col("column").isin(names))).collect()
    out = {r["column"]: r["estimate"] for r in rows}
    limits = {r["column"]: [x for x in (at_most, None if share is None else share * r["known"]) if x is not None] for r in rows}
    near = [r["column"] for r in rows if any(r["low"] <= x <= r["high"] for x in limits[r["column"]])]
    return {c: out.get(c, 0) for c in names} | exact(df, near)


def append(parts: DataFrame, path: str, run: str) -> None:
    """Adds a run's sketches to the table at path, which any number of runs may do at once.  path is a URI that Spark can write to."""
    parts.withColumn("run", F.lit(run)).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Sketches of all runs so far, merged."""
    return merge(spark.read.parquet(path))
