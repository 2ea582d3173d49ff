"""Tables between jobs, in the folder that the cluster shares: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; one of our own only on a local master that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _place(spark: SparkSession) -> str:
    """Where this application's tables are."""
    return f"{folder(spark)}/tidemark/{spark.sparkContext.applicationId}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """df as a table of its own, made once."""
    path = f"{_place(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made(df: DataFrame, label: str) -> tuple[DataFrame, int, dict[str, int]]:
    """df as a table of its own, its number of rows, and the nulls of each column: all from the one job that writes it.

    Columns of any name are kept; so are those of type void, which files can't hold.
    """
    spark, fields = df.sparkSession, df.schema.fields
    void = [isinstance(f.dataType, T.NullType) for f in fields]
    seen = Observation()
    flat = df.toDF(*[f"c{i}" for i in range(len(fields))])
    flat = flat.withColumns({f"c{i}": F.col(f"c{i}").cast("string") for i, v in enumerate(void) if v})
    told = flat.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(f"c{i}").isNull()).alias(f"n{i}") for i in range(len(fields))])
    path = f"{_place(spark)}/{label}-{uuid.uuid4().hex}"
    told.write.parquet(path)
    back = spark.read.schema(flat.schema).parquet(path)
    back = back.select(*[(F.lit(None) if v else F.col(f"c{i}")).alias(f.name) for i, (f, v) in enumerate(zip(fields, void, strict=True))])
    return back, seen.get["rows"], {f.name: seen.get[f"n{i}"] for i, f in enumerate(fields)}


def clear(spark: SparkSession) -> None:
    """Deletes the tables that this application has made so far; its results that have not been read yet are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_place(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
