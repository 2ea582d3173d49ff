"""Files in and out."""

from __future__ import annotations

import json
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from ..operators.issues import with_row_id
from ..operators.names import strip_headers
from ..operators.profile import nan_to_null
from . import shared


def read_csv(spark: SparkSession, path: str, infer: bool = True, **options) -> DataFrame:
    """A CSV file or folder with a header; white space before values is dropped."""
    reader = spark.read.option("header", True).option("inferSchema", infer).option("ignoreLeadingWhiteSpace", True)
    return strip_headers(reader.options(**options).csv(path))


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """A CSV, Parquet, ORC or JSON-lines source by its extension."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return read_csv(spark, path, **options)
    if kind in ("parquet", "orc", "json"):
        return spark.read.format(kind).options(**options).load(path)
    if kind in ("xlsx", "xls"):
        return read_xlsx(spark, path, **options)
    raise ValueError(f"unsupported file type: {path}")


def read_xlsx(spark: SparkSession, path: str, **options) -> DataFrame:
    """A workbook's first sheet, through pandas on the driver (workbooks are small); needs openpyxl."""
    try:
        import openpyxl  # noqa: F401
        import pandas as pd
    except ImportError as e:
        raise NotImplementedError("reading workbooks needs the openpyxl package") from e
    return spark.createDataFrame(pd.read_excel(path, **options))


def ingest(df: DataFrame) -> DataFrame:
    """NaN to null, and a row id."""
    return with_row_id(nan_to_null(df))


def read_many(spark: SparkSession, paths: Iterable[str], **options) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Lazy frames by path, and the errors of those that cannot be read."""
    frames, errors = {}, {}

    def one(path):
        try:
            return path, read(spark, path, **options), None
        except Exception as e:  # each file's failure is its own
            return path, None, str(e)

    with ThreadPoolExecutor(4) as pool:
        for path, df, error in pool.map(one, list(paths)):
            if error is None:
                frames[path] = df
            else:
                errors[path] = error
    return frames, errors


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("overwrite").csv(path)


#: Rows of a sheet, headings included; a fixed value.
SHEET_ROWS = 1_048_576


def write_xlsx(df: DataFrame, path: str) -> None:
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise NotImplementedError("writing workbooks needs the openpyxl package") from e
    # A sheet holds no more rows than this; one more tells of too many.
    rows = df.limit(SHEET_ROWS).toPandas()
    if len(rows) >= SHEET_ROWS:
        raise ValueError(f"a sheet holds {SHEET_ROWS - 1} rows at most: write CSV instead")
    rows.to_excel(path, index=False)


def write_report(report: dict, path: str) -> bool:
    """The report as JSON, whole or not at all; path may be a URI.  False if it could not be written."""
    try:
        shared.write_text(path, json.dumps(report, indent=2, default=str, ensure_ascii=False))
    except (OSError, Py4JError):
        return False
    return True


def write_issues(issues: DataFrame, path: str) -> None:
    issues.write.mode("overwrite").json(path)
