"""Findings as rows: schema, construction in one pass, deduplication, counts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring

ROW_ID = "__row_id"

SCHEMA = (
    "row long, column string, stage string, severity string, issue string, confidence double, explanation string, "
    "details map<string,string>, suggested_fix map<string,string>, semantic_type string, semantic_confidence double, "
    "semantic_source string, rule_weight double, base_confidence double"
)
_EXTRAS = {"semantic_type": "string", "semantic_confidence": "double", "semantic_source": "string", "rule_weight": "double", "base_confidence": "double"}


@dataclass
class Rule:
    """One kind of finding: rows where `when` holds get an issue.  Texts may be Columns."""

    when: Column
    column: str
    stage: str
    severity: str
    issue: str
    confidence: float
    explanation: Column | str = ""
    details: dict[str, Column | str] = field(default_factory=dict)
    fix: dict[str, str] = field(default_factory=dict)
    extras: dict[str, object] = field(default_factory=dict)

    def struct(self, row: Column) -> Column:
        def text(x) -> Column:
            return x.cast("string") if isinstance(x, Column) else F.lit(None if x is None else str(x)).cast("string")

        def as_map(values: dict) -> Column:
            pairs = [y for k, v in values.items() for y in (F.lit(k), text(v))]
            return (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>")

        return F.struct(
            row.cast("long").alias("row"),
            F.lit(self.column).cast("string").alias("column"),
            F.lit(self.stage).alias("stage"),
            F.lit(self.severity).alias("severity"),
            F.lit(self.issue).alias("issue"),
            F.lit(float(self.confidence)).alias("confidence"),
            text(self.explanation).alias("explanation"),
            as_map(self.details).alias("details"),
            as_map(self.fix).alias("suggested_fix"),
            *[F.lit(self.extras.get(k)).cast(t).alias(k) for k, t in _EXTRAS.items()],
        )


def with_row_id(df: DataFrame) -> DataFrame:
    """df with ROW_ID, ascending in the order of its partitions; left alone if it has one."""
    return df if ROW_ID in df.columns else df.withColumn(ROW_ID, F.monotonically_increasing_id())


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def find(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Issues of all rules over df (which has ROW_ID), in one pass over its rows."""
    if not rules:
        return empty(df.sparkSession)
    hits = [F.when(r.when, r.struct(F.col(ROW_ID))) for r in rules]
    found = df.select(F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("i")).select("i.*")
    return found


def globals_(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Issues that concern no single row."""
    if not rules:
        return empty(spark)
    return spark.range(1).select(F.explode(F.array(*[r.struct(F.lit(None)) for r in rules])).alias("i")).select("i.*")


def union(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    out = empty(spark)
    for p in parts:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def distinct(issues: DataFrame) -> DataFrame:
    """One issue for each (stage, row, column, issue): the one of highest confidence, then first explanation."""
    key = Window.partitionBy("stage", "row", "column", "issue").orderBy(F.desc("confidence"), "explanation", F.to_json("details"))
    return issues.withColumn("_n", F.row_number().over(key)).filter("_n = 1").drop("_n")


def with_ids(issues: DataFrame) -> DataFrame:
    return issues.withColumn("issue_id", scoring.issue_id(F.col("row"), F.col("column"), F.col("stage"), F.col("issue")))


def split(issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Row-level and global issues."""
    return issues.filter(F.col("row").isNotNull()), issues.filter(F.col("row").isNull())


def counts(issues: DataFrame, *keys: str, row_only: bool = True) -> DataFrame:
    """keys, count, most frequent first."""
    rows = issues.filter(F.col("row").isNotNull()) if row_only else issues
    return rows.groupBy(*keys).agg(F.count("*").alias("count")).orderBy(F.desc("count"), *keys)


#: Cuts by which the first issues of a kind are bounded, and the accuracy of their sketch.
CUTS, ACCURACY = 200, 2000


def first_per_rule(issues: DataFrame, most: int) -> DataFrame:
    """The first `most` issues of each column and issue, by row (those of no row first): a limit for reports only.

    A sketch of the rows of each kind of issue bounds where they lie, so that of a kind
    with many more issues only about one in a hundred beyond them is shuffled.
    """
    n = F.count("row")
    cuts = F.percentile_approx("row", F.expr(f"array({', '.join(f'{i / CUTS}D' for i in range(CUTS + 1))})"), F.lit(ACCURACY))
    at = F.least(F.lit(CUTS), (F.ceil((F.lit(most) / n + 1 / ACCURACY) * CUTS) + 1).cast("int"))
    kinds = issues.groupBy(F.col("column").alias("_column"), F.col("issue").alias("_issue")).agg(F.when(n > most, F.get(cuts, at)).alias("_last"))
    # One row for each kind of issue, of which there are no more than rules.
    bounded = issues.join(kinds, F.col("column").eqNullSafe(F.col("_column")) & F.col("issue").eqNullSafe(F.col("_issue")))
    few = bounded.filter(F.col("row").isNull() | F.col("_last").isNull() | (F.col("row") <= F.col("_last"))).drop("_column", "_issue", "_last")
    key = Window.partitionBy("column", "issue").orderBy("row")
    return few.withColumn("_n", F.row_number().over(key)).filter(F.col("_n") <= most).drop("_n")
