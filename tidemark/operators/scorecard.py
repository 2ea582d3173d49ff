"""The quality scorecard of a data set and its issues."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..sources.stores import QualityHistory
from . import issues as I
from . import profile as P


def penalties(issues: DataFrame) -> DataFrame:
    """stage, issues, penalty: severity-weighted confidences of row-level issues."""
    rows = issues.filter(F.col("row").isNotNull())
    return rows.groupBy("stage").agg(F.count("*").alias("issues"), F.sum(S.severity_weight(F.col("severity")) * S.clamped_confidence(F.col("confidence"))).alias("penalty"))


def worst_rows(issues: DataFrame, k: int = 5) -> DataFrame:
    """row, issue_count, severity_score of the k rows with the most severe issues."""
    rows = issues.filter(F.col("row").isNotNull())
    weight = S.severity_weight(F.col("severity")) * (0.75 + 0.25 * S.clamped_confidence(F.col("confidence")))
    scored = rows.groupBy("row").agg(F.count("*").alias("issue_count"), F.sum(weight).alias("_w"))
    return scored.select("row", "issue_count", F.round(F.col("issue_count") + F.col("_w"), 3).alias("severity_score")).orderBy(F.desc("severity_score"), "row").limit(k)


def missing_by_column(df: DataFrame) -> list[dict]:
    return _missing(df)[0]


def _missing(df: DataFrame) -> tuple[list[dict], int]:
    """Gaps of each column, most first, and the number of rows: one aggregate."""
    names = [f.name for f in P.columns_of(df)]
    seen = P.measure(df, {("", "rows"): F.count("*")} | {(c, "known"): F.count(F.col(f"`{c}`")) for c in names})
    n = seen[""]["rows"]
    out = [{"column": c, "missing": n - seen[c]["known"], "percent": round((n - seen[c]["known"]) / n * 100, 2) if n else 0.0} for c in names]
    return sorted(out, key=lambda r: -r["missing"]), n


def summary(issues: DataFrame) -> DataFrame:
    """column, issue, stage, severity (of the three), row_level, count, penalty: what all counts and scores are sums of.

    One pass over the issues.  A row for each kind of finding, so no more than rules and columns make.
    """
    severity = S.severity(F.col("severity"))
    penalty = F.sum(S.severity_weight(F.col("severity")) * S.clamped_confidence(F.col("confidence")))
    return issues.groupBy("column", "issue", "stage", severity.alias("severity"), F.col("row").isNotNull().alias("row_level")).agg(F.count("*").alias("count"), penalty.alias("penalty"))


def _kinds(counted: DataFrame, columns: list[str]) -> DataFrame:
    """column, issue, count, and the count of each severity, of a summary's row-level issues."""
    rows = counted.filter(F.col("row_level") & F.col("column").isin(columns))
    return rows.groupBy("column", "issue").agg(F.sum("count").alias("count"), *[F.coalesce(F.sum(F.when(F.col("severity") == k, F.col("count"))), F.lit(0)).alias(k) for k in S.SEVERITY_WEIGHTS])


def drilldown(issues: DataFrame, columns: list[str], per_column: int = 10, examples: int = 3, counted: DataFrame | None = None) -> DataFrame:
    """Of the given columns: the most frequent issues, by severity, with a few example rows.  counted is their summary, where it is known."""
    counts = _kinds(summary(issues) if counted is None else counted, columns)
    best = Window.partitionBy("column").orderBy(F.desc("count"), "issue")
    counts = counts.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= per_column).drop("_r")
    rows = I.with_ids(issues.filter(F.col("row").isNotNull() & F.col("column").isin(columns)))
    # Apart from the counts, so that only a few rows of a key are shuffled.
    example = F.struct("row", "issue_id", S.severity(F.col("severity")).alias("severity"), "confidence", "details")
    few = P.first_rows(rows, ["column", "issue"], "row", examples).groupBy("column", "issue").agg(F.collect_list(example).alias("examples"))
    # Details are maps, which can't be compared: rows and ids decide the order.
    few = few.withColumn("examples", F.array_sort("examples", lambda a, b: F.when(a["row"] < b["row"], -1).when(a["row"] > b["row"], 1).when(a["issue_id"] < b["issue_id"], -1).when(a["issue_id"] > b["issue_id"], 1).otherwise(0)))
    return counts.join(few, ["column", "issue"]).orderBy("column", F.desc("count"), "issue")


def overall(parts: dict[str, float]) -> float:
    return round(100 * sum(w * parts[k] for k, w in S.SCORE_PARTS.items()), 2)


def score(df: DataFrame, issues: DataFrame, history: QualityHistory | None = None, top: int = 10) -> dict:
    """Scores, grade, analytics, trend and recommended actions.

    Only issues of a row count against the score; the others are warnings.
    """
    names = [f.name for f in P.columns_of(df)]
    missing, n = _missing(df)
    cells = n * len(names)
    counted = summary(issues).collect()
    own, general = [r for r in counted if r["row_level"]], [r for r in counted if not r["row_level"]]
    penalty: Counter[str] = Counter()
    for r in own:
        penalty[r["stage"]] += r["penalty"]
    duplicates = sum(r["count"] for r in own if "duplicate" in (r["issue"] or "").lower())

    def kept(stage: str, over: int) -> float:
        return 1 - min(1.0, penalty[stage] / over) if over else 0.0

    def most(by: str) -> list[dict]:
        sums: Counter[str] = Counter()
        for r in own:
            sums[r[by]] += r["count"]
        return [{"name": k, "count": c} for k, c in sorted(sums.items(), key=lambda x: (-x[1], x[0] or ""))[:top]]

    parts = {
        "completeness": 1 - sum(m["missing"] for m in missing) / cells if cells else 0.0,
        "validity": kept("semantic", cells),
        "pattern": kept("pattern", cells),
        "consistency": kept("relationship", n),
        "uniqueness": 1 - min(1.0, duplicates / n) if n else 0.0,
    }
    total = overall(parts)
    warned = sum(r["count"] for r in general)
    warnings = [r["issue"] for r in sorted(general, key=lambda r: (r["issue"] or "", r["column"] or "")) for _ in range(r["count"])][:50]
    worst, kinds = most("column"), most("issue")
    known = issues.sparkSession.createDataFrame(counted, summary(issues).schema)
    out = {
        "overall_score": total, "grade": S.grade(total), "scores": {k: round(100 * v, 2) for k, v in parts.items()}, "row_issues": sum(r["count"] for r in own),
        "warnings": {"count": warned, "items": warnings},
        "analytics": {"missing": missing[:top], "worst_columns": worst, "issue_types": kinds, "worst_rows": [r.asDict() for r in worst_rows(issues).collect()], "drilldown": [r.asDict(True) for r in drilldown(issues, [w["name"] for w in worst], counted=known).collect()]},
    }
    if history:
        out["trend"] = history.add(S.fingerprint(n, names), total)
    out["actions"] = actions(out)
    return out


def actions(card: dict) -> list[dict]:
    """What to do next, by what the scorecard shows."""
    a = card["analytics"]
    gaps = [m["column"] for m in a["missing"] if m["missing"] > 0][:3]
    kinds, worst = [x["name"] for x in a["issue_types"][:3]], [x["name"] for x in a["worst_columns"][:3]]
    total, warned = card["overall_score"], card["warnings"]["count"]
    table = [
        (gaps, "high", "Look into the columns with most gaps", f"gaps in {gaps}"),
        (kinds, "high", "Repair the issues that occur most", f"first in number: {kinds}"),
        (worst, "medium", "Tighten the rules of the columns with most issues", f"first in issues: {worst}"),
        (warned, "medium", "Read the findings on whole columns", f"{warned} warnings"),
        (total < 70, "high", "Choose a stricter mode or add rules", f"overall score {total}"),
        (total >= 95 and not warned, "low", "Nothing needs to be done", "a score of 95 or more, and no finding on a whole column"),
    ]
    return [{"priority": p, "action": act, "reason": why} for test, p, act, why in table if test]
