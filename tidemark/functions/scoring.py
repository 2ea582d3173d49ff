"""Weights, grades, ids and confidence rules, as plain functions and as Columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weight of an issue by severity, and the parts of the overall score.
SEVERITY_WEIGHTS = {"error": 2.5, "warn": 1.0, "info": 0.25}
SCORE_PARTS = {"completeness": 0.25, "validity": 0.30, "consistency": 0.20, "uniqueness": 0.15, "pattern": 0.10}
GRADES = [(95, "A"), (85, "B"), (70, "C"), (55, "D")]


def severity(c: Column) -> Column:
    """One of error, warn, info; anything else is warn."""
    s = F.lower(F.trim(F.coalesce(c, F.lit("warn"))))
    return F.when(s.isin(list(SEVERITY_WEIGHTS)), s).otherwise("warn")


def severity_weight(c: Column) -> Column:
    s = severity(c)
    return F.when(s == "error", SEVERITY_WEIGHTS["error"]).when(s == "info", SEVERITY_WEIGHTS["info"]).otherwise(SEVERITY_WEIGHTS["warn"])


def clamped_confidence(c: Column) -> Column:
    """Between 0.1 and 1; 0.6 if unknown."""
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.6))))


def issue_id(row: Column, column: Column, stage: Column, issue: Column) -> Column:
    """First 12 hexadecimal digits of the SHA-1 of row|column|stage|issue, None standing for null."""
    parts = [F.coalesce(c.cast("string"), F.lit("None")) for c in (row, column, stage, issue)]
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12)


def fingerprint(n_rows: int, columns: Iterable[str]) -> str:
    names = list(columns)
    return hashlib.sha1(f"{n_rows}|{len(names)}|{'|'.join(names)}".encode()).hexdigest()[:16]


def grade(score: float) -> str:
    return next((g for least, g in GRADES if score >= least), "F")


def grade_column(score: Column) -> Column:
    out = F.lit("F")
    for least, g in reversed(GRADES):
        out = F.when(score >= least, g).otherwise(out)
    return out


def pattern_confidence(hit_ratio: float) -> float:
    """Confidence in findings of a pattern that so many values match."""
    return next((c for least, c in ((0.95, 0.95), (0.85, 0.90), (0.70, 0.80), (0.55, 0.70)) if hit_ratio >= least), 0.60)


def decayed(confidence: float, days: int) -> float:
    """5 % less for every 30 days, between 0 and 1."""
    return max(0.0, min(1.0, confidence * 0.95 ** (days / 30)))
