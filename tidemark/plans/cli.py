"""Command lines: train, clean, report.

    python -m tidemark.plans.cli train data.csv model.json [--mode balanced]
    python -m tidemark.plans.cli clean data.csv model.json out/
    python -m tidemark.plans.cli report out/report.json
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from ..sources import scratch
from ..sources.files import read, write_csv, write_issues, write_report
from .pipeline import MODES, CleaningPipeline, fit_and_save
from .runner import clean_and_score


def summarise(report: dict) -> list[str]:
    """A line for each stage of a report."""
    out = [f"status: {report.get('status')}"]
    for name, s in report.get("stages", {}).items():
        facts = ", ".join(f"{k}={len(v) if isinstance(v, list | dict) else v}" for k, v in s.items() if k != "status")
        out.append(f"{name}: {s.get('status')} ({facts})")
    return out


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Train and apply a cleaning pipeline.")
    sub = p.add_subparsers(dest="command", required=True)
    train = sub.add_parser("train")
    clean = sub.add_parser("clean")
    for s in (train, clean):
        s.add_argument("data")
        s.add_argument("model")
    train.add_argument("--mode", choices=sorted(MODES), default="balanced")
    clean.add_argument("out")
    sub.add_parser("report").add_argument("path")
    a = p.parse_args(args)
    if a.command == "report":
        print("\n".join(summarise(json.loads(Path(a.path).read_text(encoding="utf-8")))))
        return 0
    spark = SparkSession.builder.getOrCreate()
    df = read(spark, a.data)
    if a.command == "train":
        fit_and_save(df, a.model, a.mode)
        return 0
    found = clean_and_score(df, CleaningPipeline.load(a.model))
    write_csv(found["cleaned"], f"{a.out}/cleaned.csv")
    write_issues(found["issues"], f"{a.out}/issues")
    write_report(found["report"] | {"scorecard": found["scorecard"]}, f"{a.out}/report.json")
    print(f"score {found['scorecard']['overall_score']} ({found['scorecard']['grade']}), {found['scorecard']['row_issues']} issues")
    return 0


if __name__ == "__main__":
    code = main()
    if spark := SparkSession.getActiveSession():
        # All results are written by now.
        scratch.clear(spark)
    raise SystemExit(code)
