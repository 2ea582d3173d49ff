"""Runs of the pipeline with a scorecard, a time limit, or over many files."""

from __future__ import annotations

import threading
import uuid
import zlib
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from ..operators import issues as I
from ..operators import scorecard
from ..sources import scratch
from ..sources.files import read
from ..sources.stores import QualityHistory
from .pipeline import CleaningPipeline, Options, without_row_id


def size_warnings(df: DataFrame, most_bytes: int = 500 << 20, most_rows: int = 2_000_000, rows: int | None = None) -> list[str]:
    """Warnings of a large input, by Spark's estimate of its bytes and by its rows (counted unless given): results that are collected may not fit."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n = df.count() if rows is None else rows
    return [f"the input is estimated at {size / 1e6:.0f} MB"] * (size > most_bytes) + [f"the input has {n} rows"] * (n >= most_rows)


def clean_and_score(df: DataFrame, pipeline: CleaningPipeline, history: QualityHistory | None = None, progress=None) -> dict:
    """cleaned, issues (row and global), scorecard and reports."""
    result = pipeline.transform(df, strict=True, progress=progress)
    # A table of its own, as the scorecard and the caller read it several times.
    issues = scratch.stash(result.issues, "issues")
    rows, whole = I.split(issues)
    card = scorecard.score(result.df, issues, history)
    return {"cleaned": without_row_id(result.df), "issues": issues, "row_issues": rows, "global_issues": whole, "scorecard": card, "report": result.report, "warnings": size_warnings(df, rows=result.report["rows"]["before"])}


def with_timeout(spark: SparkSession, seconds: float | None, f):
    """f(), its Spark jobs (and any that it starts later) cancelled after so many seconds; by a tag, so that no others are."""
    if not seconds:
        return f()
    tag, context = f"tidemark-{uuid.uuid4().hex}", spark.sparkContext
    done, late = threading.Event(), threading.Event()

    def watch():
        wait = seconds
        while not done.wait(wait):
            late.set()
            context.cancelJobsWithTag(tag)
            wait = 0.2

    context.setInterruptOnCancel(True)
    context.addJobTag(tag)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        return f()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"stopped after {seconds} s") from e
        raise
    finally:
        done.set()
        watcher.join()
        context.removeJobTag(tag)


def run(df: DataFrame, options: Options | None = None, pipeline: CleaningPipeline | None = None, history_path: str | None = None, timeout: float | None = None, progress=None) -> dict:
    """A given fitted pipeline, or a new one, over df."""

    def work():
        fitted = pipeline or CleaningPipeline(options).fit(df)
        return clean_and_score(df, fitted, QualityHistory(history_path) if history_path else None, progress)

    return with_timeout(df.sparkSession, timeout, work)


def run_files(spark: SparkSession, paths: Iterable[str], pipeline: CleaningPipeline | None = None, options: Options | None = None, workers: int = 2, timeout: float | None = None, **read_options) -> tuple[dict[str, dict], dict[str, str]]:
    """Results and failures by file; files run side by side, each with its own time limit.

    Each file's jobs are in a scheduler pool of their own: under spark.scheduler.mode=FAIR
    a large file does not hold back the others.
    """

    def one(path: str):
        # The property is this thread's alone.
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"tidemark-{zlib.crc32(path.encode()):08x}")
        try:
            return path, run(read(spark, path, **read_options), options, pipeline, timeout=timeout), None
        except Exception as e:
            return path, None, f"{type(e).__name__}: {e}"
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    results, failures = {}, {}
    with ThreadPoolExecutor(workers) as pool:
        for path, result, error in pool.map(one, list(paths)):
            if error is None:
                results[path] = result
            else:
                failures[path] = error
    return results, failures
