"""Fitted models on streams.

Names, structure and export are projections and run on a stream as they are; the whole
pipeline, which looks at the data's statistics, runs on each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators import issues as I
from ..operators import names, structure
from ..plans.pipeline import CleaningPipeline


def structural(stream: DataFrame, plan: structure.Plan, config: structure.Config = structure.Config(), new_names: list[str] | None = None) -> DataFrame:
    """A stream renamed and structurally cleaned by a fitted plan: no state, no aggregate."""
    renamed = names.rename(stream, new_names) if new_names else stream
    return structure.apply(renamed, plan, config)[0]


def per_batch(stream: DataFrame, pipeline: CleaningPipeline, sink: Callable[[DataFrame, DataFrame, int], None]) -> DataStreamWriter:
    """A writer that cleans each micro-batch and hands cleaned rows, issues and batch number to sink.

    Writes in sink should be idempotent by the batch number, as a batch may be repeated.
    """

    def handle(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        cached = I.with_row_id(batch).persist()
        try:
            result = pipeline.transform(cached)
            sink(result.df, result.issues, number)
        finally:
            cached.unpersist()

    return stream.writeStream.foreachBatch(handle)
