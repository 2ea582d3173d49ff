"""The first known values of columns by row id, without sorting or moving the cells of a frame.

Row ids mostly ascend within partitions and from one partition to the next.  Where they do,
a few leading partitions, each read until every column has shown enough values, tell up to
which row id the wanted values lie; where they do not, every partition tells its lowest.
Only cells up to that row id are then looked at: the frame itself is filtered, not dealt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .issues import ROW_ID

#: Partitions that are read first, and how many times more at each further step.
LEADING, GROWTH = 4, 8

_FOUND = "start long, found array<long>, last array<long>"


def spans(df: DataFrame) -> list[tuple[int, int, bool]]:
    """First and last row id of each partition that has rows, and whether its row ids ascend; from the row ids alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        ascends = True
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if len(ids):
                ascends = ascends and bool((np.diff(ids) > 0).all()) and (last is None or ids[0] > last)
                first, last = ids[0] if first is None else first, ids[-1]
        if first is not None:
            yield pa.RecordBatch.from_pydict({"first": pa.array([first], pa.int64()), "last": pa.array([last], pa.int64()), "ascends": [ascends]})

    rows = df.select(F.col(ROW_ID).cast("long")).mapInArrow(run, "first long, last long, ascends boolean").collect()
    return sorted((r["first"], r["last"], r["ascends"]) for r in rows)


def _flags(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(F.col(ROW_ID).cast("long"), *[F.col(f"`{c}`").isNotNull() for c in names])


def _result(start: int, found: list[int], last: list[int | None]) -> pa.RecordBatch:
    kind = pa.list_(pa.int64())
    return pa.RecordBatch.from_pydict({"start": pa.array([start], pa.int64()), "found": pa.array([found], kind), "last": pa.array([last], kind)})


def _leading(starts: set[int], columns: int, n: int) -> Callable:
    """Of partitions that begin with one of starts: known values of each column, up to n, and the row id of the last counted."""

    def run(batches):
        found, last, start = [0] * columns, [None] * columns, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            if start is None:
                start = int(ids[0])
                if start not in starts:
                    return
            for i in range(columns):
                if found[i] < n:
                    at = np.flatnonzero(batch.column(i + 1).to_numpy(zero_copy_only=False))[: n - found[i]]
                    if len(at):
                        found[i] += len(at)
                        last[i] = int(ids[at[-1]])
            if min(found) >= n:
                break
        if start is not None:
            yield _result(start, found, last)

    return run


def _lowest(columns: int, n: int) -> Callable:
    """Of every partition: known values of each column, up to n, and the highest of their lowest row ids."""

    def run(batches):
        held = [np.zeros(0, np.int64)] * columns
        start = None
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if len(ids):
                start = int(ids[0]) if start is None else start
            for i in range(columns):
                new = ids[batch.column(i + 1).to_numpy(zero_copy_only=False).astype(bool)]
                if len(held[i]) == n:
                    new = new[new < held[i].max()]
                if len(new):
                    both = np.concatenate([held[i], new])
                    held[i] = np.partition(both, n - 1)[:n] if len(both) > n else both
        if start is not None:
            yield _result(start, [len(h) for h in held], [int(h.max()) if len(h) else None for h in held])

    return run


def bounds(df: DataFrame, names: list[str], n: int) -> dict[str, int | None]:
    """For each column a row id up to which it has at least n known values; None for a column with fewer in all.

    With ascending row ids there are fewer than 2 * n of them; otherwise at most n of each
    partition.  One row for each partition that is looked at reaches the driver.
    """
    out: dict[str, int | None] = dict.fromkeys(names)
    todo = list(names)
    order = spans(df)
    if all(ascends for *_, ascends in order) and all(a[1] < b[0] for a, b in zip(order, order[1:], strict=False)):
        total = dict.fromkeys(names, 0)
        at, step = 0, LEADING
        while todo and at < len(order):
            wave = [first for first, *_ in order[at : at + step]]
            rows = {r["start"]: r for r in _flags(df, todo).mapInArrow(_leading(set(wave), len(todo), n), _FOUND).collect()}
            if rows.keys() != set(wave):
                # The frame was dealt otherwise than a moment ago, so what was counted may not hold.
                todo = list(names)
                break
            for first in wave:
                for i, c in enumerate(todo):
                    if total[c] < n and rows[first]["found"][i]:
                        total[c] += rows[first]["found"][i]
                        out[c] = rows[first]["last"][i] if total[c] >= n else None
            todo = [c for c in todo if total[c] < n]
            at, step = at + step, step * GROWTH
        else:
            return out
    rows = _flags(df, todo).mapInArrow(_lowest(len(todo), n), _FOUND).collect()
    for i, c in enumerate(todo):
        out[c] = min((r["last"][i] for r in rows if r["found"][i] >= n), default=None)
    return out


def cells(df: DataFrame, names: list[str], n: int) -> DataFrame:
    """ROW_ID, column, value (as text): known cells up to the row id that bounds gives; at least the first n of each column."""
    limits = bounds(df, names, n)
    row = F.col(ROW_ID)
    flat = df
    if all(v is not None for v in limits.values()):
        flat = df.filter(row <= max(limits.values()))
    flat = flat.select(ROW_ID, *[(F.col(f"`{c}`") if limits[c] is None else F.when(row <= limits[c], F.col(f"`{c}`"))).cast("string").alias(c) for c in names])
    return flat.unpivot([ROW_ID], names, "column", "value").filter(F.col("value").isNotNull())


def first_known(df: DataFrame, names: list[str], n: int) -> DataFrame:
    """column, value, place (from 1): the first n known values of each column, by row id.  A limit that defines a heuristic's sample."""
    if not names:
        return df.sparkSession.createDataFrame([], "column string, value string, place int")
    place = F.row_number().over(Window.partitionBy("column").orderBy(ROW_ID))
    return cells(df, names, n).withColumn("place", place).filter(F.col("place") <= n).drop(ROW_ID)
