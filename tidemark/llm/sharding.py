"""Shards cut from a Hilbert curve over metadata, so that files prune on every dimension.

Each dimension is quantised to 2**bits cells in its own order (categories by rank among
the different values, numbers by logarithm); a row's place on the Hilbert curve through
that grid is its sort key.  The sorted rows are cut into runs of equal row counts.  A
file then covers a compact block of the grid, and as cells keep the order of values, its
min/max statistics exclude it from queries on any of the dimensions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, places

SHARDS = 16
BITS = 5


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells (rows x dimensions, 0 <= cell < 2**bits).

    Skilling's transform: undo the curve's rotations from the highest bit down, Gray-code
    the result and interleave its bits.
    """
    x = [c.astype(np.int64) for c in cells.T]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    parity = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        parity = np.where((x[n - 1] & q) != 0, parity ^ (q - 1), parity)
        q >>= 1
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] ^ parity) >> bit & 1
    return out


def log_cell(number: Column, bits: int = BITS) -> Column:
    """Cell of a non-negative number: two cells an octave; null counts as 0."""
    return F.least(F.lit((1 << bits) - 1), F.floor(2 * F.log2(F.coalesce(number, F.lit(0)) + 1))).cast("int")


def category_cuts(rows: DataFrame, name: str, bits: int = BITS) -> list[str]:
    """The least value of each cell of a category: its different values in order, in 2**bits equal parts.

    With up to 2**bits different values each has a cell of its own; nulls have none.  The
    values are ranked on the executors; at most one for each cell reaches the driver.
    """
    different = rows.select(F.col(name).cast("string").alias("value")).distinct().dropna()
    ranked, n = places(different, ["value"], "rank")
    cell = F.expr(f"rank * {1 << bits} div {max(n, 1)}")
    return sorted(r["least"] for r in ranked.groupBy(cell.alias("cell")).agg(F.min("value").alias("least")).collect())


def category_cell(name: Column, cuts: list[str], bits: int = BITS) -> Column:
    """Cell of a category by category_cuts: order is kept, cells are spread over all 2**bits; null has cell 0."""
    text = name.cast("string")
    number = F.lit(0)
    for cut in cuts[1:]:
        number = number + (text >= F.lit(cut)).cast("int")
    return F.coalesce(F.expr("0") if not cuts else F.floor(number * (1 << bits) / len(cuts)), F.lit(0)).cast("int")


def shard(rows: DataFrame, cells: list[Column], ties: list[str], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """rows with shard (0..shards-1) and slot (gapless from 0 in each shard).

    Rows are ordered by the Hilbert index of their cells, then by ties; name enough of
    them that few rows are alike in all (rows alike in all are interchangeable, but stay
    together in one sort task).  Shard sizes differ by at most one row; with fewer rows
    than shards some shards are empty, and an empty table gives no rows.  Columns of rows
    named shard or slot are replaced.

    One range shuffle of rows, kept in the shared folder so that places are drawn once;
    then one count for each partition of it goes to the driver.
    """
    if not cells or bits * len(cells) > 62:
        raise ValueError("cells need 1 to 62 bits in all")

    @F.pandas_udf("long")
    def curve(grid: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(grid.to_numpy(), bits))

    rows = rows.drop("shard", "slot")
    place, rank = (fresh(rows.columns, x) for x in ("_place", "_rank"))
    keyed = rows.withColumn(place, curve(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cells)])))
    placed, total = places(keyed, [place, *ties], rank)
    placed = placed.withColumn("shard", F.expr(f"cast(({shards} * ({rank} + 1) - 1) div {max(total, 1)} as int)"))
    placed = placed.withColumn("slot", F.expr(f"{rank} - (shard * {total}L) div {shards}"))
    return placed.drop(place, rank)


def document_cells(docs: DataFrame, bits: int = BITS) -> list[Column]:
    """Dimensions of documents(source, lang, text): source and language in order of their values, size of the text.

    Null values and a null text lie in cell 0; an empty table has that cell alone; other
    columns are ignored.
    """
    return [*(category_cell(F.col(c), category_cuts(docs, c, bits), bits) for c in ("source", "lang")), log_cell(F.octet_length("text"), bits)]


def write_shards(sharded: DataFrame, path: str) -> None:
    """A Parquet folder for each shard, rows in slot order."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
