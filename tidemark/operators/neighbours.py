"""Exact nearest neighbours among rows of which any number may be missing.

Distance is the mean absolute difference over the features that both rows know.  Rows are
indexed in k-d blocks: a tree, grown on a bounded sample, parts them by whether a feature
is known and at medians of known ones; every row is then sent down the tree, and the boxes
of the blocks are measured over all rows.  A box bounds from below how near its rows can
lie to a given one, whatever is missing in either.  A row without the target visits the
block that can be nearest first; its k-th distance there decides which others it visits.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stash
from .issues import ROW_ID

#: Rows with the target that a block should hold, and blocks at most (beyond, blocks grow and are dealt into shares).
BLOCK, BLOCKS = 4_000, 16_384
#: Rows, at most, that the tree is grown on; all rows are indexed.
SAMPLE = 100_000
#: Rows without the target that a task compares with a block.
ROWS = 4_000
#: A feature is parted by whether it is known where so large a share of a block's rows lacks it or knows it.
MIXED = 0.1

_FOUND = f"{ROW_ID} long, d double, id long, t double"


@dataclass
class Tree:
    """Nodes: the feature asked about (-1: a leaf), the value to be below (NaN: whether it is known), the two next nodes; leaves have a block."""

    feature: np.ndarray
    value: np.ndarray
    below: np.ndarray
    above: np.ndarray
    block: np.ndarray

    def blocks_of(self, rows: np.ndarray) -> np.ndarray:
        """The block of each row; a row that does not know a feature goes below."""
        at = np.zeros(len(rows), np.int64)
        while True:
            inner = np.flatnonzero(self.feature[at] >= 0)
            if not len(inner):
                return self.block[at]
            node = at[inner]
            x, cut = rows[inner, self.feature[node]], self.value[node]
            up = np.where(np.isnan(cut), ~np.isnan(x), x >= cut)
            at[inner] = np.where(up, self.above[node], self.below[node])


def grow(sample: np.ndarray, blocks: int) -> Tree:
    """A tree of at most `blocks` leaves; the fullest node is parted next."""
    nodes: list[list] = [[-1, np.nan, -1, -1]]
    rows = {0: np.arange(len(sample))}
    open_ = [(-len(sample), 0)]
    while open_ and len(rows) < blocks:
        _, node = heapq.heappop(open_)
        part = _part(sample[rows[node]]) if len(rows[node]) > 1 else None
        if part is None:
            continue
        feature, cut, up = part
        nodes[node] = [feature, cut, len(nodes), len(nodes) + 1]
        for side in (~up, up):
            rows[len(nodes)] = rows[node][side]
            heapq.heappush(open_, (-len(rows[len(nodes)]), len(nodes)))
            nodes.append([-1, np.nan, -1, -1])
        del rows[node]
    feature, value, below, above = (np.array(c) for c in zip(*nodes, strict=True))
    leaf = feature < 0
    return Tree(feature.astype(np.int64), value.astype(float), below.astype(np.int64), above.astype(np.int64), np.where(leaf, np.cumsum(leaf) - 1, -1))


def _part(rows: np.ndarray) -> tuple[int, float, np.ndarray] | None:
    """Feature, cut and the rows above: the feature that is known most nearly by half, if one is mixed, else the widest at its median."""
    known = ~np.isnan(rows)
    share = known.mean(axis=0)
    mixed = np.minimum(share, 1 - share)
    if len(mixed) and mixed.max() >= MIXED:
        f = int(mixed.argmax())
        return f, np.nan, known[:, f]
    spread = np.full(rows.shape[1], -1.0)
    for f in np.flatnonzero(share > 0):
        low, high = np.percentile(rows[known[:, f], f], [5, 95])
        spread[f] = high - low
    for f in np.argsort(-spread, kind="stable"):
        if share[f] > 0:
            x = rows[known[:, f], f]
            cut = float(np.median(x))
            cut = cut if (x < cut).any() else float(x[x > cut].min(initial=np.inf))
            up = rows[:, f] >= cut
            if np.isfinite(cut) and up.any() and not up.all():
                return int(f), cut, up
    return None


@dataclass
class Boxes:
    """By block: its number, rows, least and greatest value of each feature, and whether some and all of its rows know it."""

    block: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    some: np.ndarray
    all: np.ndarray

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """For each row of x and each block: no row of the block is nearer; infinite where none has a feature in common.

        A feature that all of a block's rows know counts; one that only some know counts
        where it is closer than the mean without it, as the nearest row may be one of them.
        """
        features = x.shape[1]
        gap = np.full((len(x), len(self.block), features), np.inf)
        sure = np.zeros(gap.shape, bool)
        for f in range(features):
            here = ~np.isnan(x[:, f])[:, None] & self.some[None, :, f]
            far = np.maximum(np.maximum(self.low[None, :, f] - x[:, None, f], x[:, None, f] - self.high[None, :, f]), 0.0)
            gap[..., f] = np.where(here, far, np.inf)
            sure[..., f] = here & self.all[None, :, f]
        total = np.where(sure, gap, 0.0).sum(axis=2)
        count = sure.sum(axis=2)
        mean = np.where(count > 0, total / np.maximum(count, 1), np.inf)
        optional = np.sort(np.where(sure, np.inf, gap), axis=2)
        for f in range(features):
            better = optional[..., f] < mean
            count = count + better
            total = total + np.where(better, optional[..., f], 0.0)
            mean = np.where(better, total / np.maximum(count, 1), mean)
        return mean


def _matrix(column: pa.Array, features: int) -> np.ndarray:
    """Rows of an array<double> column, nulls as NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, features)


def _blocked(rows: DataFrame, tree: Tree, features: int) -> DataFrame:
    """rows(ROW_ID, t, f) with their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), features)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.blocks_of(x).astype(np.int32))], names=[*batch.schema.names, "block"])

    return rows.mapInArrow(run, f"{ROW_ID} long, t double, f array<double>, block int")


def _boxes(have: DataFrame, features: int) -> Boxes:
    """One row for each block reaches the driver."""
    x = [F.col("f")[i] for i in range(features)]
    rows = have.groupBy("block").agg(F.count("*"), *[f(c) for c in x for f in (F.min, F.max, F.count)]).orderBy("block").collect()
    n = np.array([r[1] for r in rows], np.int64)
    low, high, known = (np.array([[np.nan if r[2 + 3 * i + k] is None else r[2 + 3 * i + k] for i in range(features)] for r in rows], float).reshape(len(rows), features) for k in range(3))
    return Boxes(np.array([r[0] for r in rows], np.int64), n, low, high, known > 0, known == n[:, None])


def _visits(lack: DataFrame, boxes: Boxes, k: int, features: int, again: bool) -> DataFrame:
    """ROW_ID, f, block: the blocks that rows of lack(ROW_ID, f[, kth]) visit.

    First those of the lowest bounds that hold k rows together; then (again) all others
    whose bound is not above the k-th distance, which is infinite for a row that found
    fewer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, 1_000_000 // max(1, len(boxes.block) * features))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = _matrix(part.column(1), features)
                bound = boxes.bounds(x)
                order = np.argsort(bound, axis=1, kind="stable")
                held = np.cumsum(boxes.rows[order], axis=1) - boxes.rows[order]
                first = np.zeros(bound.shape, bool)
                np.put_along_axis(first, order, held < k, axis=1)
                wanted = np.isfinite(bound)
                if again:
                    kth = part.column(2).to_numpy(zero_copy_only=False).astype(float)
                    wanted &= ~first & (bound <= np.where(np.isnan(kth), np.inf, kth)[:, None] * (1 + 1e-9))
                else:
                    wanted &= first
                row, block = np.nonzero(wanted)
                if len(row):
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(boxes.block[block].astype(np.int32))], names=[ROW_ID, "f", "block"])

    return lack.select(ROW_ID, "f", *["kth"] * again).mapInArrow(run, f"{ROW_ID} long, f array<double>, block int")


def compare(a: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of a: its number, the places in b of its k nearest rows, and their distances; ids rise, so ties go to the lower."""
    features = a.shape[1]
    step = max(1, 2_000_000 // max(1, len(b)))
    for at in range(0, len(a), step):
        part = a[at : at + step]
        total, known = np.zeros((len(part), len(b))), np.zeros((len(part), len(b)), np.int16)
        for i in range(features):
            apart = np.abs(part[:, i, None] - b[None, :, i])
            here = ~np.isnan(apart)
            total += np.where(here, apart, 0.0)
            known += here
        d = np.where(known > 0, total / np.maximum(known, 1), np.inf)
        kth = np.partition(d, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(d), np.inf)
        for row in range(len(d)):
            within = np.flatnonzero((d[row] <= kth[row]) & np.isfinite(d[row]))
            within = within[np.argsort(d[row, within], kind="stable")[:k]]
            yield at + row, within, d[row, within]


def _compared(visits: DataFrame, have: DataFrame, boxes: Boxes, features: int, k: int) -> DataFrame:
    """ROW_ID, d, id, t: the k nearest rows in each share of the blocks visited.

    A block of more than BLOCK rows is dealt into shares, and many visitors of a block into
    chunks, so a task holds a bounded number of either.
    """
    spark = have.sparkSession
    # One row for each block: at most BLOCKS.
    shares = spark.createDataFrame([(int(b), max(1, -(-int(n) // (2 * BLOCK)))) for b, n in zip(boxes.block, boxes.rows, strict=True)], "block int, shares int")
    chunks = visits.groupBy("block").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("chunks")).join(F.broadcast(shares), "block")
    mine = visits.join(chunks, "block").withColumn("chunk", F.pmod(F.xxhash64(ROW_ID), F.col("chunks")).cast("int")).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    theirs = have.join(chunks, "block").withColumn("share", F.pmod(F.xxhash64(ROW_ID), F.col("shares")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    keys = ["block", "share", "chunk"]

    def run(rows: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        others = others.sort_values(ROW_ID)
        ids, t, names = others[ROW_ID].to_numpy(), others["t"].to_numpy(), rows[ROW_ID].to_numpy()
        out = []
        if len(ids) and len(rows):
            a, b = (np.array([[np.nan if v is None else v for v in f] for f in side["f"]], float).reshape(-1, features) for side in (rows, others))
            out = [(np.full(len(w), names[i]), d, ids[w], t[w]) for i, w, d in compare(a, b, ids, k)]
        columns = {ROW_ID: "int64", "d": float, "id": "int64", "t": float}
        return pd.DataFrame({c: np.concatenate([o[i] for o in out]) if out else pd.Series(dtype=kind) for i, (c, kind) in enumerate(columns.items())})

    # Named anew, as both come of the same table.
    mine, theirs = (side.select(*columns).toDF(*columns) for side, columns in ((mine, [*keys, ROW_ID, "f"]), (theirs, [*keys, ROW_ID, "t", "f"])))
    return mine.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInPandas(run, _FOUND)


def nearest(rows: DataFrame, features: int, k: int, tell: Callable[[str, object], None] | None = None) -> DataFrame:
    """ROW_ID, best array<struct<d, id, t>>: the k nearest rows with a target of each row of rows(ROW_ID, t, f) without one.

    f is an array of `features` doubles with nulls.  Nearest first, ties to the lower row
    id; a row that shares no feature with any other has an empty array.  tell, if given,
    is told the number of comparisons ("comparisons", of the first and the second visits),
    at the price of a job each.
    """
    no_target = rows.filter("t is null").select(ROW_ID, "f")
    known = F.exists("f", lambda v: v.isNotNull())
    have = rows.filter(F.col("t").isNotNull() & known)
    lack = no_target.filter(known)
    n = have.count()
    none = F.array().cast("array<struct<d:double,id:bigint,t:double>>")
    if not n or not features:
        return no_target.select(ROW_ID, none.alias("best"))
    blocks = min(BLOCKS, max(1, -(-n // BLOCK)))
    share = min(1.0, SAMPLE / n)
    chosen = have.filter(F.pmod(F.xxhash64(ROW_ID), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else have
    tree = grow(np.array([[np.nan if v is None else v for v in r["f"]] for r in chosen.select("f").collect()], float).reshape(-1, features), blocks) if blocks > 1 else grow(np.zeros((0, features)), 1)
    have = _blocked(have.select(ROW_ID, "t", "f"), tree, features)
    boxes = _boxes(have, features)

    def visited(visits: DataFrame) -> DataFrame:
        # Tables of their own, as both are read twice.
        visits = stash(visits, "visits")
        if tell:
            sizes = rows.sparkSession.createDataFrame([(int(b), int(m)) for b, m in zip(boxes.block, boxes.rows, strict=True)], "block int, m long")
            tell("comparisons", visits.join(F.broadcast(sizes), "block").agg(F.sum("m")).first()[0] or 0)
        return _compared(visits, have, boxes, features, k)

    found = visited(_visits(lack, boxes, k, features, False))
    if len(boxes.block) > 1:
        found = stash(found, "near")
        reach = found.groupBy(ROW_ID).agg(F.get(F.sort_array(F.collect_list("d")), k - 1).alias("kth"))
        found = found.unionByName(visited(_visits(lack.join(reach, ROW_ID, "left"), boxes, k, features, True)))
    best = found.groupBy(ROW_ID).agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id", "t"))), 1, k).alias("best"))
    return no_target.select(ROW_ID).join(best, ROW_ID, "left").select(ROW_ID, F.coalesce("best", none).alias("best"))
