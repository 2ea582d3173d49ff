"""Exact medians of many groups at once, by selection.

A sketch of each group cuts its values; only what lies between the two cuts around the
middle is listed and sorted, once that is few enough, and cut again until then.  Sketches,
counts and lists are merged before the shuffle as well as after it, so a group that holds
most rows is no larger a task than any other.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stash

#: Cuts made of a group's values, the sketch's accuracy, and values of a group that are listed at most.
CUTS, ACCURACY, LISTED = 200, 2000, 20_000
#: Cuts on either side of the wanted one; so many times more where a sketch proves to be further out.
SLACK, WIDEN = 2, 8


def _sketch(x: Column) -> Column:
    return F.percentile_approx(x, F.expr(f"array({', '.join(f'{i / CUTS}D' for i in range(CUTS + 1))})"), F.lit(ACCURACY))


def _state(n: Column, low: Column, high: Column, most: Column, slack: Column, cuts: Column, median: Column | None = None) -> Column:
    """A group's number of values, the cuts the middle lies between, how many values may lie there, and the group's own cuts."""
    fields = {"n": n.cast("long"), "low": low.cast("double"), "high": high.cast("double"), "most": most.cast("long"), "slack": slack.cast("int"), "cuts": cuts, "median": (F.lit(None) if median is None else median).cast("double")}
    return F.struct(*[c.alias(k) for k, c in fields.items()], ((n == 0) | F.lit(median is not None)).alias("done"))


def _between(cuts: Column, first: Column, last: Column, n: Column, slack: Column) -> tuple[Column, Column, Column]:
    """The cuts some steps beyond the ranks first and last of n values, and the most values that can lie between them."""
    i = F.greatest(F.lit(0), (F.floor(first / n * CUTS) - slack).cast("int"))
    j = F.least(F.lit(CUTS), (F.ceil((last + 1) / n * CUTS) + slack).cast("int"))
    return F.get(cuts, i), F.get(cuts, j), F.ceil(n * (j - i + 2) / CUTS)


def _begin(n: Column, cuts: Column, slack: Column) -> Column:
    """State of a group of n values: all of them if they may be listed, else those around the middle."""
    low, high, most = _between(cuts, F.floor((n - 1) / 2), F.ceil((n - 1) / 2), n, slack)
    few = n <= LISTED
    return _state(n, F.when(few, -math.inf).otherwise(low), F.when(few, math.inf).otherwise(high), F.when(few, n).otherwise(most), slack, F.when(~few, cuts))


def _measures(x: Column, s: Column) -> Column:
    """What a round finds out about a group: counts around its two cuts, and the values between, or new cuts of them."""
    within = F.when(~s["done"] & (x > s["low"]) & (x < s["high"]), x)
    listed = s["most"] <= LISTED
    return F.struct(
        F.count_if(x < s["low"]).alias("below"),
        F.count_if(x == s["low"]).alias("at_low"),
        F.count(within).alias("inside"),
        F.count_if(x == s["high"]).alias("at_high"),
        F.sort_array(F.collect_list(F.when(listed, within))).alias("values"),
        _sketch(F.when(~listed, within)).alias("cuts"),
    )


def _advance(s: Column, m: Column) -> Column:
    """A group's next state: done with its median, or closer cuts, or wider ones where the middle proves to lie outside."""
    ranks = [F.floor((s["n"] - 1) / 2), F.ceil((s["n"] - 1) / 2)]
    start = m["below"] + m["at_low"]
    end = start + m["inside"]
    outside = (ranks[0] < m["below"]) | (ranks[1] >= end + m["at_high"])
    a, b = (F.when(k < start, s["low"]).when(k >= end, s["high"]).otherwise(F.get(m["values"], (k - start).cast("int"))) for k in ranks)
    inside = F.greatest(m["inside"], F.lit(1))
    low, high, most = _between(m["cuts"], F.greatest(ranks[0] - start, F.lit(0)), F.least(ranks[1] - start, inside - 1), inside, s["slack"])
    closer = _state(s["n"], F.when(ranks[0] < start, s["low"]).otherwise(low), F.when(ranks[1] >= end, s["high"]).otherwise(high), most, s["slack"], s["cuts"])
    finished = _state(s["n"], s["low"], s["high"], s["most"], s["slack"], s["cuts"], F.when(a == b, a).otherwise(0.5 * a + 0.5 * b))
    return F.when(s["done"], s).when(outside, _begin(s["n"], s["cuts"], s["slack"] * WIDEN)).when(a.isNotNull() & b.isNotNull(), finished).otherwise(closer)


def medians(df: DataFrame, keys: list[Column], numbers: dict[str, Column]) -> DataFrame:
    """__key0, __key1 ..., __size (rows) and __med_<name> of each group: exact medians, the mean of the middle two of an even number.

    Null keys form groups too; null numbers do not count, and a group without any number
    has a null median.  Two jobs do for groups of up to some 800,000 values, one more for
    each further factor of about 40.  One number a round reaches the driver.
    """
    if not keys:
        raise ValueError("medians of groups need keys")
    ids = [f"__key{i}" for i in range(len(keys))]
    at = range(len(numbers))
    flat = df.select(*[c.alias(k) for k, c in zip(ids, keys, strict=True)], *[x.cast("double").alias(f"__x{i}") for i, x in enumerate(numbers.values())])
    states = [f"__s{i}" for i in at]
    first = flat.groupBy(*ids).agg(F.count("*").alias("__size"), *[F.count(f"__x{i}").alias(f"__n{i}") for i in at], *[_sketch(F.col(f"__x{i}")).alias(f"__c{i}") for i in at])
    state = first.select(*ids, "__size", *[_begin(F.col(f"__n{i}"), F.col(f"__c{i}"), F.lit(SLACK)).alias(s) for i, s in enumerate(states)])
    done = reduce(lambda a, b: a & b, [F.col(f"{s}.done") for s in states], F.lit(True))
    parts = []
    while True:
        # One row for each group; its own table, as the next round, the count below and the result read it.
        state = stash(state, "medians")
        parts.append(state.filter(done))
        state = state.filter(~done)
        if not state.take(1):
            break
        side = state.select(*[F.col(k).alias(f"_{k}") for k in ids], "__size", *states)
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in ids])
        # Without a hint: Spark broadcasts the groups where they are small, and splits skewed keys where it sorts.
        joined = flat.join(side, on)
        found = joined.groupBy(*ids).agg(F.first("__size").alias("__size"), *[F.first(s).alias(s) for s in states], *[_measures(F.col(f"__x{i}"), F.col(s)).alias(f"__m{i}") for i, s in enumerate(states)])
        state = found.select(*ids, "__size", *[_advance(F.col(s), F.col(f"__m{i}")).alias(s) for i, s in enumerate(states)])
    out = reduce(DataFrame.unionByName, parts)
    return out.select(*ids, "__size", *[F.col(f"{s}.median").alias(f"__med_{c}") for s, c in zip(states, numbers, strict=True)])
