"""Outlier-aware imputation of numbers: group median, nearest neighbours, global median."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import groups, neighbours
from . import issues as I
from . import profile as P

# Confidence in a value by the way it was found.
CONFIDENCE = {"group_median": 0.85, "knn_numeric": 0.75, "global_median": 0.60}


#: Different values, at most, of a column that groups rows.
MOST_GROUPS = 50


@dataclass
class Config:
    enabled: bool = True
    k: int = 5
    max_missing: float = 0.50
    min_group: int = 10
    groups: int = 3


def numeric_columns(df: DataFrame) -> tuple[list[str], DataFrame]:
    """Number columns, and df with texts of which over 80 % are numbers turned into such."""
    fields = P.columns_of(df)
    texts = [f.name for f in fields if P.is_text(f)]
    shares = P.measure(df, {(c, "r"): P.ratio(X.number(F.col(f"`{c}`")).isNotNull()) for c in texts})
    turned = [c for c in texts if (shares[c]["r"] or 0) > 0.8]
    if turned:
        df = df.withColumns({c: X.number(F.col(f"`{c}`")) for c in turned})
    return [f.name for f in fields if P.is_numeric(f) or f.name in turned], df


def group_columns(df: DataFrame, most: int = 3) -> list[str]:
    """Up to `most` texts with few distinct values, fewest first."""
    names = [f.name for f in P.columns_of(df) if not P.is_numeric(f) and not P.is_date(f)]
    if not names:
        return []
    stripped = {c: X.strip(F.col(f"`{c}`")) for c in names}
    few = P.few_valued(df, stripped, MOST_GROUPS)
    if not few:
        return []
    counts = P.value_counts(df.select(*[stripped[c].alias(c) for c in few]), few)
    shape = counts.groupBy("column").agg(F.count("*").alias("unique"), F.sum("count").alias("known"), (F.sum(F.length("value") * F.col("count")) / F.sum("count")).alias("length"))
    found = [(r["unique"] / r["known"], r["unique"], names.index(r["column"]), r["column"]) for r in shape.collect() if r["unique"] / r["known"] <= 0.6 and r["unique"] <= MOST_GROUPS and r["length"] <= 25]
    return [c for *_, c in sorted(found)[:most]]


def bounds(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """1 % and 99 % quantiles, or the extremes where those are equal."""
    numbers = {c: X.number(F.col(f"`{c}`"), df.schema[c].dataType) for c in columns}
    quantiles = P.quantiles_of(df, numbers, [0.01, 0.99])
    ends = P.measure(df, {(c, k): e for c, q in quantiles.items() if q and q[0] == q[1] for k, e in (("min", F.min(numbers[c])), ("max", F.max(numbers[c])))})
    return {c: (ends[c]["min"], ends[c]["max"]) if c in ends else tuple(q) for c, q in quantiles.items() if q is not None}


def clip_to(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def group_medians(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """__key0 ..., __size and __med_<column> of each group, exact; null keys form groups too."""
    return groups.medians(df, [F.col(f"`{k}`") for k in keys], {c: X.number(F.col(f"`{c}`"), df.schema[c].dataType) for c in columns})


def nearest(df: DataFrame, target: str, features: list[str], k: int) -> DataFrame:
    """ROW_ID, __knn: the median target of the k rows nearest to each row that lacks it, among all rows that have it.

    Distance is the mean absolute difference over features known in both rows; ties go to
    the lower row id; a row with no feature known in common with any other has no value.
    """
    value = {c: X.number(F.col(f"`{c}`"), df.schema[c].dataType).cast("double") for c in [target, *features]}
    flat = df.select(F.col(I.ROW_ID).cast("long").alias(I.ROW_ID), value[target].alias("t"), F.array(*[value[c] for c in features]).alias("f"))
    values = F.array_sort(F.transform("best", lambda b: b["t"]))
    n = F.size(values)
    middle = (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2
    return neighbours.nearest(flat, len(features), k).select(I.ROW_ID, F.when(n > 0, middle).alias("__knn"))


def apply(df: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame, dict]:
    """Filled df, its issues, and a report.  Columns with too much missing are left alone."""
    spark = df.sparkSession
    if not config.enabled:
        return df, I.empty(spark), {"enabled": False}
    order = df.columns
    columns, df = numeric_columns(df)
    keys = group_columns(df, config.groups)
    missing = P.measure(df, {(c, "r"): F.avg(F.col(f"`{c}`").isNull().cast("double")) for c in columns})
    shares = {c: missing[c]["r"] or 0.0 for c in columns}
    sparse = [c for c in columns if shares[c] > config.max_missing]
    whole = [I.Rule(F.lit(True), c, "imputation", "info", "too sparse to safely impute", 0.95, f"{shares[c]:.1%} of '{c}' is missing, more than the {config.max_missing:.0%} up to which gaps are filled.", {"method": "skip_sparse", "missing_rate": str(shares[c])}, {"action": "skip_imputation"}) for c in sparse]
    wanted = [c for c in columns if shares[c] > 0 and c not in sparse]
    limits = bounds(df, wanted)
    wanted = [c for c in wanted if c in limits]
    parts = [I.globals_(spark, whole)]
    if wanted and keys:
        medians = group_medians(df, keys, wanted)
        # At most 50 values a key and 3 keys, so the groups may be broadcast; Spark decides by their size.
        on = None
        for i, k in enumerate(keys):
            test = F.col(f"`{k}`").eqNullSafe(F.col(f"__key{i}"))
            on = test if on is None else on & test
        joined = df.join(medians, on, "left")
        rules, filled = [], {}
        for c in wanted:
            gap, med, size = F.col(f"`{c}`").isNull(), F.col(f"__med_{c}"), F.col("__size")
            value = clip_to(med, *limits[c])
            details = {"group_columns": str(keys), "group_size": size, "min_group_size": config.min_group}
            rules.append(I.Rule(gap & med.isNotNull() & (size < config.min_group), c, "imputation", "info", "skipped group imputation (group too small)", 0.9, f"The rows that share this row's groups are fewer than {config.min_group}, too few for a median of '{c}'.", {"method": "group_median_skip_small_group", **details}, {"action": "skip_group_imputation"}))
            rules.append(I.Rule(gap & med.isNotNull() & (size >= config.min_group), c, "imputation", "info", "filled missing value using group median", CONFIDENCE["group_median"], f"'{c}' takes the median of the rows alike in {keys}.", {"method": "group_median", **details, "filled_value": value}, {"action": "filled"}))
            filled[c] = F.coalesce(F.col(f"`{c}`"), F.when(size >= config.min_group, value).cast(df.schema[c].dataType))
        parts.append(I.find(joined, rules))
        df = joined.withColumns(filled).select(*[f"`{c}`" for c in order])
    left = P.measure(df, {(c, "n"): F.count_if(F.col(f"`{c}`").isNull()) for c in wanted})
    frozen = df
    for c in wanted:
        features = [x for x in columns if x != c]
        if not left[c]["n"]:
            continue
        if features:
            # Kept, as several jobs read it; one row for each gap.
            near = nearest(frozen, c, features, config.k).persist()
            df = df.join(near, I.ROW_ID, "left")
            value = clip_to(F.col("__knn"), *limits[c])
            gap = F.col(f"`{c}`").isNull() & F.col("__knn").isNotNull()
            parts.append(I.find(df, [I.Rule(gap, c, "imputation", "info", "filled missing value using kNN (numeric similarity)", CONFIDENCE["knn_numeric"], f"'{c}' takes the median of the {config.k} rows whose other numbers are closest.", {"method": "knn_numeric", "k": config.k, "filled_value": value}, {"action": "filled"})]))
            df = df.withColumn(c, F.coalesce(F.col(f"`{c}`"), value.cast(df.schema[c].dataType))).drop("__knn")
        middle = P.quantiles_of(df, {c: X.number(F.col(f"`{c}`"), df.schema[c].dataType)}, [0.5])[c]
        if middle is not None:
            value = max(limits[c][0], min(limits[c][1], middle[0]))
            parts.append(I.find(df, [I.Rule(F.col(f"`{c}`").isNull(), c, "imputation", "info", "filled missing value using global median (fallback)", CONFIDENCE["global_median"], f"'{c}' takes the median of the whole column: no group and no similar row gave a value.", {"method": "global_median", "filled_value": str(value)}, {"action": "filled"})]))
            df = df.withColumn(c, F.coalesce(F.col(f"`{c}`"), F.lit(value).cast(df.schema[c].dataType)))
    return df.select(*[f"`{c}`" for c in order]), I.union(spark, parts), {"enabled": True, "groups": keys, "skipped_sparse": sparse, "confidence": CONFIDENCE, "filled_columns": wanted}
