"""Export: date-like columns as text in one format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from . import profile as P

MONTH = r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)\b"


def date_like(df: DataFrame, sample: int = 400, least: float = 0.80) -> tuple[list[str], dict[str, bool]]:
    """Columns to export as dates, and which of them carry a time zone."""
    fields = P.columns_of(df)
    out = [f.name for f in fields if P.is_date(f)]
    zoned = {f.name: isinstance(f.dataType, T.TimestampType) for f in fields if P.is_date(f)}
    texts = [f.name for f in fields if P.is_text(f)]
    if not texts:
        return out, zoned
    s = F.lower(X.strip(F.col("value")))
    share = lambda c: F.avg(c.cast("double"))
    first = P.first_known(df, texts, sample).groupBy("column").agg(share(s.rlike(r"^\d+$")).alias("digits"), share(s.rlike(r"[-/:\.]")).alias("separated"), share(s.rlike(MONTH)).alias("month"), F.avg(F.length(s)).alias("length"), share(s.rlike("z$")).alias("z"), share(s.rlike(r"[+-]\d{2}:?\d{2}$")).alias("offset"), share(s.rlike(r"\butc\b")).alias("utc"))
    looks = {r["column"]: r for r in first.collect() if r["digits"] < 0.85 and r["length"] >= 6 and (r["separated"] >= 0.35 or r["month"] >= 0.15)}
    parsed = P.measure(df, {(c, "r"): P.ratio_of_known(X.to_datetime(F.col(f"`{c}`")).isNotNull(), F.col(f"`{c}`")) for c in looks})
    for c in looks:
        if (parsed[c]["r"] or 0) >= least:
            out.append(c)
            zoned[c] = max(looks[c][k] for k in ("z", "offset", "utc")) > 0.05
    return [f.name for f in fields if f.name in out], zoned


def apply(df: DataFrame, columns: list[str] | None = None, order: list[str] | None = None, pattern: str = "yyyy-MM-dd HH:mm:ss", least: float = 0.80) -> tuple[DataFrame, dict]:
    """df with date columns as text, in the given column order, and what was lost on the way."""
    if columns is None:
        columns, zoned = date_like(df, least=least)
    else:
        columns = [c for c in columns if c in df.columns]
        zoned = {c: isinstance(df.schema[c].dataType, T.TimestampType) for c in columns}
    parsed = {c: X.to_datetime(F.col(f"`{c}`"), df.schema[c].dataType) for c in columns}
    lost = P.measure(df, {(c, k): F.count(x) for c, p in parsed.items() for k, x in (("before", F.col(f"`{c}`")), ("after", p))})
    out = df.withColumns({c: F.date_format(p, pattern) for c, p in parsed.items()}) if parsed else df
    report = {c: {"before": v["before"], "after": v["after"], "loss": v["before"] - v["after"], "loss_ratio": round((v["before"] - v["after"]) / max(v["before"], 1), 6), "timezone": zoned.get(c, False)} for c, v in lost.items()}
    warnings = [f"{c}: {v['loss']} values are no dates and became null" for c, v in report.items() if v["loss"]] + [f"{c}: its time zone is dropped" for c, v in report.items() if v["timezone"]]
    if order:
        from .names import align

        out = align(out, order)
    return out, {"columns": report, "warnings": warnings, "format": pattern}
