"""Structural typing and repair: which columns are ids, dates, numbers or categories, and what follows from that.

fit makes a plan from a few aggregates; apply is one projection.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from . import profile as P
from . import sketches

# Substrings of names that mark a column as an id, and card numbers.
ID_WORDS = [
    "id", "uuid", "order", "invoice", "inv", "txn", "transaction", "ref", "reference", "receipt", "payment", "tracking", "shipment",
    "delivery", "dispatch", "customer", "user", "session", "token", "bill", "billing", "purchase", "sale", "booking",
]
CARD = r"^(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|6(?:011|5[0-9]{2})[0-9]{12}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11})$"


@dataclass
class Config:
    datetime_threshold: float = 0.7
    numeric_threshold: float = 0.6
    outlier_factor: float = 1.5
    allow_unseen: bool = True
    rounding: int | None = None
    impute: bool = True
    protect_ids: bool = True
    id_words: list[str] = field(default_factory=lambda: list(ID_WORDS))
    whole_words: bool = False  # match id_words as words of the name, not anywhere in it
    id_sample: int = 5000
    date_sample: int = 3000
    lower_upto: int = 200
    force_schema: bool = False
    date_column: str | None = None
    cutoff: str | None = None

    def __post_init__(self):
        if not (0 <= self.datetime_threshold <= 1 and 0 <= self.numeric_threshold <= 1 and self.outlier_factor > 0):
            raise ValueError("thresholds lie in 0..1 and outlier_factor is positive")


@dataclass
class Plan:
    schema: dict[str, str]
    roles: dict[str, str]  # id, datetime, numeric, categorical
    medians: dict[str, float]
    modes: dict[str, object]
    bounds: dict[str, tuple[float, float]]
    lowered: list[str]
    warnings: list[str]
    version: str = ""
    digest: str = ""

    def of(self, role: str) -> list[str]:
        return [c for c, r in self.roles.items() if r == role]


def id_by_name(name: str, config: Config) -> bool:
    n = name.strip().lower()
    words = P.re.split(r"[_\W]+", n) if config.whole_words else n
    return any(k in words for k in config.id_words)


def _id_signals(s) -> dict[str, object]:
    """Aggregates of a sample of stripped texts that tell ids from other values."""
    n = F.length(s)
    return {
        "n": F.count(s),
        "mixed": P.ratio_of_known(s.rlike("[A-Za-z]") & s.rlike(r"\d"), s),
        "separated": P.ratio_of_known(s.rlike("[-_/]"), s),
        "digit": P.ratio_of_known(s.rlike(r"\d"), s),
        "unique": F.count_distinct(s),
        "length": F.avg(n),
        "spread": F.stddev_samp(n),
        "long": P.ratio_of_known(s.rlike(r"^\d{12,}$"), s),
        "ten": P.ratio_of_known(s.rlike(r"^\d{10,}$"), s),
        "only": P.ratio_of_known(s.rlike(r"^\d+$"), s),
        "phone": P.ratio_of_known(s.rlike(r"^\d{9,15}$"), s),
        "card": P.ratio_of_known(s.rlike(CARD), s),
    }


def id_by_values(m: dict) -> bool:
    if not m["n"]:
        return False
    unique, spread = m["unique"] / m["n"], m["spread"] if m["spread"] is not None else float("nan")
    return bool(
        m["mixed"] > 0.03
        or m["separated"] > 0.08
        or (m["digit"] > 0.80 and m["length"] >= 5 and unique > 0.35 and spread <= 6)
        or m["long"] > 0.10
        or m["ten"] > 0.10
        or (m["only"] > 0.85 and unique > 0.50 and m["length"] >= 6)
        or m["phone"] > 0.5
        or m["card"] > 0.1
    )


def before_cutoff(df: DataFrame, config: Config) -> tuple[DataFrame, list[str]]:
    """Rows dated up to the cutoff, for fitting only; all rows where the setting cannot be used."""
    if not config.date_column or not config.cutoff:
        return df, []
    if config.date_column not in df.columns:
        return df, [f"date column {config.date_column} not found: nothing filtered"]
    try:
        cutoff = dt.datetime.fromisoformat(str(config.cutoff))
    except ValueError:
        return df, [f"cutoff {config.cutoff} is not a date: nothing filtered"]
    at = X.to_datetime(F.col(f"`{config.date_column}`"), df.schema[config.date_column].dataType)
    kept = df.filter(at <= F.lit(cutoff).cast("timestamp_ntz"))
    if kept.isEmpty():
        return df, ["no row lies before the cutoff: nothing filtered"]
    return kept, []


def fit(df: DataFrame, config: Config = Config()) -> Plan:
    """Roles (first that fits: id, datetime, numeric, categorical), medians, modes and outlier bounds."""
    df, warnings = before_cutoff(df, config)
    fields = P.columns_of(df)
    roles = {f.name: "id" for f in fields if config.protect_ids and id_by_name(f.name, config)}
    rest = [f for f in fields if f.name not in roles]
    if rest:
        texts = [f.name for f in rest if P.is_text(f)]
        # One sample for ids and dates, the shorter of the two being its beginning.
        sample = P.first_known(df, [f.name for f in rest], max(config.id_sample, config.date_sample))
        s, place = X.strip(F.col("value")), F.col("place")
        wanted = _id_signals(F.when(place <= config.id_sample, s))
        wanted["dated"] = F.avg(F.when((place <= config.date_sample) & F.col("column").isin(texts), X.to_datetime(F.col("value")).isNotNull().cast("double")))
        signals = {r["column"]: r.asDict() for r in sample.groupBy("column").agg(*[c.alias(k) for k, c in wanted.items()]).collect()}
        dated = {c: m["dated"] or 0.0 for c, m in signals.items()}
        numeric = P.measure(df, {(f.name, "r"): P.ratio(X.number(F.col(f"`{f.name}`"), f.dataType).isNotNull()) for f in rest})
        for f in rest:
            share = numeric[f.name]["r"] or 0.0
            if config.protect_ids and f.name in signals and id_by_values(signals[f.name]):
                roles[f.name] = "id"
            elif dated.get(f.name, 0.0) > config.datetime_threshold and share < 0.9:
                roles[f.name] = "datetime"
            else:
                roles[f.name] = "numeric" if share > config.numeric_threshold else "categorical"
    roles = {f.name: roles[f.name] for f in fields}
    numbers = {f.name: X.number(F.col(f"`{f.name}`"), f.dataType) for f in fields if roles[f.name] == "numeric"}
    quartiles = P.quantiles_of(df, numbers, [0.25, 0.5, 0.75])
    medians = {c: q[1] for c, q in quartiles.items() if q is not None}
    bounds = {c: (q[0] - config.outlier_factor * (q[2] - q[0]), q[2] + config.outlier_factor * (q[2] - q[0])) for c, q in quartiles.items() if q is not None}
    categories = [c for c, r in roles.items() if r == "categorical"]
    modes = {c: "unknown" if m is None else m for c, m in P.mode_of(df, categories).items()}
    lowered = [c for c, n in sketches.distinct(df, categories, at_most=config.lower_upto).items() if n <= config.lower_upto] if categories else []
    plan = Plan({f.name: f.dataType.simpleString() for f in fields}, roles, medians, modes, bounds, lowered, warnings)
    plan.version = f"v1_{dt.datetime.now(dt.UTC):%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:6]}"
    plan.digest = hashlib.sha256(json.dumps({"schema": plan.schema, "roles": roles}, sort_keys=True).encode()).hexdigest()
    return plan


def check_columns(df: DataFrame, plan: Plan, config: Config) -> list[str]:
    """Columns that were not there at fit; an error unless they are allowed."""
    unseen = [f.name for f in P.columns_of(df) if f.name not in plan.schema]
    if unseen and not config.allow_unseen:
        raise ValueError(f"unseen columns: {', '.join(unseen)}")
    return unseen


def apply(df: DataFrame, plan: Plan, config: Config = Config()) -> tuple[DataFrame, dict]:
    """Coerced, normalised, imputed and clipped df; ids and unseen columns as they are."""
    unseen = check_columns(df, plan, config)
    if config.force_schema:
        from .names import force_schema

        df = force_schema(df, plan.schema)
    out = []
    for f in df.schema.fields:
        c, role = F.col(f"`{f.name}`"), plan.roles.get(f.name)
        if role == "numeric":
            c = X.number(c, f.dataType)
            if config.impute and f.name in plan.medians:
                c = F.coalesce(c, F.lit(plan.medians[f.name]))
                if config.rounding is not None:
                    c = F.bround(c, config.rounding)
            if f.name in plan.bounds:
                low, high = plan.bounds[f.name]
                c = F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))
        elif role == "datetime":
            c = X.to_datetime(c, f.dataType)
        elif role == "categorical":
            # Every distinct value is kept when there are many: only blanks and case are touched.
            c = X.normalize_category(c, f.name in plan.lowered) if isinstance(f.dataType, T.StringType) else c.cast("string")
            if config.impute:
                c = F.coalesce(c, F.lit(str(plan.modes[f.name])))
        out.append(c.alias(f.name))
    return df.select(*out), {"unseen": unseen, "roles": plan.roles, "version": plan.version, "digest": plan.digest, "warnings": plan.warnings}


def report(df: DataFrame, plan: Plan, config: Config = Config(), examples: int = 5) -> dict:
    """How many values are missing and what is done about them; outliers clipped, with the first few."""
    n = df.count()
    wanted = {}
    for f in P.columns_of(df):
        role = plan.roles.get(f.name)
        if role is None:
            continue
        c = F.col(f"`{f.name}`")
        x = X.number(c, f.dataType)
        wanted[(f.name, "missing")] = F.count_if({"numeric": x.isNull(), "datetime": X.to_datetime(c, f.dataType).isNull(), "categorical": X.normalize_category(c, False).isNull()}.get(role, F.lit(False)))
        if role == "numeric" and f.name in plan.bounds:
            low, high = plan.bounds[f.name]
            wanted[(f.name, "outliers")] = F.count_if((x < low) | (x > high))
    found = P.measure(df, wanted)
    strategy = {"numeric": "median", "categorical": "mode", "datetime": "datetime_skipped"}
    missing = {c: {"count": v["missing"], "percent": round(v["missing"] / n * 100, 2), "strategy": strategy[plan.roles[c]] if config.impute else "kept_as_nan"} for c, v in found.items() if v["missing"]}
    outliers = {}
    for c, v in found.items():
        if v.get("outliers"):
            low, high = plan.bounds[c]
            x = X.number(F.col(f"`{c}`"), df.schema[c].dataType)
            first = df.select(P.ROW_ID, x.alias("x")).filter((F.col("x") < low) | (F.col("x") > high)).orderBy(P.ROW_ID).limit(examples).collect()
            outliers[c] = {"count": v["outliers"], "percent": round(v["outliers"] / n * 100, 3), "severity": "high" if v["outliers"] / n > 0.10 else "medium", "clip_range": [low, high], "examples_first_5": [{"row": r[0], "original": r[1], "clipped_to": max(low, min(high, r[1]))} for r in first]}
    return {"missing": missing, "outliers": outliers}


def save(plan: Plan) -> dict:
    return asdict(plan)


def load(data: dict) -> Plan:
    data = dict(data)
    data["bounds"] = {c: tuple(b) for c, b in data["bounds"].items()}
    return Plan(**data)
