"""Column names: normalisation, aliases, merging of columns that end up alike."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Canonical column names and the raw names that mean them.
ALIASES = {
    "mail": "email", "emailaddress": "email", "email_address": "email", "e_mail": "email", "e-mail": "email", "user_email": "email",
    "mobile": "phone", "mobile_no": "phone", "mobile_number": "phone", "phone_no": "phone", "phone_number": "phone",
    "contact_no": "phone", "contact_number": "phone", "tel": "phone", "telephone": "phone",
    "userid": "user_id", "user_id": "user_id", "customerid": "user_id", "customer_id": "user_id",
    "orderdate": "order_date", "order_date": "order_date", "purchase_date": "order_date", "purchased_on": "order_date",
    "deliverydate": "delivery_date", "delivery_date": "delivery_date", "delivered_on": "delivery_date",
    "returndate": "return_date", "return_date": "return_date",
    "createdat": "created_at", "created_at": "created_at", "createdon": "created_at",
    "updatedat": "updated_at", "updated_at": "updated_at", "updatedon": "updated_at",
    "dateofbirth": "dob", "date_of_birth": "dob", "dob": "dob",
    "amount": "total_amount", "totalamount": "total_amount", "total_amount": "total_amount",
    "amount_paid": "amount_paid", "paid_amount": "amount_paid",
    "refund": "refund_amount", "refundamount": "refund_amount", "refund_amount": "refund_amount",
    "quantity": "qty", "qty": "qty", "qnty": "qty",
    "nation": "country", "countryname": "country", "country_name": "country",
    "unit_price": "price", "unitprice": "price", "cost": "price", "rate": "price",
}

#: An advisor's alias counts from this confidence on.
ALIAS_CONFIDENCE = 0.80


def normalize(name: object) -> str:
    """Lower-case words joined by single underscores; empty for a blank name."""
    s = "" if name is None else str(name).strip().lower()
    return re.sub(r"_+", "_", re.sub(r"[^a-z0-9_]+", "", re.sub(r"\W+", "_", s))).strip("_")


def norm(name: object) -> str:
    """Stripped, lower-cased, spaces as underscores: the form in which rules look at names."""
    return str(name).strip().lower().replace(" ", "_")


def tokens(name: object) -> set[str]:
    return {p for p in re.split(r"[_\W]+", norm(name)) if p}


def plan(columns: list[str], aliases: Mapping[str, str] | None = None, advised: Mapping[str, Mapping] | None = None, aliasing: bool = True) -> list[str]:
    """The new name of each column, in order; names may repeat.

    aliases (default ALIASES) map normalised names; advised maps raw or normalised names to
    {"alias", "confidence"} and wins over nothing but the normalised name itself.
    """
    table = {normalize(k) or k: v for k, v in (ALIASES if aliases is None else aliases).items()}
    out = []
    for i, raw in enumerate(columns):
        name = normalize(raw) or f"column_{i}"
        new = table.get(name, name) if aliasing else name
        hint = (advised or {}).get(raw) or (advised or {}).get(name)
        if new == name and hint and float(hint.get("confidence", 0)) >= ALIAS_CONFIDENCE:
            new = normalize(hint.get("alias")) or new
        out.append(new)
    return out


def rename(df: DataFrame, names: list[str]) -> DataFrame:
    """df with the given names; columns of the same name are merged, the first that is not null winning."""
    unique = [f"c{i}" for i in range(len(names))]
    flat = df.toDF(*unique)
    groups: dict[str, list[str]] = {}
    for u, n in zip(unique, names, strict=True):
        groups.setdefault(n, []).append(u)
    kinds = dict(flat.dtypes)

    def merged(n: str, us: list[str]):
        if len({kinds[u] for u in us}) > 1:
            return F.coalesce(*[F.col(u).cast("string") for u in us]).alias(n)
        return F.coalesce(*[F.col(u) for u in us]).alias(n) if len(us) > 1 else F.col(us[0]).alias(n)

    return flat.select(*[merged(n, us) for n, us in groups.items()])


def apply(df: DataFrame, **options) -> tuple[DataFrame, dict]:
    """Normalised and aliased df, and a report of renames and merges."""
    names = plan(df.columns, **options)
    merged = sorted({n for n in names if names.count(n) > 1})
    return rename(df, names), {"renamed": {a: b for a, b in zip(df.columns, names, strict=True) if a != b}, "merged": merged}


def strip_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def align(df: DataFrame, order: list[str], extras: bool = True) -> DataFrame:
    """Columns of df in the given order, others appended (or left out)."""
    kept = [c for c in order if c in df.columns]
    return df.select(*[f"`{c}`" for c in kept + [c for c in df.columns if c not in kept and extras]])


def union_by_name(frames: Mapping[str, DataFrame] | list[DataFrame]) -> tuple[DataFrame, dict]:
    """All rows under the sorted union of columns, missing ones null, and how many each frame lacked.

    Columns whose types differ become text.
    """
    named = dict(frames) if isinstance(frames, Mapping) else {str(i): f for i, f in enumerate(frames)}
    kinds: dict[str, set] = {}
    for f in named.values():
        for c, t in f.dtypes:
            kinds.setdefault(c, set()).add(t)
    columns = sorted(kinds)
    out = None
    for f in named.values():
        part = f.select(*[(F.col(f"`{c}`").cast("string") if len(kinds[c]) > 1 else F.col(f"`{c}`")) if c in f.columns else F.lit(None).cast(next(iter(kinds[c])) if len(kinds[c]) == 1 else "string").alias(c) for c in columns])
        part = part.toDF(*columns)
        out = part if out is None else out.unionByName(part)
    return out, {"columns": columns, "missing": {k: [c for c in columns if c not in f.columns] for k, f in named.items()}}


def force_schema(df: DataFrame, trained: Mapping[str, str]) -> DataFrame:
    """df with every trained column, missing ones null."""
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in trained.items() if c not in df.columns])


def differences(before: list[str], after: list[str]) -> dict[str, list[str]]:
    return {"dropped": [c for c in before if c not in after], "new": [c for c in after if c not in before], "order_changed": [] if [c for c in before if c in after] == [c for c in after if c in before] else ["order"]}
