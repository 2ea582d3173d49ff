"""Optional advice on a data set's schema: from a fixed table, or from a chat endpoint.  Off by default.

Advice is a dict {"columns": {name: {"semantic_type", "confidence", "alias", "regex", ...}}}
and passes a safety filter before anything uses it.
"""

from __future__ import annotations

import json
import re
import time
import urllib.request
from collections.abc import Callable
from functools import wraps
from typing import Protocol

from ..functions import expressions

# What advice may say.
TYPES = {"ID", "BOOLEAN", "DATE", "DATETIME", "AGE", "YEAR", "PERCENTAGE", "SCORE", "COUNT", "MONEY", "AMOUNT", "CATEGORY", "TEXT", "EMAIL", "PHONE", "ZIP", "URL"}
MODES = {"conservative", "balanced", "aggressive"}
MOST_ALIASES = 12


class SchemaAdvisor(Protocol):
    def advise(self, summary: list[dict]) -> dict:
        """Advice for the columns of a summary (profile.dataset_summary)."""


class StaticAdvisor:
    """The same advice every time: for tests and offline use."""

    def __init__(self, columns: dict[str, dict] | None = None, mode: str | None = None):
        self.columns, self.mode = columns or {}, mode

    def advise(self, summary: list[dict]) -> dict:
        names = {s["column"] for s in summary}
        return {"columns": {c: a for c, a in self.columns.items() if c in names}, "mode": self.mode}


def retry(times: int = 2, wait: float = 0.8, factor: float = 2.0) -> Callable:
    """Calls again after an error, waiting longer each time."""

    def decorate(f):
        @wraps(f)
        def call(*a, **k):
            pause = wait
            for i in range(times):
                try:
                    return f(*a, **k)
                except Exception:
                    if i == times - 1:
                        raise
                    time.sleep(pause)
                    pause *= factor

        return call

    return decorate


def json_block(text: str) -> dict | None:
    """The object from the first brace to the last; None if that is no JSON object."""
    a, b = text.find("{"), text.rfind("}")
    if a < 0 or b <= a:
        return None
    try:
        found = json.loads(text[a : b + 1])
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


class ChatClient:
    """POSTs to an endpoint of the widespread chat-completions form."""

    def __init__(self, base_url: str, model: str, timeout: float = 90, attempts: int = 3):
        self.base_url, self.model, self.timeout, self.attempts = base_url.rstrip("/"), model, timeout, attempts

    def chat(self, prompt: str) -> str:
        body = json.dumps({"model": self.model, "temperature": 0, "messages": [{"role": "user", "content": prompt}]}).encode()
        request = urllib.request.Request(f"{self.base_url}/chat/completions", body, {"Content-Type": "application/json"})

        @retry(self.attempts, 0.8, 1.0)
        def send() -> str:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                return json.load(r)["choices"][0]["message"]["content"]

        return send()

    def ask_json(self, prompt: str) -> dict | None:
        return json_block(self.chat(prompt))


class ChatAdvisor:
    """Advice from a chat model; an error is reported as such, never as an empty success."""

    def __init__(self, client: ChatClient):
        self.client = client

    def advise(self, summary: list[dict]) -> dict:
        kinds = ", ".join(sorted(TYPES))
        prompt = f"For each column give JSON {{'columns': {{name: {{'semantic_type': one of {kinds}, 'confidence': 0..1, 'alias': canonical name or null, 'regex': or null}}}}}}. Columns: {json.dumps(summary, default=str)}"
        found = self.client.ask_json(prompt)
        if found is None:
            raise ValueError("the advisor's answer holds no JSON object")
        return found


# The names that advice may rename a column to.
CANONICAL = {
    "email", "phone", "user_id", "customer_id", "order_id", "invoice_id", "transaction_id", "order_date", "delivery_date", "return_date", "created_at", "updated_at",
    "total_amount", "amount_paid", "refund_amount", "qty", "price", "country", "state", "city", "zip", "dob", "age", "year",
}
#: The parser that each advised type calls for.
PARSED_AS = {"MONEY": "money", "AMOUNT": "amount", "DATE": "date", "PERCENTAGE": "percent", "BOOLEAN": "bool"}


def safe(advice: dict, columns: list[str]) -> dict:
    """Advice on known columns only: known types, confidences in 0..1, compilable short patterns, unique canonical aliases."""
    out: dict[str, dict] = {}
    taken: set[str] = set()
    for c, a in (advice.get("columns") or {}).items():
        if c not in columns or not isinstance(a, dict):
            continue
        kind = str(a.get("semantic_type", "TEXT")).upper().strip()
        try:
            sure = min(1.0, max(0.0, float(a.get("confidence", 0))))
        except (TypeError, ValueError):
            sure = 0.0
        entry = {"semantic_type": kind if kind in TYPES else "TEXT", "confidence": sure, "protect": kind == "ID"}
        pattern = a.get("regex")
        if expressions.is_safe(pattern) and _compiles(pattern):
            entry["regex"] = pattern
        alias = str(a.get("alias") or "").strip().lower()
        if alias in CANONICAL and alias not in taken and len(taken) < MOST_ALIASES:
            taken.add(alias)
            entry["alias"] = alias
        for bound in ("min", "max"):
            if isinstance(a.get(bound), int | float):
                entry[bound] = a[bound]
        out[c] = entry
    mode = advice.get("mode")
    return {"columns": out, "mode": mode if mode in MODES else None}


def _compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def overrides(advice: dict, least: float = 0.70) -> dict:
    """Settings that advice implies: hints of types, value ranges, patterns, ids, aliases."""
    sure = {c: a for c, a in advice["columns"].items() if a["confidence"] >= least}
    return {
        "semantic_types": {c: PARSED_AS[a["semantic_type"]] for c, a in sure.items() if a["semantic_type"] in PARSED_AS},
        "domains": {c: (a["min"], a["max"]) for c, a in sure.items() if "min" in a and "max" in a},
        "custom_patterns": {c: {"regex": a["regex"], "pattern_name": c, "source": "advisor"} for c, a in sure.items() if "regex" in a},
        "id_columns": [c for c, a in sure.items() if a["protect"]],
        "aliases": {c: {"alias": a["alias"], "confidence": a["confidence"]} for c, a in advice["columns"].items() if "alias" in a},
    }


def ambiguous_only(summary: list[dict], ambiguous: list[str], most: int = 35) -> list[dict]:
    """The part of a summary worth asking about."""
    return [s for s in summary if s["column"] in ambiguous][:most]
