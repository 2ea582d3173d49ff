"""Scalar expressions against table-driven cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import expressions
from tidemark.functions import scoring as S
from tidemark.functions import text as X


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", f(F.col("v")).alias("x")).collect())]


@pytest.mark.parametrize(
    ("parser", "cases"),
    [
        (X.parse_money, {"₹1,200": 1200.0, "(500)": -500.0, "USD 1,234.56": 1234.56, "12,34,567": 1234567.0, "1,234,56": 1234.56, "1,50": 1.5, "1,500 only": 1500.0, "5/-": 5.0, "Rs. 500": 0.5, "1,2.3,4": 12.34, "1." + "2," * 90 + "3": float("1." + "2" * 90 + "3"), "1e5": None, "abc": None, "-": None, "": None, None: None}),
        (X.parse_percent, {"7%": 7.0, "0.5": 50.0, "1": 100.0, "2": 2.0, "0.5 %": 0.5, "%": None, "x": None, "-3": -3.0, None: None}),
        (X.parse_bool, {" Yes": 1.0, "returned": 1.0, "NOT returned": 0.0, "f": 0.0, "maybe": None, "n/a": None, None: None}),
        (X.number, {"1.5": 1.5, " 2 ": 2.0, "1e3": 1000.0, "1.0d": None, "nan": None, "1_000": None, "": None, None: None}),
        (X.loose_number, {"(1,200)": -1200.0, "about 5 EUR": 5.0, "none": None, None: None}),
        (X.normalize_text, {" a ": "a", "N/A": None, "--": None, "\tNot Available\n": None, None: None}),
        (X.digits, {"+91 (20) 1": "91201", None: None}),
    ],
)
def test_parsers(spark, parser, cases):
    assert column(spark, list(cases), parser) == list(cases.values())


def test_dates(spark):
    day = dt.datetime(2024, 1, 5)
    cases = {
        "2024-01-05": day,
        "01/05/2024": day,
        "25/12/2023": dt.datetime(2023, 12, 25),
        "2024-01-05 10:20:30 +05:30": dt.datetime(2024, 1, 5, 10, 20, 30),
        "on 2024-01-05 at": day,
        "45296": day,
        "1700000000": dt.datetime(2023, 11, 14, 22, 13, 20),
        "1700000000000": dt.datetime(2023, 11, 14, 22, 13, 20),
        "5 Jan 2024": day,
        "5 January 2024": day,
        "January 5, 2024": day,
        "Sept. 5, 2024": dt.datetime(2024, 9, 5),
        "05-Jan-2024 10:20": dt.datetime(2024, 1, 5, 10, 20),
        "2024-01-05 10:20:30.25": dt.datetime(2024, 1, 5, 10, 20, 30, 250000),
        "2024-01-05T10:20": dt.datetime(2024, 1, 5, 10, 20),
        "at 2024/01/05 03:20PM": dt.datetime(2024, 1, 5, 15, 20),
        "2024-01-05 12:20:30 am": dt.datetime(2024, 1, 5, 0, 20, 30),
        "05-01-2024 10:20": dt.datetime(2024, 1, 5, 10, 20),
        "13-01-2024": dt.datetime(2024, 1, 13),
        "2024-13-45": None,
        "garbage": None,
        "unknown": None,
        None: None,
    }
    assert column(spark, list(cases), X.parse_date) == list(cases.values())
    assert column(spark, ["05/01/2024", "2024-01-05T00:00:00Z", "2024-01-05 00:00:00.5+0530"], lambda c: X.to_datetime(c, day_first=True)) == [day, day, day.replace(microsecond=500000)]
    at = column(spark, ["10:30", "10:30:05 PM"], X.parse_date)
    assert [(x.hour, x.minute, x.second) for x in at] == [(10, 30, 0), (22, 30, 5)] and at[0].date() == at[1].date()


def test_scores(spark):
    assert [S.grade(x) for x in (95, 94.9, 70, 55, 0)] == ["A", "B", "C", "D", "F"]
    assert [S.pattern_confidence(x) for x in (0.95, 0.85, 0.7, 0.55, 0.1)] == [0.95, 0.90, 0.80, 0.70, 0.60]
    assert S.decayed(0.8, 30) == pytest.approx(0.76)
    assert S.fingerprint(3, ["a", "b"]) == S.fingerprint(3, ["a", "b"]) != S.fingerprint(4, ["a", "b"])
    assert column(spark, ["error", "Warning", None, "odd", "info"], S.severity_weight) == [2.5, 1.0, 1.0, 1.0, 0.25]
    assert column(spark, [0.05, 1.2, None, 0.5], S.clamped_confidence, "double") == [0.1, 1.0, 0.6, 0.5]


SAFE = [r"^\d+$", r"[A-Z]{2}\d{4}", r"^[^@\s]+@[^@\s]+\.[^@\s]+$", r"(\d+-)+\d+", r"(?:ab|cd)+x", r"\+?\d{7,15}", r"(a|ab)c", r"[a-z]+\d+", r"^(?:https?://)?[\w.-]+$", r"(\w+\s)*end", r"INV-\d{4,8}", r"(?=.*\d)[a-z\d]{3,9}", r"([a-z]{2}\d)+", r"^\s*\d{3}-\d{2}\s*$"]
UNSAFE = [r"(a+)+$", r"([a-z]+)*x", r"(\d|\d\d)+$", r"(.*)+", r"(.*.*)", r"(a*)*", r"(a|a)+b", r"\d+\d+$", r"a*[ab]*c", r"(a?a)+b", r"((ab)*)*", r"(\w+\s?)*$", r"(x+x+)+y", r"([a-zA-Z]+|\w)*!", r"(a{1,30}){1,30}b", r"(a)\1+", r"(", "", "  ", None, "x" * 251, r"(?P<n>a+)+z", r"(?:(?:a|b)+)+c", r"(a*b?)*c"]


@pytest.mark.parametrize("pattern", SAFE)
def test_linear_expressions(pattern):
    assert expressions.is_safe(pattern)


@pytest.mark.parametrize("pattern", UNSAFE)
def test_ambiguous_expressions(pattern):
    assert not expressions.is_safe(pattern)


def test_safe_expressions_are_fast():
    """What is called safe takes no time on the texts that backtracking fears."""
    import re
    import time

    for pattern in SAFE:
        compiled = re.compile(pattern)
        for text in ("a" * 400 + "!", "1" * 400 + "!", "ab" * 200 + "!", "1-" * 200 + "!", "a " * 200 + "!", "@." * 200, "aa1" * 130 + "!"):
            start = time.perf_counter()
            compiled.search(text)
            assert time.perf_counter() - start < 0.5, (pattern, text[:10])
