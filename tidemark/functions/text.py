"""Text normalisation and universal parsers as Column expressions (no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that mean "missing", currency signs and codes.
NULL_TOKENS = ["nan", "none", "null", "na", "n/a", "nil", "missing", "-", "--", "?", "", "unknown", "not_available", "not available"]
MONEY_SIGNS = ["₹", "$", "€", "£", "¥"]
MONEY_CODES = ["INR", "USD", "EUR", "GBP", "AED", "JPY", "CAD", "AUD", "RS", "RS.", "RUPEES"]
TRUE_WORDS = ["true", "t", "yes", "y", "1", "returned"]
FALSE_WORDS = ["false", "f", "no", "n", "0", "not returned"]

#: What Spark's cast would take beyond a plain number (suffixes d and f, names of infinities) is refused.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
PLAIN_NUMBER = r"^-?(\d+\.?\d*|\.\d+)$"
#: A plain number whose thousands may be set apart by commas.
GROUPED_NUMBER = r"^-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d*)?$"
#: What a regular expression's \s stands for.
SPACES = " \t\n\x0b\f\r"


def let(c: Column, f) -> Column:
    """f(c), with c evaluated once however often f uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def strip(c: Column) -> Column:
    """Without white space at either end; null stays null."""
    return F.btrim(c.cast("string"), F.lit(SPACES))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def is_null_token(c: Column) -> Column:
    """True for null and for texts that stand for a missing value."""
    return c.isNull() | F.lower(strip(c)).isin(NULL_TOKENS)


def normalize_text(c: Column) -> Column:
    """Stripped; null for blanks and null tokens."""
    s = strip(c)
    return F.when(~F.lower(s).isin(NULL_TOKENS), s)


def normalize_category(c: Column, lower: bool) -> Column:
    """Stripped (and lower-cased); null for blanks."""
    s = strip(c)
    return blank_to_null(F.lower(s) if lower else s)


def number(c: Column, kind: T.DataType | None = None) -> Column:
    """As double; null where it is no number (no date is one).  NaN counts as null."""
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return F.lit(None).cast("double")
    if isinstance(kind, T.NumericType | T.BooleanType):
        x = (c.cast("int") if isinstance(kind, T.BooleanType) else c).cast("double")
        return F.nanvl(x, F.lit(None)) if isinstance(kind, T.DoubleType | T.FloatType) else x
    s = strip(c)
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def loose_number(c: Column) -> Column:
    """Number in a text after dropping commas, brackets (as a minus) and all but digits, points and minus signs."""
    plain = F.replace(strip(c), F.lit(","), F.lit(""))
    s = F.regexp_replace(plain, r"^\((.*)\)$", "-$1")
    s = F.regexp_replace(s, r"[^\d.\-]+", "")
    # Most numbers need no rewriting, and the rewritten text is made once for others.
    return F.when(plain.rlike(PLAIN_NUMBER), plain.try_cast("double")).otherwise(let(s, lambda x: F.when(x.rlike(PLAIN_NUMBER), x.try_cast("double"))))


def digits(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"\D", "")


def parse_money(c: Column) -> Column:
    """Amount of a text such as '₹1,200', '(500)', 'USD 1,234.56' or '12,34,567,89 only'; null otherwise.

    Commas are thousands separators where a point occurs too; else the last of them is the
    decimal separator if exactly two characters follow it.  Plain amounts, with a currency
    sign or without, are read as they are; only other texts are rewritten step by step.
    """
    plain = F.ltrim(strip(c), F.lit("".join(MONEY_SIGNS)))
    s = F.regexp_replace(strip(c), "[  -​]+", " ")
    s = F.regexp_replace(F.trim(s), r"^\((.*)\)$", "-$1")
    s = F.regexp_replace(s, r"/-\s*$", "")
    s = F.regexp_replace(s, r"(?i)\b(only|approx|approximately)\b", "")
    s = F.translate(s, "".join(MONEY_SIGNS), "")
    s = F.regexp_replace(s, rf"(?i)\b({'|'.join(x for x in MONEY_CODES if '.' not in x)})\b", "")
    s = F.replace(F.trim(s), F.lit(" "), F.lit(""))
    s = let(s, lambda x: F.replace(F.when(x.contains("."), x).otherwise(F.regexp_replace(x, r",([^,]{2})$", ".$1")), F.lit(","), F.lit("")))
    rewritten = let(s, lambda x: F.when(x.rlike(PLAIN_NUMBER), x.try_cast("double")))
    return F.when(plain.rlike(GROUPED_NUMBER), F.replace(plain, F.lit(","), F.lit("")).try_cast("double")).when(plain.isNotNull(), rewritten)


def parse_percent(c: Column) -> Column:
    """'7%' is 7; a bare number from 0 to 1 is a fraction of 1; any other number is itself."""
    s = strip(c)
    signed = s.endswith("%")
    x = strip(F.when(signed, F.regexp_replace(s, "%$", "")).otherwise(s))
    v = F.when(x.rlike(NUMBER), x.try_cast("double"))
    return F.when(~signed & v.between(0, 1), v * 100).otherwise(v)


def parse_bool(c: Column) -> Column:
    """1.0, 0.0 or null."""
    s = F.lower(strip(c))
    return F.when(s.isin(TRUE_WORDS), 1.0).when(s.isin(FALSE_WORDS), 0.0)


#: A time after a date (or none), and the same with AM or PM.
_TIME, _HALF = "[ H:m[:s[.SSSSSSSSS]]]", " h:m[:s[.SSSSSSSSS]]a"

#: Year, month and day alone, as most dates are written.
DATE_ALONE = r"^\d{4}-\d{2}-\d{2}\z"

_DATE_PART = r"(?i)(\d{1,4}[-/]\d{1,2}[-/]\d{1,4}(?:[ T]\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?(?: ?[AP]M)?)?)"


def by_shape(s: Column, day_first: bool = False) -> Column:
    """Timestamp of a text in one of the known forms, null otherwise; the text's shape says which one or two to try.

    Year first, day or month first (with - or /), eight digits, or a month's name, each
    with or without a time.  Where day and month both fit, the month is first in a date
    alone, and the day in a date with a time or if day_first.
    """
    s = F.regexp_replace(F.regexp_replace(s, r"(?<=\d)T(?=\d)", " "), r"(?i) ?([AP]M)$", "$1")
    # Months by their first three letters, and one separator.
    s = F.regexp_replace(F.regexp_replace(s, r"([A-Za-z]{3})[a-z]*\.?(?=[ ,\-/]|$)", "$1"), r"^(\w+)[-/ ](\w+)[-/, ]+(\w+)", "$1-$2-$3")

    def found(x: Column) -> Column:
        half, timed = x.rlike("(?i)[AP]M$"), x.contains(":")

        def at(days: str) -> Column:
            return F.when(half, F.try_to_timestamp(x, F.lit(days + _HALF))).otherwise(F.try_to_timestamp(x, F.lit(days + _TIME)))

        day, month = at("d-M-yyyy"), at("M-d-yyyy")
        either = F.coalesce(day, month) if day_first else F.when(timed, F.coalesce(day, month)).otherwise(F.coalesce(month, day))
        return (
            F.when(x.rlike(r"^\d{4}-\d"), at("yyyy-M-d"))
            .when(x.rlike(r"^\d{1,2}-\d{1,2}-\d{4}"), either)
            .when(x.rlike(r"^\d{8}$"), F.try_to_timestamp(x, F.lit("yyyyMMdd")))
            .when(x.rlike(r"^\d{1,2}-[A-Za-z]{3}-\d{4}"), at("d-MMM-yyyy"))
            .when(x.rlike(r"^[A-Za-z]{3}-\d{1,2}-\d{4}"), at("MMM-d-yyyy"))
        )

    return let(s, found).cast("timestamp_ntz")


def to_datetime(c: Column, kind: T.DataType | None = None, day_first: bool = False) -> Column:
    """Timestamp of a date-like column; null where it is none."""
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return c.cast("timestamp_ntz")
    return by_shape(F.regexp_replace(strip(c), r"(?<=:\d{2}(\.\d{1,9})?)(Z|[+-]\d{2}:?\d{2})$", "") if day_first else strip(c), day_first)


def parse_date(c: Column) -> Column:
    """Timestamp of a text in one of many forms, of epoch seconds or milliseconds, or of a spreadsheet's day number.

    Zone names and offsets are dropped; a date within other text is found; a time alone
    is one of today.
    """
    plain = strip(c)
    s = F.trim(F.regexp_replace(plain, "[\u00a0\u2000-\u200b]+", " "))
    s = F.regexp_replace(s, r"(?i)\b(IST|UTC|GMT|CST|EST|PST|AEST|AEDT|JST|MSK|NZST|NZDT)\b", "")
    s = F.trim(F.regexp_replace(s, r"[+-]\d{2}:\d{2}(?=\s|$)", ""))
    s = F.coalesce(F.nullif(F.regexp_extract(s, _DATE_PART, 1), F.lit("")), s)

    def found(x: Column) -> Column:
        n = F.when(x.rlike(r"^-?\d+(\.\d+)?$"), x.try_cast("double"))
        by_number = (
            F.when(n.between(1_000_000_000, 2_000_000_000), F.timestamp_seconds(F.floor(n)))
            .when(n.between(1_000_000_000_000, 2_000_000_000_000), F.timestamp_millis(F.floor(n)))
            .when(n.between(20000, 60000), F.timestamp_seconds(F.round((n - 25569) * 86400)))
        )
        dated = F.when(x.rlike(r"(?i)^\d{1,2}:\d{2}(:\d{2})?(\.\d+)?( ?[AP]M)?$"), F.concat(F.current_date().cast("string"), F.lit(" "), x)).otherwise(x)
        return F.coalesce(by_number.cast("timestamp_ntz"), by_shape(dated))

    # A date alone needs no rewriting.
    return F.when(plain.rlike(DATE_ALONE), F.try_to_timestamp(plain, F.lit("yyyy-M-d" + _TIME)).cast("timestamp_ntz")).when(plain.isNotNull(), let(s, found).cast("timestamp_ntz"))


def export_datetime(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# Forms that count as a date, and the formats of a common pattern.
DATE_FORMS = [r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{2}-\d{2}-\d{4}", r"\d{4}/\d{2}/\d{2}", r"\d{2}\s[A-Za-z]{3}\s\d{4}"]


def has_date_form(c: Column) -> Column:
    return strip(c).rlike(rf"^(?:{'|'.join(DATE_FORMS)})$")
