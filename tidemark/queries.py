"""Registered queries of the cleaning operators, and the SQL that gives the same rows.

The driver tables hold no dirt, so queries add it by expressions that SQL can repeat.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scoring as S
from .functions import text as X
from .operators import export, impute, names, patterns, quality, relations, scorecard, semantics, sketches, structure
from .operators import issues as I
from .operators import profile as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL of its rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with a row id, and nulls in price (every 7th key) and priority (every 11th)."""
    o = _table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias(I.ROW_ID), "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate",
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
    )


_ORDERS = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders)"
_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice", "o_orderpriority"]


def _per_column(sql: str, columns: list[str] = _COLUMNS) -> str:
    return " UNION ALL ".join(sql.format(c=c) for c in columns)


def _plain(issues: DataFrame) -> DataFrame:
    return issues.select("row", "column", "stage", "severity", "issue", F.round("confidence", 6).alias("confidence"))


# ---- profiles


@query(_per_column(f"SELECT '{{c}}' AS column_name, count(*) AS n_rows, count(*) - count({{c}}) AS missing, round((count(*) - count({{c}})) * 100.0 / count(*), 4) AS missing_percent FROM {_ORDERS}").replace("* 100.0", "* CAST(100 AS DOUBLE)"))
def profile_nulls(spark, sf_dir):
    found = P.profile(_orders(spark, sf_dir), frequencies=False, moments=False)
    return spark.createDataFrame([(p.column, p.rows, p.missing, p.missing_percent) for p in found], "column_name string, n_rows long, missing long, missing_percent double").withColumn("missing_percent", F.round("missing_percent", 4))


@query(_per_column(f"SELECT '{{c}}' AS column_name, count(DISTINCT {{c}}) AS n_unique, round((CAST(1 AS DOUBLE) - count(DISTINCT {{c}}) / CAST(count({{c}}) AS DOUBLE)) * 100, 4) AS duplicate_percent FROM {_ORDERS}"))
def profile_unique(spark, sf_dir):
    found = P.profile(_orders(spark, sf_dir), moments=False)
    return spark.createDataFrame([(p.column, p.unique, p.duplicate_percent) for p in found], "column_name string, n_unique long, duplicate_percent double").withColumn("duplicate_percent", F.round("duplicate_percent", 4))


@query(_per_column("SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value, round(avg({c}), 4) AS mean_value, round(stddev_samp({c}), 4) AS std_value FROM lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def profile_numeric_stats(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    m = P.measure(df, {(c, k): f(c) for c in df.columns for k, f in (("min", F.min), ("max", F.max), ("avg", F.avg), ("std", F.stddev_samp))})
    found = spark.createDataFrame([(c, v["min"], v["max"], v["avg"], v["std"]) for c, v in m.items()], "column_name string, min_value double, max_value double, mean_value double, std_value double")
    return found.withColumns({c: F.round(c, 4) for c in ("mean_value", "std_value")})


@query(
    "SELECT column_name, value, count, rank FROM (SELECT column_name, value, count(*) AS count, CAST(row_number() OVER (PARTITION BY column_name ORDER BY count(*) DESC, value) AS INTEGER) AS rank FROM ("
    + _per_column("SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM part", ["p_brand", "p_type", "p_size"])
    + ") WHERE value IS NOT NULL GROUP BY column_name, value) WHERE rank <= 5"
)
def profile_top_values(spark, sf_dir):
    counts = P.value_counts(_table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])
    return P.top_values(counts).withColumnRenamed("column", "column_name")


_IQR = "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem)"


@query("SELECT round(quantile_cont(l_extendedprice, 0.25) - 1.5 * (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)), 4) AS low, round(quantile_cont(l_extendedprice, 0.75) + 1.5 * (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)), 4) AS high FROM lineitem")
def iqr_bounds(spark, sf_dir):
    low, high = P.iqr_bounds(_table(spark, sf_dir, "lineitem"), {"l_extendedprice": F.col("l_extendedprice")})["l_extendedprice"]
    return spark.createDataFrame([(low, high)], "low double, high double").select(F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query(_IQR + " SELECT count(*) FILTER (WHERE l_extendedprice < a - 0.5 * (b - a) OR l_extendedprice > b + 0.5 * (b - a)) AS outliers FROM lineitem, q")
def iqr_outlier_count(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem")
    low, high = P.iqr_bounds(df, {"x": F.col("l_extendedprice")}, 0.5)["x"]
    return df.agg(P.iqr_outliers(F.col("l_extendedprice"), low, high).alias("outliers"))


@query(_IQR + " SELECT l_orderkey, l_linenumber, round(least(greatest(l_extendedprice, a - 0.5 * (b - a)), b + 0.5 * (b - a)), 4) AS clipped FROM lineitem, q")
def iqr_clip(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem")
    low, high = P.iqr_bounds(df, {"x": F.col("l_extendedprice")}, 0.5)["x"]
    return df.select("l_orderkey", "l_linenumber", F.round(impute.clip_to(F.col("l_extendedprice"), low, high), 4).alias("clipped"))


@query("SELECT 'o_orderdate' AS column_name, 'unknown' AS meaning UNION ALL SELECT 'mail', 'email' UNION ALL SELECT 'o_totalprice', 'amount' UNION ALL SELECT 'code', 'pincode' UNION ALL SELECT 'order_id', 'id' UNION ALL SELECT 'note', 'unknown'")
def semantic_meanings(spark, sf_dir):
    o = _orders(spark, sf_dir)
    df = o.select(I.ROW_ID, "o_orderdate", F.concat(F.lit("a"), F.col("o_orderkey"), F.lit("@x.org")).alias("mail"), "o_totalprice", (100000 + F.col("o_orderkey") % 800000).cast("string").alias("code"), F.col("o_orderkey").alias("order_id"), F.lit("no meaning").alias("note"))
    found = P.meanings(df)
    return spark.createDataFrame(list(found.items()), "column_name string, meaning string")


@query(_per_column("SELECT '{c}' AS column_name, count(DISTINCT {c}) <= 60 AS few, count(DISTINCT {c}) <= 0.6 * count({c}) AS repeated, count(DISTINCT {c}) >= 0.95 * count({c}) AS nearly_unique FROM lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_partkey", "l_shipdate"]))
def distinct_decisions(spark, sf_dir):
    """What sketches decide about columns, counting exactly only where they leave it open; the parts of the table are sketched apart and merged."""
    names = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_partkey", "l_shipdate"]
    df = _table(spark, sf_dir, "lineitem").select(*names)
    parts = [sketches.sketches(df.filter(F.col("l_orderkey") % 2 == k), names) for k in (0, 1)]
    merged = sketches.merge(parts[0].unionByName(parts[1]))
    known = {r["column"]: r["known"] for r in merged.collect()}
    few = sketches.distinct(df, names, at_most=60, parts=merged)
    repeated, unique = (sketches.distinct(df, names, share=share, parts=merged) for share in (0.6, 0.95))
    rows = [(c, few[c] <= 60, repeated[c] <= 0.6 * known[c], unique[c] >= 0.95 * known[c]) for c in names]
    return spark.createDataFrame(rows, "column_name string, few boolean, repeated boolean, nearly_unique boolean")


@query("SELECT lang, source, count(*) AS docs, round(avg(CASE WHEN regexp_matches(text, '[*$%&#]{3}') THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS junk_share, round(avg(length(text)), 4) AS mean_length FROM documents GROUP BY lang, source")
def document_quality_profile(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return d.groupBy("lang", "source").agg(F.count("*").alias("docs"), F.round(P.ratio(F.col("text").rlike("[*$%&#]{3}")), 6).alias("junk_share"), F.round(F.avg(F.length("text")), 4).alias("mean_length"))


@query(f"""SELECT column_name, round(abs(a_missing - b_missing), 6) AS delta_missing, round(abs(a_unique - b_unique), 6) AS delta_unique,
CASE WHEN greatest(abs(a_missing - b_missing), abs(a_unique - b_unique)) >= 0.15 THEN 'high' WHEN greatest(abs(a_missing - b_missing), abs(a_unique - b_unique)) >= 0.05 THEN 'medium' ELSE 'none' END AS level FROM (
{_per_column(f"SELECT '{{c}}' AS column_name, count(*) FILTER (WHERE o_orderkey % 2 = 0 AND {{c}} IS NULL) / CAST(count(*) FILTER (WHERE o_orderkey % 2 = 0) AS DOUBLE) AS a_missing, count(*) FILTER (WHERE o_orderkey % 2 = 1 AND {{c}} IS NULL) / CAST(count(*) FILTER (WHERE o_orderkey % 2 = 1) AS DOUBLE) AS b_missing, count(DISTINCT {{c}}) FILTER (WHERE o_orderkey % 2 = 0) / CAST(count(*) FILTER (WHERE o_orderkey % 2 = 0) AS DOUBLE) AS a_unique, count(DISTINCT {{c}}) FILTER (WHERE o_orderkey % 2 = 1) / CAST(count(*) FILTER (WHERE o_orderkey % 2 = 1) AS DOUBLE) AS b_unique FROM {_ORDERS}", ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])})""")
def drift_report(spark, sf_dir):
    o = _orders(spark, sf_dir).select(I.ROW_ID, "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    trained = P.rates(o.filter(F.col(I.ROW_ID) % 2 == 0))
    found = P.drift(o.filter(F.col(I.ROW_ID) % 2 == 1), trained)
    return spark.createDataFrame([(c, round(d["delta_missing"], 6), round(d["delta_unique"], 6), d["level"]) for c, d in found.items()], "column_name string, delta_missing double, delta_unique double, level string")


# ---- names and set operations


@query("SELECT s_suppkey AS user_id, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_name END, s_name || '@x') AS email, s_acctbal AS price FROM supplier")
def rename_and_merge(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier")
    raw = s.select(F.col("s_suppkey").alias("Customer ID"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("E-Mail"), F.concat("s_name", F.lit("@x")).alias("user email"), F.col("s_acctbal").alias(" Unit Price "))
    return names.apply(raw)[0]


@query("SELECT coalesce(CASE WHEN n_nationkey % 3 = 0 THEN n_name END, CASE WHEN n_nationkey % 3 = 1 THEN lower(n_name) END, 'x') AS country, n_nationkey AS n_nationkey FROM nation")
def coalesce_duplicate_columns(spark, sf_dir):
    n = _table(spark, sf_dir, "nation")
    raw = n.select(F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).alias("Nation"), F.when(F.col("n_nationkey") % 3 == 1, F.lower("n_name")).alias("country name"), F.lit("x").alias("Country"), "n_nationkey")
    return names.apply(raw)[0]


@query("SELECT c_acctbal, c_custkey, c_name, CAST(NULL AS DOUBLE) AS s_acctbal, CAST(NULL AS BIGINT) AS s_suppkey FROM customer UNION ALL SELECT NULL, NULL, NULL, s_acctbal, s_suppkey FROM supplier")
def union_by_name_align(spark, sf_dir):
    return names.union_by_name([_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), _table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")])[0]


# ---- scalar parsers


@query("SELECT event_id, CASE WHEN lower(trim(raw)) IN ('nan','none','null','na','n/a','nil','missing','-','--','?','','unknown','not_available','not available') THEN NULL ELSE trim(raw) END AS value FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' ' || event_type || ' ' WHEN 1 THEN 'N/A' WHEN 2 THEN '  ' WHEN 3 THEN 'Unknown ' WHEN 4 THEN '--' ELSE upper(event_type) END AS raw FROM events)")
def null_tokens(spark, sf_dir):
    e, k = _table(spark, sf_dir, "events"), F.col("event_id") % 6
    raw = F.when(k == 0, F.concat(F.lit(" "), "event_type", F.lit(" "))).when(k == 1, "N/A").when(k == 2, "  ").when(k == 3, "Unknown ").when(k == 4, "--").otherwise(F.upper("event_type"))
    return e.select("event_id", X.normalize_text(raw).alias("value"))


@query("SELECT c_custkey, nullif(lower(trim(CASE WHEN c_custkey % 4 = 0 THEN '  ' ELSE '  ' || c_mktsegment || ' ' END)), '') AS segment FROM customer")
def text_normalize(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    raw = F.when(F.col("c_custkey") % 4 == 0, "  ").otherwise(F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")))
    return c.select("c_custkey", X.normalize_category(raw, True).alias("segment"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN cents WHEN 1 THEN -cents WHEN 2 THEN cents WHEN 3 THEN NULL ELSE cents END AS amount
FROM (SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) + CAST(0 AS DOUBLE) AS cents FROM orders)""")
def parse_money(spark, sf_dir):
    n = F.round("o_totalprice").cast("bigint")
    grouped, k = F.format_number(n, 0), F.col("o_orderkey") % 5
    raw = F.when(k == 0, F.concat(F.lit("₹"), grouped, F.lit(" only"))).when(k == 1, F.concat(F.lit("("), grouped, F.lit(".00)"))).when(k == 2, F.concat(F.lit(" USD "), n.cast("string"), F.lit("/- "))).when(k == 3, F.concat(n.cast("string"), F.lit(" apples"))).otherwise(F.concat(F.lit("$ "), n.cast("string"), F.lit(",00")))
    return _table(spark, sf_dir, "orders").select("o_orderkey", X.parse_money(raw).alias("amount"))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN CAST(hundredths AS DOUBLE) WHEN 1 THEN round(hundredths / CAST(100 AS DOUBLE) * 100, 6) ELSE NULL END AS percent FROM (SELECT l_orderkey, l_linenumber, CAST(round(l_discount * 100) AS BIGINT) AS hundredths FROM lineitem)")
def parse_percent(spark, sf_dir):
    n, k = F.round(F.col("l_discount") * 100).cast("bigint"), F.col("l_linenumber") % 3
    raw = F.when(k == 0, F.concat(n.cast("string"), F.lit(" %"))).when(k == 1, (n / 100).cast("string")).otherwise("n/a")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(X.parse_percent(raw), 6).alias("percent"))


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN CAST(1 AS DOUBLE) WHEN 'A' THEN CAST(0 AS DOUBLE) END AS flag FROM lineitem")
def parse_bool(spark, sf_dir):
    f = F.col("l_returnflag")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.parse_bool(F.when(f == "R", " Returned").when(f == "A", "NO").otherwise("maybe")).alias("flag"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 4 THEN NULL WHEN o_orderkey % 6 IN (0, 1, 2, 5) THEN date_trunc('day', o_orderdate) ELSE date_trunc('second', o_orderdate) END AS at FROM orders")
def parse_date(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    raw = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd MMM yyyy")).when(k == 2, F.concat(F.lit("on "), F.date_format(d, "yyyy-MM-dd"))).when(k == 3, F.concat(F.date_format(d, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))).when(k == 4, "not available").otherwise(F.date_format(d, "yyyyMMdd"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", X.parse_date(raw).alias("at"))


@query("SELECT s_suppkey, round(s_acctbal, 2) AS amount FROM supplier")
def loose_number(spark, sf_dir):
    x = F.round("s_acctbal", 2)
    raw = F.when(x < 0, F.concat(F.lit("("), F.format_number(-x, 2), F.lit(")"))).otherwise(F.concat(F.lit("about "), F.format_number(x, 2), F.lit(" EUR")))
    return _table(spark, sf_dir, "supplier").select("s_suppkey", X.loose_number(raw).alias("amount"))


# ---- structure and quality


@query(f"SELECT o_orderkey, coalesce(o_totalprice, (SELECT median(o_totalprice) FROM {_ORDERS})) AS price FROM {_ORDERS}")
def impute_median(spark, sf_dir):
    o = _orders(spark, sf_dir)
    median = P.quantiles_of(o, {"p": F.col("o_totalprice")}, [0.5])["p"][0]
    return o.select("o_orderkey", F.coalesce("o_totalprice", F.lit(median)).alias("price"))


@query(f"SELECT o_orderkey, coalesce(o_orderpriority, (SELECT o_orderpriority FROM {_ORDERS} WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS priority FROM {_ORDERS}")
def impute_mode(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return o.select("o_orderkey", F.coalesce("o_orderpriority", F.lit(P.mode_of(o, ["o_orderpriority"])["o_orderpriority"])).alias("priority"))


_STRUCT = "(SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS balance, CASE WHEN c_custkey % 9 <> 0 THEN ' ' || c_mktsegment END AS segment FROM customer)"


@query(f"""WITH d AS (SELECT * FROM {_STRUCT}), q AS (SELECT quantile_cont(balance, 0.25) AS a, median(balance) AS m, quantile_cont(balance, 0.75) AS b FROM d),
t AS (SELECT segment FROM d WHERE segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT c_custkey, round(least(greatest(coalesce(balance, m), a - 1.5 * (b - a)), b + 1.5 * (b - a)), 4) AS balance, coalesce(lower(trim(d.segment)), t.segment) AS segment FROM d, q, t""")
def structural_clean(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    df = c.select(F.col("c_custkey").alias(I.ROW_ID), F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("balance"), F.when(F.col("c_custkey") % 9 != 0, F.concat(F.lit(" "), "c_mktsegment")).alias("segment"))
    config = structure.Config(protect_ids=False)
    out, _ = structure.apply(df, structure.fit(df, config), config)
    return out.select(F.col(I.ROW_ID).alias("c_custkey"), F.round("balance", 4).alias("balance"), "segment")


def _role_columns(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias(I.ROW_ID), F.col("c_custkey").alias("o_orderkey"), F.col("c_acctbal").alias("o_totalprice"), (F.col("c_custkey") % 100).alias("balance"), F.col("c_mktsegment").alias("segment"), F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")), "dd MMM yyyy").alias("day"))


def _roles(spark, fitted):
    return spark.createDataFrame(list(fitted.roles.items()), "column_name string, role string")


@query("SELECT 'o_orderkey' AS column_name, 'numeric' AS role UNION ALL SELECT 'o_totalprice', 'numeric' UNION ALL SELECT 'balance', 'numeric' UNION ALL SELECT 'segment', 'categorical' UNION ALL SELECT 'day', 'datetime'")
def structural_roles(spark, sf_dir):
    """Roles of one fit without protection of ids."""
    return _roles(spark, structure.fit(_role_columns(spark, sf_dir), structure.Config(protect_ids=False)))


@query("SELECT 'o_orderkey' AS column_name, 'id' AS role UNION ALL SELECT 'segment', 'categorical' UNION ALL SELECT 'balance', 'numeric'")
def structural_roles_by_id_word(spark, sf_dir):
    """Roles of one fit that takes columns named after orders for ids."""
    return _roles(spark, structure.fit(_role_columns(spark, sf_dir).select(I.ROW_ID, "o_orderkey", "segment", "balance"), structure.Config(id_words=["order"])))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01'")
def temporal_filter(spark, sf_dir):
    kept, _ = structure.before_cutoff(_table(spark, sf_dir, "orders"), structure.Config(date_column="o_orderdate", cutoff="1996-01-01"))
    return kept.select("o_orderkey", "o_orderdate")


@query("SELECT c_custkey, CASE WHEN income BETWEEN 0 AND 1000000 THEN income END AS income, CASE WHEN age BETWEEN 0 AND 1 THEN age * 100 WHEN age <= 100 THEN age END AS age FROM (SELECT c_custkey, c_acctbal * 200 AS income, CAST(c_custkey % 110 AS DOUBLE) AS age FROM customer)")
def domain_rule(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    df = c.select(F.col("c_custkey").alias(I.ROW_ID), (F.col("c_acctbal") * 200).alias("income"), (F.col("c_custkey") % 110).cast("double").alias("age"))
    config = quality.Config(null_inflation=1e9, gating=True, required_ids=())
    out, _ = quality.apply(df, quality.fit(df, config), config)
    return out.select(F.col(I.ROW_ID).alias("c_custkey"), "income", "age")


@query("SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS price, CASE WHEN rate BETWEEN 0 AND 100 THEN rate END AS discount FROM (SELECT s_suppkey, s_acctbal, CAST(s_suppkey % 120 + 2 AS DOUBLE) AS rate FROM supplier)")
def money_negative_percent_range(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier")
    df = s.select(F.col("s_suppkey").alias(I.ROW_ID), F.col("s_acctbal").alias("price"), (F.col("s_suppkey") % 120 + 2).cast("double").alias("discount"))
    config = quality.Config(null_inflation=1e9, gating=False, required_ids=())
    out, _ = quality.apply(df, quality.fit(df, config), config)
    return out.select(F.col(I.ROW_ID).alias("s_suppkey"), "price", "discount")


@query("SELECT c_custkey, lower(c_mktsegment) AS segment FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 5 <> 0")
def category_repair(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    typo = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.col("c_mktsegment"), F.lit("s"))).otherwise(F.col("c_mktsegment"))
    config = quality.Config(required_ids=())
    clean = c.select(F.col("c_custkey").alias(I.ROW_ID), F.col("c_mktsegment").alias("segment"))
    vocabularies = quality.fit(clean, config).vocabularies
    out, _ = quality.repair_categories(c.select("c_custkey", typo.alias("segment")), vocabularies)
    return out


# ---- issues

_RANGES = "(SELECT l_orderkey * 10 + l_linenumber AS row, l_extendedprice AS price_min, l_extendedprice + CASE WHEN l_linenumber % 3 = 0 THEN -1 ELSE 1 END * l_quantity AS price_max, CAST(l_linenumber * 30 - 40 AS DOUBLE) AS tax_percent FROM lineitem)"


def _ranges(spark, sf_dir) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    sign = F.when(F.col("l_linenumber") % 3 == 0, -1).otherwise(1)
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias(I.ROW_ID), F.col("l_extendedprice").alias("price_min"), (F.col("l_extendedprice") + sign * F.col("l_quantity")).alias("price_max"), (F.col("l_linenumber") * 30 - 40).cast("double").alias("tax_percent"))


@query(f"SELECT row, 'price_max' AS column, 'relationship' AS stage, 'error' AS severity, 'price_min is greater than price_max' AS issue, CAST(0.828 AS DOUBLE) AS confidence FROM {_RANGES} WHERE price_min > price_max UNION ALL SELECT row, 'tax_percent', 'relationship', 'warn', 'percentage out of range', 0.85 FROM {_RANGES} WHERE tax_percent NOT BETWEEN 0 AND 100")
def minmax_and_percent_issues(spark, sf_dir):
    df = _ranges(spark, sf_dir)
    return _plain(I.find(df, relations.rules(df)[0]))


@query(f"SELECT row, least(price_min, price_max) AS price_min, greatest(price_min, price_max) AS price_max, least(greatest(tax_percent, 0), 100) AS tax_percent FROM {_RANGES}")
def swap_minmax_clip_percent(spark, sf_dir):
    out, _, _ = relations.apply(_ranges(spark, sf_dir))
    return out.withColumnRenamed(I.ROW_ID, "row")


@query("SELECT o_orderkey AS row, 'trip_end_date' AS column, 'relationship' AS stage, 'error' AS severity, 'trip_end_date is before trip_start_date' AS issue, CAST(0.9 AS DOUBLE) AS confidence FROM orders WHERE o_orderkey % 5 = 0")
def date_order_issues(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    end = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderdate") - F.expr("interval 3 days")).otherwise(F.col("o_orderdate"))
    df = o.select(F.col("o_orderkey").alias(I.ROW_ID), F.col("o_orderdate").alias("trip_start_date"), F.date_format(end, "yyyy-MM-dd HH:mm:ss").alias("trip_end_date"))
    return _plain(I.find(df, relations.rules(df)[0]))


_CONTACT = "(SELECT c_custkey AS row, CASE c_custkey % 4 WHEN 0 THEN 'user' || c_custkey || '@x.org' WHEN 1 THEN ' a b@x.org' WHEN 2 THEN 'c' || c_custkey || '@y' ELSE 'd@e.f' END AS email, CASE WHEN c_custkey % 6 = 0 THEN '12-34' ELSE '+91 98765 ' || CAST(10000 + c_custkey % 90000 AS VARCHAR) END AS phone FROM customer)"


def _contacts(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    email = F.when(k % 4 == 0, F.concat(F.lit("user"), k, F.lit("@x.org"))).when(k % 4 == 1, " a b@x.org").when(k % 4 == 2, F.concat(F.lit("c"), k, F.lit("@y"))).otherwise("d@e.f")
    phone = F.when(k % 6 == 0, "12-34").otherwise(F.concat(F.lit("+91 98765 "), (10000 + k % 90000).cast("string")))
    return _table(spark, sf_dir, "customer").select(k.alias(I.ROW_ID), email.alias("email"), phone.alias("phone"))


@query(f"SELECT row, 'email' AS column, 'relationship' AS stage, 'error' AS severity, 'invalid email format' AS issue, CAST(0.9 AS DOUBLE) AS confidence FROM {_CONTACT} WHERE NOT regexp_matches(trim(email), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') UNION ALL SELECT row, 'phone', 'relationship', 'warn', 'phone length suspicious', 0.75 FROM {_CONTACT} WHERE length(regexp_replace(phone, '\\D', '', 'g')) NOT BETWEEN 7 AND 15")
def email_and_phone_issues(spark, sf_dir):
    df = _contacts(spark, sf_dir)
    return _plain(I.find(df, relations.rules(df)[0]))


@query("SELECT CAST(NULL AS BIGINT) AS row, 'order_id' AS column, 'relationship' AS stage, 'error' AS severity, 'high null rate for primary key' AS issue, CAST(1 AS DOUBLE) AS confidence")
def pk_null_rate(spark, sf_dir):
    df = _orders(spark, sf_dir).select(I.ROW_ID, F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderkey")).alias("order_id"))
    return _plain(I.globals_(spark, relations.rules(df)[1]))


@query(f"""SELECT row, 'email' AS column, 'pattern' AS stage, 'error' AS severity, 'email pattern: invalid @ count' AS issue, CAST(0.9 AS DOUBLE) AS confidence FROM {_CONTACT} WHERE length(email) - length(replace(email, '@', '')) <> 1
UNION ALL SELECT row, 'email', 'pattern', 'warn', 'email pattern: domain missing dot', 0.9 FROM {_CONTACT} WHERE NOT contains(regexp_extract(email, '@(.+)$', 1), '.')
UNION ALL SELECT row, 'phone', 'pattern', 'error', 'phone pattern: too few digits', 0.85 FROM {_CONTACT} WHERE length(regexp_replace(phone, '\\D', '', 'g')) < 7
UNION ALL SELECT row, 'phone', 'pattern', 'warn', 'phone pattern: invalid format', 0.8 FROM {_CONTACT} WHERE NOT regexp_matches(phone, '^\\+?[\\d\\-\\s\\(\\)]{{7,20}}$')""")
def pattern_email_phone(spark, sf_dir):
    df = _contacts(spark, sf_dir)
    return _plain(I.find(df, patterns.rules(df)))


_PLACES = "(SELECT c_custkey AS row, CASE WHEN c_custkey % 200 = 0 THEN '12' ELSE CAST(10000 + c_custkey % 90000 AS VARCHAR) END AS zip, CASE WHEN c_custkey % 9 = 0 THEN 'bad' ELSE '123-45-' || CAST(1000 + c_custkey % 9000 AS VARCHAR) END AS ssn, CASE WHEN c_custkey % 2 = 0 THEN 'HTTPS://x.org/' || c_custkey ELSE 'x.org' END AS url, CASE WHEN c_custkey % 3 = 0 THEN 'a-b' ELSE 'ab_' || c_custkey END AS username, CASE WHEN c_custkey % 7 = 0 THEN 'R2 D2' ELSE 'Ann O''Neil' END AS full_name, CASE WHEN c_custkey = 7 THEN 'BUILDINGG' ELSE c_mktsegment END AS segment FROM customer)"


@query(f"""SELECT row, 'zip' AS column, 'pattern' AS stage, 'warn' AS severity, 'postal pattern: rare length' AS issue, CAST(0.75 AS DOUBLE) AS confidence FROM {_PLACES} WHERE length(zip) = 2
UNION ALL SELECT row, 'zip', 'pattern', 'warn', 'zip_us pattern: invalid format', 0.95 FROM {_PLACES} WHERE length(zip) = 2
UNION ALL SELECT row, 'ssn', 'pattern', 'error', 'ssn_us pattern: invalid format', 0.9 FROM {_PLACES} WHERE ssn = 'bad'
UNION ALL SELECT row, 'url', 'pattern', 'warn', 'url pattern: missing scheme', 0.75 FROM {_PLACES} WHERE url = 'x.org'
UNION ALL SELECT row, 'username', 'pattern', 'error', 'username pattern: invalid characters', 0.85 FROM {_PLACES} WHERE username = 'a-b'
UNION ALL SELECT row, 'full_name', 'pattern', 'warn', 'name pattern: contains unusual characters', 0.7 FROM {_PLACES} WHERE full_name = 'R2 D2'
UNION ALL SELECT row, 'segment', 'pattern', 'warn', 'category pattern: rare value (possible typo)', 0.7 FROM {_PLACES} WHERE segment = 'BUILDINGG'""")
def pattern_postal_ssn_url_names(spark, sf_dir):
    k = F.col("c_custkey")
    df = _table(spark, sf_dir, "customer").select(
        k.alias(I.ROW_ID),
        F.when(k % 200 == 0, "12").otherwise((10000 + k % 90000).cast("string")).alias("zip"),
        F.when(k % 9 == 0, "bad").otherwise(F.concat(F.lit("123-45-"), (1000 + k % 9000).cast("string"))).alias("ssn"),
        F.when(k % 2 == 0, F.concat(F.lit("HTTPS://x.org/"), k)).otherwise("x.org").alias("url"),
        F.when(k % 3 == 0, "a-b").otherwise(F.concat(F.lit("ab_"), k)).alias("username"),
        F.when(k % 7 == 0, "R2 D2").otherwise("Ann O'Neil").alias("full_name"),
        F.when(k == 7, "BUILDINGG").otherwise(F.col("c_mktsegment")).alias("segment"),
    )
    return _plain(I.find(df, patterns.rules(df)))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'https://' || regexp_replace(url, '^https?://', '') END AS url FROM pages")
def url_prepend_fix(spark, sf_dir):
    p = _table(spark, sf_dir, "pages")
    df = p.select(F.col("page_id").alias(I.ROW_ID), F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.regexp_replace("url", "^https?://", "")).alias("url"))
    out, _, _ = patterns.apply(df, fix=True)
    return out.withColumnRenamed(I.ROW_ID, "page_id")


@query("SELECT page_id, 'https://' || regexp_replace(url, '^https?://', '') AS link, 'ab' || page_id AS code FROM pages")
def text_fixes(spark, sf_dir):
    """Values that break a given pattern, repaired by its fix: another prefix, lower case."""
    p, k = _table(spark, sf_dir, "pages"), F.col("page_id")
    bare, code = F.regexp_replace("url", "^https?://", ""), F.concat(F.lit("ab"), k)
    df = p.select(k.alias(I.ROW_ID), F.concat(F.when(k % 5 == 0, "http://").otherwise("https://"), bare).alias("link"), F.when(k % 4 == 0, F.upper(code)).otherwise(code).alias("code"))
    custom = {"link": {"regex": "https://", "fix": {"action": "replace_prefix", "prefix": "http://", "value": "https://"}}, "code": {"regex": r"[a-z]+\d+", "fix": {"action": "lowercase"}}}
    return patterns.apply(df, custom, fix=True)[0].withColumnRenamed(I.ROW_ID, "page_id")


@query("SELECT row, 'code' AS column, 'pattern' AS stage, 'error' AS severity, 'part code pattern: invalid format' AS issue, CAST(0.8 AS DOUBLE) AS confidence FROM (SELECT p_partkey AS row FROM part) WHERE row % 5 = 0")
def pattern_custom(spark, sf_dir):
    k = F.col("p_partkey")
    df = _table(spark, sf_dir, "part").select(k.alias(I.ROW_ID), F.when(k % 5 == 0, "none of it").otherwise(F.concat(F.lit("P-"), k)).alias("code"))
    return _plain(I.find(df, patterns.rules(df, {"^co": {"regex": r"P-\d+", "pattern_name": "part code", "severity": "error"}})))


_SEM = "(SELECT l_orderkey * 10 + l_linenumber AS row, CASE WHEN l_linenumber = 7 THEN -l_quantity ELSE l_quantity + CASE WHEN l_linenumber = 6 THEN 0.5 ELSE 0 END END AS age FROM lineitem)"


@query(f"SELECT row, 'age' AS column, 'semantic' AS stage, 'warn' AS severity, 'below minimum' AS issue, CAST(0.855 AS DOUBLE) AS confidence FROM {_SEM} WHERE age < 0 UNION ALL SELECT row, 'age', 'semantic', 'warn', 'must be integer', 0.855 FROM {_SEM} WHERE age % 1 <> 0")
def semantic_issues(spark, sf_dir):
    li, n = _table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    age = F.when(n == 7, -F.col("l_quantity")).otherwise(F.col("l_quantity") + F.when(n == 6, 0.5).otherwise(0.0))
    df = li.select((F.col("l_orderkey") * 10 + n).alias(I.ROW_ID), age.alias("age"))
    return _plain(I.find(df, semantics.rules(df, semantics.decide(df))))


@query("SELECT row, CASE WHEN age < 0 THEN NULL WHEN age % 1 <> 0 THEN round_even(age, 0) ELSE age END AS age FROM (SELECT l_orderkey * 10 + l_linenumber AS row, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_orderkey % 200 = 3 THEN -l_quantity ELSE l_quantity + CASE WHEN l_linenumber = 6 THEN 0.5 ELSE 0 END END AS age FROM lineitem)")
def semantic_repairs(spark, sf_dir):
    """Ages below 0 become null (few enough for the guard of nulls), halves whole."""
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    age = F.when(n == 7, None).when(k % 200 == 3, -F.col("l_quantity")).otherwise(F.col("l_quantity") + F.when(n == 6, 0.5).otherwise(0.0))
    df = _table(spark, sf_dir, "lineitem").select((k * 10 + n).alias(I.ROW_ID), age.alias("age"))
    out, _, _ = semantics.apply(df)
    return out.withColumnRenamed(I.ROW_ID, "row")


@query(f"WITH o AS (SELECT * FROM {_ORDERS}), m AS (" + _per_column("SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, count(*) AS n FROM o") + ") SELECT column_name, missing, round(missing * CAST(100 AS DOUBLE) / n, 2) AS percent FROM m")
def missing_by_column(spark, sf_dir):
    found = scorecard.missing_by_column(_orders(spark, sf_dir))
    return spark.createDataFrame([(m["column"], m["missing"], m["percent"]) for m in found], "column_name string, missing long, percent double")


@query("SELECT 'c_mktsegment' AS column_name, 0 AS rank UNION ALL SELECT 'nation', 1")
def group_columns(spark, sf_dir):
    """Columns that may group rows for imputation: few distinct values, the fewest first."""
    c = _table(spark, sf_dir, "customer")
    df = c.select(F.col("c_custkey").alias(I.ROW_ID), "c_name", F.concat(F.lit("nation "), F.col("c_nationkey")).alias("nation"), "c_mktsegment", "c_acctbal")
    return spark.createDataFrame(list(enumerate(impute.group_columns(df))), "rank int, column_name string")


@query("SELECT 'l_quantity' AS column_name, quantile_cont(l_quantity, 0.01) AS low, quantile_cont(l_quantity, 0.99) AS high FROM lineitem UNION ALL SELECT 'l_extendedprice', quantile_cont(l_extendedprice, 0.01), quantile_cont(l_extendedprice, 0.99) FROM lineitem UNION ALL SELECT 'flag', min(flag), max(flag) FROM (SELECT CASE WHEN l_orderkey % 10000 = 77 THEN 1 ELSE 0 END + CAST(0 AS DOUBLE) AS flag FROM lineitem)")
def impute_bounds(spark, sf_dir):
    """Quantiles that filled values are clipped to; the extremes of a column that is nearly constant."""
    li = _table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", F.when(F.col("l_orderkey") % 10000 == 77, 1.0).otherwise(0.0).alias("flag"))
    return spark.createDataFrame([(c, *b) for c, b in impute.bounds(li, li.columns).items()], "column_name string, low double, high double")


@query()
def semantic_candidates(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    found = semantics.decide(e.withColumn(I.ROW_ID, F.col("event_id")))
    return spark.createDataFrame([(c, k["type"], k["confidence"], i) for c, d in found.items() for i, k in enumerate(d["candidates"])], "column_name string, type string, confidence double, rank int")


# ---- imputation and export


@query(f"""WITH o AS (SELECT * FROM {_ORDERS}), g AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n, median(o_totalprice) AS m FROM o GROUP BY ALL), q AS (SELECT quantile_cont(o_totalprice, 0.01) AS a, quantile_cont(o_totalprice, 0.99) AS b, median(o_totalprice) AS m FROM o)
SELECT o.o_orderkey, round(coalesce(o.o_totalprice, CASE WHEN g.n >= 10 THEN least(greatest(g.m, a), b) END), 4) AS price FROM o JOIN g ON o.o_orderstatus IS NOT DISTINCT FROM g.o_orderstatus AND o.o_orderpriority IS NOT DISTINCT FROM g.o_orderpriority, q""")
def group_median_impute(spark, sf_dir):
    o = _orders(spark, sf_dir).select(I.ROW_ID, "o_orderstatus", "o_orderpriority", "o_totalprice")
    keys, limits = ["o_orderstatus", "o_orderpriority"], impute.bounds(o, ["o_totalprice"])["o_totalprice"]
    groups = impute.group_medians(o, keys, ["o_totalprice"])
    joined = o.join(groups, F.col("o_orderstatus").eqNullSafe(F.col("__key0")) & F.col("o_orderpriority").eqNullSafe(F.col("__key1")))
    filled = F.coalesce("o_totalprice", F.when(F.col("__size") >= 10, impute.clip_to(F.col("__med_o_totalprice"), *limits)))
    return joined.select(F.col(I.ROW_ID).alias("o_orderkey"), F.round(filled, 4).alias("price"))


_CASCADE = "(SELECT c_custkey AS id, CASE WHEN c_custkey <= 8 THEN 'tiny' ELSE c_mktsegment END AS seg, CASE WHEN c_custkey % 7 <> 0 AND c_custkey <> 3 THEN c_acctbal END AS v, CASE WHEN c_custkey <> 7 THEN CAST(c_nationkey AS DOUBLE) END AS f FROM customer)"


@query(f"""WITH d AS (SELECT * FROM {_CASCADE}), q AS (SELECT quantile_cont(v, 0.01) AS a, quantile_cont(v, 0.99) AS b FROM d),
g AS (SELECT seg, count(*) AS n, median(v) AS m FROM d GROUP BY seg),
s AS (SELECT id, d.seg, f, v IS NULL AS gap, coalesce(v, CASE WHEN n >= 10 THEN least(greatest(m, a), b) END) AS v FROM d JOIN g ON d.seg = g.seg, q),
o AS (SELECT s.id, t.v, row_number() OVER (PARTITION BY s.id ORDER BY abs(s.f - t.f), t.id) AS r FROM s, s t WHERE s.v IS NULL AND s.f IS NOT NULL AND t.v IS NOT NULL AND t.f IS NOT NULL),
k AS (SELECT id, median(v) AS m FROM o WHERE r <= 5 GROUP BY id),
w AS (SELECT s.id, s.gap, s.v IS NOT NULL AS grouped, k.m IS NOT NULL AS near, coalesce(s.v, CASE WHEN k.m IS NOT NULL THEN least(greatest(k.m, a), b) END) AS v FROM s LEFT JOIN k ON s.id = k.id, q)
SELECT id AS c_custkey, round(coalesce(v, (SELECT least(greatest(median(v), max(a)), max(b)) FROM w, q)), 4) AS value, CASE WHEN gap THEN CASE WHEN grouped THEN 'group_median' WHEN near THEN 'knn_numeric' ELSE 'global_median' END END AS method FROM w""")
def impute_cascade(spark, sf_dir):
    """Every row's value and how it was found: most gaps by group, a small group's by neighbours, one without numbers by the median."""
    k = F.col("c_custkey")
    df = _table(spark, sf_dir, "customer").select(
        k.alias(I.ROW_ID),
        F.when(k <= 8, "tiny").otherwise(F.col("c_mktsegment")).alias("seg"),
        F.when((k % 7 != 0) & (k != 3), F.col("c_acctbal")).alias("v"),
        F.when(k != 7, F.col("c_nationkey").cast("double")).alias("f"),
    )
    out, found, _ = impute.apply(df)
    how = found.filter((F.col("column") == "v") & F.col("issue").startswith("filled")).select(F.col("row").alias("c_custkey"), F.col("details")["method"].alias("method"))
    return out.select(F.col(I.ROW_ID).alias("c_custkey"), F.round("v", 4).alias("value")).join(how, "c_custkey", "left")


@query("""WITH s AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS t, CAST(s_nationkey AS DOUBLE) AS f FROM supplier),
d AS (SELECT a.id, b.t, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.f - b.f), b.id) AS r FROM s a, s b WHERE a.t IS NULL AND b.t IS NOT NULL)
SELECT id AS s_suppkey, round(median(t), 4) AS value FROM d WHERE r <= 5 GROUP BY id""")
def knn_impute(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier")
    df = s.select(F.col("s_suppkey").alias(I.ROW_ID), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal")).alias("t"), "s_nationkey")
    near = impute.nearest(df, "t", ["s_nationkey"], 5)
    return near.select(F.col(I.ROW_ID).alias("s_suppkey"), F.round("__knn", 4).alias("value"))


_HOT = "(SELECT CASE WHEN l_orderkey % 10 < 7 THEN 'hot' WHEN l_orderkey % 10 < 9 THEN l_returnflag END AS grp, l_linenumber % 2 AS half, CASE WHEN l_orderkey % 3 <> 0 THEN l_extendedprice END AS price, l_quantity AS quantity FROM lineitem)"


@query(f"SELECT grp, half, count(*) AS size, round(median(price), 4) AS price, round(median(quantity), 4) AS quantity FROM {_HOT} GROUP BY grp, half")
def group_medians_of_a_hot_group(spark, sf_dir):
    """Exact medians of two columns where one key holds most rows, nulls being a key and values missing."""
    k = F.col("l_orderkey")
    df = _table(spark, sf_dir, "lineitem").select(F.when(k % 10 < 7, "hot").when(k % 10 < 9, F.col("l_returnflag")).alias("grp"), (F.col("l_linenumber") % 2).alias("half"), F.when(k % 3 != 0, F.col("l_extendedprice")).alias("price"), F.col("l_quantity").alias("quantity"))
    found = impute.group_medians(df, ["grp", "half"], ["price", "quantity"])
    return found.select(F.col("__key0").alias("grp"), F.col("__key1").alias("half"), F.col("__size").alias("size"), F.round("__med_price", 4).alias("price"), F.round("__med_quantity", 4).alias("quantity"))


_HOLES = "(SELECT c_custkey AS id, CASE WHEN c_custkey % 9 <> 4 THEN CAST(c_custkey * 7919 % 1009 AS DOUBLE) END AS t, CASE WHEN c_custkey * 31 % 10 > 2 THEN c_acctbal END AS a, CASE WHEN c_custkey * 57 % 100 > 29 THEN CAST(c_custkey * 104729 % 5003 AS DOUBLE) END AS b, CASE WHEN c_custkey * 83 % 1000 > 299 THEN CAST(c_nationkey * 100 AS DOUBLE) END AS c FROM customer)"


@query(f"""WITH d AS (SELECT * FROM {_HOLES}),
p AS (SELECT x.id, y.id AS other, y.t, (CASE WHEN x.a IS NOT NULL AND y.a IS NOT NULL THEN abs(x.a - y.a) ELSE 0 END + CASE WHEN x.b IS NOT NULL AND y.b IS NOT NULL THEN abs(x.b - y.b) ELSE 0 END + CASE WHEN x.c IS NOT NULL AND y.c IS NOT NULL THEN abs(x.c - y.c) ELSE 0 END)
/ nullif(CAST(x.a IS NOT NULL AND y.a IS NOT NULL AS INT) + CAST(x.b IS NOT NULL AND y.b IS NOT NULL AS INT) + CAST(x.c IS NOT NULL AND y.c IS NOT NULL AS INT), 0) AS far FROM d x, d y WHERE x.t IS NULL AND y.t IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY far, other) AS n FROM p WHERE far IS NOT NULL)
SELECT d.id AS c_custkey, median(r.t) AS value FROM d LEFT JOIN r ON d.id = r.id AND r.n <= 5 WHERE d.t IS NULL GROUP BY d.id""")
def knn_missing_features(spark, sf_dir):
    """Neighbours by three features, three in ten of each missing: exact, by blocks whose boxes leave them possible."""
    k, c = F.col("c_custkey").cast("long"), _table(spark, sf_dir, "customer")
    df = c.select(
        k.alias(I.ROW_ID),
        F.when(k % 9 != 4, (k * 7919 % 1009).cast("double")).alias("t"),
        F.when(k * 31 % 10 > 2, F.col("c_acctbal")).alias("a"),
        F.when(k * 57 % 100 > 29, (k * 104729 % 5003).cast("double")).alias("b"),
        F.when(k * 83 % 1000 > 299, (F.col("c_nationkey") * 100).cast("double")).alias("c"),
    )
    return impute.nearest(df, "t", ["a", "b", "c"], 5).select(F.col(I.ROW_ID).alias("c_custkey"), F.col("__knn").alias("value"))


@query(f"SELECT column_name, value, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY o_orderkey) AS place FROM ("
    + _per_column(f"SELECT o_orderkey, '{{c}}' AS column_name, CAST({{c}} AS VARCHAR) AS value FROM {_ORDERS}", ["o_custkey", "o_orderstatus", "o_orderpriority"])
    + ") WHERE value IS NOT NULL) WHERE place <= 3000")
def first_known_values(spark, sf_dir):
    """The sample of 3,000 known values of each column that types are judged by."""
    found = P.first_known(_orders(spark, sf_dir), ["o_custkey", "o_orderstatus", "o_orderpriority"], 3000)
    return found.withColumnRenamed("column", "column_name")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, strftime(ts, '%Y-%m-%d 00:00:00') AS day, event_type FROM events")
def export_datetime(spark, sf_dir):
    e = _table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    out, _ = export.apply(e.select(F.col("event_id").alias(I.ROW_ID), "ts", "day", "event_type"))
    return out.withColumnRenamed(I.ROW_ID, "event_id")


# ---- scorecard


def _issues(spark, sf_dir) -> DataFrame:
    """Issues by rule from lineitem: three stages, three severities, confidences from 0.05 to 1.2; every 50th global."""
    li = _table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    n = F.col("l_linenumber")
    return li.select(
        F.when(k % 50 != 0, F.col("l_orderkey")).alias("row"),
        F.concat(F.lit("c"), (n % 3).cast("string")).alias("column"),
        F.when(n % 3 == 0, "semantic").when(n % 3 == 1, "pattern").otherwise("relationship").alias("stage"),
        F.when(n % 4 == 0, "error").when(n % 4 == 1, "info").when(n % 4 == 2, "warning").otherwise("odd").alias("severity"),
        F.when(n % 5 == 0, "duplicate value").otherwise(F.concat(F.lit("rule "), (n % 2).cast("string"))).alias("issue"),
        (F.col("l_discount") * 11.5 + 0.05).alias("confidence"),
        F.lit("").alias("explanation"),
        F.create_map().cast("map<string,string>").alias("details"),
    )


_ISSUES = """(SELECT CASE WHEN (l_orderkey * 10 + l_linenumber) % 50 <> 0 THEN l_orderkey END AS row, 'c' || CAST(l_linenumber % 3 AS VARCHAR) AS column, CASE l_linenumber % 3 WHEN 0 THEN 'semantic' WHEN 1 THEN 'pattern' ELSE 'relationship' END AS stage,
CASE l_linenumber % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'info' ELSE 'warn' END AS severity, CASE l_linenumber % 4 WHEN 0 THEN 2.5 WHEN 1 THEN 0.25 ELSE 1.0 END + CAST(0 AS DOUBLE) AS weight,
CASE WHEN l_linenumber % 5 = 0 THEN 'duplicate value' ELSE 'rule ' || CAST(l_linenumber % 2 AS VARCHAR) END AS issue, greatest(0.1, least(1.0, l_discount * 11.5 + 0.05)) + CAST(0 AS DOUBLE) AS conf, l_discount * 11.5 + 0.05 + CAST(0 AS DOUBLE) AS raw FROM lineitem)"""


@query(f"SELECT \"column\", issue, count(*) AS count FROM {_ISSUES} WHERE row IS NOT NULL GROUP BY ALL")
def issue_counts(spark, sf_dir):
    return I.counts(_issues(spark, sf_dir), "column", "issue")


@query(f"SELECT stage, count(*) AS issues, round(sum(weight * conf), 4) AS penalty FROM {_ISSUES} WHERE row IS NOT NULL GROUP BY stage")
def penalty_by_stage(spark, sf_dir):
    return scorecard.penalties(_issues(spark, sf_dir)).withColumn("penalty", F.round("penalty", 4))


@query(f"SELECT row, count(*) AS issue_count, round(count(*) + sum(weight * (0.75 + 0.25 * conf)), 3) AS severity_score FROM {_ISSUES} WHERE row IS NOT NULL GROUP BY row ORDER BY severity_score DESC, row LIMIT 5")
def worst_rows(spark, sf_dir):
    return scorecard.worst_rows(_issues(spark, sf_dir))


@query(f"SELECT row, \"column\", stage, issue, substr(sha1(coalesce(CAST(row AS VARCHAR), 'None') || '|' || \"column\" || '|' || stage || '|' || issue), 1, 12) AS issue_id FROM {_ISSUES}")
def issue_ids(spark, sf_dir):
    return I.with_ids(_issues(spark, sf_dir)).select("row", "column", "stage", "issue", "issue_id")


@query(f"SELECT \"column\", issue, row, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY \"column\", issue ORDER BY row NULLS FIRST) AS k FROM {_ISSUES}) WHERE k <= 1500 GROUP BY ALL")
def first_issues_of_each_rule(spark, sf_dir):
    """What a report shows of each kind of issue: the first 1,500, by row."""
    return I.first_per_rule(_issues(spark, sf_dir), 1500).groupBy("column", "issue", "row").agg(F.count("*").alias("n"))


@query(f"SELECT row, \"column\", stage, issue, round(max(raw), 6) AS confidence FROM {_ISSUES} GROUP BY ALL")
def issue_distinct(spark, sf_dir):
    """Of issues alike in row, column, stage and kind, the most confident."""
    return I.distinct(_issues(spark, sf_dir)).select("row", "column", "stage", "issue", F.round("confidence", 6).alias("confidence"))


@query(f"SELECT \"column\", issue, count(*) AS count, count(*) FILTER (WHERE severity = 'error') AS error, count(*) FILTER (WHERE severity = 'warn') AS warn, count(*) FILTER (WHERE severity = 'info') AS info, array_to_string(list_sort(list(row))[1:3], ',') AS example_rows FROM {_ISSUES} WHERE row IS NOT NULL GROUP BY \"column\", issue")
def drilldown(spark, sf_dir):
    found = scorecard.drilldown(_issues(spark, sf_dir), ["c0", "c1", "c2"])
    return found.select("column", "issue", "count", "error", "warn", "info", F.concat_ws(",", F.transform("examples", lambda e: e["row"].cast("string"))).alias("example_rows"))


@query(f"SELECT \"column\", issue, stage, severity, row IS NOT NULL AS row_level, count(*) AS count, round(sum(weight * conf), 4) AS penalty FROM {_ISSUES} GROUP BY ALL")
def issue_summary(spark, sf_dir):
    """What all counts and scores of a scorecard are sums of, from one pass over the issues."""
    return scorecard.summary(_issues(spark, sf_dir)).withColumn("penalty", F.round("penalty", 4))


@query(f"""WITH i AS (SELECT * FROM {_ISSUES} WHERE row IS NOT NULL)
SELECT * FROM (SELECT 'column' AS kind, "column" AS name, count(*) AS count FROM i GROUP BY "column" UNION ALL SELECT 'issue', issue, count(*) FROM i GROUP BY issue
UNION ALL SELECT 'warnings', '', count(*) FROM {_ISSUES} WHERE row IS NULL UNION ALL SELECT 'rows', '', count(*) FROM i)""")
def scorecard_counts(spark, sf_dir):
    """The worst columns, the kinds of issues and the warnings of a scorecard."""
    card = scorecard.score(_orders(spark, sf_dir), _issues(spark, sf_dir))
    rows = [(kind, x["name"], x["count"]) for kind, part in (("column", "worst_columns"), ("issue", "issue_types")) for x in card["analytics"][part]]
    return spark.createDataFrame([*rows, ("warnings", "", card["warnings"]["count"]), ("rows", "", card["row_issues"])], "kind string, name string, count long")


@query(f"""WITH i AS (SELECT * FROM {_ISSUES} WHERE row IS NOT NULL), o AS (SELECT * FROM {_ORDERS}), n AS (SELECT count(*) AS n, count(*) * 6 AS cells, count(o_orderkey) + count(o_custkey) + count(o_orderstatus) + count(o_orderdate) + count(o_totalprice) + count(o_orderpriority) AS known FROM o),
p AS (SELECT known / CAST(cells AS DOUBLE) AS completeness, 1 - least(1, (SELECT coalesce(sum(weight * conf), 0) FROM i WHERE stage = 'semantic') / cells) AS validity, 1 - least(1, (SELECT coalesce(sum(weight * conf), 0) FROM i WHERE stage = 'relationship') / n) AS consistency,
1 - least(1, (SELECT count(*) FROM i WHERE contains(issue, 'duplicate')) / CAST(n AS DOUBLE)) AS uniqueness, 1 - least(1, (SELECT coalesce(sum(weight * conf), 0) FROM i WHERE stage = 'pattern') / cells) AS pattern FROM n),
s AS (SELECT round(100 * (0.25 * completeness + 0.30 * validity + 0.20 * consistency + 0.15 * uniqueness + 0.10 * pattern), 2) AS score FROM p)
SELECT score, CASE WHEN score >= 95 THEN 'A' WHEN score >= 85 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 55 THEN 'D' ELSE 'F' END AS grade FROM s""")
def scorecard_overall(spark, sf_dir):
    card = scorecard.score(_orders(spark, sf_dir), _issues(spark, sf_dir))
    return spark.createDataFrame([(card["overall_score"], card["grade"])], "score double, grade string")


@query("SELECT c_custkey, CASE WHEN s >= 95 THEN 'A' WHEN s >= 85 THEN 'B' WHEN s >= 70 THEN 'C' WHEN s >= 55 THEN 'D' ELSE 'F' END AS grade FROM (SELECT c_custkey, c_custkey % 101 AS s FROM customer)")
def health_grade(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", S.grade_column(F.col("c_custkey") % 101).alias("grade"))


# ---- the whole


def _dirty_orders(spark, sf_dir) -> DataFrame:
    """orders as a dirty text table."""
    k = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select(
        F.concat(F.lit("INV-"), k).alias("Invoice No"),
        F.when(k % 7 != 0, F.concat(F.lit("₹"), F.format_number(F.round("o_totalprice").cast("bigint"), 0))).alias("Amount Paid"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created on"),
        F.when(k % 13 == 0, "n/a").otherwise(F.col("o_orderstatus")).alias("State"),
        F.when(k % 9 != 0, F.col("o_totalprice")).alias("weight"),
    )


_CLEANED = """WITH d AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 <> 0 THEN round(o_totalprice) END AS amount, strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS day, CASE WHEN o_orderkey % 13 = 0 THEN 'n/a' ELSE lower(o_orderstatus) END AS state, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS weight FROM orders),
q AS (SELECT quantile_cont(amount, 0.01) AS a1, quantile_cont(amount, 0.99) AS a2, quantile_cont(weight, 0.01) AS w1, quantile_cont(weight, 0.99) AS w2 FROM d),
g AS (SELECT state, median(amount) AS a, median(weight) AS w FROM d GROUP BY state)
"""


@query(
    _CLEANED
    + "SELECT 'INV-' || k AS invoice_no, CASE WHEN amount IS NULL THEN NULL WHEN amount < 1000 THEN '₹' || CAST(CAST(amount AS BIGINT) AS VARCHAR) ELSE '₹' || CAST(CAST(amount AS BIGINT) // 1000 AS VARCHAR) || ',' || lpad(CAST(CAST(amount AS BIGINT) % 1000 AS VARCHAR), 3, '0') END AS amount_paid, day AS created_on, state, round(coalesce(weight, least(greatest(g.w, w1), w2)), 4) AS weight FROM d JOIN g USING (state), q"
)
def clean_orders(spark, sf_dir):
    """The pipeline over orders as a dirty text table; amounts stay texts, as the gate of roles is not sure of them."""
    from .plans.pipeline import CleaningPipeline, without_row_id

    return without_row_id(CleaningPipeline().fit_transform(_dirty_orders(spark, sf_dir)).df).withColumn("weight", F.round("weight", 4))


@query(_CLEANED + "SELECT 'INV-' || k AS invoice_no, round(coalesce(amount, least(greatest(g.a, a1), a2)), 4) AS amount_paid, day AS created_on, state, round(coalesce(weight, least(greatest(g.w, w1), w2)), 4) AS weight FROM d JOIN g USING (state), q")
def clean_orders_parsed(spark, sf_dir):
    """The same with the gate open and meanings for hints: amounts become numbers, and their gaps are filled."""
    from .plans.pipeline import CleaningPipeline, Options, without_row_id

    options = Options(semantic_hints=True, quality=quality.Config(gating=False))
    cleaned = without_row_id(CleaningPipeline(options).fit_transform(_dirty_orders(spark, sf_dir)).df)
    return cleaned.withColumns({c: F.round(c, 4) for c in ("amount_paid", "weight")})
