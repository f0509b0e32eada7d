"""Registered queries: each runs a library operator over a driver table.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name]`` (DuckDB
SQL over the same tables) are exposed through ``__spark_entry__.py``.
Derived inputs (nulls, duplicates, constants) are made inside both the
Spark query and its SQL, identically, because the driver tables have none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.operators.identifiers import identifiers
from tablelens.operators.profile import profile, statistics
from tablelens.operators.quality import duplicate_rows, quality_columns, quality_summary
from tablelens.plans import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


# ---------------------------------------------------------------------------
# derived inputs (same definition on both sides)
# ---------------------------------------------------------------------------

# lineitem with missing values: every third line number, NaN discounts on
# some rows, returnflag missing on 'N', a whole null column.
MISSING_LINEITEM_SQL = """
SELECT l_orderkey, l_partkey,
       nullif(l_linenumber, 3) AS l_linenumber,
       CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
       CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_discount END AS l_discount,
       nullif(l_returnflag, 'N') AS l_returnflag,
       CAST(NULL AS DOUBLE) AS l_empty
FROM lineitem
"""
MISSING_LINEITEM_COLS = [
    ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_linenumber", "int"),
    ("l_quantity", "double"), ("l_discount", "double"), ("l_returnflag", "string"), ("l_empty", "double"),
]


def missing_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_partkey",
        F.nullif(F.col("l_linenumber"), F.lit(3)).alias("l_linenumber"),
        F.when(F.col("l_orderkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("l_quantity"),
        F.when(F.col("l_partkey") % 5 == 0, F.lit(None)).otherwise(F.col("l_discount")).alias("l_discount"),
        F.nullif(F.col("l_returnflag"), F.lit("N")).alias("l_returnflag"),
        F.lit(None).cast("double").alias("l_empty"),
    )


# events with a constant column, an all-null column, a value+null column and
# a 95 %-constant measure (zero IQR → z-score fallback).
EVENTS_DERIVED_SQL = """
SELECT event_id, user_id, event_type, value,
       'web' AS channel,
       CAST(NULL AS VARCHAR) AS note,
       CASE WHEN event_id % 2 = 0 THEN 'x' END AS half_flag,
       CASE WHEN event_id % 20 = 0 THEN value * 10 ELSE 5.0 END AS spiky
FROM events
"""
EVENTS_DERIVED_COLS = [
    ("event_id", "bigint"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double"),
    ("channel", "string"), ("note", "string"), ("half_flag", "string"), ("spiky", "double"),
]


def events_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id", "user_id", "event_type", "value",
        F.lit("web").alias("channel"),
        F.lit(None).cast("string").alias("note"),
        F.when(F.col("event_id") % 2 == 0, F.lit("x")).alias("half_flag"),
        F.when(F.col("event_id") % 20 == 0, F.col("value") * 10).otherwise(F.lit(5.0)).alias("spiky"),
    )


# ---------------------------------------------------------------------------
# profile / statistics
# ---------------------------------------------------------------------------

PROFILE_NUMBERS = ["min", "max", "mean", "median"]
STATS_NUMBERS = PROFILE_NUMBERS + ["sum", "std", "variance", "q25", "q75", "skewness"]


def comparable(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns in ten significant digits, for the comparison alone: sums of
    doubles differ between engines in their last bits."""
    def rounded(c):
        unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c))) - 9)
        return F.when(F.abs(c) < 1e6, c).otherwise(F.round(c / unit, 0) * unit)

    return df.withColumns({c: rounded(F.col(c)) for c in names})


def _profile_sql(src: str, cols) -> str:
    return f"""
SELECT column_name, CAST(ord AS BIGINT) AS ordinal, data_type,
       CAST(missing_count AS BIGINT) AS missing_count,
       CASE WHEN total_rows > 0 THEN round(missing_count / total_rows * 100.0, 2) ELSE 0.0 END AS missing_pct,
       CAST(unique_count AS BIGINT) AS unique_count,
       CASE WHEN kind = 'numeric' AND num_count > 0 THEN {O.r4('num_min')} END AS min,
       CASE WHEN kind = 'numeric' AND num_count > 0 THEN {O.r4('num_max')} END AS max,
       CASE WHEN kind = 'numeric' AND num_count > 0 THEN {O.r4('num_mean')} END AS mean,
       CASE WHEN kind = 'numeric' AND num_count > 0 THEN {O.r4('median')} END AS median
FROM ({O.colstats_sql(src, cols)}) cs
"""


def _stats_sql(src: str, cols) -> str:
    ids = O.identifier_sql(O.colstats_sql(src, cols))
    return f"""
SELECT column_name, CAST(ord AS BIGINT) AS ordinal, data_type,
  CASE WHEN is_identifier THEN 'identifier' WHEN kind = 'boolean' THEN 'boolean'
       WHEN kind = 'numeric' THEN 'numeric' ELSE 'categorical' END AS semantic_type,
  CAST(missing_count AS BIGINT) AS missing_count,
  CASE WHEN total_rows > 0 THEN round(missing_count / total_rows * 100.0, 2) ELSE 0.0 END AS missing_pct,
  CAST(unique_count AS BIGINT) AS unique_count,
  CAST(CASE WHEN isnum THEN num_count WHEN iscat THEN present END AS BIGINT) AS count,
  CASE WHEN isnum THEN {O.r4('num_min')} END AS min,
  CASE WHEN isnum THEN {O.r4('num_max')} END AS max,
  CASE WHEN isnum THEN {O.r4('num_mean')} END AS mean,
  CASE WHEN isnum THEN {O.r4('median')} END AS median,
  CASE WHEN isnum THEN {O.r4('num_sum')} END AS sum,
  CASE WHEN isnum THEN {O.r4('CASE WHEN num_count > 1 THEN num_std ELSE 0.0 END')} END AS std,
  CASE WHEN isnum THEN {O.r4('CASE WHEN num_count > 1 THEN num_var ELSE 0.0 END')} END AS variance,
  CASE WHEN isnum THEN {O.r4('CASE WHEN num_count > 1 THEN q25 ELSE num_min END')} END AS q25,
  CASE WHEN isnum THEN {O.r4('CASE WHEN num_count > 1 THEN q75 ELSE num_max END')} END AS q75,
  CASE WHEN isnum THEN {O.r4('CASE WHEN num_count > 2 THEN coalesce(num_skew, 0.0) ELSE 0.0 END')} END AS skewness,
  CASE WHEN iscat THEN top_value END AS top_value,
  CAST(CASE WHEN iscat THEN top_freq END AS BIGINT) AS top_frequency,
  CASE WHEN iscat THEN CASE WHEN present > 0 THEN round(top_freq / present * 100.0, 2) ELSE 0.0 END END AS top_pct, exact_min, exact_max, exact_sum
FROM (SELECT *, (kind = 'numeric' AND num_count > 0) AS isnum,
             (kind NOT IN ('numeric', 'complex') AND present > 0) AS iscat FROM ({ids}) x) y
"""


def _ids_sql(src: str, cols) -> str:
    ids = O.identifier_sql(O.colstats_sql(src, cols))
    return f"""
SELECT column_name, CAST(ord AS BIGINT) AS ordinal, is_identifier, id_rule AS rule,
  CASE id_rule WHEN 'A' THEN 0.99 WHEN 'B' THEN 0.95 WHEN 'C' THEN 0.99 WHEN 'D' THEN 0.95
               WHEN 'E' THEN 0.90 WHEN 'F' THEN 0.85 WHEN 'G' THEN 0.95 ELSE 0.0 END::DOUBLE AS confidence,
  CASE WHEN usable THEN ratio ELSE 0.0 END AS uniqueness_ratio,
  (usable AND seq) AS is_sequential
FROM ({ids}) x
"""


@register("profile_lineitem", O.comparable_sql(_profile_sql("lineitem", O.TABLES["lineitem"]), PROFILE_NUMBERS))
def q_profile_lineitem(spark, sf_dir):
    return comparable(profile(table(spark, sf_dir, "lineitem")), PROFILE_NUMBERS)


@register("profile_missing_lineitem", O.comparable_sql(_profile_sql(f"({MISSING_LINEITEM_SQL})", MISSING_LINEITEM_COLS), PROFILE_NUMBERS))
def q_profile_missing(spark, sf_dir):
    return comparable(profile(missing_lineitem(spark, sf_dir)), PROFILE_NUMBERS)


@register("stats_orders", O.comparable_sql(_stats_sql("orders", O.TABLES["orders"]), STATS_NUMBERS))
def q_stats_orders(spark, sf_dir):
    return comparable(statistics(table(spark, sf_dir, "orders")), STATS_NUMBERS)


@register("stats_lineitem", O.comparable_sql(_stats_sql("lineitem", O.TABLES["lineitem"]), STATS_NUMBERS))
def q_stats_lineitem(spark, sf_dir):
    return comparable(statistics(table(spark, sf_dir, "lineitem")), STATS_NUMBERS)


@register("categorical_stats_customer", O.comparable_sql(_stats_sql("customer", O.TABLES["customer"]), STATS_NUMBERS))
def q_stats_customer(spark, sf_dir):
    return comparable(statistics(table(spark, sf_dir, "customer")), STATS_NUMBERS)


# integers beyond 2**53 and decimals that a double cannot tell apart
EXACT_SQL = """SELECT o_orderkey + 9007199254740992 AS big,
       CAST(CAST('12345678901234567890.00' AS DECIMAL(30,2)) + CAST(o_orderkey AS DECIMAL(18,2)) AS DECIMAL(30,2)) AS amount FROM orders"""


@register("stats_decimal_bigint", f"""
WITH x AS (SELECT big, amount FROM ({EXACT_SQL}) y)
SELECT 'big' AS column_name, 'bigint' AS data_type, count(DISTINCT big) AS unique_count, CAST(min(big) AS VARCHAR) AS exact_min,
       CAST(max(big) AS VARCHAR) AS exact_max, CAST(sum(big) AS VARCHAR) AS exact_sum FROM x
UNION ALL SELECT 'amount', 'decimal(30,2)', count(DISTINCT amount), CAST(min(amount) AS VARCHAR), CAST(max(amount) AS VARCHAR),
       CAST(sum(amount) AS VARCHAR) FROM x
""")
def q_stats_exact(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") + 9007199254740992).alias("big"),
        (F.lit("12345678901234567890.00").cast("decimal(30,2)") + F.col("o_orderkey").cast("decimal(18,2)")).cast("decimal(30,2)").alias("amount"),
    )
    return statistics(df).select("column_name", "data_type", "unique_count", "exact_min", "exact_max", "exact_sum")


@register("stats_missing_lineitem", O.comparable_sql(_stats_sql(f"({MISSING_LINEITEM_SQL})", MISSING_LINEITEM_COLS), STATS_NUMBERS))
def q_stats_missing(spark, sf_dir):
    return comparable(statistics(missing_lineitem(spark, sf_dir)), STATS_NUMBERS)


# ---------------------------------------------------------------------------
# identifiers
# ---------------------------------------------------------------------------

def _ids_query(name):
    def fn(spark, sf_dir):
        return identifiers(table(spark, sf_dir, name)).drop("reason")
    return fn


for _t in ("orders", "customer", "documents", "events", "part", "conversations"):
    register(f"identifiers_{_t}", _ids_sql(_t, O.TABLES[_t]))(_ids_query(_t))


# ---------------------------------------------------------------------------
# quality
# ---------------------------------------------------------------------------

from tablelens.operators.correlation import correlation_matrix, correlations, top_correlations  # noqa: E402
from tablelens.operators.distributions import distributions  # noqa: E402
from tablelens.operators.insights import insights, report  # noqa: E402
from tablelens.plans import oracle_eda as OE  # noqa: E402

PART_QUANTITY_SQL = "(SELECT l_partkey, l_quantity FROM lineitem)"
ORDERS_1995_SQL = "(SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01')"


# One calendar year of orders: a date range under 730 days switches the time
# distribution to monthly periods (the feature being checked), where the full
# table spans six years and yields yearly ones.  Not a row cap.
def orders_1995(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))


_DERIVED = {
    "missing_lineitem": (missing_lineitem, f"({MISSING_LINEITEM_SQL})", MISSING_LINEITEM_COLS),
    "events_derived": (events_derived, f"({EVENTS_DERIVED_SQL})", EVENTS_DERIVED_COLS),
}


def _source(key: str):
    """(spark builder, SQL source, columns) for a table name or a derived input."""
    if key in _DERIVED:
        return _DERIVED[key]
    return (lambda spark, sf_dir: table(spark, sf_dir, key)), key, O.TABLES[key]


for _key in ("missing_lineitem", "events_derived", "orders", "documents"):
    _build, _src, _cols = _source(_key)
    register(f"quality_columns_{_key}", OE.quality_columns_sql(_src, _cols))(
        (lambda b: lambda spark, sf_dir: quality_columns(b(spark, sf_dir)))(_build))

for _key in ("missing_lineitem", "events_derived", "lineitem"):
    _build, _src, _cols = _source(_key)
    register(f"quality_summary_{_key}", OE.quality_summary_sql(_src, _cols))(
        (lambda b: lambda spark, sf_dir: quality_summary(b(spark, sf_dir)))(_build))


@register("duplicates_part_quantity",
          OE.duplicates_sql(PART_QUANTITY_SQL, [("l_partkey", "bigint"), ("l_quantity", "double")]))
def q_duplicates(spark, sf_dir):
    return duplicate_rows(table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity"))


@register("duplicates_lineitem", OE.duplicates_sql("lineitem", O.TABLES["lineitem"]))
def q_duplicates_lineitem(spark, sf_dir):
    return duplicate_rows(table(spark, sf_dir, "lineitem"))


# ---------------------------------------------------------------------------
# distributions
# ---------------------------------------------------------------------------

for _key in ("lineitem", "orders", "events", "documents", "customer", "part", "events_derived"):
    _build, _src, _cols = _source(_key)
    register(f"distributions_{_key}", OE.distributions_sql(_src, _cols))(
        (lambda b: lambda spark, sf_dir: distributions(b(spark, sf_dir)))(_build))


_DATE_TEXTS = (  # column, Spark format, the formats that DuckDB may read it by
    ("us", "MM/dd/yyyy", ["%m/%d/%Y"]),
    ("eu", "d.M.yyyy", ["%m.%d.%Y", "%d.%m.%Y"]),
    ("named", "dd MMM yyyy", ["%d %b %Y"]),
    ("long", "EEEE, MMMM d, yyyy h:mm a", ["%A, %B %d, %Y %I:%M %p"]),
    ("iso", "yyyy-MM-dd'T'HH:mm:ss", ["%Y-%m-%dT%H:%M:%S"]),
)
_DUCK_DATES = ", ".join(f"strftime(o_orderdate, '{f[-1]}') AS {n}" for n, _, f in _DATE_TEXTS)
_MIXED_DUCK = "CASE o_orderkey % 10 WHEN 0 THEN 'unknown' WHEN 1 THEN us WHEN 2 THEN named WHEN 3 THEN eu ELSE iso END"
DATE_TEXTS_SQL = f"""
SELECT us, eu, named, long, iso, {_MIXED_DUCK} AS mixed, CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus ELSE named END AS seldom
FROM (SELECT o_orderkey, o_orderstatus, {_DUCK_DATES} FROM orders) d0"""


def _date_texts_oracle() -> str:
    read = lambda formats: "[" + ", ".join(f"'{f}'" for f in formats) + "]"
    given = {n: f for n, _, f in _DATE_TEXTS}
    given["mixed"] = given["us"] + given["eu"] + given["named"] + given["iso"]
    parts = [OE.time_sql(f"({DATE_TEXTS_SQL}) s", i, n, f"try_strptime({n}, {read(f)})") for i, (n, f) in enumerate(given.items())]
    parts.append(OE.frequency_sql(f"({DATE_TEXTS_SQL}) s", len(given), "seldom", "string"))
    return "\nUNION ALL\n".join(f"SELECT * FROM ({p}) p{k}" for k, p in enumerate(parts))


@register("distributions_date_texts", _date_texts_oracle())
def q_date_texts(spark, sf_dir):
    """Dates as text in five forms, a mixture of four with a tenth of other words, and one where a quarter is no date."""
    made = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", *[F.date_format("o_orderdate", f).alias(n) for n, f, _ in _DATE_TEXTS])
    key = F.col("o_orderkey")
    mixed = F.when(key % 10 == 0, "unknown").when(key % 10 == 1, F.col("us")).when(key % 10 == 2, F.col("named")).when(key % 10 == 3, F.col("eu"))
    return distributions(made.select(
        "us", "eu", "named", "long", "iso", mixed.otherwise(F.col("iso")).alias("mixed"),
        F.when(key % 4 == 0, F.col("o_orderstatus")).otherwise(F.col("named")).alias("seldom"),
    ))


@register("distributions_orders_1995", OE.distributions_sql(ORDERS_1995_SQL, O.TABLES["orders"]))
def q_dist_orders_1995(spark, sf_dir):
    return distributions(orders_1995(spark, sf_dir))


# ---------------------------------------------------------------------------
# correlations
# ---------------------------------------------------------------------------

for _key in ("lineitem", "missing_lineitem", "events_derived", "part", "customer"):
    _build, _src, _cols = _source(_key)
    register(f"correlations_{_key}", OE.correlations_sql(_src, _cols))(
        (lambda b: lambda spark, sf_dir: correlations(b(spark, sf_dir)))(_build))
    register(f"top_correlations_{_key}", OE.top_correlations_sql(_src, _cols))(
        (lambda b: lambda spark, sf_dir: top_correlations(b(spark, sf_dir)))(_build))


# ---------------------------------------------------------------------------
# insights and report (rows-only checks; texts are unit-tested)
# ---------------------------------------------------------------------------

for _key in ("events_derived", "missing_lineitem"):
    _build, _src, _cols = _source(_key)
    register(f"insights_{_key}")((lambda b: lambda spark, sf_dir: insights(b(spark, sf_dir)))(_build))
    register(f"report_{_key}")((lambda b: lambda spark, sf_dir: report(b(spark, sf_dir)))(_build))


from tablelens.plans import catalog_sql  # noqa: E402,F401  (registers the SQL-surface queries)
from tablelens.plans import catalog_ml  # noqa: E402,F401  (registers the model-path queries)


_build, _src, _cols = _source("lineitem")


@register("correlation_matrix_lineitem", f"""
WITH p AS ({OE.correlations_sql(_src, _cols)})
SELECT column1 AS row_column, column2 AS col_column, correlation AS value FROM p
UNION ALL SELECT column2, column1, correlation FROM p
UNION ALL SELECT c, c, 1.0::DOUBLE FROM (SELECT column1 AS c FROM p UNION SELECT column2 FROM p) each_column
""")
def q_correlation_matrix(spark, sf_dir):
    return correlation_matrix(table(spark, sf_dir, "lineitem"))


# ---------------------------------------------------------------------------
# insight rules with an oracle: which rules fire, in which order, with which
# severity, title and columns (message texts are unit-tested)
# ---------------------------------------------------------------------------

def insight_rules_sql(src: str, cols) -> str:
    s = OE.quality_summary_sql(src, cols)
    st = _stats_sql(src, cols)
    qc = OE.quality_columns_sql(src, cols)
    tp = OE.top_correlations_sql(src, cols)
    none = "CAST([] AS VARCHAR[])"
    return f"""
WITH s AS ({s}), st AS ({st}), qc AS ({qc}), tp AS ({tp})
SELECT 100 AS position, 'overview' AS type, 'info' AS severity, 'Table at a glance' AS title, {none} AS columns FROM s
UNION ALL
SELECT 200, CASE WHEN missing_pct = 0 THEN 'data_integrity' ELSE 'missing_values' END,
       CASE WHEN missing_pct > 20 THEN 'high' WHEN missing_pct > 5 THEN 'medium' ELSE 'info' END,
       CASE WHEN missing_pct > 20 THEN 'Many cells are missing' WHEN missing_pct > 5 THEN 'Some cells are missing'
            ELSE 'No cell is missing' END, {none}
FROM s WHERE missing_pct > 5 OR missing_pct = 0
UNION ALL
SELECT 300, 'duplicates', CASE WHEN duplicate_pct > 10 THEN 'high' ELSE 'medium' END, 'Repeated rows',
       {none} FROM s WHERE duplicate_rows > 0
UNION ALL
SELECT CAST(400 + ordinal AS INTEGER), 'outliers', CASE WHEN outlier_pct > 10 THEN 'high' ELSE 'medium' END,
       'Far values in ' || column_name, [column_name]
FROM (SELECT * FROM qc WHERE outlier_count > 0 ORDER BY ordinal LIMIT 3) o
UNION ALL
SELECT CAST(500 + rank AS INTEGER), 'correlation', 'info', column1 || ' with ' || column2 || ': ' || strength,
       [column1, column2] FROM tp WHERE abs(correlation) >= 0.40
UNION ALL
SELECT CAST(1000 + ordinal AS INTEGER), 'categorical_dominance', 'info', 'One value leads in ' || column_name,
       [column_name] FROM st
WHERE top_value IS NOT NULL AND top_pct >= 60.0 AND top_value NOT IN ('None', 'Missing', 'null')
UNION ALL
SELECT CAST(2000 + 2 * ordinal AS INTEGER), 'distribution', 'low',
       'Long ' || CASE WHEN skewness > 0 THEN 'right' ELSE 'left' END || ' tail in ' || column_name,
       [column_name] FROM st WHERE mean IS NOT NULL AND abs(skewness) > 1.5
UNION ALL
SELECT CAST(2001 + 2 * ordinal AS INTEGER), 'high_variance', 'low',
       'Wide spread in ' || column_name, [column_name] FROM st
WHERE mean IS NOT NULL AND mean <> 0 AND std <> 0 AND std / abs(mean) > 1.5 AND min IS NOT NULL AND max IS NOT NULL
UNION ALL
SELECT 9000, 'empty_columns', 'high', 'Columns without values', empty_columns FROM s WHERE len(empty_columns) > 0
UNION ALL
SELECT 9100, 'constant_columns', 'medium', 'Columns of one value', constant_columns FROM s
WHERE len(constant_columns) > 0
UNION ALL
SELECT 9200, 'identifier', 'info', 'Columns that identify rows', id_columns FROM s WHERE len(id_columns) > 0
"""


for _key in ("events_derived", "missing_lineitem", "lineitem", "orders", "customer", "part"):
    _build, _src, _cols = _source(_key)
    register(f"insight_rules_{_key}", insight_rules_sql(_src, _cols))(
        (lambda b: lambda spark, sf_dir: insights(b(spark, sf_dir)).drop("message"))(_build))


# ---------------------------------------------------------------------------
# table-level summaries
# ---------------------------------------------------------------------------

from tablelens.operators.correlation import correlation_summary  # noqa: E402
from tablelens.operators.profile import profile_summary  # noqa: E402


def profile_summary_sql(src: str, cols) -> str:
    widths = {"numeric": 8, "boolean": 1, "datetime": 8}
    fixed = sum(widths.get(O.kind_of(d), 0) for _, d in cols)
    text = " + ".join(f"coalesce(sum(strlen({O.q(n)})), 0)" for n, d in cols if O.kind_of(d) == "string") or "0"
    missing = ", ".join(
        f"CASE WHEN count(*) - count({O.q(n)}) > 0 THEN {O.lit(n)} END" for n, _ in cols)
    return (
        f"SELECT CAST(count(*) AS BIGINT) AS row_count, CAST({len(cols)} AS BIGINT) AS column_count, "
        f"list_filter([{missing}], lambda x: x IS NOT NULL) AS missing_columns, "
        f"round(({text} + count(*) * {fixed}) / 1024.0, 2) AS memory_kb FROM {src} t"
    )


def correlation_summary_sql(src: str, cols) -> str:
    ids = O.identifier_sql(O.colstats_sql(src, cols))
    return (
        f"SELECT CAST(k AS INTEGER) AS numeric_column_count, CAST(k * (k - 1) / 2 AS INTEGER) AS total_pairs_evaluated, "
        f"CASE WHEN k < 2 THEN 'At least two suitable numeric columns are required to calculate correlations.' "
        f"ELSE 'Ready' END AS message FROM (SELECT count(*) AS k FROM ({ids}) e "
        f"WHERE kind = 'numeric' AND unique_count > 1 AND NOT is_identifier) c"
    )


for _key in ("lineitem", "missing_lineitem", "documents", "events_derived"):
    _build, _src, _cols = _source(_key)
    register(f"profile_summary_{_key}", profile_summary_sql(_src, _cols))(
        (lambda b: lambda spark, sf_dir: profile_summary(b(spark, sf_dir)))(_build))
    register(f"correlation_summary_{_key}", correlation_summary_sql(_src, _cols))(
        (lambda b: lambda spark, sf_dir: correlation_summary(b(spark, sf_dir)))(_build))


# ---------------------------------------------------------------------------
# report texts (all but the key findings) with an oracle
# ---------------------------------------------------------------------------

def report_texts_sql(src: str, cols) -> str:
    s = OE.quality_summary_sql(src, cols)
    score = ("CASE WHEN health_score = floor(health_score) THEN format('{:.1f}', health_score) "
             "ELSE CAST(health_score AS VARCHAR) END")
    return f"""
SELECT format('{{:,}}', row_count) || ' rows and ' || CAST(column_count AS VARCHAR) || ' columns were profiled; their health score is '
       || {score} || ' of 100, ' || health_status || '.' AS summary,
       format('{{:.1f}}', missing_pct) || '% of the cells hold no value, ' || format('{{:,}}', duplicate_rows)
       || ' rows repeat others, and ' || CAST(len(outlier_columns) AS VARCHAR)
       || ' numeric column(s) have values outside the quartile fences.' AS data_quality,
       array_to_string(list_filter([
         CASE WHEN missing_pct > 0 THEN 'Decide for each column with missing cells whether to fill or drop them.' END,
         CASE WHEN len(outlier_columns) > 0 THEN 'Look at the far values of ' || array_to_string(outlier_columns, ', ') || ' before a model is fitted.' END,
         CASE WHEN duplicate_rows > 0 THEN 'Remove the repeated rows.' END,
         CASE WHEN len(id_columns) > 0 THEN 'Keep ' || array_to_string(id_columns, ', ') || ' out of the features.' END
       ], lambda x: x IS NOT NULL), chr(10)) AS recommendations
FROM ({s}) q
"""


for _key in ("events_derived", "missing_lineitem", "lineitem", "orders"):
    _build, _src, _cols = _source(_key)
    register(f"report_texts_{_key}", report_texts_sql(_src, _cols))(
        (lambda b: lambda spark, sf_dir: report(b(spark, sf_dir)).select("summary", "data_quality", "recommendations"))(_build))
