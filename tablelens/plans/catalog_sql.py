"""Registered SQL-surface and template queries.

Each SQL query runs through the guarded :func:`run_sql` over the driver
tables registered as views; the oracle is the same statement in DuckDB, with
all its rows (``sql_guard_default_limit`` alone asks for a cap).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tablelens.operators.sqlrun import run_sql, schema_summary, sql_summary
from tablelens.operators.templates import (
    avg_by,
    column_roles,
    count_by,
    overall_avg,
    sum_by,
    template_sql,
    top_n,
    total_rows,
    trend_by,
)
from tablelens.plans import oracle as O
from tablelens.plans.catalog import register, table
from tablelens.session import conf_override, ensure_checkpoint_dir
from tablelens.sources.csv import read_csv, validate_csv, write_csv

VIEW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents")


def _views(spark, sf_dir):
    return {t: table(spark, sf_dir, t) for t in VIEW_TABLES}


# name: (statement, whether the query asks for the default cap)
SQL_QUERIES = {
    "sql_filter_sort": (
        "SELECT o_orderkey, o_custkey, o_totalprice FROM orders "
        "WHERE o_totalprice > 300000 AND o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey",
        False,
    ),
    "sql_group": (
        "SELECT l_returnflag, l_linestatus, count(*) AS count_order, sum(l_quantity) AS sum_qty, "
        "round(sum(l_extendedprice), 2) AS sum_base_price, "
        "round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, "
        "round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 4) AS avg_disc "
        "FROM lineitem WHERE l_shipdate <= CAST('1998-09-02' AS TIMESTAMP) "
        "GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus",
        False,
    ),
    "sql_having": (
        "SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total_spend FROM orders "
        "GROUP BY o_custkey HAVING count(*) > 15 ORDER BY n_orders DESC, o_custkey",
        False,
    ),
    "sql_cte": (
        "WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS spend FROM orders GROUP BY o_custkey) "
        "SELECT c.c_mktsegment, count(*) AS customers, round(avg(s.spend), 2) AS avg_spend "
        "FROM spend s JOIN customer c ON c.c_custkey = s.o_custkey "
        "GROUP BY c.c_mktsegment ORDER BY c.c_mktsegment",
        False,
    ),
    "sql_join": (
        "SELECT l.l_orderkey, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue, o.o_orderdate "
        "FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey "
        "JOIN lineitem l ON l.l_orderkey = o.o_orderkey "
        "WHERE c.c_mktsegment = 'BUILDING' AND o.o_orderdate < CAST('1995-03-15' AS TIMESTAMP) "
        "AND l.l_shipdate > CAST('1995-03-15' AS TIMESTAMP) "
        "GROUP BY l.l_orderkey, o.o_orderdate ORDER BY revenue DESC, o.o_orderdate, l.l_orderkey LIMIT 10",
        False,
    ),
    "sql_multi_join": (
        "SELECT n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue "
        "FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey "
        "JOIN lineitem l ON l.l_orderkey = o.o_orderkey "
        "JOIN supplier s ON l.l_suppkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey "
        "JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey "
        "WHERE r.r_name = 'ASIA' GROUP BY n.n_name ORDER BY revenue DESC, n.n_name",
        False,
    ),
    "sql_window_rank": (
        "SELECT c_nationkey, c_custkey, c_acctbal, rnk FROM ("
        "SELECT c_nationkey, c_custkey, c_acctbal, "
        "rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rnk FROM customer) t "
        "WHERE rnk <= 3 ORDER BY c_nationkey, rnk",
        False,
    ),
    "sql_window_running": (
        "WITH w AS (SELECT o_custkey, sum(o_totalprice) OVER (PARTITION BY o_custkey "
        "ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running, "
        "lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev_date "
        "FROM orders) "
        "SELECT o_custkey, round(max(running), 2) AS lifetime_value, count(prev_date) AS repeat_orders "
        "FROM w GROUP BY o_custkey ORDER BY lifetime_value DESC, o_custkey LIMIT 20",
        False,
    ),
    "sql_setops": (
        "SELECT 'both' AS kind, count(*) AS n FROM "
        "(SELECT s_nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer) a "
        "UNION ALL SELECT 'supplier_only' AS kind, count(*) AS n FROM "
        "(SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer) b "
        "UNION ALL SELECT 'either' AS kind, count(*) AS n FROM "
        "(SELECT s_nationkey FROM supplier UNION SELECT c_nationkey FROM customer) c",
        False,
    ),
    "sql_semi_anti": (
        "SELECT count(*) AS with_orders, "
        "(SELECT count(*) FROM customer c2 WHERE NOT EXISTS "
        "(SELECT 1 FROM orders o2 WHERE o2.o_custkey = c2.c_custkey)) AS without_orders "
        "FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
        False,
    ),
    "sql_in_scalar_subquery": (
        "SELECT p_brand, count(*) AS n FROM part "
        "WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) "
        "AND p_retailprice > (SELECT avg(p_retailprice) FROM part) "
        "GROUP BY p_brand ORDER BY n DESC, p_brand",
        False,
    ),
    "sql_quoted_identifiers": (
        'SELECT "o_orderpriority", COUNT(*) AS count FROM orders GROUP BY "o_orderpriority" '
        'ORDER BY count DESC, "o_orderpriority"',
        False,
    ),
    "sql_ilike": (
        "SELECT p_type, count(*) AS n FROM part WHERE p_name ILIKE '%BOLT%' GROUP BY p_type ORDER BY p_type",
        False,
    ),
    "sql_guard_default_limit": (
        "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber",
        True,
    ),
    "sql_case_scalars": (
        "SELECT CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium' "
        "ELSE 'small' END AS size_band, year(o_orderdate) AS yr, upper(o_orderstatus) AS status, "
        "count(*) AS n, round(avg(o_totalprice), 2) AS avg_price "
        "FROM orders GROUP BY 1, 2, 3 ORDER BY 1, 2, 3",
        False,
    ),
    "sql_distinct_counts": (
        "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, "
        "count(DISTINCT l_orderkey) AS orders FROM lineitem",
        False,
    ),
    "sql_left_join": (
        "SELECT c.c_custkey, count(o.o_orderkey) AS n_orders FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey "
        "GROUP BY c.c_custkey ORDER BY c.c_custkey",
        False,
    ),
    "sql_self_join": (
        "SELECT a.n_name AS name, count(*) AS neighbours FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey "
        "GROUP BY a.n_name ORDER BY name",
        False,
    ),
    "sql_recursive_cte": (
        "WITH RECURSIVE band(lo) AS (SELECT 0 UNION ALL SELECT lo + 100000 FROM band WHERE lo < 400000) "
        "SELECT b.lo, count(*) AS n FROM band b JOIN orders o ON o.o_totalprice >= b.lo AND o.o_totalprice < b.lo + 100000 "
        "GROUP BY b.lo ORDER BY b.lo",
        False,
    ),
    "sql_offset": (
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 25",
        False,
    ),
    "sql_words_in_literals": (
        "SELECT o_orderpriority AS \"update\", 'drop -- this; table' AS note, count(*) AS n FROM orders "
        "WHERE o_orderpriority <> 'insert' GROUP BY o_orderpriority /* delete */ ORDER BY 1 -- end",
        False,
    ),
    "sql_text_lengths": (
        "SELECT lang, count(*) AS docs, sum(length(text)) AS chars, max(n_chars) AS max_chars "
        "FROM documents GROUP BY lang ORDER BY lang",
        False,
    ),
}


def _sql_query(stmt: str, capped: bool):
    def fn(spark, sf_dir):
        return run_sql(spark, stmt, views=_views(spark, sf_dir), default_limit=1000 if capped else None)
    return fn


for _name, (_stmt, _capped) in SQL_QUERIES.items():
    register(_name, _stmt + (" LIMIT 1000" if _capped else ""))(_sql_query(_stmt, _capped))


@register("sql_summary_group", "SELECT count(*) AS row_count, (SELECT count(*) FROM lineitem) AS total_dataset_rows, 100.0::DOUBLE AS scanned_percentage, "
                               "true AS is_aggregate, false AS truncated FROM (SELECT DISTINCT l_partkey FROM lineitem) t")
def q_summary_group(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return sql_summary(spark, "SELECT l_partkey, count(*) AS n FROM dataset GROUP BY l_partkey", df, {"dataset": df}).drop("sql")


@register("sql_decimal_sum", """
SELECT o_orderstatus, CAST(sum(v) AS VARCHAR) AS total, CAST(max(v) AS VARCHAR) AS largest FROM
  (SELECT o_orderstatus, CAST(CAST('12345678901234567890.25' AS DECIMAL(30,2)) + CAST(o_orderkey AS DECIMAL(18,2)) AS DECIMAL(30,2)) AS v FROM orders) t
GROUP BY o_orderstatus""")
def q_decimal_sum(spark, sf_dir):
    """Decimals of more digits than a double holds come out whole."""
    amount = (F.lit("12345678901234567890.25").cast("decimal(30,2)") + F.col("o_orderkey").cast("decimal(18,2)")).cast("decimal(30,2)")
    df = table(spark, sf_dir, "orders").withColumn("v", amount)
    made = run_sql(spark, "SELECT o_orderstatus, sum(v) AS total, max(v) AS largest FROM dataset GROUP BY o_orderstatus", views={"dataset": df})
    return made.select("o_orderstatus", F.col("total").cast("string").alias("total"), F.col("largest").cast("string").alias("largest"))


@register("sql_summary_capped", "SELECT least(count(*), 1000) AS row_count, count(*) AS total_dataset_rows, 100.0::DOUBLE AS scanned_percentage, "
                                "false AS is_aggregate, count(*) > 1000 AS truncated FROM orders")
def q_summary_capped(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return sql_summary(spark, "SELECT * FROM dataset", df, {"dataset": df}, default_limit=1000).drop("sql")


# ---------------------------------------------------------------------------
# templates (DataFrame API and the SQL text of the same shape)
# ---------------------------------------------------------------------------

@register("template_count_by", "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY o_orderpriority "
                               "ORDER BY count DESC, o_orderpriority LIMIT 10")
def q_count_by(spark, sf_dir):
    return count_by(table(spark, sf_dir, "orders"), "o_orderpriority")


@register("template_sum_by", "SELECT l_returnflag, sum(l_quantity) AS total_l_quantity FROM lineitem "
                             "GROUP BY l_returnflag ORDER BY total_l_quantity DESC, l_returnflag LIMIT 10")
def q_sum_by(spark, sf_dir):
    return sum_by(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")


@register("template_avg_by", "SELECT o_orderpriority, round(avg(o_totalprice), 2) AS avg_o_totalprice FROM orders "
                             "GROUP BY o_orderpriority ORDER BY avg_o_totalprice DESC, o_orderpriority LIMIT 10")
def q_avg_by(spark, sf_dir):
    return avg_by(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")


@register("template_overall_avg", "SELECT round(avg(l_extendedprice), 2) AS avg_l_extendedprice FROM lineitem")
def q_overall_avg(spark, sf_dir):
    return overall_avg(table(spark, sf_dir, "lineitem"), "l_extendedprice")


@register("template_top_n", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def q_top_n(spark, sf_dir):
    return top_n(table(spark, sf_dir, "orders"), "o_totalprice", 10, tie_breakers=["o_orderkey"])


@register("template_trend_by", "SELECT date_trunc('month', l_shipdate) AS period, sum(l_quantity) AS total_l_quantity "
                               "FROM lineitem GROUP BY 1 ORDER BY 1")
def q_trend_by(spark, sf_dir):
    return trend_by(table(spark, sf_dir, "lineitem"), "l_shipdate", "l_quantity", "month")


@register("template_total_rows", "SELECT count(*) AS total_rows FROM lineitem")
def q_total_rows(spark, sf_dir):
    return total_rows(table(spark, sf_dir, "lineitem"))


@register("template_sql_sum_by", "SELECT c_mktsegment, round(sum(c_acctbal), 4) AS total_c_acctbal FROM customer "
                                 "GROUP BY c_mktsegment ORDER BY total_c_acctbal DESC, c_mktsegment LIMIT 10")
def q_template_sql(spark, sf_dir):
    stmt = template_sql("sum_by", category="c_mktsegment", measure="c_acctbal")
    return run_sql(spark, stmt, views={"dataset": table(spark, sf_dir, "customer")})


def _roles_sql(cols) -> str:
    from tablelens.operators.sqlrun import sql_type

    rows = []
    for i, (n, d) in enumerate(cols):
        t = sql_type(d)
        rows.append(f"SELECT {O.lit(n)} AS column_name, CAST({i} AS BIGINT) AS ordinal, {O.lit(t)} AS sql_type")
    body = " UNION ALL ".join(rows)
    idr = ("(lower(trim(column_name)) IN ('id','index','uuid','guid','row_id','row_number','key','code','no','num') "
           "OR regexp_matches(lower(trim(column_name)), '(^|[_\\s])(id|uuid|guid|key|code|index|no|num)$') "
           "OR (ends_with(lower(trim(column_name)), 'id') AND length(trim(column_name)) > 2))")
    return (f"SELECT column_name, ordinal, sql_type, CASE WHEN sql_type = 'DATETIME' THEN 'date' "
            f"WHEN {idr} THEN 'id' WHEN sql_type IN ('INTEGER', 'REAL') THEN 'measure' "
            f"WHEN sql_type = 'TEXT' THEN 'category' ELSE 'other' END AS role FROM ({body}) r")


for _t in ("orders", "lineitem", "customer"):
    register(f"column_roles_{_t}", _roles_sql(O.TABLES[_t]))(
        (lambda t: lambda spark, sf_dir: column_roles(table(spark, sf_dir, t)))(_t))


def _schema_summary_sql(src: str, cols) -> str:
    from tablelens.operators.sqlrun import sql_type

    parts = []
    for i, (n, d) in enumerate(cols):
        c = O.q(n)
        kind = O.kind_of(d)
        if kind == "numeric":
            key = f"CAST(CAST({c} AS DOUBLE) AS VARCHAR)" if d in ("double", "float") else f"CAST({c} AS VARCHAR)"
            num = f"CAST({c} AS DOUBLE)"
        else:
            key, num = f"CAST({c} AS VARCHAR)", "CAST(NULL AS DOUBLE)"
        parts.append(
            f"SELECT {O.lit(n)} AS column_name, CAST({i} AS BIGINT) AS ordinal, {O.lit(d)} AS data_type, "
            f"{O.lit(sql_type(d))} AS sql_type, coalesce((SELECT list(k ORDER BY v NULLS LAST, k) FROM "
            f"(SELECT DISTINCT {key} AS k, {num} AS v FROM {src} WHERE {c} IS NOT NULL "
            f"ORDER BY v NULLS LAST, k LIMIT 5) s), CAST([] AS VARCHAR[])) AS sample_values"
        )
    return " UNION ALL ".join(parts)


for _t in ("customer", "orders", "nation"):
    _cols = O.TABLES.get(_t) or [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")]
    register(f"schema_summary_{_t}", _schema_summary_sql(_t, _cols))(
        (lambda t: lambda spark, sf_dir: schema_summary(table(spark, sf_dir, t)))(_t))



# ---------------------------------------------------------------------------
# CSV source: orders written as CSV under the shared checkpoint folder and
# read back with type inference
# ---------------------------------------------------------------------------

def _csv_folder(spark, sf_dir: str, name: str) -> str:
    digest = hashlib.md5(sf_dir.encode()).hexdigest()[:8]
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tablelens-csv/{name}-{digest}"


@register("csv_roundtrip_orders",
          "SELECT count(*) AS row_count, sum(o_orderkey) AS key_sum, round(sum(o_totalprice), 2) AS price_sum, "
          "count(DISTINCT o_orderstatus) AS statuses, count(DISTINCT o_orderpriority) AS priorities FROM orders")
def q_csv_roundtrip(spark, sf_dir):
    path = _csv_folder(spark, sf_dir, "orders")
    write_csv(table(spark, sf_dir, "orders"), path)
    df = read_csv(spark, path)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("o_orderkey").alias("key_sum"),
        F.round(F.sum("o_totalprice"), 2).alias("price_sum"),
        F.count_distinct("o_orderstatus").alias("statuses"), F.count_distinct("o_orderpriority").alias("priorities"),
    )


# a number column with gaps, booleans, an integer and text: what inference makes of each
@register("csv_types_orders",
          "SELECT unnest(['o_orderkey', 'o_totalprice', 'gaps', 'flag', 'o_orderstatus']) AS column_name, "
          "unnest(['bigint', 'double', 'double', 'boolean', 'string']) AS data_type, count(*) AS n FROM orders")
def q_csv_types(spark, sf_dir):
    path = _csv_folder(spark, sf_dir, "orders-types")
    odd = F.col("o_orderkey") % 2 == 1
    write_csv(table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", F.when(odd, F.col("o_custkey").cast("string")).otherwise("NA").alias("gaps"),
        F.when(odd, "True").otherwise("false").alias("flag"), "o_orderstatus"), path)
    df = read_csv(spark, path)
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("data_type"), F.col("n")) for c, t in df.dtypes])))


@register("csv_validate_orders",
          "SELECT CAST(count(*) AS BIGINT) AS row_count, CAST(6 AS BIGINT) AS column_count, CAST(0 AS BIGINT) AS bad_rows, "
          "true AS header_ok, count(*) > 0 AS is_valid, 'OK' AS message FROM orders")
def q_csv_validate(spark, sf_dir):
    path = _csv_folder(spark, sf_dir, "orders-valid")
    write_csv(table(spark, sf_dir, "orders"), path)
    return validate_csv(spark, path)


# of each ten keys one line is short, one long, and one has a quoted comma; the header has one too
@register("csv_validate_bad",
          "SELECT count(*) AS row_count, CAST(3 AS BIGINT) AS column_count, count(*) FILTER (o_orderkey % 10 < 2) AS bad_rows, true AS header_ok, "
          "false AS is_valid, CAST(count(*) FILTER (o_orderkey % 10 < 2) AS VARCHAR) || ' row(s) do not match the header width.' AS message FROM orders")
def q_csv_validate_bad(spark, sf_dir):
    path = _csv_folder(spark, sf_dir, "orders-bad")
    k = F.col("o_orderkey")
    line = F.when(k % 10 == 0, F.concat(k.cast("string"), F.lit(",1"))).when(k % 10 == 1, F.concat(k.cast("string"), F.lit(",1,2,3"))) \
        .when(k % 10 == 2, F.concat(F.lit('"a, '), k.cast("string"), F.lit('",1,2'))).otherwise(F.concat(k.cast("string"), F.lit(",1,2")))
    # one column without quoting: its name and values are the lines
    table(spark, sf_dir, "orders").select(line.alias('"a,x",b,c')).write.mode("overwrite").option("header", True).option("quote", "\x00").option("sep", "\x01").csv(path)
    return validate_csv(spark, path)


# texts with line breaks, quotes and commas in one file of many splits
_NOTE = "'line ' || CAST(o_orderkey AS VARCHAR) || chr(10) || 'says \"' || o_orderstatus || '\", twice' || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || chr(10) || '\"' ELSE '' END"


@register("csv_multiline_orders",
          f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'plain' ELSE {_NOTE} END AS note, o_totalprice FROM orders")
def q_csv_multiline(spark, sf_dir):
    path = _csv_folder(spark, sf_dir, "orders-lines")
    k, lf = F.col("o_orderkey"), F.lit("\n")
    tail = F.when(k % 3 == 0, F.concat(lf, lf, F.lit('"'))).otherwise("")
    note = F.concat(F.lit("line "), k.cast("string"), lf, F.lit('says "'), "o_orderstatus", F.lit('", twice'), tail)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 5 == 0, "plain").otherwise(note).alias("note"), "o_totalprice")
    write_csv(rows.coalesce(1), path)
    # so that even a small file has many splits, and a large one not ever more of the same size
    size = spark.read.text(path).select("_metadata.file_size").first()
    with conf_override(spark, "spark.sql.files.maxPartitionBytes", str(max(100_000, (size[0] if size else 0) // 256))):
        return read_csv(spark, path).checkpoint()


# the same texts are no fault of the table
@register("csv_validate_multiline",
          "SELECT CAST(count(*) AS BIGINT) AS row_count, CAST(2 AS BIGINT) AS column_count, count(*) FILTER (o_orderkey % 10 = 0) AS bad_rows, true AS header_ok, "
          "false AS is_valid, CAST(count(*) FILTER (o_orderkey % 10 = 0) AS VARCHAR) || ' row(s) do not match the header width.' AS message FROM orders")
def q_csv_validate_multiline(spark, sf_dir):
    path = _csv_folder(spark, sf_dir, "orders-lines-bad")
    k = F.col("o_orderkey").cast("string")
    line = F.concat(k, F.lit(',"a\n""b"",'), k, F.lit('\n"'), F.when(F.col("o_orderkey") % 10 == 0, ",1").otherwise(""))
    top = spark.createDataFrame([('k,"v\nw"',)], "line string")
    top.unionByName(table(spark, sf_dir, "orders").select(line.alias("line"))).coalesce(1).write.mode("overwrite").text(path)
    return validate_csv(spark, path)


# the name rule of the templates does not see "o_orderkey" as an id ("key" must
# follow "_" or a space), so the first measure of orders is o_orderkey
@register("suggested_total_by_category_orders",
          "SELECT o_orderstatus, CAST(sum(o_orderkey) AS BIGINT) AS total_o_orderkey FROM orders "
          "GROUP BY o_orderstatus ORDER BY total_o_orderkey DESC, o_orderstatus LIMIT 10")
def q_suggest(spark, sf_dir):
    from tablelens.operators.templates import suggest_aggregates

    suggested = suggest_aggregates(table(spark, sf_dir, "orders"))
    return suggested["total_o_orderkey_by_o_orderstatus"]
