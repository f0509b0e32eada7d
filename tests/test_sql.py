"""Guarded SQL: refusals, cleaning, default limit, exact aggregation,
quoted identifiers, templates and roles."""

import pytest

from conftest import rows_by
from tablelens.operators.sqlrun import SqlGuardError, clean_sql, run_sql, schema_summary, validate_sql
from tablelens.operators.templates import column_roles, count_by, is_id_name, suggest_aggregates, template_sql

PRODUCTS = [("Laptop", "Electronics", 1200.0, 50), ("Mouse", "Accessories", 25.0, 400),
            ("Monitor", "Electronics", 300.0, 120), ("Keyboard", "Accessories", 75.0, 250),
            ("Headset", "Audio", 150.0, 180)]


@pytest.fixture
def products(spark):
    return spark.createDataFrame(PRODUCTS, "product string, category string, price double, units_sold bigint")


@pytest.mark.parametrize("sql", [
    "DROP TABLE dataset", "DELETE FROM dataset", "UPDATE dataset SET price = 0",
    "INSERT INTO dataset VALUES (1)", "ALTER TABLE dataset ADD COLUMN x INT",
    "SELECT * FROM dataset; DROP TABLE dataset", "ATTACH DATABASE 'x' AS y",
    "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "", "-- nothing", "SET x = 1", "(DROP TABLE x)", "FROM a INSERT INTO b SELECT 1",
    "WITH a AS (SELECT 1), b AS (SELECT 2) DELETE FROM t", "CACHE TABLE x AS SELECT 1", "EXPLAIN SELECT 1",
])
def test_refusals(sql):
    with pytest.raises(SqlGuardError):
        validate_sql(sql)


def test_cleaning():
    assert clean_sql("```sql\nSELECT 1 -- c\n/* x */;```") == "SELECT 1"


def test_filter_sort(spark, products):
    rows = run_sql(spark, "SELECT * FROM dataset WHERE price > 100 ORDER BY price DESC",
                   views={"dataset": products}).collect()
    assert len(rows) == 3 and rows[0]["product"] == "Laptop"


def test_group_and_cte(spark, products):
    g = rows_by(run_sql(spark, "SELECT category, SUM(units_sold) AS total FROM dataset GROUP BY category",
                        views={"dataset": products}), "category")
    assert g["Accessories"]["total"] == 650
    c = run_sql(spark, "WITH r AS (SELECT product, price * units_sold AS revenue FROM dataset) "
                       "SELECT * FROM r WHERE revenue > 20000 ORDER BY revenue DESC", views={"dataset": products})
    rows = c.collect()
    assert len(rows) == 3 and rows[0]["product"] == "Laptop"


def test_exact_aggregation_10000_rows(spark):
    df = spark.range(10000).selectExpr("CASE WHEN id % 2 = 0 THEN 'Alpha' ELSE 'Beta' END AS category",
                                       "10.0 AS amount")
    r = rows_by(run_sql(spark, "SELECT category, COUNT(*) AS n, SUM(amount) AS s FROM dataset GROUP BY category",
                        views={"dataset": df}), "category")
    assert r["Alpha"]["n"] == 5000 and r["Beta"]["s"] == 50000.0


def test_all_rows_unless_a_cap_is_asked_for(spark):
    view = {"dataset": spark.range(5000).toDF("x")}
    assert run_sql(spark, "SELECT * FROM dataset", views=view).count() == 5000
    capped = lambda sql: run_sql(spark, sql, views=view, default_limit=1000).count()
    assert capped("SELECT * FROM dataset") == 1000
    assert capped("SELECT * FROM dataset LIMIT 3000") == 3000
    assert capped("SELECT * FROM (SELECT * FROM dataset LIMIT 4000) t") == 1000
    assert capped("SELECT x, 'LIMIT 5' AS note FROM dataset") == 1000
    assert capped("WITH t AS (SELECT * FROM dataset) SELECT * FROM t ORDER BY x LIMIT 2000 OFFSET 10") == 2000


def test_literals_and_comments_are_no_sql(spark):
    view = {"dataset": spark.createDataFrame([("update",), ("b",)], "word string")}
    assert run_sql(spark, "SELECT 'a--b' AS x", views=view).first()["x"] == "a--b"
    assert run_sql(spark, "SELECT 'it''s; /* no */ \\' -- drop' AS x -- rest", views=view).count() == 1
    assert run_sql(spark, "SELECT word FROM dataset WHERE word = 'update'", views=view).count() == 1
    assert run_sql(spark, 'SELECT "word" AS "a ""b"" `c" FROM dataset /* ; */;', views=view).columns == ['a "b" `c']
    assert run_sql(spark, "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 4), s AS (SELECT n FROM r) SELECT sum(n) AS n FROM s", views=view).first()["n"] == 10


def test_only_the_views_are_read(spark, tmp_path):
    (tmp_path / "f.txt").write_text("secret")
    view = {"dataset": spark.range(5)}
    spark.range(3).createOrReplaceTempView("other_view")
    spark.read.parquet("/root/testdata/sf0.001/nation.parquet").createOrReplaceTempView("nation_file")
    for sql in (f"SELECT * FROM text.`{tmp_path}/f.txt`", f"SELECT id FROM dataset WHERE EXISTS (SELECT 1 FROM text.`{tmp_path}/f.txt`)", f"WITH t AS (SELECT * FROM text.`{tmp_path}/f.txt`) SELECT * FROM t",
                "SELECT reflect('java.lang.System', 'getProperty', 'java.version')", "SELECT `java_method`('java.lang.Math', 'abs', -1)", "SELECT system.builtin.try_reflect ('java.lang.Math', 'abs', -1)",
                "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM dataset", "SELECT * FROM nation_file"):
        with pytest.raises(SqlGuardError):
            run_sql(spark, sql, views=view)
    assert run_sql(spark, "SELECT * FROM dataset d JOIN (SELECT 1 AS id) e USING (id)", views=view).count() == 1


def test_quoted_identifiers(spark, products):
    sql = template_sql("count_by", category="category")
    rows = run_sql(spark, sql, views={"dataset": products}).collect()
    assert rows[0]["category"] in ("Accessories", "Electronics") and rows[0]["count"] == 2


def test_roles_and_id_names(spark):
    assert is_id_name("CustomerID") and is_id_name("paid") and is_id_name("grid") and is_id_name("order_no")
    assert not is_id_name("Gender")
    df = spark.createDataFrame([(1, "M", 2.0)], "CustomerID int, Gender string, amount double")
    roles = {r["column_name"]: r["role"] for r in column_roles(df).collect()}
    assert roles == {"CustomerID": "id", "Gender": "category", "amount": "measure"}


def test_templates(spark, products):
    top = count_by(products, "category").collect()
    assert top[0]["count"] == 2
    sugg = suggest_aggregates(products)
    assert 1 <= len(sugg) <= 5 and all(hasattr(v, "collect") for v in sugg.values())
    s = rows_by(schema_summary(products))
    assert s["price"]["sql_type"] == "REAL" and s["price"]["sample_values"][0] == "25.0"
