"""Value counts by class of types."""

import datetime as dt
from collections import Counter
from decimal import Decimal

from tablelens.plans.passes import TableMetrics, column_specs, counted_values
from tablelens.session import conf_override

SCHEMA = "i int, l long, d double, f float, s string, b boolean, t timestamp, y date, m decimal(12,2), a array<int>"


def _rows():
    day = dt.datetime(2024, 10, 27, 0, 30)
    out = []
    for k in range(40):
        gap = k % 7 == 0
        out.append((None if gap else k % 5, 2**60 + k % 3, float("nan") if k == 3 else [-0.0, 0.0, 1.5][k % 3], 0.5, None if gap else "ab"[k % 2], k % 2 == 0 if k % 5 else None,
                    day + dt.timedelta(hours=k % 4), None if gap else dt.date(2024, 1, 1 + k % 3), Decimal(k % 4), None if gap else [k]))
    return out


def test_counts_of_every_class(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    got = Counter()
    for r in counted_values(df, column_specs(df)).collect():
        assert (r["ord"], r["key"]) not in got
        got[r["ord"], r["key"]] += r["n"]
        if r["key"] is not None and r["ord"] < 4:
            assert float(r["key"]) == r["num"] or r["ord"] == 1
    want = Counter()
    texts = df.selectExpr("string(i)", "string(l)", "CASE WHEN isnan(d) THEN NULL ELSE string(d + 0.0D) END", "string(f)", "s", "CASE WHEN b THEN 'True' WHEN NOT b THEN 'False' END",
                          "string(t)", "string(y)", "string(m)", "CASE WHEN a IS NOT NULL THEN '' END").collect()
    for r in texts:
        want.update(enumerate(r))
    assert got == want


def test_hours_told_twice_are_one_text(spark):
    with conf_override(spark, "spark.sql.session.timeZone", "Europe/Berlin"):
        df = spark.sql("SELECT timestamp_seconds(1729989000 + 3600 * (id % 2)) AS t FROM range(10)")  # 02:30 in summer and in winter time
        assert [(r["key"], r["n"]) for r in counted_values(df, column_specs(df)).collect()] == [("2024-10-27 02:30:00", 10)]


def test_rows_are_grouped_without_texts_of_numbers_and_times(spark):
    df = spark.createDataFrame(_rows(), SCHEMA).select("i", "l", "d", "t", "y")
    plan = counted_values(df, column_specs(df))._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert len(dealt) == 4 and all("hashpartitioning(ord#" in line and "key#" not in line for line in dealt), plan


def test_mode_and_least_text(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,), (None,), (None,)], "s string")
    r = TableMetrics(df).moments.first()
    assert (r["top_value"], r["top_freq"], r["min_text"], r["unique_count"], r["n_rows"]) == ("a", 2, "a", 3, 8)
