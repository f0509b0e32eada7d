"""Profile and statistics on small hand-checked frames (empty, one row,
all-null, constant, semantic types) and on a driver table."""

import math

from conftest import SF_SMALL, rows_by
from tablelens.operators.profile import profile, profile_summary, statistics


def test_empty_frame(spark):
    df = spark.createDataFrame([], "name string, age bigint, salary double")
    p = rows_by(profile(df))
    assert set(p) == {"name", "age", "salary"}
    assert all(r["missing_count"] == 0 and r["missing_pct"] == 0.0 for r in p.values())
    s = profile_summary(df).first()
    assert s["row_count"] == 0 and s["column_count"] == 3


def test_single_row(spark):
    df = spark.createDataFrame([("a", 25, 1000.0)], "name string, age bigint, salary double")
    st = rows_by(statistics(df))
    age = st["age"]
    assert age["mean"] == 25.0 and age["std"] == 0.0 and age["variance"] == 0.0
    assert age["q25"] == 25.0 and age["q75"] == 25.0 and age["skewness"] == 0.0


def test_all_null_column_and_nan(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("b", None, float("nan"))], "name string, age double, salary double")
    p = rows_by(profile(df))
    assert p["age"]["missing_count"] == 2 and p["age"]["mean"] is None
    assert p["salary"]["missing_count"] == 1  # NaN is missing
    assert p["salary"]["unique_count"] == 1


def test_semantic_types(spark):
    df = spark.createDataFrame([(100.0, True, "x"), (200.0, False, "y"), (300.0, True, "x")],
                               "revenue double, is_active boolean, category string")
    st = rows_by(statistics(df))
    assert st["revenue"]["semantic_type"] == "numeric" and st["revenue"]["sum"] == 600.0
    assert st["is_active"]["semantic_type"] == "boolean"
    assert st["category"]["semantic_type"] == "categorical"
    assert st["category"]["top_value"] == "x" and st["category"]["top_frequency"] == 2
    assert st["category"]["top_pct"] == 66.67


def test_bias_corrected_skew(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    sk = statistics(df).first()["skewness"]
    assert math.isclose(sk, 1.7636, abs_tol=1e-4)  # G1, not the population g1 (1.0182)


def test_lineitem_profile(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    p = rows_by(profile(li))
    assert p["l_returnflag"]["unique_count"] == li.select("l_returnflag").distinct().count()
    assert p["l_quantity"]["min"] >= 1.0
