"""Data quality: duplicates, empty / constant columns, IQR and z-score
outliers, health score."""

from conftest import rows_by
from tablelens.operators.quality import duplicate_rows, quality_columns, quality_summary


def test_zero_iqr_outliers(spark):
    vals = [(10.0,)] * 50 + [(500.0,), (1000.0,), (-400.0,)]
    q = quality_columns(spark.createDataFrame(vals, "val double")).first()
    # IQR is 0 → mean ± 2.5·std: exactly the three extreme values
    assert q["outlier_count"] == 3
    assert q["lower_bound"] == -375.11 and q["upper_bound"] == 435.49


def test_iqr_needs_four_values(spark):
    q = quality_columns(spark.createDataFrame([(1.0,), (2.0,), (100.0,)], "v double")).first()
    assert q["outlier_count"] == 0 and q["lower_bound"] is None


def test_constant_and_empty(spark):
    df = spark.createDataFrame([("a", "on", 1.0, None, None), ("b", "on", 1.0, None, "x"),
                                ("c", "on", 1.0, None, None)],
                               "name string, status string, score double, empty string, half string")
    q = rows_by(quality_columns(df))
    assert q["status"]["is_constant"] and q["score"]["is_constant"]
    assert q["empty"]["is_empty"] and q["empty"]["is_constant"]
    assert not q["half"]["is_constant"]  # a value plus missing is not constant
    s = quality_summary(df).first()
    assert s["empty_columns"] == ["empty"]
    assert s["constant_columns"] == ["status", "score", "empty"]


def test_duplicates_with_nulls_and_nan(spark):
    df = spark.createDataFrame([(1, None, float("nan")), (1, None, float("nan")), (2, "a", 1.0), (2, "a", 1.0),
                                (2, "a", 1.0), (3, "b", 0.0), (3, "b", -0.0)], "a int, b string, c double")
    assert duplicate_rows(df).first()["duplicate_rows"] == 4


def test_health_score_excellent(spark):
    df = spark.createDataFrame([(f"p{i}", float(i * 10), i, ["n", "s"][i % 2]) for i in range(5)],
                               "product string, sales double, units int, region string")
    s = quality_summary(df).first()
    assert s["health_status"] == "Excellent" and 85 <= s["health_score"] <= 100
