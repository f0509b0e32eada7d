"""Correlation tiers, identifier exclusion, insights and the text report."""

from conftest import rows_by
from tablelens.operators.correlation import correlations, top_correlations
from tablelens.operators.insights import analyze, insights, report


def _correlated(spark):
    rows = []
    for i in range(50):
        x = i * 1.5 + 0.25  # not a unit-step series (that would be an identifier)
        y = 2 * x + ((i * 7919) % 13 - 6) * 0.3
        z = float((i * 37) % 17)
        rows.append((x, y, z))
    return spark.createDataFrame(rows, "x double, y double, z double")


def test_strong_pair_first(spark):
    top = top_correlations(_correlated(spark)).orderBy("rank").collect()
    assert (top[0]["column1"], top[0]["column2"]) == ("x", "y")
    assert top[0]["correlation"] > 0.95 and top[0]["strength"] == "Very Strong Positive"


def test_negative_label(spark):
    df = spark.createDataFrame([(float(s), 100.0 / s + (s % 3), 5.0 + s * 0.1) for s in range(1, 9)],
                               "speed double, travel_time double, fuel_consumed double")
    assert any(r["direction"] == "Negative" for r in correlations(df).collect())


def test_constant_pair_is_zero_not_an_error(spark):
    df = spark.createDataFrame([(1.0, 2.0, float(i)) for i in range(5)] + [(None, None, 9.0)], "a double, b double, c double")
    # a and b are constant: excluded (one distinct value); no ANSI divide-by-zero anywhere
    assert correlations(df).count() == 0


def test_identifiers_excluded(spark):
    rows = [(1000 + i, 20 + i % 40, float(i % 7), float((i * 3) % 11), i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "CustomerID bigint, Age bigint, Tenure double, Spend double, Churn int")
    cols = {r["column1"] for r in correlations(df).collect()} | {r["column2"] for r in correlations(df).collect()}
    assert "CustomerID" not in cols and {"Age", "Tenure", "Spend", "Churn"} <= cols


def test_text_only_has_no_pairs(spark):
    df = spark.createDataFrame([("a", "x", "r"), ("b", "y", "s"), ("c", "z", "t")], "name string, city string, role string")
    assert correlations(df).count() == 0


def test_insights_and_report(spark):
    rows = [(f"p{i % 4}", i * 2.5 + 1, i * 2 + i % 3, "north" if i % 5 else "south") for i in range(40)]
    df = spark.createDataFrame(rows, "product string, sales double, units int, region string")
    found = insights(df).orderBy("position").collect()
    assert found[0]["type"] == "overview"
    assert any(r["type"] == "correlation" for r in found)
    assert any(r["type"] == "categorical_dominance" and r["columns"] == ["region"] for r in found)
    rep = report(df).first()
    assert rep["summary"].startswith("40 rows and 4 columns were profiled;")
    assert rep["key_findings"].startswith("• ")


def test_no_leakage_between_runs(spark):
    a = spark.createDataFrame([(1.0, 2.0, "x")], "price double, quantity double, region string")
    b = spark.createDataFrame([(30, 1.0, "hr")], "age int, salary double, department string")
    ra, rb = analyze(a), analyze(b)
    assert set(rows_by(ra["profile"])) == {"price", "quantity", "region"}
    assert set(rows_by(rb["profile"])) == {"age", "salary", "department"}


def test_exploded_pairs_match_pandas(spark, monkeypatch):
    import numpy as np
    import pandas as pd

    import tablelens.operators.correlation as C

    rng = np.random.default_rng(42)
    n = 300
    base = rng.normal(0, 1, n)
    data = {f"c{k}": base * (k % 3 - 1) + rng.normal(0, 1 + k, n) * 3 for k in range(6)}
    pdf = pd.DataFrame(data)
    for k in range(6):  # scattered nulls, different per column
        pdf.loc[rng.choice(n, 20 + 5 * k, replace=False), f"c{k}"] = np.nan
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, ", ".join(f"c{k} double" for k in range(6)))
    cols = [(k, f"c{k}") for k in range(6)]
    expected = pdf.corr()
    for per_job in (60, 1):  # one aggregate / exploded pairs
        monkeypatch.setattr(C, "PAIRS_PER_JOB", per_job)
        got = {(r["column1"], r["column2"]): r["r"] for r in C.pair_correlations(df, cols).collect()}
        assert len(got) == 15
        for (a, b), r in got.items():
            assert abs(r - round(expected.loc[a, b], 3)) < 1e-9, (per_job, a, b, r, expected.loc[a, b])


def test_id_formats(spark):
    """Three identifier columns excluded, four features kept."""
    rows = [(f"CUST_{i:04d}", 5000 + i * 7, i + 1, 0.5 + (i * 37 % 23) / 10, 1.0 + (i * 11 % 17) / 3,
             float(100 + i * 13 % 41), (i * 29 % 19) / 19) for i in range(50)]
    df = spark.createDataFrame(rows, "CustomerID string, user_id bigint, row_id bigint, grid_stability double, "
                                     "fluid_flow double, total_spend double, churn_rate double")
    kept = {r["column1"] for r in correlations(df).collect()} | {r["column2"] for r in correlations(df).collect()}
    assert kept == {"grid_stability", "fluid_flow", "total_spend", "churn_rate"}


def test_wide_table(spark):
    from pyspark.sql import functions as F

    cols = [((F.col("id") * (i + 7)) % 31 + F.col("id") % 3 * 0.25).alias(f"n{i}") for i in range(20)]
    cols += [F.concat(F.lit("c"), (F.col("id") % (i + 2)).cast("string")).alias(f"s{i}") for i in range(20)]
    df = spark.range(400).select(*cols)
    res = analyze(df)
    assert res["correlations"].count() == 190  # 20 numeric columns, all pairs, exploded path
    assert res["statistics"].count() == 40 and res["distributions"].count() > 0
