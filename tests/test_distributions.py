"""Histograms (right-closed bins, integer edges, discrete bars), category
frequencies with an Other row, and time periods."""

import datetime as dt

import numpy as np
import pandas as pd

from tablelens.operators.distributions import distributions


def _hist(spark, values, name="v", dtype="double"):
    df = spark.createDataFrame([(v,) for v in values], f"{name} {dtype}")
    return [r for r in distributions(df).orderBy("position").collect()]


def test_right_closed_bins_match_pandas_cut(spark):
    rng = np.random.default_rng(42)
    values = [float(x) for x in np.round(rng.normal(50, 15, 2000), 3)]
    bars = _hist(spark, values)
    edges = np.linspace(min(values), max(values), 9)
    expected = pd.cut(pd.Series(values), bins=edges, include_lowest=True, right=True, labels=False)
    counts = expected.value_counts().sort_index().tolist()
    assert [b["count"] for b in bars] == counts
    assert bars[0]["lower"] == edges[0] and bars[-1]["upper"] == edges[-1]


def test_discrete_bars_up_to_14_values(spark):
    bars = _hist(spark, [i % 14 for i in range(140)], dtype="bigint")
    assert len(bars) == 14 and all(b["count"] == 10 for b in bars)
    assert bars[0]["label"] == "0"


def test_integer_edges_above_14_values(spark):
    bars = _hist(spark, list(range(22, 42)), name="age", dtype="bigint")
    edges = np.unique(np.round(np.linspace(22, 41, 9)).astype(int))
    assert [b["lower"] for b in bars] == [float(e) for e in edges[:-1]]
    assert sum(b["count"] for b in bars) == 20
    assert "–" in bars[0]["label"]


def test_constant_and_infinite(spark):
    assert [b["count"] for b in _hist(spark, [5.0] * 7)] == [7]
    bars = _hist(spark, [1.0, 2.5, float("inf")])
    assert len(bars) == 1 and bars[0]["percentage"] == 100.0


def test_top10_and_other(spark):
    df = spark.createDataFrame([(f"c{i % 13}",) for i in range(130)] + [("  ",)], "cat string")
    rows = distributions(df).orderBy("position").collect()
    assert len(rows) == 11
    assert rows[-1]["value"] == "Other" and rows[-1]["label"] == "Other (4 values)"
    assert sum(r["count"] for r in rows) == 131


def test_time_granularity(spark):
    base = dt.datetime(2020, 1, 1)
    days = spark.createDataFrame([(base + dt.timedelta(days=i),) for i in range(20)], "d timestamp")
    years = spark.createDataFrame([(base + dt.timedelta(days=200 * i),) for i in range(20)], "d timestamp")
    strings = spark.createDataFrame([(f"2024-03-{i + 1:02d}",) for i in range(12)], "created_at string")
    d = distributions(days).collect()
    assert all(r["type"] == "time" and len(r["value"]) == 10 for r in d) and len(d) == 10  # last 10 days
    y = distributions(years).collect()
    assert {r["value"] for r in y} == {str(v) for v in range(2020, 2031)} - {"2020"}
    s = distributions(strings).collect()
    assert all(r["type"] == "time" for r in s)


def test_boolean_is_categorical(spark):
    from tablelens.operators.profile import statistics

    df = spark.createDataFrame([(True,)] * 7 + [(False,)] * 3 + [(None,)], "flag boolean")
    rows = {r["value"]: r for r in distributions(df).collect()}
    assert set(rows) == {"True", "False"} and rows["True"]["count"] == 7 and rows["True"]["type"] == "frequency"
    st = statistics(df).first()
    assert st["semantic_type"] == "boolean" and st["top_value"] == "True" and st["top_pct"] == 70.0
