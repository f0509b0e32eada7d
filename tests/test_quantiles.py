"""Exact quantiles: the map-based path and the bucketed path used for
columns with very many distinct values give numpy's linear quantiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.functions.quantiles import exact_quantiles

PROBS = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.mark.parametrize("large", [False, True])
def test_exact_quantiles(spark, large):
    rng = np.random.default_rng(42)
    cols = {
        0: np.round(rng.normal(100, 30, 5000), 2),          # many distinct values
        1: rng.integers(0, 7, 3000).astype(float),           # heavy repeats
        2: np.concatenate([np.full(2000, 5.0), rng.uniform(0, 10, 11)]),  # one hot value
    }
    rows = [(o, float(v)) for o, vals in cols.items() for v in vals]
    vc = spark.createDataFrame(rows, "ord int, num double").groupBy("ord", "num").agg(F.count(F.lit(1)).alias("n"))
    out = {r["ord"]: r["q"] for r in exact_quantiles(vc, PROBS, large_ords=list(cols) if large else [],
                                                     buckets=16).collect()}
    for o, vals in cols.items():
        expected = np.quantile(vals, PROBS)
        assert np.allclose(out[o], expected, rtol=0, atol=1e-9), (o, out[o], expected)
