"""Correlations of complete columns from centred products."""

import numpy as np

from tablelens.operators.correlation import pair_correlations


def test_correlation_of_complete_columns_is_one_sum_a_pair(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=200)
    m = np.stack([1e9 + a, a + rng.normal(size=200), rng.normal(size=200)], axis=1)
    df = spark.createDataFrame(m.tolist(), "a double, b double, c double")
    known = {n: (float(m[:, i].mean()), float(m[:, i].std())) for i, n in enumerate("abc")}
    made = pair_correlations(df, list(enumerate("abc")), complete=known)
    r = np.corrcoef(m, rowvar=False)
    assert all(abs(x["r"] - r[x["ord1"], x["ord2"]]) < 6e-4 for x in made.collect())
    assert "covar_pop" not in made._jdf.queryExecution().executedPlan().toString()
