"""Ridge, trees and boosting of numbers on binned blocks, against their definitions and MLlib."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import functions as F

from tablelens.operators import automl, regressors
from tablelens.operators.automl import SMALL_SIZES, benchmark, block_scores, load, save
from tablelens.operators.boosting import Settings, bin_edges, nodes_of
from tablelens.operators.regressors import HELD_OUT, RegressionTrees, Ridge, blocks_of, correlations, end_values, places, shared_counts


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(11)
    n = 900
    x = np.column_stack([rng.integers(0, 20, n), rng.normal(size=n).round(1).clip(-1.5, 1.5), rng.integers(0, 2, n), np.zeros(n)]).astype(float)
    y = np.where(x[:, 0] > 7, 30.0, 5.0) + 4 * x[:, 1] * x[:, 2] + rng.normal(size=n) + 1000
    fold = rng.integers(0, 4, n) - 1
    df = spark.createDataFrame([(a.tolist(), float(b), int(f)) for a, b, f in zip(x, y, fold)], "x array<double>, label double, fold int").repartition(3).cache()
    return x, y, fold, df


def blocks(df, monkeypatch):
    monkeypatch.setattr(regressors, "BLOCK_ROWS", 64)
    monkeypatch.setattr(regressors, "CELLS", 64)
    return blocks_of(df, bin_edges(df.select("x"), 4, 32), 990.0)


def test_trees_of_all_folds_are_those_of_mllib(made, monkeypatch):
    x, y, fold, df = made
    kept = blocks(df, monkeypatch)
    vectors = df.withColumn("features", array_to_vector("x"))
    own = RegressionTrees(Settings(rounds=1, depth=4, least_rows=5, l2=0.0))
    boosted = RegressionTrees(Settings(rounds=4, depth=3, least_rows=1, l2=0.0, rate=0.1))
    theirs = DecisionTreeRegressor(maxDepth=4, minInstancesPerNode=5), GBTRegressor(maxIter=4, maxDepth=3, stepSize=0.1, subsamplingRate=1.0)
    held = [0, 1, 2, None]
    for est, other in zip((own, boosted), theirs):
        for h, model in zip(held, est.fitted(kept, held)):
            train = vectors.where(F.col("fold") != HELD_OUT).where(F.lit(True) if h is None else F.col("fold") != h)
            want = other.fit(train).transform(vectors).select("x", "prediction").collect()
            got = model.transform(vectors).select("prediction").collect()
            assert np.allclose([r.prediction for r in got], [r.prediction for r in want], rtol=1e-9)
        judged = est.predicted(kept, {HELD_OUT: model}).collect()
        assert len(judged) == (fold == HELD_OUT).sum()
        want = model.transform(vectors.where(F.col("fold") == HELD_OUT)).select("label", "prediction").collect()
        assert np.allclose(sorted((r.label, r.prediction) for r in judged), sorted((r.label, r.prediction) for r in want))


def test_ridge_of_each_fold_is_the_closed_form(made, monkeypatch):
    x, y, fold, df = made
    kept = blocks(df, monkeypatch)
    est = Ridge(2.0)
    scores = block_scores(est, kept, 3)
    for h, model in zip([0, 1, 2, None], est.fitted(kept, [0, 1, 2, None])):
        some = (fold != HELD_OUT) & (fold != (h if h is not None else HELD_OUT))
        xc, yc = x[some] - x[some].mean(0), y[some] - y[some].mean()
        want = np.linalg.solve(xc.T @ xc + 2.0 * np.eye(4), xc.T @ yc)
        assert np.allclose(model.coefficients.toArray(), want) and abs(model.intercept - (y[some].mean() - x[some].mean(0) @ want)) < 1e-8
        if h is not None:
            out = fold == h
            rest = y[out] - x[out] @ want - model.intercept
            assert abs(scores[h] - (1 - (rest**2).sum() / ((y[out] - y[out].mean()) ** 2).sum())) < 1e-9
    got = correlations(kept.fitted_on(None))
    some = fold != HELD_OUT
    assert got[3] is None and np.allclose(got[:3], [np.corrcoef(x[some, i], y[some])[0, 1] for i in range(3)])


def test_a_fold_without_rows_is_told(made, monkeypatch):
    kept = blocks(made[3], monkeypatch)
    with pytest.raises(ValueError, match="validation data at fold 3"):
        block_scores(Ridge(), kept, 4)


def test_a_round_sees_its_share_and_a_constant_label_is_not_cut(spark, made, monkeypatch):
    kept = blocks(made[3], monkeypatch)
    some = regressors.level_sums(kept, [None], regressors.grown(kept, [None], Settings(rounds=0, share=0.5)), [regressors.Tree.empty(1)], [[0]], 0, 1)[0]
    n = (made[2] != HELD_OUT).sum()
    assert 0.4 * n < some[0].sum() / 4 < 0.6 * n
    flat = made[3].withColumn("label", F.lit(0.1))
    model = RegressionTrees(Settings(rounds=2, depth=3, least_rows=1, share=0.9)).fitted(blocks(flat, monkeypatch), [None])[0]
    assert all(f < 0 for (t,) in model.boosted.rounds for f in t.feature) and model.boosted.base == [pytest.approx(0.1)]


def test_places_and_shared_counts():
    assert shared_counts([32, 7, 300, 2, 2]) == [[0, 1], [2, 3, 4]] and shared_counts([5000, 2]) == [[0], [1]]
    t = regressors.Tree([1, -1, 0, -1, -1, -1, -1], [1, 0, 2, 0, 0, 0, 0], [1.0, 0, 2.0, 0, 0, 0, 0], [0, 5.0, 0, 0, 0, 7.0, 9.0], [0.0] * 7)
    b = np.array([[0, 3, 2, 3], [0, 1, 2, 2]], np.uint8)
    assert end_values(t, 2)[places(t, b, 2)].tolist() == [5.0, 5.0, 7.0, 9.0]
    assert np.array(t.value)[nodes_of(t, b.T, True)].tolist() == [5.0, 5.0, 7.0, 9.0]


def test_benchmark_of_numbers_reads_no_vector_and_is_saved(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, float(a) if i % 9 else None, "uvw"[i % 3], float(50 * (a > 40) + (i % 3) + rng.normal())) for i, a in enumerate(rng.integers(0, 90, 400))]
    df = spark.createDataFrame(rows, "id long, a double, c string, price double")
    monkeypatch.setattr(automl, "fold_scores", None)  # folds by folds, on vectors
    b = benchmark(df, "price", excluded=["id"], sizes=SMALL_SIZES, split_key=["id"], models=["Ridge Regression", "Decision Tree Regressor", "Gradient Boosting Regressor"])
    lines = b.leaderboard.collect()
    assert [r.error for r in lines] == [None] * 3 and all(0.3 < r.cv_score_mean < 1 and 0.3 < r.r2_score < 1 for r in lines)
    assert "Gradient" in b.champion_name or "Tree" in b.champion_name
    # the medians of missing values are cut off from their neighbours
    assert b.prep.medians["a"] in b.prep.cuts["a"] and len(b.prep.cuts["a"]) <= 32
    want = b.prep.frame.where("split = 'train'").selectExpr("corr(f0, label) AS r").first().r
    told = {r.feature: r.correlation for r in b.attribution.collect()}
    assert told["a"] == round(want, 3) and b.importance.first()["feature"] == "a"
    save(b, str(tmp_path / "m"))
    prep, model, _ = load(spark, str(tmp_path / "m"))
    test = b.prep.frame.where("split = 'test'")
    assert model.transform(test).select("prediction").collect() == b.champion.transform(test).select("prediction").collect()
    ridge = Ridge().fit(b.prep.frame.where("split = 'train'"))
    ridge.save(str(tmp_path / "r"))
    assert regressors.RidgeModel.load(str(tmp_path / "r")).transform(test).first()["prediction"] == pytest.approx(ridge.transform(test).first()["prediction"])
