"""Histogram boosting against a plain numpy version."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from tablelens.operators import boosting as B


def plain(x, y, s):
    """Scores of the rows after all rounds, by definition: every cut between two values of a feature is tried."""
    n = len(y)
    if s.classes == 0:
        raw = np.full((n, 1), y.mean())
    else:
        logs = np.log([(y == k).sum() for k in range(s.classes)])
        raw = np.tile([logs[1] - logs[0]] if s.classes == 2 else logs - logs.mean(), (n, 1))
    for _ in range(s.rounds):
        if s.classes == 0:
            g, h = raw - y[:, None], np.ones_like(raw)
        elif s.classes == 2:
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y[:, None], p * (1 - p)
        else:
            p = np.exp(raw) / np.exp(raw).sum(axis=1, keepdims=True)
            g, h = p - (y[:, None] == np.arange(s.classes)), p * (1 - p)
        step = np.zeros_like(raw)
        for k in range(raw.shape[1]):
            def grow(at, depth, top):
                G, H = g[at, k].sum(), h[at, k].sum()
                best = None
                if depth < s.depth:
                    for f in range(x.shape[1]):
                        v = np.unique(x[:, f])
                        for b, cut in enumerate((v[1:] + v[:-1]) / 2):
                            left = at[x[at, f] <= cut]
                            right = at[x[at, f] > cut]
                            if min(len(left), len(right)) < s.least_rows:
                                continue
                            gain = round(g[left, k].sum() ** 2 / (h[left, k].sum() + s.l2) + g[right, k].sum() ** 2 / (h[right, k].sum() + s.l2) - G * G / (H + s.l2), 9)
                            if gain > 0 and (best is None or gain > best[0]):
                                best = (gain, left, right)
                if best is None:
                    step[at, k] = 0.0 if top else -s.rate * G / (H + s.l2)
                else:
                    grow(best[1], depth + 1, False)
                    grow(best[2], depth + 1, False)

            grow(np.arange(n), 0, True)
        raw = raw + step
    return raw


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_scores_equal_the_plain_version(spark, classes, monkeypatch):
    monkeypatch.setattr(B, "WRITTEN_ROUNDS", 2)
    rng = np.random.default_rng(classes)
    x = np.stack([rng.integers(0, 9, 120), rng.normal(size=120).round(1), np.ones(120)], axis=1)
    t = x[:, 0] + 3 * x[:, 1] + rng.normal(size=120)
    y = t if classes == 0 else np.digitize(t, np.quantile(t, [0.5] if classes == 2 else [0.3, 0.7])).astype(float)
    s = B.Settings(classes=classes, rounds=3, depth=3, least_rows=4, l2=0.05)
    df = spark.createDataFrame([(i, Vectors.dense(a), float(b), "kept") for i, (a, b) in enumerate(zip(x, y))], ["row", "features", "label", "raw"]).repartition(3)
    model = B.HistBoosting(s).fit(df)
    made = sorted(model.transform(df).collect(), key=lambda r: r.row)
    want = plain(x, y, s)
    if classes == 0:
        assert np.allclose([r.prediction for r in made], want[:, 0])
    else:
        p = B.probabilities(want)
        assert np.allclose([r.probability.toArray() for r in made], p) and np.allclose(p.sum(axis=1), 1)
        assert [r.prediction for r in made] == p.argmax(axis=1).tolist()
    assert all(r.raw == "kept" for r in made)
    shares = model.featureImportances.toArray()
    assert abs(shares.sum() - 1) < 1e-9 and shares[2] == 0


def test_save_and_load(spark, tmp_path):
    rows = [(Vectors.dense([float(i % 7), float(i % 3)]), float(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, ["features", "label"])
    model = B.HistBoosting(B.Settings(classes=3, rounds=2, depth=2, least_rows=1, share=0.9)).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = B.BoostedModel.load(str(tmp_path / "m"))
    assert [r.probability for r in model.transform(df).collect()] == [r.probability for r in again.transform(df).collect()]


def test_many_values_are_cut_at_quantiles(spark):
    df = spark.range(5000).selectExpr("array(cast(id as double), 1.0) as x")
    edges = B.bin_edges(df, 2, 16)
    assert len(edges[0]) == 15 and edges[1] == []
    assert all(abs(e - 5000 * (k + 1) / 16) < 50 for k, e in enumerate(edges[0]))


def test_no_rows_and_nothing_to_gain(spark):
    flat = spark.createDataFrame([(Vectors.dense([1.0]), 2.0)] * 10, ["features", "label"])
    model = B.HistBoosting(B.Settings(rounds=3)).fit(flat)
    assert model.boosted.rounds == [] and {r.prediction for r in model.transform(flat).collect()} == {2.0}
    assert model.transform(flat.limit(0)).count() == 0


def test_features_of_few_values_need_no_quantiles(spark, monkeypatch):
    def none(*_):
        raise AssertionError("quantiles of a feature whose values are all cuts")

    monkeypatch.setattr(B.F, "percentile_approx", none)
    rows = spark.createDataFrame([([float(i % 7), 1.0],) for i in range(40)] + [([9.0, 1.0],)], "x array<double>").repartition(3)
    assert B.bin_edges(rows, 2, 8) == [[0.5, 1.5, 2.5, 3.5, 4.5, 5.5, 7.5], []]
    assert {r.i: sorted(r["values"]) for r in B.few_values(rows, 2, 7).collect()} == {0: [], 1: [1.0]}  # eight values are too many
    assert B.bin_edges(rows.limit(0), 2, 8) == [[], []]


def test_scoring_sends_the_features_alone_to_python(spark):
    rows = spark.createDataFrame([(Vectors.dense([float(i % 5)]), float(i % 5 > 2), f"text {i}") for i in range(30)], ["features", "label", "note"])
    made = B.HistBoosting(B.Settings(classes=2, rounds=1, depth=1, least_rows=1, rate=1.0)).fit(rows).transform(rows)
    assert "MapInArrow" not in made._jdf.queryExecution().executedPlan().toString()
    assert all(r.prediction == r.label and r.note.startswith("text") for r in made.collect())
