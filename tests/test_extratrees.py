"""Extra trees against a plain version that draws the same cuts."""

import hashlib

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from tablelens.operators import extratrees as E


def unit(*key):
    return int(hashlib.md5(":".join(map(str, key)).encode()).hexdigest()[:8], 16) / 2**32


def plain(x, y, s):
    """Answers of the rows by definition; nodes are numbered level by level, in the order of their parents."""
    n, classes = len(y), s.classes
    onehot = (y[:, None] == np.arange(classes)).astype(float) if classes else (y - y.mean())[:, None]
    out = np.zeros((n, onehot.shape[1]))
    for tree in range(s.trees):
        level, made = [(0, np.arange(n))], 1
        for depth in range(s.depth + 1):
            coming = []
            for node, at in level:
                varied = [f for f in range(x.shape[1]) if x[at, f].min() < x[at, f].max()] if depth < s.depth else []
                if s.tries:
                    varied = sorted(varied, key=lambda f: unit(s.seed, "feature", tree, node, f))[: s.tries]
                best = None
                for f in sorted(varied):
                    lo, hi = x[at, f].min(), x[at, f].max()
                    cut = lo + unit(s.seed, "cut", tree, node, f) * (hi - lo)
                    left, right = at[x[at, f] <= cut], at[x[at, f] > cut]
                    if min(len(left), len(right)) < s.least_rows:
                        continue
                    part = lambda rows: (onehot[rows].sum(axis=0) ** 2).sum() / len(rows)
                    gain = round(part(left) + part(right) - part(at), 9)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = gain, left, right
                if best is None:
                    out[at] += onehot[at].mean(axis=0)
                else:
                    coming += [best[1], best[2]]
            level, made = [(made + i, at) for i, at in enumerate(coming)], made + len(coming)
    return out / s.trees + (0 if classes else y.mean())


def frame(spark, x, y):
    return spark.createDataFrame([(i, Vectors.dense(a), float(b), "kept") for i, (a, b) in enumerate(zip(x, y))], ["row", "features", "label", "p"]).repartition(3)


@pytest.mark.parametrize("classes,tries,cells", [(0, 0, 10**6), (3, 2, 10**6), (2, 1, 60)])
def test_answers_equal_the_plain_version(spark, classes, tries, cells, monkeypatch):
    monkeypatch.setattr(E, "CELLS", cells)
    rng = np.random.default_rng(classes)
    x = np.stack([rng.integers(0, 6, 90), rng.normal(size=90).round(2), np.ones(90), rng.normal(size=90).round(1)], axis=1)
    t = x[:, 0] + 2 * x[:, 1]
    y = t if not classes else np.digitize(t, np.quantile(t, [0.5] if classes == 2 else [0.3, 0.7])).astype(float)
    s = E.Settings(classes=classes, trees=3, depth=3, least_rows=3, tries=tries)
    df = frame(spark, x, y)
    model = E.ExtraTrees(s).fit(df)
    made = sorted(model.transform(df).collect(), key=lambda r: r.row)
    want = plain(x, y, s)
    if classes:
        assert np.allclose([r.probability.toArray() for r in made], want) and np.allclose(want.sum(axis=1), 1)
        assert [r.prediction for r in made] == want.argmax(axis=1).tolist()
    else:
        assert np.allclose([r.prediction for r in made], want[:, 0])
    shares = model.featureImportances.toArray()
    assert abs(shares.sum() - 1) < 1e-9 and shares[2] == 0 and all(r.p == "kept" for r in made)


def test_no_rows_nothing_to_gain_and_persistence(spark, tmp_path):
    flat = frame(spark, np.ones((8, 1)), np.full(8, 2.0))
    model = E.ExtraTrees(E.Settings(trees=2)).fit(flat)
    assert {r.prediction for r in model.transform(flat).collect()} == {2.0}
    assert model.transform(flat.limit(0)).count() == 0
    empty = E.ExtraTrees(E.Settings(trees=1)).fit(flat.limit(0))
    assert empty.forest.trees[0].feature == [-1]
    x = np.arange(20.0)[:, None]
    df = frame(spark, x, (x[:, 0] > 9).astype(float))
    model = E.ExtraTrees(E.Settings(classes=2, trees=2, depth=2)).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = E.ExtraTreesModel.load(str(tmp_path / "m"))
    assert sorted(map(str, model.transform(df).collect())) == sorted(map(str, again.transform(df).collect()))
