"""Exact shares and positions, and the permutation importance on top of them."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tablelens.operators import quota
from tablelens.operators.automl import fold_ranks
from tablelens.operators.permutation import permutation_importance
from tablelens.operators.prep import hash_unit


@pytest.mark.parametrize("buckets", [2048, 5])
def test_parts_have_the_given_sizes_in_the_order_of_the_hash(spark, buckets, monkeypatch):
    monkeypatch.setattr(quota, "BUCKETS", buckets)
    rows = [(i, "ab"[i % 7 == 0] if i else "one") for i in range(301)] + [(301, None), (302, "unnamed")]
    df = spark.createDataFrame(rows, "id int, c string").repartition(5).cache()
    ranks = fold_ranks({"a": 43 - 1, "b": 258, "one": 1}, 3)
    unit = hash_unit(["id"], 7)
    made = quota.parts(df, F.col("c"), unit, ranks).withColumn("u", unit).collect()
    assert len(made) == len(rows)
    for c in ("a", "b"):
        own = sorted((r for r in made if r.c == c), key=lambda r: r.u)
        assert [r.part for r in own] == sorted(r.part for r in own)
        n = len(own)
        want = quota_sizes(ranks[c], n)
        assert [sum(r.part == k for r in own) for k in range(3)] == want
    assert [r.part for r in made if r.c in (None, "unnamed")] == [0, 0]


def quota_sizes(cuts, n):
    edges = [0, *[min(c, n) for c in cuts], n]
    return [b - a for a, b in zip(edges, edges[1:])]


def test_rows_of_one_hash_are_cut_too(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), "id").repartition(4).cache()
    made = quota.parts(df, F.lit(0.0), hash_unit(["k"], 1), {0.0: [200, 201, 999]})
    assert {r.part: r["count"] for r in made.groupBy("part").count().collect()} == {0: 200, 1: 1, 2: 798, 3: 1}
    assert quota.parts(df.limit(0).cache(), F.lit(0.0), hash_unit(["k"], 1), {0.0: [3]}).count() == 0
    assert {r.part for r in quota.parts(df, F.lit(0.0), hash_unit(["k"], 1), {0.0: []}).collect()} == {0}


def test_positions(spark):
    df = spark.range(500).select((F.col("id") % 50).alias("v"), "id").repartition(6).cache()
    made = quota.positions(df, [F.col("v")]).orderBy("pos").collect()
    assert [r.pos for r in made] == list(range(500))
    assert [r.v for r in made] == sorted(r.v for r in made) and {r.id for r in made} == set(range(500))
    assert quota.positions(df.limit(0).cache(), [F.col("v")]).count() == 0


@pytest.mark.parametrize("classes", [True, False])
def test_permutation_importance_equals_the_definition(spark, classes):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 5, (60, 3)).astype(float)
    y = (x[:, 0] > 2).astype(float) if classes else 2 * x[:, 0] + x[:, 1] + rng.normal(size=60)
    df = spark.createDataFrame([(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id int, x array<double>, label double") \
        .withColumn("features", array_to_vector("x")).repartition(4).cache()

    def rule(d):
        v = vector_to_array("features")
        return d.withColumn("prediction", (v[0] > 2).cast("double") if classes else 2 * v[0] + v[1])

    predict = (lambda v: (v[:, 0] > 2).astype(float)) if classes else (lambda v: 2 * v[:, 0] + v[:, 1])
    score = lambda p: (p == y).mean() if classes else 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    turn = [7, 31]  # coprime with 60: the second order of each round

    def orders(number):
        return [F.col("id")], [(F.col("id") * turn[number]) % 60]

    made = {r.feature: r for r in permutation_importance(df, rule, 3, classes, orders, repeats=2).collect()}
    for f in range(3):
        losses = []
        for t in turn:
            donor = np.argsort(np.arange(60) * t % 60)
            z = x.copy()
            z[:, f] = x[donor, f]
            losses.append(score(predict(x)) - score(predict(z)))
        assert np.allclose(made[f].losses, losses) and abs(made[f].importance - np.mean(losses)) < 1e-9
    assert made[2].importance == 0 and made[0].importance > 0
    none = permutation_importance(df.limit(0).cache(), rule, 3, classes, orders, repeats=1)
    assert none.filter("importance is not null").count() == 0


def test_permutation_importance_scores_each_row_once_and_frees_its_rows(spark):
    df = spark.range(60).select(array_to_vector(F.array(F.col("id") % 5.0, F.col("id") % 7.0)).alias("features"), (F.col("id") % 5.0).alias("label"), "id")
    scored = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def first(v):
        scored.add(1)
        return float(v[0])

    def kept():
        return spark.sparkContext._jsc.getPersistentRDDs().size()

    before = kept()
    orders = lambda number: ([F.col("id")], [(F.col("id") * [7, 31][number]) % 60])
    made = permutation_importance(df, lambda d: d.withColumn("prediction", first("features")), 2, False, orders, repeats=2).collect()
    assert {r.feature for r in made} == {0, 1} and all(len(r.losses) == 2 for r in made)
    assert scored.value == 2 * 3 * 60  # the rows as they are and with each feature changed, in each round
    assert kept() == before
