import numpy as np
from pyspark.sql import functions as F
from llm_fixtures import SF_SMALL  # noqa: F401

from tablelens.llm import neighbours as N

QUERY = "vec_id % 50 = 0"


def truth(rows, top=5):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = N.cosine(np.repeat(x[i : i + 1], len(x), 0), x)
        s[i] = -9
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s))[: min(top, len(ids) - 1)]]
    return out


def test_recall(spark):
    table = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    expect = truth([(r.vec_id, r.embedding) for r in table.collect()])
    got = {}
    for r in N.search(table, F.expr(QUERY)).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(expect) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    hit = sum(len({v for v, _ in g.values()} & {v for v, _ in expect[q]}) for q, g in got.items())
    assert hit >= 0.9 * 5 * len(expect)
    exact = {(q, v): s for q, e in expect.items() for v, s in e}
    for q, g in got.items():
        for v, s in g.values():
            assert abs(exact.get((q, v), s) - s) < 1e-12
        assert [s for _, s in (g[k] for k in sorted(g))] == sorted((s for _, s in g.values()), reverse=True)


def test_equal_vectors_and_odd_rows(spark):
    rng = np.random.default_rng(8)
    some = rng.normal(size=(3, 8)).astype(np.float32).tolist()
    rows = [(i, some[0]) for i in range(40)] + [(50, some[0]), (60, some[1]), (61, some[2])]
    odd = [(100, None), (101, [0.0] * 8), (102, [float("nan")] * 8), (103, [1.0] * 7 + [None]), (104, [1.0]), (None, some[0]), (105, [float("inf")] * 8), (150, [])]
    table = spark.createDataFrame(rows + rows[:3] + odd, "vec_id long, embedding array<float>")
    got = {}
    for r in N.search(table, F.expr(QUERY)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == [1, 2, 3, 4, 5] and got[50] == [0, 1, 2, 3, 4] and set(got) == {0, 50}


def test_few_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert N.search(make([]), F.expr(QUERY)).count() == 0
    assert N.search(make([(0, [1.0, 0.0])]), F.expr(QUERY)).count() == 0
    assert [(r.rank, r.vec_id, r.score) for r in N.search(make([(0, [1.0, 0.0]), (3, [2.0, 0.0])]), F.expr(QUERY)).collect()] == [(1, 3, 1.0)]


def test_large_groups_are_salted(spark, monkeypatch):
    monkeypatch.setattr(N, "GROUP_ROWS", 40)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(300, 6)) * 0.01 + 1, rng.normal(size=(300, 6))]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for r in N.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.expr(QUERY)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    expect = truth(rows)
    assert sum(len(got[q] & {v for v, _ in e}) for q, e in expect.items()) >= 0.9 * sum(map(len, expect.values()))


def answers(spark, rows):
    got = {}
    for r in N.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.expr(QUERY)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


def test_a_query_that_lies_alone_gets_its_five(spark, monkeypatch):
    """One direction holds all rows but the query; the pass over all rows runs in several groups and blocks."""
    monkeypatch.setattr(N, "GROUP_ROWS", 500)
    monkeypatch.setattr(N, "BLOCK", 2)
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(2999, 8)) * 0.02 + 1).astype(np.float32)
    rows = [(i + 1, v.tolist()) for i, v in enumerate(x)]
    rows = [r for r in rows if r[0] not in (50, 100)] + [(0, [-1.0] * 8), (50, [1.0, -1.0] * 4), (100, [-1.0, 1.0] * 4)]
    got, expect = answers(spark, rows), truth(rows)
    assert set(got) == set(expect) and all(len(g) == 5 for g in got.values())
    for q in (0, 50, 100):
        assert [v for v, _ in got[q]] == [v for v, _ in expect[q]]


def test_equal_cosines_of_different_vectors(spark):
    """One direction, many lengths: cosines that differ by rounding only, in exact order, ties by id."""
    rng = np.random.default_rng(6)
    for _ in range(2):
        way = rng.normal(size=8)
        rows = [(i, (way * rng.uniform(0.1, 9)).astype(np.float32).tolist()) for i in range(400)]
        assert answers(spark, rows) == truth(rows)
        lengths = [(i, (np.float32([1, 2, 3, 4]) * np.float32(1 + i)).tolist()) for i in range(300)]
        assert answers(spark, lengths) == truth(lengths)


def test_shared_ids(spark):
    rows = [(0, [1.0, 0.0]), (7, [1.0, 0.1]), (7, [0.0, 1.0]), (9, [0.5, 0.5])]
    for order in (rows, rows[::-1]):
        assert [v for v, _ in answers(spark, order)[0]] == [9, 7]
