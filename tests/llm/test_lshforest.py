import random

import numpy as np
import pytest
from llm_fixtures import docs_of  # noqa: F401

from tablelens.llm import lshforest as L


def brute(rows, size, percent=80):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        k = min(size, len(w))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    roots = {}
    for i, (key, _) in enumerate(rows):
        roots.setdefault(find(i), []).append(key)
    return sorted((key, len(sets[i]), min(roots[find(i)]), key == min(roots[find(i)])) for i, (key, _) in enumerate(rows))


def fixture(n=40):
    rng = random.Random(9)
    word = lambda: "w%d" % rng.randrange(300)
    rows = []
    for i in range(n):
        text = [word() for _ in range(rng.choice([1, 2, 3, 30, 120]))]
        rows.append(" ".join(text))
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(text)
            for _ in range(rng.choice([0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = word()
            rows.append("  ".join(copy).upper())
    base = [word() for _ in range(80)]
    for i in range(60):  # a large group of near copies
        copy = list(base)
        copy[rng.randrange(80)] = word()
        rows.append(" ".join(copy))
    rows += [" ".join(base)] * 50 + [None, "", " \n", "one", "ONE", "x y"]
    ids = rng.sample(range(1000), len(rows))
    return list(zip(ids, rows))


@pytest.mark.parametrize("size", [2, 5])
def test_components_equal_brute_force(docs_of, size):
    rows = fixture()
    got = L.near_duplicates(docs_of(rows), size=size).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, size)


def test_strays_of_a_large_region(docs_of):
    """Near copies of which many are linked with a few members only, more in a region than the window holds."""
    rng = random.Random(2)
    rows = []
    for i in range(400):
        copy = [f"b{j}" for j in range(100)]
        for j in rng.sample(range(100), 4 if i % 8 else 8):
            copy[j] = f"r{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    got = L.near_duplicates(docs_of(rows), size=2).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 2)


def test_neighbours_across_partitions(spark):
    rng = np.random.default_rng(2)
    sig = rng.integers(0, 2, (400, L.DEPTH)).astype(">u4")
    rows = [(0, sig[i].tobytes(), i) for i in range(400)]
    pairs = {(r.a, r.b): r.score for r in L.neighbours(spark.createDataFrame([(*r, 5) for r in rows], "tree int, sig binary, id long, n long")).collect()}
    order = sorted(range(400), key=lambda i: (sig[i].tolist(), i))
    for x, y in zip(order, order[1:]):  # each row at least meets its successor if they share enough
        same = int(np.cumprod(sig[x] == sig[y]).sum())
        if same >= L.LEAST_DEPTH:
            assert pairs.get((min(x, y), max(x, y)), -1) >= L.LEAST_DEPTH


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.id: r.root for r in L.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_edges(docs_of):
    assert L.near_duplicates(docs_of([])).count() == 0
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (6, "a b c d e f g"), (7, None), (7, None), (None, "q r s t u v w")]
    left = sorted(((r.doc_id, r.text) for r in L.one_of_each(docs_of(rows)).collect()), key=str)
    assert left == sorted([(5, "a b c d e f g"), (7, None), (None, "q r s t u v w")], key=str)


def test_borders_of_borders(spark, monkeypatch):
    monkeypatch.setattr(L, "BORDER_ROWS", 20)
    test_neighbours_across_partitions(spark)


@pytest.mark.parametrize("most", [None, 1])
def test_no_link_is_lost_by_the_bitmaps(most):
    rng = np.random.default_rng(6)
    sets = []
    for n in (1, 3, 40, 60, 700, 9000):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for changed in (0, 0.02, 0.08, 0.1, 0.12, 0.2, 0.9):
            x = base.copy()
            at = rng.random(n) < changed
            x[at] = rng.integers(0, 1 << 63, at.sum(), dtype=np.uint64)
            sets.append(np.unique(x))
    ids, sizes = np.arange(len(sets)), np.array([len(x) for x in sets])
    roots = ids // 2 * 2
    side = (ids, sizes, roots, [L.parity(x).tobytes() for x in sets])
    a, b, apart = L.close_pairs(side, side, most, 80)
    found = set(zip(a.tolist(), b.tolist()))
    for i in ids:
        linked = {}
        for j in ids:
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            differ = sizes[i] + sizes[j] - 2 * common
            if roots[i] != roots[j] and 100 * common >= 80 * (sizes[i] + sizes[j] - common):
                linked.setdefault(roots[j], []).append(j)
            assert all(d <= differ for d in apart[(a == i) & (b == j)])
        for root, js in linked.items():
            if most is None:
                assert all((i, j) in found for j in js)
            else:
                assert sum(roots[y] == root for x, y in found if x == i) == 1


def test_rows_are_judged_not_keys(docs_of):
    """Rows without a key, and rows that share one, are rows of their own."""
    a, b, c = "a b c d e f g h", "q r s t u v w x", "one two three four five six"
    rows = [(1, a), (None, a), (None, a), (2, b), (2, c), (3, b), (None, c), (None, c + " seven"), (4, None), (4, c + " 7 8 9 10")]
    left = sorted(((r.doc_id, r.text) for r in L.one_of_each(docs_of(rows)).collect()), key=str)
    assert left == sorted([(1, a), (2, b), (2, c), (None, c + " seven"), (4, None), (4, c + " 7 8 9 10")], key=str)
    got = sorted((tuple(r) for r in L.near_duplicates(docs_of(rows)).select("doc_id", "component_id", "kept").collect()), key=str)
    assert got == sorted([(1, 1, True), (None, 1, False), (None, 1, False), (2, 2, True), (2, 2, True), (3, 2, False), (None, 2, False), (None, None, True), (4, 4, True), (4, 4, True)], key=str)
