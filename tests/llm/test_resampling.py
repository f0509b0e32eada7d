import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from llm_fixtures import SF_SMALL, docs_of  # noqa: F401
from pyspark.sql import functions as F

from tablelens.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def by_definition(docs, target):
    """doc_id, n_features, weight, score, rank from (doc_id, text) and texts."""

    def feats(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = WORD.findall(low)
        return len(w), [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(feats(x)[1])
    for x in target:
        t.update(feats(x)[1])
    S, T = float(sum(s.values())), float(sum(t.values()))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (S + 10000) / ((s[b] + 1.0) * (T + 10000))))
    rows = []
    for k, x in docs:
        n, f = feats(x)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((-r[3], r[0] is None, r[0] or 0, i) for i, r in enumerate(rows) if r[4] >= 20)
    rank = {x[3]: p + 1 for p, x in enumerate(able[: 25 * len(able) // 100])}
    return [(*r[:4], rank.get(i)) for i, r in enumerate(rows)]


def drawn(spark, docs, target):
    made = resampling.resample(docs, spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string"))
    return [(r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in made.collect()]


def test_whole_table_by_definition(spark, docs_of):
    rng = random.Random(5)
    words = ["Alpha", "beta", "né", "x1", "你好", "delta", "I", "of", "the"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", ",", "-z"]) for _ in range(n))
    rows = [(i, text(rng.randint(0, 60))) for i in range(300)] + [(900, None), (901, ""), (902, " ,.-"), (903, text(9000)), (904, "w" * 50000)]
    rows += [(5, rows[5][1])] * 3 + [(None, text(40)), (None, text(50))]
    target = [text(30) + " delta delta", None, "", "Only here"]
    assert sorted(map(str, drawn(spark, docs_of(rows), target))) == sorted(map(str, by_definition(rows, target)))
    assert sorted(map(str, drawn(spark, docs_of(rows), [None]))) == sorted(map(str, by_definition(rows, [])))


def test_empty_table(spark, docs_of):
    assert drawn(spark, docs_of([]), ["a b"]) == []


def test_given_tables(spark):
    docs, items = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    got = [(r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in resampling.resample(docs, items).collect()]
    want = by_definition([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in items.collect()])
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_ranks_of_any_rows(spark, ranges):
    """Many equal scores, a key that holds a third of the rows, runs of unlike sizes."""
    rows = [(1 if i % 3 == 0 else i, i % 7 if i % 2 else 4) for i in range(5000)]
    df = spark.createDataFrame(rows, "key long, score long").repartition(7, F.col("score"))
    made = [(r.rank, -r.score, r.key) for r in resampling.ranked(df, ranges).collect()]
    assert sorted(made) == [(i + 1, *x) for i, x in enumerate(sorted((-s, k) for k, s in rows))]


def test_splitters_are_regular():
    assert resampling.splitters([(i,) for i in range(100)], 4) == [(25,), (50,), (75,)]
    assert resampling.splitters([], 4) == []
