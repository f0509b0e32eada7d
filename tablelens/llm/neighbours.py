"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length one, so the largest cosine is the smallest
Euclidean distance.  In each of ``TABLES`` tables a vector's bucket is the
grid cell of ``PROJECTIONS`` Gaussian (2-stable) projections.  A query visits
the cells near its own in the order of their estimated success: under the
Gaussian law of a neighbour's offset each cell has a chance, the product over
its projections.  The first ``probes`` cells are visited in every table, the
candidates are ranked by exact cosine inside their bucket, and the tables'
best are merged.  Ranking inside a bucket keeps all rows within the rounding
of the rough product's border, so the exact cosines alone decide.

A query that has fewer than ``top`` candidates in the cells that it visits is
asked again over all rows, in blocks of ``BLOCK`` queries and groups of index
rows: exact, and needed only by vectors that lie alone.

How many cells to visit is fitted on a bounded sample (``SAMPLE`` vectors): the
least number that finds ``GOAL`` of the true neighbours there.  All vectors
are indexed.  Neighbours in the whole table are nearer than in the sample, so
its recall is a lower estimate.

Rows meet by (table, cell group): the index rows of a group, split by a salt
where a group is large, and the queries with the cells that they visit in it.
No pair of rows leaves a task, only each query's best.

Defined results: vectors that are null, zero, of another dimension than most,
or hold null or non-finite components take no part; of rows that share an id
the smallest vector (as Spark orders arrays) counts; equal cosines come by id;
equal vectors beyond the
``top`` + 1 smallest ids of each cannot be in a result and are left out of the
index, however many there are; repeated rows count once; a query with fewer
candidates gets all of them; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from tablelens.llm.frames import stored

TABLES, PROJECTIONS, WIDTH = 3, 6, 2.0
REACH = 1  # cells on either side of the query's own, in each projection
SAMPLE, SAMPLE_QUERIES, GOAL = 4096, 256, 0.97
#: Index rows that one task should meet at a time.
GROUP_ROWS = 8192
#: Queries in a block of the pass over all rows.
BLOCK = 2048
#: Pairs whose exact cosines are taken at a time.
PAIRS = 1 << 16

_STEPS = np.stack(np.meshgrid(*[np.arange(-REACH, REACH + 1)] * PROJECTIONS, indexing="ij"), -1).reshape(-1, PROJECTIONS)


def usable(vector: Column) -> Column:
    """Whether the vector has a direction."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def hashing(dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Projections (dims, TABLES * PROJECTIONS) and shifts, from a fixed seed."""
    rng = np.random.default_rng(29)
    return rng.normal(size=(dims, TABLES * PROJECTIONS)), rng.uniform(0, WIDTH, TABLES * PROJECTIONS)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps tiny and huge vectors from under- or overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def places(x: np.ndarray, h: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Cells (n, TABLES, PROJECTIONS) of unit vectors, and where in the cell they lie (0 to 1)."""
    at = (x @ h[0] + h[1]) / WIDTH
    cell = np.floor(at)
    return cell.astype(np.int64).reshape(-1, TABLES, PROJECTIONS), (at - cell).reshape(-1, TABLES, PROJECTIONS)


def code(cell: np.ndarray) -> np.ndarray:
    """One number for each cell (projections of unit vectors lie within a few dozen cells)."""
    return ((cell + 512) * (1024 ** np.arange(PROJECTIONS))).sum(axis=-1)


def chances(inside: np.ndarray, distance: float) -> np.ndarray:
    """Log chance, for each of the steps, that a neighbour at that distance lies in the cell. inside: (n, PROJECTIONS)."""
    edges = np.arange(-REACH, REACH + 2)
    grid = np.linspace(0, 1, 257)
    law = np.array([[0.5 * (1 + erf((e - g) * WIDTH / distance / sqrt(2))) for e in edges] for g in grid])
    part = np.log(np.maximum(np.diff(law, axis=1), 1e-12))[np.rint(inside * 256).astype(int)]  # (n, PROJECTIONS, 2 * REACH + 1)
    return sum(part[:, j][:, _STEPS[:, j] + REACH] for j in range(PROJECTIONS))


def fit(sample: np.ndarray, top: int) -> tuple[int, float]:
    """(probes, usual distance of a neighbour) from unit vectors."""
    n = len(sample)
    if n < 2:
        return len(_STEPS), 1.0
    h = hashing(sample.shape[1])
    q = np.arange(min(n, SAMPLE_QUERIES))
    likeness = sample[q] @ sample.T
    likeness[q, q] = -2
    best = np.argsort(-likeness, axis=1)[:, : min(top, n - 1)]
    distance = float(np.sqrt(np.maximum(1e-6, 2 - 2 * np.take_along_axis(likeness, best, 1))).mean())
    cell, inside = places(sample, h)
    rank = np.full((*best.shape, TABLES), len(_STEPS), np.int64)
    for t in range(TABLES):
        order = np.argsort(-chances(inside[q, t], distance), axis=1, kind="stable")
        position = np.argsort(order, axis=1)
        step = cell[best, t] - cell[q, t][:, None, :]
        near = (np.abs(step) <= REACH).all(axis=2)
        at = ((step + REACH) * ((2 * REACH + 1) ** np.arange(PROJECTIONS - 1, -1, -1))).sum(axis=2)
        rank[..., t] = np.where(near, np.take_along_axis(position, np.where(near, at, 0), 1) + 1, len(_STEPS) + 1)
    need = np.sort(rank.min(axis=2).ravel())
    return int(min(len(_STEPS), need[min(len(need) - 1, int(np.ceil(GOAL * len(need))) - 1)])), distance


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _rows(vectors: DataFrame, dims: int, groups: int) -> DataFrame:
    """Index rows: t, g, cell, id, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hashing(dims)
        for b in batches:
            if not b.num_rows:
                continue
            cells = code(places(unit(_matrix(b.column(1))), h)[0])
            for t in range(TABLES):
                c = cells[:, t]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), t, np.int32)), pa.array(_group(c, groups)), pa.array(c), b.column(0), b.column(1)], names=["t", "g", "cell", "id", "v"])

    out = StructType().add("t", IntegerType()).add("g", LongType()).add("cell", LongType()).add("id", LongType()).add("v", vectors.schema["v"].dataType)
    return vectors.select("id", "v").mapInArrow(run, out)


def _group(cells: np.ndarray, groups: int) -> np.ndarray:
    return (cells * 0x9E3779B1 >> 7) % groups


def _visits(queries: DataFrame, dims: int, groups: int, probes: int, distance: float) -> DataFrame:
    """Visits: t, g, id, v, cells (those of the group that the query visits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hashing(dims)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                cell, inside = places(unit(_matrix(b.column(1))), h)
                for t in range(TABLES):
                    best = np.argsort(-chances(inside[:, t], distance), axis=1, kind="stable")[:, :probes]
                    seen = code(cell[:, t][:, None, :] + _STEPS[best])
                    row, g, c = np.repeat(np.arange(len(seen)), seen.shape[1]), _group(seen, groups).ravel(), seen.ravel()
                    order = np.lexsort((c, g, row))
                    row, g, c = row[order], g[order], c[order]
                    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (g[1:] != g[:-1])))
                    cells = pa.ListArray.from_arrays(pa.array(np.append(first, len(c)).astype(np.int32)), pa.array(c))
                    some = pa.array(row[first])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), t, np.int32)), pa.array(g[first]), b.column(0).take(some), b.column(1).take(some), cells], names=["t", "g", "id", "v", "cells"])

    out = StructType().add("t", IntegerType()).add("g", LongType()).add("id", LongType()).add("v", queries.schema["v"].dataType).add("cells", ArrayType(LongType()))
    return queries.select("id", "v").mapInArrow(run, out)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, in double precision on the vectors as given."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def best_in_group(index: pa.Table, visits: pa.Table, top: int) -> pa.Table:
    """query_id, vec_id, score: each query's best in the cells that it visits."""
    names = ["query_id", "vec_id", "score"]
    kinds = (pa.int64(), pa.int64(), pa.float64())
    if not index.num_rows or not visits.num_rows:
        return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
    index, visits = index.combine_chunks(), visits.combine_chunks()
    order = np.argsort(index["cell"].to_numpy(), kind="stable")
    cells, ids = index["cell"].to_numpy()[order], index["id"].to_numpy()[order]
    raw = _matrix(index["v"].combine_chunks())[order]
    lists = visits["cells"].combine_chunks()
    of, visited = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
    asked, own = _matrix(visits["v"].combine_chunks()), visits["id"].to_numpy()
    x, q = unit(raw), unit(asked)
    by_cell = np.argsort(visited, kind="stable")
    of, visited = of[by_cell], visited[by_cell]
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    slack = 8 * (raw.shape[1] + 8) * np.finfo(float).eps  # more than the product and the exact cosine can differ
    for c in np.unique(visited):
        lo, hi = np.searchsorted(cells, [c, c + 1])
        if lo == hi:
            continue
        a, b = np.searchsorted(visited, [c, c + 1])
        for s in range(a, b, 512):
            who = of[s : min(b, s + 512)]
            near = q[who] @ x[lo:hi].T
            near[own[who][:, None] == ids[None, lo:hi]] = -2
            n = min(top, hi - lo)
            border = np.maximum(np.partition(near, hi - lo - n, axis=1)[:, hi - lo - n] - slack, -1.5)
            at, some = np.nonzero(near >= border[:, None])
            got.append(_best(who[at], some + lo, asked, raw, ids, top))
    if not got:
        return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
    who, row, score = _nearest(*(np.concatenate(z) for z in zip(*got)), ids, top)
    return pa.Table.from_arrays([pa.array(own[who]), pa.array(ids[row]), pa.array(score)], names=names)


def _nearest(who: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's first ``top`` rows by score, then id."""
    order = np.lexsort((ids[row], -score, who))
    who, row, score = who[order], row[order], score[order]
    first = np.arange(len(who)) - np.searchsorted(who, who) < top
    return who[first], row[first], score[first]


def _best(who: np.ndarray, row: np.ndarray, asked: np.ndarray, raw: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries' nearest rows by exact cosine, with the cosine."""
    parts = [cosine(asked[who[i : i + PAIRS]], raw[row[i : i + PAIRS]]) for i in range(0, len(who), PAIRS)]
    return _nearest(who, row, np.concatenate(parts or [np.zeros(0)]), ids, top)


def search(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", top: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of each query's nearest rows. Queries are rows of the same table."""
    spark = vectors.sparkSession
    rows = vectors.filter(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    out = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], out)
    dims, total = sizes[0].d, sizes[0].n
    rows = rows.filter(F.size("v") == dims).groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    chosen = rows.select("id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    sample = rows.select("id", "v").join(F.broadcast(chosen), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    probes, distance = fit(unit(_matrix(sample["v"].combine_chunks())), top)
    groups = max(1, total // GROUP_ROWS)
    # Of equal vectors only the smallest ids can be among the nearest (one more, as a query skips itself).
    alike = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    index = _rows(rows.withColumn("r", alike).filter(F.col("r") <= top + 1), dims, groups)
    visits = _visits(rows.filter("q"), dims, groups, probes, distance)
    # A large group is split by a salt; its visits go to every part.
    parts = index.groupBy("t", "g").agg(F.ceil(F.count("*") / (2 * GROUP_ROWS)).cast("int").alias("parts"))
    index = index.join(parts, ["t", "g"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    visits = visits.join(parts, ["t", "g"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))).drop("parts")
    names = ("t", "g", "salt")
    found = index.groupBy(*names).cogroup(visits.groupBy(*names)).applyInArrow(lambda a, b: best_in_group(a, b, top), "query_id long, vec_id long, score double")
    # Merge the tables' and parts' candidates.
    made = stored(_ranked(found, top))
    # Queries that lie alone: over all rows.
    full = made.groupBy("query_id").count().filter(F.col("count") >= top).select(F.col("query_id").alias("id"))
    short = stored(rows.filter("q").select("id", "v").join(full, "id", "left_anti"))
    left = short.count()
    if not left:
        return made
    again = _ranked(_over_all(rows.withColumn("r", alike).filter(F.col("r") <= top + 1), short, groups, -(-left // BLOCK), top), top)
    return made.join(short, F.col("query_id") == F.col("id"), "left_anti").unionByName(again)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _over_all(index: DataFrame, queries: DataFrame, groups: int, blocks: int, top: int) -> DataFrame:
    """query_id, vec_id, score: the best of every group of index rows for every block of queries."""
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    one = F.lit(0).cast("long")
    a = index.select(F.pmod(F.xxhash64("id"), F.lit(groups)).alias("g"), every(blocks).alias("block"), one.alias("cell"), "id", "v")
    b = queries.select(every(groups).alias("g"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), "id", "v", F.array(one).alias("cells"))
    return a.groupBy("g", "block").cogroup(b.groupBy("g", "block")).applyInArrow(lambda x, y: best_in_group(x, y, top), "query_id long, vec_id long, score double")
