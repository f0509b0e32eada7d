"""Ridge, regression tree and gradient boosting of numbers, on rows kept as binned blocks.

Features are put into bins once, a byte each, and the rows of
a fold are kept in blocks of columns: a row takes a byte for each feature and
eight for the label, and no pass reads a vector.  Every block has its sums of
products, from which any ridge regression follows by subtraction of a fold.

Trees grow level by level, those of all folds in one pass over the blocks:
each task counts rows and adds up residuals by (tree, node, feature, bin), and
sends one row for each tree.  Features with few bins share one count, which is
then split up.  Ties go to the smaller feature, then the smaller cut:

    gain = SL² / nL + SR² / nR − S² / n
    value = S / n

Boosting is that of squared errors: the first tree fits the label, each later
one twice the residual, weighted by ``rate``; a round sees ``share`` of the rows.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.operators.boosting import Boosted, BoostedModel, Settings, Tree, bin_edges
from tablelens.operators.prep import BINS
from tablelens.session import conf_override

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Cells of one count, shared by features with few bins.
CELLS = 2048
#: Rows of a full block, and blocks handed to Python at once.
BLOCK_ROWS, BLOCKS_AT_ONCE = 32_768, 8
#: Sums of tasks that the driver adds up itself; more are added up by tasks first.
MOST_SUMS = 256
#: Number of the rows that no model is fitted on.
HELD_OUT = -1


@dataclass
class Blocks:
    """``frame``: fold, id, label, b, sums — a row for each block. ``rows``: the (x, label, fold) they are made of."""

    frame: DataFrame
    rows: DataFrame
    edges: list[list[float]]
    shift: float
    tasks: int = 1
    sums: dict[int, np.ndarray] = field(default_factory=dict)

    @property
    def width(self) -> int:
        return len(self.edges)

    def fitted_on(self, held: int | None) -> np.ndarray:
        """Sums of products of (1, features, label − shift) over the rows of all folds but ``held`` and ``HELD_OUT``."""
        size = self.width + 2
        return sum((m for f, m in self.sums.items() if f not in (held, HELD_OUT)), np.zeros((size, size)))

    def spread(self, fold: int) -> float:
        """Summed squared differences of a fold's labels from their mean."""
        m = self.sums[fold]
        return float(m[-1, -1] - m[0, -1] ** 2 / m[0, 0])

    def unpersist(self) -> None:
        self.frame.unpersist()


def _summed(parts: DataFrame, tasks: int) -> dict[int, np.ndarray]:
    """key → the sum of its arrays in (key int, v binary), a row for each task and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _added(kv for b in batches for kv in zip(b.column("key").to_pylist(), b.column("v")))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["key", "v"])

    if tasks > MOST_SUMS:
        parts = parts.repartition(int(tasks**0.5)).mapInArrow(run, "key int, v binary")
    with conf_override(parts.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BLOCKS_AT_ONCE)):
        return _added((r["key"], r["v"]) for r in parts.collect())  # a row for each tree and task


def _added(pairs) -> dict[int, np.ndarray]:
    total: dict[int, np.ndarray] = {}
    for key, v in pairs:
        v = np.frombuffer(v.as_buffer() if isinstance(v, pa.Scalar) else v, float)
        total[key] = total[key] + v if key in total else v.copy()
    return total


def blocks_of(rows: DataFrame, edges: list[list[float]], shift: float = 0.0) -> Blocks:
    """Blocks of (x array<double> without gaps, label double, fold int), with the features cut at ``edges`` (255 at most)."""
    width = len(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        waiting: dict[int, list] = {}
        cuts = [np.array(e) for e in edges]

        def block(fold: int) -> pa.RecordBatch:
            nonlocal number
            number += 1
            x, y = (np.concatenate(a) for a in zip(*waiting.pop(fold)))
            b = np.empty((width, len(x)), np.uint8)
            for i, e in enumerate(cuts):
                b[i] = x[:, i] > e[0] if len(e) == 1 else np.searchsorted(e, np.ascontiguousarray(x[:, i]), side="left")
            z = np.column_stack([np.ones(len(x)), x, y - shift])
            return pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([number], pa.int64()), *[pa.array([a.tobytes()], pa.binary()) for a in (y, b, z.T @ z)]], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            fold, y = np.asarray(batch.column("fold")), np.asarray(batch.column("label"), float)
            x = np.asarray(batch.column("x").flatten(), float).reshape(len(y), -1)
            for f in np.unique(fold).tolist():
                at = fold == f
                waiting.setdefault(f, []).append((x[at], y[at]))
                if sum(len(a) for _, a in waiting[f]) >= BLOCK_ROWS:
                    yield block(f)
        for f in sorted(waiting):
            yield block(f)

    names = ["fold", "id", "label", "b", "sums"]
    frame = rows.select("x", "label", "fold").mapInArrow(run, "fold int, id long, label binary, b binary, sums binary").cache()
    made = Blocks(frame, rows, edges, shift)
    # counted in a job of its own: the first pass over a kept frame fills it with batches of usual size
    frame.count()
    made.tasks = frame.rdd.getNumPartitions()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _added(kv for b in batches for kv in zip(b.column("fold").to_pylist(), b.column("sums")))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())], names=["key", "v"])

    found = _summed(frame.select("fold", "sums").mapInArrow(total, "key int, v binary"), made.tasks)
    made.sums = {f: v.reshape(width + 2, width + 2) for f, v in found.items()}
    return made


def correlations(sums: np.ndarray) -> list[float | None]:
    """Pearson r of each feature with the label; None where one of them does not vary."""
    n, mean = sums[0, 0], sums[0] / max(sums[0, 0], 1.0)
    spread = sums - n * np.outer(mean, mean)
    own = np.diag(spread)
    # a constant leaves rounding only
    varies = own > 1e-12 * np.maximum(np.diag(sums), 1e-300)
    return [float(spread[i, -1] / np.sqrt(own[i] * own[-1])) if varies[i] and varies[-1] else None for i in range(1, len(sums) - 1)]


# -- trees ---------------------------------------------------------------------

def shared_counts(bins: list[int]) -> list[list[int]]:
    """Features of one count each: neighbours whose bins multiply to ``CELLS`` at most."""
    groups: list[list[int]] = []
    size = 0
    for i, n in enumerate(bins):
        if groups and size * n <= CELLS:
            groups[-1].append(i)
            size *= n
        else:
            groups.append([i])
            size = n
    return groups


def places(tree: Tree, b: np.ndarray, levels: int) -> np.ndarray:
    """Where in its level each row (a column of ``b``) is after ``levels`` cuts; rows in a leaf go left."""
    at = np.zeros(b.shape[1], np.uint8 if levels <= 8 else np.uint32)
    for level in range(levels):
        right = np.zeros(len(at), bool)
        first = 2**level - 1
        for i in range(2**level):
            f = tree.feature[first + i]
            if f >= 0:
                right |= (b[f] > tree.cut_bin[first + i]) & (at == i) if level else b[f] > tree.cut_bin[0]
        at <<= 1
        at |= right
    return at


def end_values(tree: Tree, levels: int) -> np.ndarray:
    """The value of each place after ``levels`` cuts."""
    node = np.zeros(2**levels, np.int64)
    for bit in range(levels - 1, -1, -1):
        inner = np.array(tree.feature)[node] >= 0
        node = np.where(inner, 2 * node + 1 + ((np.arange(2**levels) >> bit) & 1), node)
    return np.array(tree.value)[node]


def _depth(tree: Tree) -> int:
    return (len(tree.feature) + 1).bit_length() - 2


def raised(raw: np.ndarray, trees: list[tuple[Tree, int, np.ndarray]], b: np.ndarray) -> np.ndarray:
    for tree, depth, values in trees:
        raw += values[places(tree, b, depth)]
    return raw


def _ready(rounds: list[list[Tree]]) -> list[tuple[Tree, int, np.ndarray]]:
    return [(t, _depth(t), end_values(t, _depth(t))) for (t,) in rounds]


def _blocks_in(batches: Iterator[pa.RecordBatch], width: int):
    for batch in batches:
        folds, ids = batch.column("fold").to_pylist(), batch.column("id").to_pylist()
        for fold, number, y, b in zip(folds, ids, batch.column("label"), batch.column("b")):
            y = np.frombuffer(y.as_buffer(), float)
            yield fold, number, y, np.frombuffer(b.as_buffer(), np.uint8).reshape(width, len(y))


def level_sums(blocks: Blocks, held: list[int | None], made: list[Boosted], growing: list[Tree], open_nodes: list[list[int]],
               level: int, number: int) -> dict[int, np.ndarray]:
    """Model → rows and summed residuals (2, open nodes, bins of all features): of its open nodes, in one pass."""
    bins = [len(e) + 1 for e in blocks.edges]
    groups, width = shared_counts(bins), blocks.width
    s = made[0].settings
    sent = blocks.frame.sparkSession.sparkContext.broadcast((made, growing, open_nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, growing, open_nodes = sent.value
        first = 2**level - 1
        sizes = [int(np.prod([bins[i] for i in g])) for g in groups]
        totals = [[np.zeros((2, (len(nodes) + 1) * size)) for size in sizes] for nodes in open_nodes]
        done = [_ready(m.rounds) for m in made]
        slots = []
        for nodes in open_nodes:
            slot = np.full(2**level, len(nodes))  # the last is that of rows which are not counted
            slot[np.array(nodes, int) - first] = np.arange(len(nodes))
            slots.append(slot)
        for fold, block, y, b in _blocks_in(batches, width):
            mine = [k for k, h in enumerate(held) if fold not in (h, HELD_OUT) and open_nodes[k]]
            if not mine:
                continue
            codes = []
            for g in groups:
                code = b[g[0]].astype(np.int64)
                for i in g[1:]:
                    code *= bins[i]
                    code += b[i]
                codes.append(code)
            out = None
            if s.share < 1:
                out = np.random.Generator(np.random.SFC64([s.seed, number, block])).random(len(y), np.float32) >= s.share
            for k in mine:
                raw = raised(np.full(len(y), made[k].base[0]), done[k], b)
                rest = y - raw if number == 0 else 2 * (y - raw)
                slot = slots[k][places(growing[k], b, level)]
                if out is not None:
                    slot[out] = len(open_nodes[k])
                for t, code, size in zip(totals[k], codes, sizes):
                    cell = slot * size
                    cell += code
                    t[0] += np.bincount(cell, minlength=t.shape[1])
                    t[1] += np.bincount(cell, rest, minlength=t.shape[1])
        for k, of_group in enumerate(totals):
            if open_nodes[k]:
                sums = []
                for g, t in zip(groups, of_group):
                    t = t.reshape(2, len(open_nodes[k]) + 1, *[bins[i] for i in g])[:, :-1]
                    sums += [t.sum(axis=tuple(2 + j for j in range(len(g)) if j != i)) for i in range(len(g))]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.concatenate(sums, axis=2).tobytes()], pa.binary())], names=["key", "v"])

    with conf_override(blocks.frame.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BLOCKS_AT_ONCE)):
        found = _summed(blocks.frame.select("fold", "id", "label", "b").mapInArrow(run, "key int, v binary"), blocks.tasks)
    sent.destroy()
    return {k: v.reshape(2, len(open_nodes[k]), sum(bins)) for k, v in found.items()}


def grown(blocks: Blocks, held: list[int | None], s: Settings) -> list[Boosted]:
    """A model for each of ``held``, fitted on the rows of all other folds; all side by side."""
    made, scale = [], []
    for h in held:
        m = blocks.fitted_on(h)
        mean = m[0, -1] / max(m[0, 0], 1.0)
        made.append(Boosted(s, [float(blocks.shift + mean)], blocks.edges))
        scale.append(float(m[-1, -1] - m[0, 0] * mean * mean))
    bins = [len(e) + 1 for e in blocks.edges]
    starts = np.cumsum([0, *bins])
    for number in range(s.rounds):
        weight = 1.0 if number == 0 else s.rate
        trees = [Tree.empty(s.depth) for _ in held]
        open_nodes = [[0] for _ in held]
        for level in range(s.depth):
            if not any(open_nodes):
                break
            found = level_sums(blocks, held, made, trees, open_nodes, level, number)
            for k, nodes in enumerate(open_nodes):
                open_nodes[k] = []
                for j, i in enumerate(nodes):
                    if k in found:
                        open_nodes[k] += _cut(trees[k], i, found[k][:, j], starts, blocks.edges, s, weight, scale[k])
        for m, t in zip(made, trees):
            m.rounds.append([t])
    return made


def _cut(tree: Tree, node: int, sums: np.ndarray, starts: np.ndarray, edges: list[list[float]], s: Settings, weight: float, scale: float) -> list[int]:
    """Cut the node where it gains most, if anywhere; its children."""
    best = None
    for f, e in enumerate(edges):
        n, r = sums[:, starts[f]:starts[f + 1]]
        nl, rl, na, ra = np.cumsum(n)[:-1], np.cumsum(r)[:-1], n.sum(), r.sum()
        if node == 0 and f == 0 and na:
            tree.value[0] = weight * ra / na
        able = (nl >= s.least_rows) & (na - nl >= s.least_rows)
        if not able.any():
            continue
        safe = np.where(able, nl, 1), np.where(able, na - nl, 1)
        gain = np.where(able, rl**2 / safe[0] + (ra - rl) ** 2 / safe[1] - ra**2 / max(na, 1), 0.0)
        part = np.round(gain / scale, 12) if scale > 0 else np.zeros(len(gain))
        c = int(part.argmax())
        if part[c] > 0 and (best is None or part[c] > best[0]):
            best = part[c], f, c, gain[c], (rl[c] / nl[c], (ra - rl[c]) / (na - nl[c]))
    if best is None:
        return []
    _, f, c, gain, values = best
    tree.feature[node], tree.cut_bin[node], tree.cut[node], tree.gain[node] = f, c, float(edges[f][c]), float(gain)
    children = [2 * node + 1, 2 * node + 2]
    for child, v in zip(children, values):
        tree.value[child] = float(weight * v)
    return children


class OnBlocks(Estimator):
    """Estimator on ``features`` and ``label`` that fits from blocks: the models of several folds side by side."""

    def fitted(self, blocks: Blocks, held: list[int | None]) -> list[Model]:
        raise NotImplementedError

    def predicted(self, blocks: Blocks, models: dict[int, Model]) -> DataFrame:
        """(fold, label, prediction) of the rows of the folds in ``models``."""
        raise NotImplementedError

    def left(self, blocks: Blocks, models: dict[int, Model]) -> dict[int, float]:
        """Summed squared residuals of each fold in ``models``, in one pass."""
        rest = F.col("label") - F.col("prediction")
        found = self.predicted(blocks, models).groupBy("fold").agg(F.sum(rest * rest).alias("left"))
        return {r["fold"]: r["left"] for r in found.collect()}  # a row for each fold

    def _fit(self, df: DataFrame) -> Model:
        width = len(df.select("features").first()["features"])
        rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"), F.lit(0).alias("fold"))
        blocks = blocks_of(rows, bin_edges(rows.select("x"), width, BINS), rows.agg(F.avg("label")).first()[0] or 0.0)
        try:
            return self.fitted(blocks, [None])[0]
        finally:
            blocks.unpersist()


class RegressionTrees(OnBlocks):
    """A tree (one round) or gradient boosting."""

    def __init__(self, settings: Settings | None = None):
        super().__init__()
        self.settings = settings or Settings(rounds=1, least_rows=1, l2=0.0)

    def fitted(self, blocks: Blocks, held: list[int | None]) -> list[BoostedModel]:
        return [BoostedModel(m) for m in grown(blocks, held, self.settings)]

    def predicted(self, blocks: Blocks, models: dict[int, Model]) -> DataFrame:
        width, frame = blocks.width, blocks.frame
        sent = frame.sparkSession.sparkContext.broadcast({f: m.boosted for f, m in models.items()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready = {f: (m.base[0], _ready(m.rounds)) for f, m in sent.value.items()}
            for fold, _, y, b in _blocks_in(batches, width):
                base, trees = ready[fold]
                raw = raised(np.full(len(y), base), trees, b)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), fold, np.int32)), pa.array(y), pa.array(raw)], names=["fold", "label", "prediction"])

        wanted = frame.where(F.col("fold").isin(list(models))).select("fold", "id", "label", "b")
        return wanted.mapInArrow(run, "fold int, label double, prediction double")


class RidgeModel(Model):
    """Transformer: ``prediction``."""

    def __init__(self, coefficients: list[float] | None = None, intercept: float = 0.0):
        super().__init__()
        self.coefficients, self.intercept = DenseVector(coefficients or []), intercept

    def _transform(self, df: DataFrame) -> DataFrame:
        x = vector_to_array("features")
        c = F.array(*[F.lit(v) for v in self.coefficients.toArray().tolist()])
        dot = F.aggregate(F.zip_with(x, c, lambda a, b: a * b), F.lit(float(self.intercept)), lambda a, b: a + b)
        return df.select(*[F.col(f"`{n}`") for n in df.columns], dot.alias("prediction"))

    # -- persistence: one row of JSON -------------------------------------------------

    def write(self):
        return self

    def overwrite(self):
        return self

    def save(self, path: str) -> None:
        text = json.dumps({"coefficients": self.coefficients.toArray().tolist(), "intercept": self.intercept})
        SparkSession.getActiveSession().createDataFrame([(text,)], "model string").write.mode("overwrite").json(path)

    @classmethod
    def load(cls, path: str) -> RidgeModel:
        return cls(**json.loads(SparkSession.getActiveSession().read.json(path).first()["model"]))


class Ridge(OnBlocks):
    """Least squares with the penalty ``alpha`` on the squared coefficients, in closed form; the intercept is free."""

    def __init__(self, alpha: float = 1.0):
        super().__init__()
        self.alpha = alpha

    def fitted(self, blocks: Blocks, held: list[int | None]) -> list[RidgeModel]:
        made = []
        for h in held:
            m = blocks.fitted_on(h)
            n, mean = m[0, 0], m[0] / max(m[0, 0], 1.0)
            centred = m - n * np.outer(mean, mean)
            a = centred[1:-1, 1:-1] + self.alpha * np.eye(blocks.width)
            coefficients = np.linalg.lstsq(a, centred[1:-1, -1], rcond=None)[0]
            made.append(RidgeModel(coefficients.tolist(), float(blocks.shift + mean[-1] - coefficients @ mean[1:-1])))
        return made

    def predicted(self, blocks: Blocks, models: dict[int, Model]) -> DataFrame:
        made = {f: (m.coefficients.toArray(), m.intercept) for f, m in models.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                fold = np.asarray(batch.column("fold"))
                x = np.asarray(batch.column("x").flatten(), float).reshape(len(fold), -1)
                out = np.empty(len(fold))
                for f in np.unique(fold).tolist():
                    out[fold == f] = x[fold == f] @ made[f][0] + made[f][1]
                yield pa.RecordBatch.from_arrays([batch.column("fold"), batch.column("label"), pa.array(out)], names=["fold", "label", "prediction"])

        wanted = blocks.rows.where(F.col("fold").isin(list(models))).select("fold", "label", "x")
        return wanted.mapInArrow(run, "fold int, label double, prediction double")

    def left(self, blocks: Blocks, models: dict[int, Model]) -> dict[int, float]:
        """From the sums of each fold alone."""
        out = {}
        for f, m in models.items():
            v = np.array([blocks.shift - m.intercept, *-m.coefficients.toArray(), 1.0])
            out[f] = max(0.0, float(v @ blocks.sums[f] @ v))
        return out
