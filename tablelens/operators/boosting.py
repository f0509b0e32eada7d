"""Histogram gradient boosting with an L2 term, for numbers and for two or more classes.

Features are put into at most ``bins`` bins once.  A level of all trees of a
round is one pass over the rows: each task adds up gradients, hessians and rows
by (class, node, feature, bin), one aggregate adds up the tasks' sums, and
running sums over the bins score every split.  The best split of each node by
each feature reaches the driver, a row each, and the best one's two sides are
the leaf values:

    gain = GL² / (HL + l2) + GR² / (HR + l2) − G² / (H + l2)
    value = −rate · G / (H + l2)

Gradients are those of the squared error, of the logistic loss for two classes
and of the softmax loss for more, one tree a class and round.  So every class
has a probability, and they add up to 1.

Trees grow level by level; ties go to the smaller feature, then the smaller
bin.  A feature of at most ``bins`` distinct values is cut midway between each
two of them, any other at its quantiles.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tablelens.session import ensure_checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rounds after which the scores so far are written down.
WRITTEN_ROUNDS = 10
#: Rows that a task has at least, if there are so many: a level's pass is short.
TASK_ROWS = 25_000
#: Features whose quantiles are aggregates of their own; more are unpivoted.
SKETCHED_TOGETHER = 60


@dataclass
class Settings:
    """How to boost. ``classes`` 0 is regression."""

    classes: int = 0
    rounds: int = 80
    depth: int = 8
    least_rows: int = 5
    l2: float = 0.05
    rate: float = 0.1
    bins: int = 255
    #: Share of the rows that a round sees.
    share: float = 1.0
    seed: int = 42

    @property
    def outputs(self) -> int:
        return self.classes if self.classes > 2 else 1


@dataclass
class Tree:
    """Nodes as a heap: the children of i are 2i + 1 (at most the cut) and 2i + 2. A leaf has feature −1."""

    feature: list[int]
    cut_bin: list[int]
    cut: list[float]
    value: list[float]
    gain: list[float]

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls([-1] * n, [0] * n, [0.0] * n, [0.0] * n, [0.0] * n)


def nodes_of(tree: Tree, x: np.ndarray, binned: bool) -> np.ndarray:
    """The leaf, or the open node, that each row is in."""
    feature, cut = np.array(tree.feature), np.array(tree.cut_bin if binned else tree.cut)
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while True:
        f = feature[node]
        if (f < 0).all():
            return node
        node = np.where(f < 0, node, 2 * node + 1 + (x[rows, f] > cut[node]))


def added(raw: np.ndarray, rounds: list[list[Tree]], x: np.ndarray, binned: bool) -> np.ndarray:
    """Scores (rows by outputs) with the rounds' leaf values added."""
    out = raw.copy()
    for trees in rounds:
        for k, t in enumerate(trees):
            out[:, k] += np.array(t.value)[nodes_of(t, x, binned)]
    return out


def gradients(raw: np.ndarray, label: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of each output."""
    if classes == 0:
        return raw - label[:, None], np.ones_like(raw)
    p = probabilities(raw)
    hit = (label[:, None] == np.arange(classes)).astype(float)
    if classes <= 2:
        p, hit = p[:, 1:], (label[:, None] == 1).astype(float)
    return p - hit, p * (1 - p)


def probabilities(raw: np.ndarray) -> np.ndarray:
    """Of each class, from one score (two classes) or one a class."""
    if raw.shape[1] == 1:
        p = 1 / (1 + np.exp(-raw))
        return np.hstack([1 - p, p])
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return np.asarray(column.flatten(), kind).reshape(len(column), -1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bin_edges(x: DataFrame, width: int, bins: int) -> list[list[float]]:
    """Ascending cuts of each of the ``width`` entries of the array column ``x``."""
    values: dict[int, list[float]] = {}
    for r in few_values(x, width, bins).collect():  # at most ``bins`` values a feature
        values[r.i] = sorted(r["values"])
    many = [i for i, v in values.items() if not v]
    quantiles: dict[int, list[float]] = {}
    share = [(k + 1) / bins for k in range(bins - 1)]
    if 0 < len(many) <= SKETCHED_TOGETHER:  # the other features' cuts are known
        row = x.agg(*[F.percentile_approx(F.col("x")[i], share, 100 * bins).alias(f"q{i}") for i in many]).first()
        quantiles = {i: row[f"q{i}"] for i in many}
    elif many:
        long = x.select(F.posexplode("x").alias("i", "v")).filter(F.col("i").isin(many))
        quantiles = {r.i: r.q for r in long.groupBy("i").agg(F.percentile_approx("v", share, 100 * bins).alias("q")).collect()}  # a row for each feature
    return [sorted(set(quantiles[i])) if i in quantiles else [(a + b) / 2 for a, b in zip(values.get(i, []), values.get(i, [])[1:])] for i in range(width)]


def few_values(x: DataFrame, width: int, most: int) -> DataFrame:
    """i, values: the distinct values of each entry of the array column ``x``; none if there are more than ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray | None] = [np.zeros(0)] * width  # None: too many
        for b in batches:
            m = _matrix(b.column("x"), float) if b.num_rows else np.zeros((0, width))
            for i in (i for i, v in enumerate(seen) if v is not None):
                had, v = seen[i], m[:, i]
                if len(had):  # mostly nothing is new, and nothing is sorted then
                    v = v[had[np.minimum(np.searchsorted(had, v), len(had) - 1)] != v]
                if len(v):
                    v = np.union1d(had, v)
                    seen[i] = v if len(v) <= most else None
        found = [(i, v) for i, vs in enumerate(seen) for v in ([None] if vs is None else vs.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int32()), pa.array([v for _, v in found], pa.float64())], names=["i", "v"])

    each = x.select("x").filter("x IS NOT NULL").mapInArrow(run, "i int, v double").distinct()
    few = (F.count(F.lit(1)) <= most) & (F.count_if(F.col("v").isNull()) == 0)
    return each.groupBy("i").agg(F.when(few, F.collect_list("v")).otherwise(F.array().cast("array<double>")).alias("values"))


def histograms(rows: DataFrame, done: list[list[Tree]], growing: list[Tree], open_nodes: list[list[int]], s: Settings, width: int, number: int) -> DataFrame:
    """output, node, feature, bin, g, h, n: sums over the rows (id, b, label, raw) in open nodes."""
    sent = rows.sparkSession.sparkContext.broadcast((done, growing, open_nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, growing, open_nodes = sent.value
        size = s.bins + 1
        totals = [np.zeros((3, len(nodes) * width * size)) for nodes in open_nodes]
        for batch in batches:
            if not batch.num_rows:
                continue
            b, raw, label = _matrix(batch.column("b"), np.int64), _matrix(batch.column("raw"), float), np.asarray(batch.column("label"), float)
            if s.share < 1:
                u = _mixed(np.asarray(batch.column("id")).astype(np.uint64) * np.uint64(1_000_003) + np.uint64(number * 7919 + s.seed))
                some = (u >> np.uint64(11)).astype(float) / 2**53 < s.share
                b, raw, label = b[some], raw[some], label[some]
            g, h = gradients(added(raw, done, b, True), label, s.classes)
            for k, nodes in enumerate(open_nodes):
                if not nodes:
                    continue
                slot = np.full(len(growing[k].feature), -1)
                slot[nodes] = np.arange(len(nodes))
                mine = slot[nodes_of(growing[k], b, True)]
                at = np.flatnonzero(mine >= 0)
                cell = (((mine[at, None] * width) + np.arange(width)) * size + b[at]).ravel()
                for t, w in zip(totals[k], (g[at, k], h[at, k], np.ones(len(at)))):
                    t += np.bincount(cell, np.repeat(w, width), minlength=len(t))
        for k, t in enumerate(totals):
            some = np.flatnonzero(t[2])
            node = np.array(open_nodes[k], np.int64)[some // (width * size)]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in (np.full(len(some), k, np.int32), node, some // size % width, some % size, t[0][some], t[1][some], t[2][some])], names=names)

    names = ["output", "node", "feature", "bin", "g", "h", "n"]
    parts = rows.mapInArrow(run, "output int, node long, feature long, bin long, g double, h double, n double")
    # dealt once by what the running sums need; the tasks' sums are partial sums already
    return parts.repartition("output", "node", "feature").groupBy("output", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))


def best_splits(sums: DataFrame, s: Settings) -> DataFrame:
    """output, node, feature, bin, gain, and the sums g, h of the left (l) and right (r) side: the best split by each feature of each node."""
    whole = Window.partitionBy("output", "node", "feature")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sides = sums.select("output", "node", "feature", "bin", *[F.sum(c).over(upto).alias(f"{c}l") for c in "ghn"], *[F.sum(c).over(whole).alias(c) for c in "ghn"])
    sides = sides.select("*", *[(F.col(c) - F.col(f"{c}l")).alias(f"{c}r") for c in "ghn"])
    part = lambda g, h: F.col(g) * F.col(g) / (F.col(h) + s.l2)
    gain = F.round(part("gl", "hl") + part("gr", "hr") - part("g", "h"), 9)
    able = sides.filter((F.col("nl") >= s.least_rows) & (F.col("nr") >= s.least_rows) & (F.col("hl") + s.l2 > 0) & (F.col("hr") + s.l2 > 0)).withColumn("gain", gain).filter("gain > 0")
    row = F.struct(F.col("gain"), -F.col("bin"), *[F.col(c) for c in ("gl", "hl", "gr", "hr")])
    return able.groupBy("output", "node", "feature").agg(F.max(row).alias("x")).select(
        "output", "node", "feature", (-F.col("x.col2")).alias("bin"), "x.gain", "x.gl", "x.hl", "x.gr", "x.hr")


@dataclass
class Boosted:
    settings: Settings
    base: list[float]
    edges: list[list[float]]
    rounds: list[list[Tree]] = field(default_factory=list)

    def gains(self) -> list[float]:
        """Summed gain of each feature's splits, as a share of all."""
        total = np.zeros(len(self.edges))
        for trees in self.rounds:
            for t in trees:
                for f, g in zip(t.feature, t.gain):
                    if f >= 0:
                        total[f] += g
        return (total / (total.sum() or 1.0)).tolist()


def boost(frame: DataFrame, s: Settings, x: str = "x", label: str = "label") -> Boosted:
    """Fit on an array column of features without gaps and a label (a number, or the class 0, 1, 2...)."""
    ensure_checkpoint_dir(frame.sparkSession)
    plain = frame.select(F.col(x).cast("array<double>").alias("x"), F.col(label).cast("double").alias("label"))
    numbers = [F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width"), F.avg("label").alias("mean")]
    found = (plain.groupBy("label").agg(*numbers) if s.classes else plain.agg(*numbers)).collect()  # a row for each class
    total, width = sum(r.n for r in found), max((r.width or 0 for r in found), default=0)
    edges = bin_edges(plain, width, s.bins)
    if s.classes == 0:
        base = [found[0].mean or 0.0]
    else:
        counts = {int(r.label): r.n for r in found}
        logs = np.log([max(counts.get(k, 0), 1e-9) for k in range(max(s.classes, 2))])
        base = [float(logs[1] - logs[0])] if s.classes <= 2 else (logs - logs.mean()).tolist()
    made = Boosted(s, base, edges)

    def put_in_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column("x"), float) if b.num_rows else np.zeros((0, width))
            out = np.stack([np.searchsorted(np.array(e), m[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.int16) if width else np.zeros((len(m), 0), np.int16)
            ends = np.arange(0, out.size + 1, max(width, 1), dtype=np.int32)[: len(m) + 1]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel())), b.column("label"), b.column("raw")], names=["id", "b", "label", "raw"])

    start = plain.select(F.monotonically_increasing_id().alias("id"), "x", "label", F.array(*[F.lit(v) for v in base]).alias("raw"))
    start = start.coalesce(-(-max(total, 1) // TASK_ROWS))
    rows = start.mapInArrow(put_in_bins, "id long, b array<smallint>, label double, raw array<double>").checkpoint()
    since: list[list[Tree]] = []
    for number in range(s.rounds):
        trees = [Tree.empty(s.depth) for _ in range(s.outputs)]
        open_nodes = [[0] for _ in trees]
        for _ in range(s.depth):
            if not any(open_nodes):
                break
            found = best_splits(histograms(rows, since, trees, open_nodes, s, width, number), s).collect()  # a row for each open node and feature
            open_nodes = [[] for _ in trees]
            best = {}
            for r in sorted(found, key=lambda r: (-r.gain, r.feature)):
                best.setdefault((r.output, r.node), r)
            for r in best.values():
                t, i = trees[r.output], r.node
                t.feature[i], t.cut_bin[i], t.cut[i], t.gain[i] = r.feature, r.bin, edges[r.feature][r.bin], r.gain
                for child, g, h in ((2 * i + 1, r.gl, r.hl), (2 * i + 2, r.gr, r.hr)):
                    t.value[child] = -s.rate * g / (h + s.l2)
                    open_nodes[r.output].append(child)
        if not any(f >= 0 for t in trees for f in t.feature):
            break  # nothing is left to gain
        made.rounds.append(trees)
        since.append(trees)
        if len(since) == WRITTEN_ROUNDS and number + 1 < s.rounds:
            rows = _with_scores(rows, since).checkpoint()
            since = []
    return made


def _with_scores(rows: DataFrame, rounds: list[list[Tree]]) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                raw = added(_matrix(b.column("raw"), float), sent.value, _matrix(b.column("b"), np.int64), True)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("b"), b.column("label"), _list(raw)], names=["id", "b", "label", "raw"])

    return rows.mapInArrow(run, rows.schema)


def _list(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))


def scores(df: DataFrame, model: Boosted, x: str, out: str) -> DataFrame:
    """The rows with the model's output scores as an array column."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    # only the features go to Python
    @F.arrow_udf(ArrayType(DoubleType()))
    def raw(x: pa.Array) -> pa.Array:
        m = sent.value
        return _list(added(np.tile(np.array(m.base), (len(x), 1)), m.rounds, _matrix(x, float), False)) if len(x) else pa.array([], pa.list_(pa.float64()))

    return df.select("*", raw(F.col(x).cast("array<double>")).alias(out))


class BoostedModel(Model):
    """Transformer: ``prediction``, and for classes ``probability``."""

    def __init__(self, boosted: Boosted | None = None):
        super().__init__()
        self.boosted = boosted

    @property
    def featureImportances(self) -> DenseVector:
        return DenseVector(self.boosted.gains())

    def _transform(self, df: DataFrame) -> DataFrame:
        names = df.columns
        made = scores(df.withColumn("__x", vector_to_array("features")), self.boosted, "__x", "__raw").drop("__x")
        kept = [F.col(f"`{c}`") for c in names]
        if self.boosted.settings.classes == 0:
            return made.select(*kept, F.col("__raw")[0].alias("prediction"))
        raw = F.col("__raw")
        if self.boosted.settings.classes <= 2:
            p = 1 / (1 + F.exp(-raw[0]))
            probability = F.array(1 - p, p)
        else:
            e = F.transform(raw, lambda v: F.exp(v - F.array_max(raw)))
            probability = F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
        made = made.select(*kept, probability.alias("__p"))
        best = (F.array_position("__p", F.array_max("__p")) - 1).cast("double")
        return made.select(*kept, array_to_vector("__p").alias("probability"), best.alias("prediction"))

    # -- persistence: one row of JSON -------------------------------------------------

    def write(self):
        return self

    def overwrite(self):
        return self

    def save(self, path: str) -> None:
        text = json.dumps(asdict(self.boosted))
        SparkSession.getActiveSession().createDataFrame([(text,)], "model string").write.mode("overwrite").json(path)

    @classmethod
    def load(cls, path: str) -> BoostedModel:
        d = json.loads(SparkSession.getActiveSession().read.json(path).first()["model"])
        return cls(Boosted(Settings(**d["settings"]), d["base"], d["edges"], [[Tree(**t) for t in r] for r in d["rounds"]]))


class HistBoosting(Estimator):
    """Estimator on the columns ``features`` and ``label``."""

    def __init__(self, settings: Settings | None = None):
        super().__init__()
        self.settings = settings or Settings()

    def _fit(self, df: DataFrame) -> BoostedModel:
        return BoostedModel(boost(df.select(vector_to_array("features").alias("x"), "label"), self.settings))
