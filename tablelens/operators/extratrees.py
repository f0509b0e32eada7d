"""Extra trees: forests whose cuts are drawn at random, for numbers and for classes (A3).

All trees grow together, level by level, and every tree sees all rows.  A level
is two passes over the rows:

* the least and greatest value of each feature in each open node.  Of the
  features that vary there, ``tries`` are drawn, each with one cut between the
  two, by a hash of (seed, tree, node, feature);
* the sums on both sides of each drawn cut, all in one aggregate.  The cut with
  the greatest gain splits the node:

    gain = Σ VL² / NL + Σ VR² / NR − Σ (VL + VR)² / (NL + NR)

V are the rows of each class (the Gini index), or the sum of the centred label
(the variance); N are the rows.  A cut must leave ``least_rows`` rows on both
sides.  Ties go to the smaller feature.  A leaf holds the shares of the classes,
or the mean label; the forest's answer is the mean over its trees.

Nodes are passed over in groups of at most ``CELLS`` sums a task, so a task's
memory does not grow with the number of rows, trees or nodes.  The driver holds
the model: one row for each node.
"""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Sums that a task holds in one pass.
CELLS = 4_000_000
#: Rows that a task has at least, if there are so many.
TASK_ROWS = 25_000


@dataclass
class Settings:
    """How to grow. ``classes`` 0 is regression; ``tries`` 0 draws a cut for every feature."""

    classes: int = 0
    trees: int = 50
    depth: int = 12
    least_rows: int = 2
    tries: int = 0
    seed: int = 42


@dataclass
class Tree:
    """Nodes in the order of their making: ``left`` is the place of the left child, the right one follows it. A leaf has feature −1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    value: list[list[float]] = field(default_factory=lambda: [[]])

    def split(self, node: int, feature: int, cut: float, gain: float, values: list[list[float]]) -> list[int]:
        """The node's two children."""
        self.feature[node], self.cut[node], self.gain[node], self.left[node] = feature, cut, gain, len(self.feature)
        for v in values:
            for column, first in ((self.feature, -1), (self.cut, 0.0), (self.left, 0), (self.gain, 0.0), (self.value, v)):
                column.append(first)
        return [self.left[node], self.left[node] + 1]


@dataclass
class Forest:
    settings: Settings
    width: int
    trees: list[Tree]

    def gains(self) -> list[float]:
        """Mean over the trees of each feature's share of the tree's gain, as shares of all."""
        total = np.zeros(self.width)
        for t in self.trees:
            own = np.zeros(self.width)
            for f, g in zip(t.feature, t.gain):
                if f >= 0:
                    own[f] += g
            total += own / (own.sum() or 1.0)
        return (total / (total.sum() or 1.0)).tolist()


def nodes_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf, or the open node, that each row is in."""
    feature, cut, left = np.array(tree.feature), np.array(tree.cut), np.array(tree.left)
    node = np.zeros(len(x), np.int64)
    moving = np.flatnonzero(feature[node] >= 0)
    while len(moving):
        at = node[moving]
        node[moving] = left[at] + (x[moving, feature[at]] > cut[at])
        moving = moving[feature[node[moving]] >= 0]
    return node


def answers(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Mean of the leaves' values over the trees, a row each."""
    out = 0.0
    for t in forest.trees:
        values = np.zeros((len(t.feature), max(1, forest.settings.classes)))
        for i, f in enumerate(t.feature):
            if f < 0:
                values[i] = t.value[i]
        out = out + values[nodes_of(t, x)]
    return out / len(forest.trees)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def _batch(names: list[str], *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=names)


def _slots(trees: dict[int, Tree], nodes: list[tuple[int, int]]) -> list[tuple[Tree, np.ndarray, int, int]]:
    """For each tree with open nodes: the place of each of its nodes in ``nodes`` (sorted) or −1, and the first and end of its places."""
    own = np.array(nodes, np.int64).reshape(-1, 2)
    out = []
    for number, tree in trees.items():
        first, end = np.searchsorted(own[:, 0], [number, number + 1])
        slot = np.full(len(tree.feature), -1)
        slot[own[first:end, 1]] = np.arange(first, end)
        out.append((tree, slot, first, end))
    return out


def ranges(rows: DataFrame, trees: list[Tree], nodes: list[tuple[int, int]], width: int) -> DataFrame:
    """tree, node, feature, lo, hi over the rows (x, label) in the open ``nodes``."""
    sent = rows.sparkSession.sparkContext.broadcast(({t: trees[t] for t, _ in nodes}, nodes))
    names = ["tree", "node", "feature", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, nodes = sent.value
        slots = _slots(trees, nodes)
        lo, hi = np.full((len(nodes), width), np.inf), np.full((len(nodes), width), -np.inf)
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("x"))
            for tree, slot, _, _ in slots:
                place = slot[nodes_of(tree, x)]
                at = np.flatnonzero(place >= 0)
                np.minimum.at(lo, place[at], x[at])
                np.maximum.at(hi, place[at], x[at])
        place, feature = np.nonzero(lo <= hi)
        own = np.array(nodes, np.int64).reshape(-1, 2)[place]
        yield _batch(names, own[:, 0], own[:, 1], feature, lo[place, feature], hi[place, feature])

    parts = rows.mapInArrow(run, "tree long, node long, feature long, lo double, hi double")
    return parts.groupBy("tree", "node", "feature").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def drawn(seed: int, purpose: str) -> Column:
    """A number from [0, 1) for each (tree, node, feature)."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), "tree", "node", "feature")
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def cuts(found: DataFrame, s: Settings) -> DataFrame:
    """tree, node, feature, cut: the drawn features of each node, those left out that do not vary there."""
    varied = found.filter("lo < hi")
    if s.tries:
        order = Window.partitionBy("tree", "node").orderBy("pick", "feature")
        varied = varied.withColumn("pick", drawn(s.seed, "feature")).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= s.tries)
    cut = F.col("lo") + drawn(s.seed, "cut") * (F.col("hi") - F.col("lo"))
    return varied.select("tree", "node", "feature", F.when(cut < F.col("hi"), cut).otherwise(F.col("lo")).alias("cut"))


def side_sums(rows: DataFrame, trees: list[Tree], drawn_cuts: list[tuple[int, int, int, float]], s: Settings, center: float) -> DataFrame:
    """tree, node, feature, cut, k and the sums v, n left (l) and right (r) of each drawn cut; k is a class, or 0."""
    nodes = sorted({(t, i) for t, i, _, _ in drawn_cuts})
    sent = rows.sparkSession.sparkContext.broadcast(({t: trees[t] for t, _ in nodes}, nodes, drawn_cuts))
    names = ["tree", "node", "feature", "cut", "k", "vl", "nl", "vr", "nr"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, nodes, all_cuts = sent.value
        slots, place_of = _slots(trees, nodes), {n: j for j, n in enumerate(nodes)}
        by_node = _grouped(all_cuts)
        most, kinds = max(map(len, by_node)), max(1, s.classes)
        feature, cut = np.full((len(nodes), most), -1), np.zeros((len(nodes), most))
        for g in by_node:
            for j, (t, i, f, c) in enumerate(g):
                feature[place_of[t, i], j], cut[place_of[t, i], j] = f, c
        size = most * kinds * 2  # sums of a node
        v, n = (np.zeros(len(nodes) * size) for _ in range(2))
        for b in batches:
            if not b.num_rows:
                continue
            x, label = _matrix(b.column("x")), np.asarray(b.column("label"), float)
            kind = label.astype(np.int64) if s.classes else np.zeros(len(label), np.int64)
            weight = np.ones(len(label)) if s.classes else label - center
            for tree, slot, first, end in slots:
                place = slot[nodes_of(tree, x)]
                at = np.flatnonzero(place >= 0)
                place = place[at]
                for j in range(most):
                    has = feature[place, j] >= 0
                    row, own = at[has], place[has]
                    right = x[row, feature[own, j]] > cut[own, j]
                    cell = (((own - first) * most + j) * kinds + kind[row]) * 2 + right
                    v[first * size:end * size] += np.bincount(cell, weight[row], minlength=(end - first) * size)
                    n[first * size:end * size] += np.bincount(cell, minlength=(end - first) * size)
        v, n = v.reshape(-1, 2), n.reshape(-1, 2)
        some = np.flatnonzero(n.sum(axis=1))
        place, j = some // kinds // most, some // kinds % most
        own = np.array(nodes, np.int64).reshape(-1, 2)[place]
        yield _batch(names, own[:, 0], own[:, 1], feature[place, j], cut[place, j], some % kinds, v[some, 0], n[some, 0], v[some, 1], n[some, 1])

    parts = rows.mapInArrow(run, "tree long, node long, feature long, cut double, k long, vl double, nl double, vr double, nr double")
    # dealt once by what the gains need
    parts = parts.repartition("tree", "node", "feature")
    return parts.groupBy("tree", "node", "feature", "k").agg(F.max("cut").alias("cut"), *[F.sum(c).alias(c) for c in ("vl", "nl", "vr", "nr")])


def _grouped(all_cuts: list[tuple[int, int, int, float]]) -> list[list[tuple[int, int, int, float]]]:
    out: dict[tuple[int, int], list[tuple[int, int, int, float]]] = {}
    for c in all_cuts:
        out.setdefault(c[:2], []).append(c)
    return list(out.values())


def best_cuts(sums: DataFrame, s: Settings) -> DataFrame:
    """tree, node, feature, cut, gain, nl, nr and the sums of each k on both sides: the best drawn cut of each node."""
    square = lambda c: F.sum(F.col(c) * F.col(c))
    sides = sums.withColumn("v", F.col("vl") + F.col("vr")).groupBy("tree", "node", "feature").agg(
        F.max("cut").alias("cut"), F.sum("nl").alias("nl"), F.sum("nr").alias("nr"), square("vl").alias("sl"), square("vr").alias("sr"), square("v").alias("s"),
        F.collect_list(F.struct("k", "vl", "vr")).alias("values"))  # one entry for each class
    able = sides.filter((F.col("nl") >= s.least_rows) & (F.col("nr") >= s.least_rows))
    gain = F.round(F.col("sl") / F.col("nl") + F.col("sr") / F.col("nr") - F.col("s") / (F.col("nl") + F.col("nr")), 9)
    able = able.withColumn("gain", gain).filter("gain > 0")
    best = F.max_by(F.struct("feature", "cut", "gain", "nl", "nr", "values"), F.struct("gain", -F.col("feature")))
    return able.groupBy("tree", "node").agg(best.alias("b")).select("tree", "node", "b.*")


def grow(frame: DataFrame, s: Settings, x: str = "x", label: str = "label") -> Forest:
    """Fit on an array column of features without gaps and a label (a number, or the class 0, 1, 2...)."""
    plain = frame.select(F.col(x).cast("array<double>").alias("x"), F.col(label).cast("double").alias("label"))
    total, width, center = plain.agg(F.count(F.lit(1)), F.max(F.size("x")), F.avg("label")).first()
    width, center = width or 0, 0.0 if s.classes else center or 0.0
    plain = plain.coalesce(-(-max(total, 1) // TASK_ROWS))
    if s.classes:
        counts = {int(r.label): r["count"] for r in plain.groupBy("label").count().collect()}  # a row for each class
        top = [counts.get(k, 0) / max(total, 1) for k in range(s.classes)]
    else:
        top = [center]
    trees = [Tree(value=[top]) for _ in range(s.trees)]
    per_node = max(1, width * max(2, 2 * s.classes))
    step = max(1, CELLS // per_node)
    open_nodes = [(t, 0) for t in range(s.trees)]
    for _ in range(s.depth):
        children: list[tuple[int, int]] = []
        for start in range(0, len(open_nodes), step):
            some = open_nodes[start:start + step]
            chosen = [tuple(r) for r in cuts(ranges(plain, trees, some, width), s).collect()]  # at most ``tries`` rows for each open node
            if not chosen:
                continue
            for r in best_cuts(side_sums(plain, trees, chosen, s, center), s).collect():  # a row for each open node
                values = []
                for name, n in (("vl", r.nl), ("vr", r.nr)):
                    sums = {e["k"]: e[name] for e in r["values"]}
                    values.append([sums.get(k, 0.0) / n for k in range(s.classes)] if s.classes else [center + sums[0] / n])
                children += [(r.tree, c) for c in trees[r.tree].split(r.node, r.feature, r.cut, r.gain, values)]
        open_nodes = sorted(children)
        if not open_nodes:
            break
    return Forest(s, width, trees)


class ExtraTreesModel(Model):
    """Transformer: ``prediction``, and for classes ``probability``."""

    def __init__(self, forest: Forest | None = None):
        super().__init__()
        self.forest = forest

    @property
    def featureImportances(self) -> DenseVector:
        return DenseVector(self.forest.gains())

    def _transform(self, df: DataFrame) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(self.forest)
        packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), vector_to_array("features").alias("x"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    p = answers(sent.value, _matrix(b.column("x")))
                    ends = pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([b.column("row"), pa.ListArray.from_arrays(ends, pa.array(p.ravel()))], names=["row", "p"])

        made = packed.mapInArrow(run, StructType([packed.schema[0]]).add("p", ArrayType(DoubleType())))
        if not self.forest.settings.classes:
            return made.select("row.*", F.col("p")[0].alias("prediction"))
        best = (F.array_position("p", F.array_max("p")) - 1).cast("double")
        return made.select("row.*", array_to_vector("p").alias("probability"), best.alias("prediction"))

    # -- persistence: one row of JSON -------------------------------------------------

    def write(self):
        return self

    def overwrite(self):
        return self

    def save(self, path: str) -> None:
        text = json.dumps(asdict(self.forest))
        SparkSession.getActiveSession().createDataFrame([(text,)], "model string").write.mode("overwrite").json(path)

    @classmethod
    def load(cls, path: str) -> ExtraTreesModel:
        d = json.loads(SparkSession.getActiveSession().read.json(path).first()["model"])
        return cls(Forest(Settings(**d["settings"]), d["width"], [Tree(**t) for t in d["trees"]]))


class ExtraTrees(Estimator):
    """Estimator on the columns ``features`` and ``label``.

    Without ``tries`` in the settings, classes draw the root of the number of
    features for each node, and numbers draw all.
    """

    def __init__(self, settings: Settings | None = None):
        super().__init__()
        self.settings = settings or Settings()

    def _fit(self, df: DataFrame) -> ExtraTreesModel:
        s = self.settings
        if s.classes and not s.tries:
            width = df.select(F.max(F.size(vector_to_array("features")))).first()[0] or 1
            s = Settings(**dict(asdict(s), tries=max(1, math.isqrt(width))))
        return ExtraTreesModel(grow(df.select(vector_to_array("features").alias("x"), "label"), s))
