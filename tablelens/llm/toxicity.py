"""Toxicity by a weighted lexicon.

Texts are folded: lower case, look-alike letters of other scripts and digits
or signs that stand for letters become Latin letters, and all words are joined
by single spaces.  An Aho-Corasick automaton over the folded text finds the
lexicon's words and word beginnings at word limits; hits inside an exception
phrase do not count.  The hits' weights, in total and per hundred words, go
through a logistic curve.

The weights are log odds learned from a bounded sample of labelled rows (at
most ``TOXIC_ROWS`` and ``CLEAN_ROWS`` rows in the order of a hash of the
key); a seed list serves where nothing can be learned.  Scores cover every
text whole.

Defined results: null and empty texts score as texts without hits; repeated
rows are scored each; labels that are null, or contradict one another for a
key, are not learned from.
"""

from __future__ import annotations

import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructType

from tablelens.llm.frames import map_text

TOXIC_ROWS, CLEAN_ROWS = 4000, 8000
#: A lexicon entry: toxic sample rows at least, share of the rows with it that are toxic, entries at most.
SUPPORT, TOXIC_SHARE, ENTRIES = 6, 0.75, 2000
BEGINNINGS = (4, 5, 6, 7)
#: Phrases whose words are no insult. Learned ones: pairs of words that this many clean and no toxic rows have.
EXCEPTIONS = ("clown fish", "class clown act", "trash can", "trash bag", "trash collection", "pond scum", "good loser")
EXCEPTION_SUPPORT = 5
#: Weights where no labels can be learned from.
SEED = {" idiot ": 3.0, " moron ": 3.0, " stupid ": 2.0, " scum ": 3.0, " loser ": 2.0, " worthless ": 2.0, " pathetic ": 2.0}
SEED_CURVE = (-3.0, 1.0, 1.0, 1.0)

#: Look-alike letters and digits, and the letters they stand for.
_ALIKE = dict(zip("аеорсхуікмнтвѕјԁһɡαεορτυνικ013457", "aeopcxyikmhtbsjdhgaeoptuvikoieast"))
FOLD = str.maketrans(_ALIKE | {"​": "", "‌": "", "‍": "", "­": ""} | {chr(0xFF21 + i): chr(97 + i) for i in range(26)} | {chr(0xFF41 + i): chr(97 + i) for i in range(26)})
_WORD = re.compile(r"[^\W\d_]+")
_SIGN = re.compile(r"(?<![@$])[@$](?=[^\W\d_])")


def fold(text: str) -> str:
    t = text.lower()
    if "@" in t or "$" in t:  # a sign before a letter stands for one; rows of signs do not
        t = _SIGN.sub(lambda m: "a" if m[0] == "@" else "s", t)
    words = _WORD.findall(t.translate(FOLD))
    return f" {' '.join(words)} " if words else " "


def entries_of(folded: str) -> set[str]:
    """The words and word beginnings that a lexicon could list, with their limits as spaces."""
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in BEGINNINGS if len(w) > n}


def automaton(weights: dict[str, float], exceptions) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for entry, weight in weights.items():
        a.add_word(entry, (len(entry), weight))
    for phrase in exceptions:
        if (p := fold(phrase)) not in weights:
            a.add_word(p, (len(p), None))
    if len(a):
        a.make_automaton()
    return a


def features(text: str | None, a: ahocorasick.Automaton) -> tuple[float, float, float]:
    """ln(1 + weight), ln(1 + weight per 100 words) and whether anything hit."""
    folded = fold(text) if text else " "
    if not len(a) or len(folded) < 2:
        return 0.0, 0.0, 0.0
    hits, excused = [], []
    for end, (size, weight) in a.iter(folded):
        (hits if weight is not None else excused).append((end - size + 1, end, weight))
    if excused:
        hits = [h for h in hits if not any(x <= h[0] and h[1] <= y for x, y, _ in excused)]
    best: dict[int, float] = {}  # a word counts once, by its heaviest entry
    for start, _, weight in hits:
        best[start] = max(best.get(start, 0.0), weight)
    total = sum(best.values())
    return float(np.log1p(total)), float(np.log1p(100 * total / folded.count(" "))), float(bool(best))


def probability(x: np.ndarray, curve) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve[0] + x @ np.asarray(curve[1:]), -30, 30)))


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Weighted, slightly damped logistic regression by Newton steps."""
    z = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(z.shape[1])
    for _ in range(30):
        p = probability(x, beta)
        slope = z.T @ (weight * (y - p)) - 0.1 * beta
        bend = (z * (weight * p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(z.shape[1])
        step = np.linalg.solve(bend, slope)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, beta))


def lexicon(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Weights from (entry, toxic rows, clean rows): log odds of those that mark toxic rows.

    A word that a listed beginning covers as well is left out.
    """
    share = toxic / clean  # the sample's classes need not have the corpus's sizes
    rated = {}
    for entry, t, c in counts:
        odds = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
        if t >= SUPPORT and t >= TOXIC_SHARE * (t + c * max(1.0, share)):
            rated[entry] = float(odds)
    best = dict(sorted(rated.items(), key=lambda e: (-e[1], e[0]))[:ENTRIES])
    return {e: w for e, w in best.items() if w > max([0.0, *(best.get(e[: n + 1], 0.0) for n in BEGINNINGS if len(e) > n + 1)])}


def _chosen(labels: DataFrame, allowed: Column, key: str, label: str) -> tuple[DataFrame, int, int]:
    """Sampled keys with their label, and the number of labelled keys of each class."""
    known = labels.filter(allowed & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(label).alias("y"), F.max(label).alias("z")).filter("y = z").select("k", F.col("y").cast("int").alias("y"))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64(F.col("k").cast("string")), F.col("k")]
    picked = known.filter("y = 1").orderBy(*order).limit(TOXIC_ROWS).unionByName(known.filter("y = 0").orderBy(*order).limit(CLEAN_ROWS))
    return picked, sizes.get(1, 0), sizes.get(0, 0)


def _entry_counts(sampled: DataFrame) -> list[tuple[str, int, int]]:
    out = StructType().add("seen", ArrayType(StructType().add("entry", StringType()).add("t", LongType()).add("c", LongType())))

    def run(batches):
        names = pa.list_(pa.struct([("entry", pa.string()), ("t", pa.int64()), ("c", pa.int64())]))
        for b in batches:
            n = (Counter(), Counter())
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n[y].update(entries_of(fold(t)))
            keep = [{"entry": e, "t": n[1][e], "c": n[0][e]} for e in n[1]] + [{"entry": e, "t": 0, "c": c} for e, c in n[0].items() if e not in n[1]]
            yield pa.RecordBatch.from_arrays([pa.array([keep], names)], names=["seen"])

    each = sampled.select("y", "text").mapInArrow(run, out).select(F.inline("seen"))
    summed = each.groupBy("entry").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    # At most as many entries as the bounded sample can support.
    return [tuple(r) for r in summed.filter((F.col("t") >= SUPPORT) & (F.col("t") >= TOXIC_SHARE * (F.col("t") + F.col("c")))).orderBy("entry").collect()]


def learned_exceptions(sampled: DataFrame, weights: dict[str, float]) -> list[str]:
    """Pairs of words with a lexicon word that only clean sample rows have."""
    sent = sampled.sparkSession.sparkContext.broadcast(frozenset(e.strip() for e in weights if e.endswith(" ")))

    def run(batches):
        for b in batches:
            n = Counter()
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = fold(t).split()
                n.update({(f"{p} {q}", y) for p, q in zip(w, w[1:]) if p in sent.value or q in sent.value})
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.int32()), pa.array(list(n.values()), pa.int64())], names=["pair", "y", "n"])

    pairs = sampled.select("y", "text").mapInArrow(run, "pair string, y int, n long").groupBy("pair").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c"))
    return [r.pair for r in pairs.filter((F.col("t") == 0) & (F.col("c") >= EXCEPTION_SUPPORT)).orderBy("pair").collect()]


def train(docs: DataFrame, labels: DataFrame, allowed: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[dict[str, float], tuple[str, ...], tuple[float, ...]]:
    """(weights, exception phrases, curve)."""
    picked, toxic, clean = _chosen(labels, allowed, key, label)
    n = {r.y: r.n for r in picked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if min(n.get(0, 0), n.get(1, 0)) < SUPPORT:
        return SEED, EXCEPTIONS, SEED_CURVE
    sampled = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).filter("text is not null").join(F.broadcast(picked), "k").select("k", "y", "text").cache()
    try:
        weights = lexicon(_entry_counts(sampled), n[1], n[0])
        exceptions = (*EXCEPTIONS, *learned_exceptions(sampled, weights))
        rows = _feature_rows(sampled, weights, exceptions).orderBy("k").collect()
    finally:
        sampled.unpersist()
    if not weights or len({r.y for r in rows}) < 2:
        return SEED, EXCEPTIONS, SEED_CURVE
    x = np.array([[r.total, r.share, r.any] for r in rows])
    y = np.array([r.y for r in rows], float)
    each = np.where(y == 1, toxic / max(1, n[1]), clean / max(1, n[0]))  # the corpus's share of each class
    return weights, exceptions, fit_curve(x, y, each / each.mean())


def _feature_rows(rows: DataFrame, weights: dict[str, float], exceptions) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast((weights, tuple(exceptions)))
    out = StructType().add("total", DoubleType()).add("share", DoubleType()).add("any", DoubleType())

    def make():
        a = automaton(*sent.value)
        return lambda column: zip(*[features(t, a) for t in column.to_pylist()])

    return map_text(rows, "text", out, lambda: (lambda work: lambda c: [list(x) for x in work(c)])(make()), ("k", "y"))


def scored(docs: DataFrame, model, text: str = "text", carry=("doc_id",), keep: str | None = None) -> DataFrame:
    """The carried columns, the text under the name ``keep`` if given, score (0 to 1) and predicted (1 if the score is 0.5 or more)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    out = StructType().add("score", DoubleType()).add("predicted", IntegerType())

    def make():
        weights, exceptions, curve = sent.value
        a = automaton(weights, exceptions)

        def work(column: pa.Array):
            p = probability(np.array([features(t, a) for t in column.to_pylist()]).reshape(-1, 3), curve)
            return p, (p >= 0.5).astype(np.int32)

        return work

    return map_text(docs, text, out, make, carry, keep=keep)
