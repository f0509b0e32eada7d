"""Target-distribution importance resampling over hashed word pairs.

Features are all runs of one and two consecutive words, counted in a fixed
number of buckets over all raw texts and all target texts.  A bucket's gain is
the log ratio of its smoothed shares, times 1000 and floored; a text's weight is
the floored mean of the gains of its features, looked up in one array.  Adding
Gumbel noise that the key decides turns "the highest scores" into a draw
without replacement in proportion to the exponent of the weight.

Ranks come from parallel sorting by regular sampling.  Each task sorts its rows
and writes them as a run; every d-th row of each run is a sample, and regular
samples of those in order are the splitters.  Each run is cut at the splitters,
the segments go to one task per range and are merged there, and the rows of
all earlier ranges, a prefix of the counts, make a row's place in its range an
exact rank.  The order is total (score, key, then run and place in it), so rows
that tie are split between ranges like all others.

Words: A-Z lower-cased, runs of letters and digits and of all that is not
ASCII.  Defined results: a null, empty or wordless text has no features, weight
0 and no rank; a null key draws as an empty one and comes last among equal
scores; of repeated rows each has a rank of its own; with an empty target all
buckets still have gains; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from tablelens.llm.frames import PIECE_BYTES, map_text, pieces, stored

BUCKETS = 10_000
SEED = 7
LEAST_WORDS = 20
#: Percent of the texts of at least ``LEAST_WORDS`` words that are drawn.
PERCENT = 25
#: Samples of runs that reach the driver at most (four numbers each), besides one a run.
MOST_SAMPLES = 1 << 18

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text: bytes, buckets: int) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of each feature."""
    words = WORD.findall(text.lower())
    one = list(map(zlib.crc32, words))
    two = map(zlib.crc32, [b" " + w for w in words[1:]], one)  # goes on from the first word's checksum
    return len(words), np.array([*one, *two], np.int64) % buckets


def bucket_counts(texts: DataFrame, text: str, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: features of all texts; a row for each bucket that has some."""
    chosen = texts.select(F.col(text).cast("string").alias("text")).filter("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for some in pieces(batch, 0, PIECE_BYTES):
                n += np.bincount(np.concatenate([features(t, buckets)[1] for t in some.column(0).cast(pa.binary()).to_pylist()]), minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], names=["bucket", "n"])

    return chosen.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _array(counts: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for r in counts.collect():  # at most a row for each bucket
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed share in the target over that in the raw texts) of each bucket."""
    k, s, t = float(len(raw)), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log(((b + 1) * (s + k)) / ((a + 1) * (t + k)))) for a, b in zip(raw.astype(float).tolist(), target.astype(float).tolist())], np.int64)


def noise(key: str) -> int:
    """Gumbel noise times 1000, floored, of the first 32 bits of the key's digest."""
    h = int(hashlib.sha256(f"{SEED}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_features, weight."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    out = StructType().add("n_words", LongType()).add("n_features", LongType()).add("weight", LongType())

    def make():
        gain = sent.value

        def work(column: pa.Array):
            rows = []
            for t in column.cast(pa.binary()).to_pylist():
                n, f = features(t or b"", len(gain))
                rows.append((n, len(f), int(gain[f].sum()) // len(f) if len(f) else 0))
            return [list(c) for c in zip(*rows)]

        return work

    return map_text(docs, text, out, make, (key,))


def _with_noise(rows: DataFrame) -> DataFrame:
    """The rows with score, the weight and the noise of ``key_text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            drawn = np.fromiter(map(noise, b.column("key_text").to_pylist()), np.int64, b.num_rows)
            yield b.append_column("score", pa.array(b.column("weight").to_numpy() + drawn))

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("score", LongType()))


#: Highest first; a key that is null is last of its score.
_ORDER = ("turned", "keyless", "key")


def _sorted_runs(rows: DataFrame) -> DataFrame:
    """The rows, sorted in each task, with the task's number and their place in it."""
    runs = rows.sortWithinPartitions(*_ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield b.append_column("run", pa.array(np.full(b.num_rows, part, np.int64))).append_column("place", pa.array(np.arange(at, at + b.num_rows)))
            at += b.num_rows

    return runs.mapInArrow(run, StructType([*rows.schema.fields]).add("run", LongType()).add("place", LongType()))


def splitters(samples: list[tuple], ranges: int) -> list[tuple]:
    """Every n-th of the samples in order, one between each two ranges."""
    s = sorted(samples)
    return [s[i * len(s) // ranges] for i in range(1, ranges)] if s else []


def _segments(runs: DataFrame, cuts: list[tuple]) -> DataFrame:
    """The rows with the range that each belongs to: the number of splitters not after it."""
    sent = runs.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        cuts = sent.value
        for b in batches:
            columns = [b.column(c).to_pylist() for c in (*_ORDER, "run", "place")]
            yield b.append_column("segment", pa.array([bisect_right(cuts, row) for row in _comparable(columns)], pa.int32()))

    return runs.mapInArrow(run, StructType([*runs.schema.fields]).add("segment", IntegerType()))


def _comparable(columns: list[list]) -> Iterator[tuple]:
    turned, keyless, key, run, place = columns
    return zip(turned, keyless, (0 if k is None else k for k in key), run, place)


def ranked(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """The rows (``key`` an integer, ``score``) with rank: 1, 2, 3... from the highest score, ties to the smaller key."""
    spark = rows.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.withColumn("turned", -F.col("score")).withColumn("keyless", F.col("key").isNull())
    runs = stored(_sorted_runs(ordered))
    n, tasks = runs.agg(F.count("*"), F.count_distinct("run")).first()
    distance = max(1, -(-n // max(1, min(tasks * ranges, MOST_SAMPLES))))
    taken = runs.filter(F.col("place") % distance == distance // 2).select(*_ORDER, "run", "place").collect()
    cuts = splitters(list(_comparable([list(c) for c in zip(*taken)] or [[]] * 5)), ranges)
    # One partition a range: no two ranges share a task, and the sort there merges the runs' segments.
    merged = _segments(runs, cuts).repartitionById(ranges, F.col("segment")).sortWithinPartitions("segment", *_ORDER, "run", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            yield b.append_column("nth", pa.array(np.arange(at + 1, at + 1 + b.num_rows)))
            at += b.num_rows

    placed = stored(merged.mapInArrow(run, StructType([*merged.schema.fields]).add("nth", LongType())))
    before, begins = 0, []
    for r in sorted(placed.groupBy("segment").count().collect()):  # a row for each range
        begins.append((r.segment, before))
        before += r["count"]
    table = spark.createDataFrame(begins, "segment int, before long")
    return placed.join(F.broadcast(table), "segment").select(*rows.columns, (F.col("before") + F.col("nth")).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """key, n_words, n_features, weight, score, rank of every text; rank is null where the text is not drawn."""
    gain = gains(_array(bucket_counts(docs, text, buckets), buckets), _array(bucket_counts(target, target_text, buckets), buckets))
    rows = weighed(docs, gain, key, text).select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key_text"), "n_words", "n_features", "weight")
    scored = stored(_with_noise(rows).drop("key_text"))
    able = F.col("n_words") >= least_words
    drawn = scored.filter(able).count() * percent // 100
    of_able = ranked(scored.filter(able))
    whole = of_able.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))
    return whole.withColumnRenamed("key", key)
