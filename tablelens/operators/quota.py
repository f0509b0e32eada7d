"""Exact shares of groups, and exact positions of rows, without a task that holds a group.

``parts`` deals the rows of each group to parts of given sizes, in the order of
a hash.  The cuts are found by counting: a histogram of the hash for each group
and cut, then one of the bucket that holds the cut, until a single value is
left; rows that share it are told apart by their place in the frame, in the
same way.  Every pass is one aggregate that tasks combine beforehand, the
driver holds one row for each cut, and no row moves.

``positions`` numbers rows in an order: sorted ranges, and for each range the
number of rows before it.

Both need a frame that gives the same rows in the same order again: a kept
frame, or a scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.session import materialize

#: Buckets of a histogram, for each group and cut.
BUCKETS = 2048
#: Values of ``hash_unit`` as whole numbers.
HASHES = 2**32


#: Windows and cuts of so many are told by literals; more are joined.
FEW = 16


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _narrowed(rows: DataFrame, by: list[str], key: str, size: int, wanted: dict[tuple, int]) -> dict[tuple, tuple[int, int, int]]:
    """For each (group, cut): the value of ``key`` (from 0, below ``size``) at the wanted rank, the rank among the rows that share it, and their number.

    ``by``: ``__group``, and ``__cut`` if each cut has rows of its own. Cuts in the same bucket share its histogram.
    """
    spark = rows.sparkSession
    kinds = f"__group {rows.schema['__group'].dataType.simpleString()}, __cut int, __lo long"
    state = {c: (0, rank, 0) for c, rank in wanted.items()}
    while size > 1 and state:
        width = -(-size // BUCKETS)
        # one row for each group and cut: their number is bounded by the caller
        now = spark.createDataFrame([(*c, lo, rank) for c, (lo, rank, _) in state.items()], f"{kinds}, __rank long")
        windows = {(*c[: len(by)], lo) for c, (lo, _, _) in state.items()}
        inside, shared = rows, ", ".join(k for k in kinds.split(", ") if k.split()[0] in (*by, "__lo"))
        if len(windows) <= FEW:
            inside = rows.filter(_any([F.col(key).between(lo, lo + size - 1) for lo in sorted({w[-1] for w in windows})]))
        here = inside.join(F.broadcast(spark.createDataFrame(sorted(windows), shared)), by).filter(F.col(key).between(F.col("__lo"), F.col("__lo") + size - 1))
        counts = here.groupBy(*by, "__lo", F.expr(f"({key} - __lo) div {width}").alias("b")).agg(F.count(F.lit(1)).alias("n"))
        counts = counts.join(F.broadcast(now), [*by, "__lo"])
        upto = Window.partitionBy("__group", "__cut").orderBy("b")  # at most BUCKETS rows each
        found = counts.withColumn("upto", F.sum("n").over(upto)).filter(F.col("upto") > F.col("__rank"))
        least = found.groupBy("__group", "__cut", "__lo", "__rank").agg(F.min(F.struct("b", "upto", "n")).alias("f")).collect()
        state = {(r["__group"], r["__cut"]): (r["__lo"] + r.f.b * width, r["__rank"] - (r.f.upto - r.f.n), r.f.n) for r in least}
        size = width
    return state


def parts(df: DataFrame, group: Column, unit: Column, ranks: dict[object, list[int]], name: str = "part") -> DataFrame:
    """The rows with the number of their part: the rows of ``group`` in the order of ``unit`` are cut before each of its ascending ``ranks``.

    ``unit`` lies in [0, 1), in steps of 2⁻³² (``hash_unit``). Rows of a group
    that ``ranks`` does not name, and those without a group, are in part 0.
    """
    spark = df.sparkSession
    rows = df.select("*", group.alias("__group"), (unit * F.lit(float(HASHES))).cast("long").alias("__hash"), F.monotonically_increasing_id().alias("__place"))
    keys = rows.select("__group", "__hash", "__place")
    group_type = rows.schema["__group"].dataType.simpleString()
    wanted = {(g, i): r for g, own in ranks.items() for i, r in enumerate(own)}
    numbers = sorted({i for _, i in wanted})
    at = _narrowed(keys, ["__group"], "__hash", HASHES, wanted) if numbers else {}
    shared = {c: rank for c, (_, rank, n) in at.items() if rank and n > 1}
    places: dict[tuple, tuple[int, int, int]] = {}
    if shared:
        tied = spark.createDataFrame([(*c, at[c][0]) for c in shared], f"__group {group_type}, __cut int, __at long")
        near = keys if len(shared) > FEW else keys.filter(F.col("__hash").isin(sorted({at[c][0] for c in shared})))
        by_cut = near.select("*", F.explode(F.array(*[F.lit(i) for i in numbers])).alias("__cut"))
        same = by_cut.join(F.broadcast(tied), ["__group", "__cut"]).filter(F.col("__hash") == F.col("__at")).drop("__at")
        places = _narrowed(same, ["__group", "__cut"], "__place", (same.agg(F.max("__place")).first()[0] or 0) + 1, shared)
    found: dict[object, list[tuple[int, int]]] = {}
    for (g, i), (value, rank, _) in at.items():
        found.setdefault(g, []).append((value, places.get((g, i), (0, 0, 0))[0]))
    if sum(len(c) for c in found.values()) <= FEW:
        part = F.lit(0)
        for g, c in found.items():
            passed = [((F.col("__hash") > h) | ((F.col("__hash") == h) & (F.col("__place") >= p))).cast("int") for h, p in c]
            part = F.when(F.col("__group") == F.lit(g), reduce(lambda a, b: a + b, passed)).otherwise(part)
        return rows.select(*[F.col(f"`{c}`") for c in df.columns], part.alias(name))
    cuts = spark.createDataFrame([(g, [{"h": h, "p": p} for h, p in c]) for g, c in found.items()], f"__group {group_type}, __cuts array<struct<h: bigint, p: bigint>>")
    after = lambda c: (F.col("__hash") > c["h"]) | ((F.col("__hash") == c["h"]) & (F.col("__place") >= c["p"]))
    part = F.coalesce(F.size(F.filter("__cuts", after)), F.lit(0))
    made = rows.join(F.broadcast(cuts), "__group", "left")
    return made.select(*[F.col(f"`{c}`") for c in df.columns], F.when(F.col("__cuts").isNull(), 0).otherwise(part).alias(name))


def positions(df: DataFrame, order: list[Column], name: str = "pos", reliable: bool = False, keep: list[str] | None = None) -> DataFrame:
    """The rows with their position, from 0, in ascending ``order``; equal ones follow their place in the frame.

    Only the columns ``keep`` move (all, unless named). ``unpersist`` of the
    frame's ``kept`` frees the sorted rows once nothing more is made of them.
    """
    spark = df.sparkSession
    named = df.columns if keep is None else keep
    own = [F.col(f"`{c}`") for c in named]
    keys = [f"__o{i}" for i in range(len(order))] + ["__place"]
    keyed = df.select(*own, *[o.alias(k) for o, k in zip(order, keys)], F.monotonically_increasing_id().alias("__place"))
    runs = materialize(keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys), reliable=reliable)
    numbered = runs.withColumn("__at", F.monotonically_increasing_id()).select(
        *own, F.shiftright("__at", 33).alias("__run"), F.col("__at").bitwiseAND(2**33 - 1).alias("__in"))
    before, first = 0, []
    for r in sorted(numbered.groupBy("__run").count().collect()):  # one row for each range
        first.append((r["__run"], before))
        before += r["count"]
    starts = spark.createDataFrame(first, "__run long, __before long")
    made = numbered.join(F.broadcast(starts), "__run").select(*own, (F.col("__before") + F.col("__in")).alias(name))
    made.kept = runs
    return made
