"""Exact quantiles from a value-count frame.

Input is ``(ord, num, n)``: distinct numeric values of a column with their
counts.  The result is the linear-interpolation quantile at position
``p * (N - 1)`` (the numpy/pandas default, and DuckDB's ``quantile_cont``).

Two strategies, chosen per column by its distinct count:

* ``percentile(num, p, n)`` — Spark's exact aggregate with a frequency
  argument.  Its buffer is a value→count map, so it is only used when the
  column's distinct count is below a limit (a proven memory bound).
* bucketed exact — for columns with more distinct values than that: cut
  points from ``percentile_approx`` over the distinct values split each
  column into ``buckets`` ranges of about equal distinct count (each value
  finds its range by binary search, ``Bucketizer``); bucket totals (a few
  hundred rows per column) locate the bucket holding each wanted rank;
  only those buckets are ranked with a window, each one a ``1/buckets``
  slice of the column.  No task ever holds a whole column.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _percentile_expr(probs: list[float]) -> F.Column:
    arr = ", ".join(repr(float(p)) for p in probs)
    return F.expr(f"percentile(num, array({arr}), n)")


def exact_quantiles(
    vc: DataFrame,
    probs: list[float],
    large_ords: list[int] | None = None,
    buckets: int = 256,
) -> DataFrame:
    """(ord, q: array<double>) with one entry per ``probs`` item."""
    large_ords = list(large_ords or [])
    small = vc.where(~F.col("ord").isin(large_ords)) if large_ords else vc
    out = small.groupBy("ord").agg(_percentile_expr(probs).alias("q"))
    if large_ords:
        out = out.unionByName(
            bucketed_quantiles(vc.where(F.col("ord").isin(large_ords)), probs, buckets)
        )
    return out


def bucketed_quantiles(vc: DataFrame, probs: list[float], buckets: int = 256) -> DataFrame:
    """Exact quantiles without gathering a column into one task (see module doc)."""
    fracs = [i / buckets for i in range(1, buckets)]
    cuts = vc.groupBy("ord").agg(
        F.sum("n").alias("N"),
        F.percentile_approx("num", fracs, max(10000, 8 * buckets)).alias("cuts"),
    )
    # one row per large column with `buckets` doubles: bounded by the schema width
    cut_rows = cuts.collect()
    cuts = vc.sparkSession.createDataFrame([(r["ord"], r["N"], r["cuts"]) for r in cut_rows],
                                           "ord int, N long, cuts array<double>")
    # bucket of each value: a binary search over the column's cut points
    # (Bucketizer, JVM side), one projection per large column
    vb = None
    for r in cut_rows:
        splits = [float("-inf")] + sorted(set(float(x) for x in r["cuts"])) + [float("inf")]
        part = Bucketizer(splits=splits, inputCol="num", outputCol="b").transform(
            vc.where(F.col("ord") == r["ord"])).select("ord", "num", "n", F.col("b").cast("int").alias("b"))
        vb = part if vb is None else vb.unionByName(part)
    if vb is None:
        return vc.sparkSession.createDataFrame([], "ord int, q array<double>")
    bstat = vb.groupBy("ord", "b").agg(F.sum("n").alias("bn"))
    before = Window.partitionBy("ord").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    bcum = bstat.withColumn("before", F.coalesce(F.sum("bn").over(before), F.lit(0)))

    targets = cuts.select(
        "ord", "N", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("i", "p")
    ).withColumn("pos", F.col("p") * (F.col("N") - 1))
    targets = targets.select(
        "ord", "i", "pos",
        F.floor("pos").alias("lo"),
        F.ceil("pos").alias("hi"),
    )
    ranks = targets.select(
        "ord", "i",
        F.explode(F.array(
            F.struct(F.lit(0).alias("side"), F.col("lo").alias("r")),
            F.struct(F.lit(1).alias("side"), F.col("hi").alias("r")),
        )).alias("t"),
    ).select("ord", "i", "t.side", "t.r")
    need = ranks.join(bcum, "ord").where(
        (F.col("r") >= F.col("before")) & (F.col("r") < F.col("before") + F.col("bn"))
    ).select("ord", "i", "side", "r", "b", "before")

    wanted = F.broadcast(need.select("ord", "b").distinct())  # ≤ 2·len(probs) per column
    sel = vb.join(wanted, ["ord", "b"], "left_semi")
    within = Window.partitionBy("ord", "b").orderBy("num").rowsBetween(Window.unboundedPreceding, 0)
    sel = sel.withColumn("end", F.sum("n").over(within)).withColumn("start", F.col("end") - F.col("n"))
    vals = need.join(sel, ["ord", "b"]).where(
        (F.col("r") >= F.col("before") + F.col("start")) & (F.col("r") < F.col("before") + F.col("end"))
    ).select("ord", "i", "side", "num")
    piv = vals.groupBy("ord", "i").agg(
        F.max(F.when(F.col("side") == 0, F.col("num"))).alias("lo_v"),
        F.max(F.when(F.col("side") == 1, F.col("num"))).alias("hi_v"),
    )
    qv = piv.join(targets, ["ord", "i"]).select(
        "ord", "i",
        F.when(F.col("hi") == F.col("lo"), F.col("lo_v"))
        .otherwise(
            (F.col("hi") - F.col("pos")) * F.col("lo_v") + (F.col("pos") - F.col("lo")) * F.col("hi_v")
        ).alias("v"),
    )
    return qv.groupBy("ord").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("q")
    )
