"""Permutation importance: how much worse a model's score is if one feature is dealt anew among the rows.

All rows are put into two orders, each by a hash, and the rows at the same
position of both become pairs: a row and a donor.  Feature j is permuted by
giving each row its donor's value of it.  One pair of orders serves all features
of a round; the rows with one feature changed are made, scored and summed up
inside the tasks, so a round shuffles every row four times, whatever the number
of features.  Each round is summed up before the next begins, and its sorted
rows are freed.  No window or task holds all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.operators.quota import positions


def donors(df: DataFrame, features: str, orders: tuple[list[Column], list[Column]], keep: list[str], reliable: bool = False) -> DataFrame:
    """The columns ``keep`` of all rows with ``donor``, the array column ``features`` of the row that has their position in the second order.

    ``kept`` are the two sorted frames, to free in the end.
    """
    own = positions(df, orders[0], "__pos", reliable, keep)
    other = positions(df.withColumn("donor", F.col(features)), orders[1], "__pos", reliable, ["donor"])
    made = own.join(other, "__pos").drop("__pos")
    made.kept = [own.kept, other.kept]
    return made


def permutation_importance(frame: DataFrame, transform: Callable[[DataFrame], DataFrame], width: int, classes: bool,
                           orders: Callable[[int], tuple[list[Column], list[Column]]], repeats: int = 3, reliable: bool = False) -> DataFrame:
    """feature, importance (mean loss of the score), spread (its population deviation), losses: a row for each of the ``width`` entries of ``features``.

    ``frame`` has the vector ``features`` and ``label``, gives the same rows in
    the same order again (kept, or a scan), and ``transform`` adds
    ``prediction``.  The score is the accuracy, or R² for numbers; without rows,
    or with a label that does not vary, there is none and the result is null.
    ``orders`` gives the two orders of each round over the columns of ``frame``.
    """
    spark = frame.sparkSession
    rows = frame.withColumn("__x", vector_to_array("features"))
    feature, y, p = F.col("feature"), F.col("label"), F.col("prediction")
    score = F.avg((y == p).cast("double")) if classes else 1 - F.sum((y - p) * (y - p)) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))
    found = []
    for number in range(repeats):
        paired = donors(rows, "__x", orders(number), ["label", "__x"], reliable)
        # feature -1 is the row as it is, summed up in the same pass: an unused feature loses exactly 0
        changed = paired.withColumn("feature", F.explode(F.sequence(F.lit(-1), F.lit(width - 1))))
        swapped = F.when(feature < 0, F.col("__x")).otherwise(
            F.concat(F.slice("__x", F.lit(1), feature), F.slice("donor", feature + 1, F.lit(1)), F.slice("__x", feature + 2, F.lit(width))))
        made = transform(changed.select("label", "feature", array_to_vector(swapped).alias("features")))
        found += [(r.feature, r.score, number) for r in made.groupBy("feature").agg(score.alias("score")).collect()]  # a row for each feature, and one
        for runs in paired.kept:
            runs.unpersist()
    each = spark.createDataFrame(found, "feature int, score double, round int")
    whole = each.filter("feature < 0").select("round", F.col("score").alias("best"))  # a row for each round
    lost = each.filter("feature >= 0").join(F.broadcast(whole), "round").withColumn("loss", F.col("best") - F.col("score"))
    losses = F.transform(F.array_sort(F.collect_list(F.struct("round", "loss"))), lambda v: v["loss"])
    return lost.groupBy("feature").agg(F.avg("loss").alias("importance"), F.stddev_pop("loss").alias("spread"), losses.alias("losses"))
