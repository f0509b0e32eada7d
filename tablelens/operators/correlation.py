"""Pearson correlations between numeric columns (C1–C5) and the same safe
correlation used by leakage and attribution rules.

All k(k−1)/2 pairs come out of one aggregate over the raw rows (chunked for
wide tables).  Each pair is pairwise-complete: both sides are nulled where
either is missing, and ``covar_pop / (stddev_pop · stddev_pop)`` is taken
with ``try_divide`` so a constant pair yields null (then 0.0) instead of the
ANSI divide-by-zero that the built-in ``corr`` raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.operators.profile import metrics_of
from tablelens.plans.passes import clean_numeric, col_ref, column_specs
from tablelens.session import conf_override

PAIRS_PER_JOB = 60
MIN_ALIGNED = 3
TOP_PAIRS = 12
MEANINGFUL = 0.05


def safe_corr(a: Column, b: Column) -> tuple[Column, Column]:
    """(aligned row count, Pearson r or null) of two double columns."""
    both = a.isNotNull() & b.isNotNull()
    a2, b2 = F.when(both, a), F.when(both, b)
    r = F.try_divide(F.covar_pop(a2, b2), F.stddev_pop(a2) * F.stddev_pop(b2))
    return F.count_if(both), r


def safe_corr_parts(a: Column, b: Column, present: Column) -> list[Column]:
    """``n`` and ``r`` aggregates of a pair, counting only rows where both are present."""
    a2, b2 = F.when(present, a), F.when(present, b)
    return [
        F.count_if(present).alias("n"),
        F.try_divide(F.covar_pop(a2, b2), F.stddev_pop(a2) * F.stddev_pop(b2)).alias("r"),
    ]


def usable_r(n: Column, r: Column, min_rows: int = MIN_ALIGNED) -> Column:
    """Undefined, non-finite or under-supported → 0.0."""
    bad = r.isNull() | F.isnan(r) | (F.abs(r) == F.lit(float("inf"))) | (n < min_rows)
    return F.when(bad, F.lit(0.0)).otherwise(r)


def strength_columns(r: Column) -> list[Column]:
    a = F.round(F.abs(r), 4)
    tier = (
        F.when(a >= 0.80, "Very Strong").when(a >= 0.60, "Strong").when(a >= 0.40, "Moderate")
        .when(a >= 0.20, "Weak").otherwise("Very Weak")
    )
    direction = F.when(r >= 0, "Positive").otherwise("Negative")
    return [
        F.concat_ws(" ", tier, direction).alias("strength"),
        direction.alias("direction"),
        tier.alias("tier"),
    ]


def _complete(m) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of the columns with no missing value (per-column frame: one row per column)."""
    rows = m.identified.where(F.col("missing_count") == 0).select("column_name", "num_mean", "num_std_pop").collect()
    return {r["column_name"]: (r["num_mean"], r["num_std_pop"]) for r in rows if r["num_std_pop"] is not None}


def eligible_columns(df_or_metrics) -> list[tuple[int, str]]:
    """Numeric, non-boolean, more than one distinct value, not an identifier.

    Collects the per-column frame (one row per column: bounded by the schema).
    """
    m = metrics_of(df_or_metrics)
    c = m.identified
    rows = c.where(
        (F.col("kind") == "numeric") & (F.col("unique_count") > 1) & ~F.col("is_identifier")
    ).select("ord", "column_name").orderBy("ord").collect()
    return [(r["ord"], r["column_name"]) for r in rows]


def pair_correlations(df: DataFrame, cols: list[tuple[int, str]], digits: int = 3,
                      complete: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(ord1, ord2, column1, column2, n, r) for every pair of ``cols``
    ((ordinal, name), in column order), pairwise-complete, in one pass.

    Few columns: one aggregate with a (count, covariance, two deviations)
    term per pair; columns known to have no missing value (``complete``: their
    mean and population deviation) need no pairwise masking, so such a pair is
    one sum of centred products.
    Many columns: the values are exploded into (i, j, a, b) pairs and
    grouped by (i, j) — the plan stays the same size whatever the width,
    the data is read once, and partial aggregation leaves one row per pair
    per task to shuffle.
    """
    complete = complete or {}
    spark = df.sparkSession
    schema = "ord1 int, ord2 int, column1 string, column2 string, n long, r double"
    if len(cols) < 2:
        return spark.createDataFrame([], schema)
    ords = [o for o, _ in cols]
    names = [n for _, n in cols]
    cs = {s.name: s for s in column_specs(df.select(*[col_ref(n) for n in names]))}
    vals = [clean_numeric(cs[n], col_ref(n)) for n in names]
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    if len(pairs) <= PAIRS_PER_JOB:
        aggs, entries = [], []
        for k, (i, j) in enumerate(pairs):
            a, b = vals[i], vals[j]
            if names[i] in complete and names[j] in complete:
                n = F.count(F.lit(1))
                (ma, sa), (mb, sb) = complete[names[i]], complete[names[j]]
                r = F.try_divide(F.avg((a - F.lit(ma)) * (b - F.lit(mb))), F.lit(sa * sb))
            else:
                n, r = safe_corr(a, b)
            aggs += [n.alias(f"n{k}"), r.alias(f"r{k}")]
            entries.append(F.struct(
                F.lit(ords[i]).alias("ord1"), F.lit(ords[j]).alias("ord2"),
                F.lit(names[i]).alias("column1"), F.lit(names[j]).alias("column2"),
                F.col(f"n{k}").cast("long").alias("n"), F.col(f"r{k}").alias("r"),
            ))
        out = df.agg(*aggs).select(F.inline(F.array(*entries)))
    else:
        v = df.select(F.array(*vals).alias("v"))
        left = v.select(F.posexplode("v").alias("i", "a"), "v")
        both = left.select("i", "a", F.posexplode("v").alias("j", "b")).where(F.col("i") < F.col("j"))
        # masking inside the aggregates (not null filters on the generated
        # values, which make constraint inference blow up on wide inputs)
        a, b = F.col("a"), F.col("b")
        present = a.isNotNull() & b.isNotNull()
        agg = both.groupBy("i", "j").agg(*safe_corr_parts(a, b, present))
        # one row per pair (bounded by the schema): every pair is listed, also
        # pairs that share no row (n = 0), without a join in the data plan
        # the filter on generated pair indices makes constraint inference
        # exponential in the number of aliased input columns; the collect is
        # planned without it (nothing here benefits from inferred filters)
        with conf_override(spark, "spark.sql.constraintPropagation.enabled", "false"):
            collected = agg.collect()
        got = {(r["i"], r["j"]): (r["n"], r["r"]) for r in collected}
        rows = []
        for i, j in pairs:
            n, r = got.get((i, j), (0, None))
            rows.append((ords[i], ords[j], names[i], names[j], int(n), None if r is None else float(r)))
        out = spark.createDataFrame(rows, schema)
    return out.withColumn("r", F.round(usable_r(F.col("n"), F.col("r")), digits) + F.lit(0.0))


def correlations(df_or_metrics) -> DataFrame:
    """Every unique pair of eligible columns: column1, column2, correlation,
    abs_correlation, strength, direction, tier."""
    m = metrics_of(df_or_metrics)
    names = eligible_columns(m)
    pc = pair_correlations(m.df, names, complete=_complete(m))
    return pc.select(
        "ord1", "ord2", "column1", "column2",
        F.col("r").alias("correlation"),
        F.abs("r").alias("abs_correlation"),
        *strength_columns(F.col("r")),
    )


def correlation_matrix(df_or_metrics) -> DataFrame:
    """Long-form matrix over eligible columns (both orders and the diagonal)."""
    m = metrics_of(df_or_metrics)
    names = eligible_columns(m)
    pc = pair_correlations(m.df, names, complete=_complete(m))
    spark = m.spark
    diag = spark.createDataFrame([(n, n, 1.0) for _, n in names], "row_column string, col_column string, value double")
    # both orders from one row of a pair, so the pairs are computed once
    pair = lambda a, b: F.struct(F.col(a).alias("row_column"), F.col(b).alias("col_column"), F.col("r").alias("value"))
    return pc.select(F.inline(F.array(pair("column1", "column2"), pair("column2", "column1")))).unionByName(diag)


def top_correlations(df_or_metrics, pairs: DataFrame | None = None, top: int = TOP_PAIRS) -> DataFrame:
    """Pairs ranked by |r| (ties in column order); near-zero pairs dropped when
    at least three stronger ones remain; first ``top``."""
    pc = pairs if pairs is not None else correlations(df_or_metrics)
    enough = pc.agg(F.count_if(F.col("abs_correlation") >= MEANINGFUL).alias("n_meaningful"))
    kept = pc.crossJoin(F.broadcast(enough)).where(
        (F.col("n_meaningful") < 3) | (F.col("abs_correlation") >= MEANINGFUL)
    )
    best = kept.orderBy(F.col("abs_correlation").desc(), "ord1", "ord2").limit(top)
    # at most `top` rows: a single-partition window is fine here
    rank = F.row_number().over(Window.orderBy(F.col("abs_correlation").desc(), "ord1", "ord2"))
    return best.select(rank.alias("rank"), *[c for c in pc.columns])


def correlation_summary(df_or_metrics) -> DataFrame:
    """One row: eligible numeric column count, pairs evaluated, and a message
    when fewer than two columns qualify (C5)."""
    m = metrics_of(df_or_metrics)
    k = len(eligible_columns(m))
    msg = ("At least two suitable numeric columns are required to calculate correlations." if k < 2 else "Ready")
    return m.spark.createDataFrame([(k, k * (k - 1) // 2, msg)],
                                   "numeric_column_count int, total_pairs_evaluated int, message string")
