"""Data quality: missing cells, duplicates, empty/constant/high-cardinality
columns, IQR outliers with a z-score fallback, health score (Q1–Q11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions.cleaning import pct
from tablelens.operators.profile import metrics_of
from tablelens.plans.passes import TableMetrics, col_ref


def outlier_bounds(cols: DataFrame) -> DataFrame:
    """Per numeric column: (ord, lo, hi, lower_bound, upper_bound, eligible).

    n ≥ 4 values; IQR fence q1−1.5·iqr / q3+1.5·iqr; when iqr = 0, mean ±
    2.5·sample std; when that std is 0 too, no outliers and the bounds are
    reported as q1 / q3.
    """
    n = F.col("num_count")
    q1, q3 = F.col("q25"), F.col("q75")
    iqr = q3 - q1
    mean, std = F.col("num_mean"), F.col("num_std")
    eligible = (F.col("kind") == "numeric") & (n >= 4)
    lo = F.when(iqr > 0, q1 - 1.5 * iqr).when(std > 0, mean - 2.5 * std)
    hi = F.when(iqr > 0, q3 + 1.5 * iqr).when(std > 0, mean + 2.5 * std)
    return cols.where(eligible).select(
        "ord",
        lo.alias("lo"),
        hi.alias("hi"),
        F.round(F.coalesce(lo, q1), 2).alias("lower_bound"),
        F.round(F.coalesce(hi, q3), 2).alias("upper_bound"),
    )


def outlier_counts(m: TableMetrics) -> DataFrame:
    """(ord, outlier_count, lower_bound, upper_bound) over the value-count frame."""
    bounds = outlier_bounds(m.columns)
    # bounds: one row per numeric column — bounded by the schema width
    vc = m.value_counts.where(F.col("num").isNotNull())
    hits = vc.join(F.broadcast(bounds.where(F.col("lo").isNotNull())), "ord").groupBy("ord").agg(
        F.sum(F.when((F.col("num") < F.col("lo")) | (F.col("num") > F.col("hi")), F.col("n")).otherwise(0))
        .alias("outlier_count")
    )
    return bounds.join(hits, "ord", "left").select(
        "ord",
        F.coalesce(F.col("outlier_count"), F.lit(0)).cast("long").alias("outlier_count"),
        "lower_bound",
        "upper_bound",
    )


def quality_columns(df_or_metrics) -> DataFrame:
    """Per-column quality record (Q9)."""
    m = metrics_of(df_or_metrics)
    c = m.identified.join(outlier_counts(m), "ord", "left")
    total = F.col("total_rows")
    unique = F.col("unique_count")
    non_numericish = ~F.col("kind").isin("numeric", "boolean")
    high_card = non_numericish & (total >= 10) & (unique / F.when(total > 0, total) > 0.8)
    numeric = F.col("kind") == "numeric"
    out_n = F.coalesce(F.col("outlier_count"), F.lit(0))
    return c.select(
        "column_name",
        F.col("ord").cast("long").alias("ordinal"),
        "data_type",
        F.col("missing_count").cast("long").alias("missing_count"),
        pct(F.col("missing_count"), total).alias("missing_pct"),
        unique.cast("long").alias("unique_count"),
        ((F.coalesce(unique, F.lit(0)) + (F.col("missing_count") > 0).cast("int")) <= 1).alias("is_constant"),
        (F.col("present") == 0).alias("is_empty"),
        F.col("is_identifier").alias("is_id_candidate"),
        F.coalesce(high_card, F.lit(False)).alias("is_high_cardinality"),
        F.when(numeric, out_n).cast("long").alias("outlier_count"),
        F.when(numeric, pct(out_n, F.col("num_count"))).alias("outlier_pct"),
        F.when(numeric, F.col("lower_bound")).alias("lower_bound"),
        F.when(numeric, F.col("upper_bound")).alias("upper_bound"),
    )


def _normalized_row(df: DataFrame) -> list[Column]:
    """Row values with NaN → null and -0.0 → 0.0, so equal rows compare equal."""
    cols = []
    for f in df.schema.fields:
        c = col_ref(f.name)
        t = f.dataType.simpleString()
        if t in ("double", "float"):
            c = F.when(F.isnan(c), F.lit(None).cast(t)).otherwise(c + F.lit(0.0).cast(t))
        elif t.startswith("map<"):
            c = F.to_json(c)
        cols.append(c.alias(f.name))
    return cols


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: ``duplicate_rows`` = rows beyond the first of each identical row.

    Only 64-bit row hashes are grouped over all rows (partial aggregation
    collapses repeats map-side).  Rows whose hash is seen once cannot be
    duplicates; the others are kept by a semi join, whose strategy is left to
    the optimiser, and grouped exactly.
    """
    if not df.columns:
        return df.sparkSession.createDataFrame([(0,)], "duplicate_rows long")
    norm = df.select(*_normalized_row(df))
    keys = [col_ref(c) for c in norm.columns]
    hashed = norm.withColumn("__h", F.xxhash64(*keys))
    seen = hashed.groupBy("__h").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1).select("__h")
    grouped = hashed.join(seen, "__h", "left_semi").drop("__h").groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return grouped.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def _names_where(cond: Column) -> Column:
    picked = F.filter(
        F.array_sort(F.collect_list(F.struct(F.col("ordinal"), F.col("column_name"), cond.alias("hit")))),
        lambda s: s["hit"],
    )
    return F.transform(picked, lambda s: s["column_name"])


def health_status(score: Column) -> Column:
    return (
        F.when(score >= 85, "Excellent").when(score >= 70, "Good").when(score >= 50, "Fair").otherwise("Poor")
    )


def quality_summary(df_or_metrics, duplicates: DataFrame | None = None) -> DataFrame:
    """One row: cells, missing, duplicates, column lists, outliers, health score and status."""
    m = metrics_of(df_or_metrics)
    qc = quality_columns(m)
    dup = duplicates if duplicates is not None else duplicate_rows(m.df)
    per = qc.agg(
        F.count(F.lit(1)).cast("long").alias("column_count"),
        F.coalesce(F.sum("missing_count"), F.lit(0)).cast("long").alias("missing_cells"),
        _names_where(F.col("is_empty")).alias("empty_columns"),
        _names_where(F.col("is_constant")).alias("constant_columns"),
        _names_where(F.col("is_id_candidate")).alias("id_columns"),
        _names_where(F.col("is_high_cardinality") & ~F.col("is_id_candidate")).alias("high_cardinality_columns"),
        _names_where(F.coalesce(F.col("outlier_count"), F.lit(0)) > 0).alias("outlier_columns"),
        F.coalesce(F.sum("outlier_count"), F.lit(0)).cast("long").alias("total_outliers"),
    )
    rows = m.columns.agg(F.coalesce(F.max("total_rows"), F.lit(0)).cast("long").alias("row_count"))
    s = rows.crossJoin(per).crossJoin(dup)
    cells = F.col("row_count") * F.col("column_count")
    s = s.withColumn("total_cells", cells.cast("long"))
    s = s.withColumn("missing_pct", pct(F.col("missing_cells"), F.col("total_cells")))
    s = s.withColumn(
        "duplicate_rows", F.when(F.col("row_count") > 0, F.col("duplicate_rows")).otherwise(F.lit(0)).cast("long")
    )
    s = s.withColumn("duplicate_pct", pct(F.col("duplicate_rows"), F.col("row_count")))
    score = (
        F.lit(100.0)
        - F.least(F.lit(35.0), F.col("missing_pct") * 1.5)
        - F.least(F.lit(20.0), F.col("duplicate_pct") * 2.0)
        - F.least(F.lit(15.0), F.size("empty_columns") * 10.0)
        - F.least(F.lit(15.0), F.size("constant_columns") * 5.0)
        - F.when(
            F.col("total_cells") > 0,
            F.least(F.lit(15.0), F.col("total_outliers") / F.col("total_cells") * 100.0 * 3.0),
        ).otherwise(F.lit(0.0))
    )
    s = s.withColumn("health_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(score, 1))))
    s = s.withColumn("health_status", health_status(F.col("health_score")))
    return s.select(
        "row_count", "column_count", "total_cells", "missing_cells", "missing_pct",
        "duplicate_rows", "duplicate_pct", "empty_columns", "constant_columns", "id_columns",
        "high_cardinality_columns", "outlier_columns", "total_outliers", "health_score", "health_status",
    )
