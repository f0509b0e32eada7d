"""Profile and descriptive statistics, one row per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions.cleaning import emit, pct
from tablelens.plans.passes import TableMetrics, col_ref


def metrics_of(df_or_metrics) -> TableMetrics:
    return df_or_metrics if isinstance(df_or_metrics, TableMetrics) else TableMetrics(df_or_metrics)


def skew_g1(g1: Column, n: Column) -> Column:
    """Bias-corrected sample skewness G1 from Spark's population g1.

    n ≤ 2 → 0; a constant column (g1 undefined) → 0.
    """
    adj = g1 * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n <= 2, F.lit(0.0)).otherwise(F.coalesce(adj, F.lit(0.0)))


def profile(df_or_metrics) -> DataFrame:
    """name, ordinal, data_type, missing count / %, distinct count, min/max/mean/median."""
    m = metrics_of(df_or_metrics)
    c = m.columns
    numeric = (F.col("kind") == "numeric") & (F.col("num_count") > 0)

    def num(x: Column) -> Column:
        return F.when(numeric, x)

    out = c.select(
        "column_name",
        F.col("ord").cast("long").alias("ordinal"),
        "data_type",
        F.col("missing_count").cast("long").alias("missing_count"),
        pct(F.col("missing_count"), F.col("total_rows")).alias("missing_pct"),
        F.col("unique_count").cast("long").alias("unique_count"),
        num(F.col("num_min")).alias("min"),
        num(F.col("num_max")).alias("max"),
        num(F.col("num_mean")).alias("mean"),
        num(F.col("median")).alias("median"),
    )
    return emit(out, ["min", "max", "mean", "median"])


def profile_summary(df_or_metrics) -> DataFrame:
    """One row: row_count, column_count, logical size in KB, columns with missing values."""
    m = metrics_of(df_or_metrics)
    c = m.columns
    size_bytes = _logical_size(m)
    missing = F.filter(
        F.array_sort(F.collect_list(F.struct("ord", "column_name", "missing_count"))),
        lambda s: s["missing_count"] > 0,
    )
    return c.agg(
        F.max("total_rows").cast("long").alias("row_count"),
        F.count(F.lit(1)).cast("long").alias("column_count"),
        F.transform(missing, lambda s: s["column_name"]).alias("missing_columns"),
    ).crossJoin(size_bytes)


def _logical_size(m: TableMetrics) -> DataFrame:
    """Memory size re-aimed as logical size: text bytes + fixed widths × rows.

    Text bytes come from the kept value counts (bytes of each distinct value
    × its count), so no extra scan is needed unless the table has nested
    columns, whose JSON size is summed over the rows.
    """
    widths = {"numeric": 8, "boolean": 1, "datetime": 8}
    str_ords = m.ords("string")
    fixed = sum(widths.get(s.kind, 0) for s in m.specs)
    text = m.value_counts.where(F.col("ord").isin(str_ords)) if str_ords else m.value_counts.limit(0)
    parts = m.columns.agg(F.coalesce(F.max("total_rows"), F.lit(0)).alias("rows")).crossJoin(
        text.agg(F.coalesce(F.sum(F.octet_length("key") * F.col("n")), F.lit(0)).alias("text_bytes"))
    )
    nested = [s for s in m.specs if s.kind == "complex"]
    if nested:
        js = [F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(col_ref(s.name))))), F.lit(0)) for s in nested]
        total = js[0]
        for e in js[1:]:
            total = total + e
        parts = parts.crossJoin(m.df.agg(total.alias("nested_bytes")))
    else:
        parts = parts.withColumn("nested_bytes", F.lit(0))
    size = F.col("text_bytes") + F.col("nested_bytes") + F.col("rows") * fixed
    return parts.select(F.round(size / 1024.0, 2).alias("memory_kb"))


def semantic_type(cols: DataFrame) -> Column:
    return (
        F.when(F.col("is_identifier"), "identifier")
        .when(F.col("kind") == "boolean", "boolean")
        .when(F.col("kind") == "numeric", "numeric")
        .otherwise("categorical")
    )


def statistics(df_or_metrics) -> DataFrame:
    """Whole-table statistics frame, one row per column.

    Numeric (non-boolean) columns get count/min/max/mean/median/sum/std/
    variance/q25/q75/skewness; others get count, unique count and the most
    frequent value (ties: smallest value) with its share of non-missing.
    """
    m = metrics_of(df_or_metrics)
    c = m.identified.join(m.exact_ranges, "ord", "left")
    n = F.col("num_count")
    numeric = (F.col("kind") == "numeric") & (n > 0)
    categorical = (F.col("kind") != "numeric") & (F.col("kind") != "complex") & (F.col("present") > 0)

    def num(x: Column) -> Column:
        return F.when(numeric, x)

    out = c.select(
        "column_name",
        F.col("ord").cast("long").alias("ordinal"),
        "data_type",
        semantic_type(c).alias("semantic_type"),
        F.col("missing_count").cast("long").alias("missing_count"),
        pct(F.col("missing_count"), F.col("total_rows")).alias("missing_pct"),
        F.col("unique_count").cast("long").alias("unique_count"),
        F.when(numeric, n).when(categorical, F.col("present")).cast("long").alias("count"),
        num(F.col("num_min")).alias("min"),
        num(F.col("num_max")).alias("max"),
        num(F.col("num_mean")).alias("mean"),
        num(F.col("median")).alias("median"),
        num(F.col("num_sum")).alias("sum"),
        num(F.when(n > 1, F.col("num_std")).otherwise(F.lit(0.0))).alias("std"),
        num(F.when(n > 1, F.col("num_var")).otherwise(F.lit(0.0))).alias("variance"),
        num(F.when(n > 1, F.col("q25")).otherwise(F.col("num_min"))).alias("q25"),
        num(F.when(n > 1, F.col("q75")).otherwise(F.col("num_max"))).alias("q75"),
        num(skew_g1(F.col("num_skew_pop"), n)).alias("skewness"),
        F.when(categorical, F.col("top_value")).alias("top_value"),
        F.when(categorical, F.col("top_freq")).cast("long").alias("top_frequency"),
        F.when(categorical, pct(F.col("top_freq"), F.col("present"))).alias("top_pct"),
        # integers and decimals as they are, however large
        "exact_min", "exact_max", "exact_sum",
    )
    return emit(out, ["min", "max", "mean", "median", "sum", "std", "variance", "q25", "q75", "skewness"])
