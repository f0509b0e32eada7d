"""Chart data: histograms, discrete bars, category frequencies and time
periods, one row per bar (V1–V8).

Everything is computed from the shared value-count frame (one row per
distinct value per column) and the per-column frame; raw rows are not read
again.  Bin edges are Spark expressions on the per-column frame (one row per
column, so the frame that is broadcast is bounded by the schema width), and
each value is placed by counting the inner edges below it, which gives
right-closed bins with the first bin closed on both ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions.dates import parse_date
from tablelens.functions.formatting import format_int_edge, format_int_label, format_label
from tablelens.functions.naming import is_year_name
from tablelens.operators.profile import metrics_of
from tablelens.plans.passes import TableMetrics

MAX_CATEGORIES = 10
DEFAULT_BINS = 8
DISCRETE_MAX_DISTINCT = 14
DATETIME_MIN_RATE = 0.8


def _pct1(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole * 100.0, 1)).otherwise(F.lit(0.0))


def histogram_plan(cols: DataFrame, bins: int = DEFAULT_BINS) -> DataFrame:
    """Per numeric column: ``mode`` (constant / single / discrete / bins), the
    bin edges and whether they are integer edges."""
    n = F.col("num_count")
    mn, mx = F.col("num_min"), F.col("num_max")
    u = F.col("unique_count")
    all_int = (F.col("num_nonint") == 0) & (F.col("num_inf") == 0)
    mode = (
        F.when(n == 0, F.lit(None))
        .when(mn == mx, "constant")
        .when(F.col("num_inf") > 0, "single")
        .when(all_int & (u <= DISCRETE_MAX_DISTINCT), "discrete")
        .otherwise("bins")
    )
    k = F.least(F.lit(bins), F.greatest(F.lit(2), F.least(u, F.lit(8)))).cast("int")
    step = (mx - mn) / k
    # evenly spaced: start + i·step, the last edge exactly the maximum
    lin = F.transform(
        F.sequence(F.lit(0), k),
        lambda i: F.when(i == k, mx).otherwise(mn + i.cast("double") * step),
    )
    int_edges = F.array_distinct(F.transform(lin, lambda x: F.bround(x, 0)))
    int_edges = F.when(F.size(int_edges) >= 2, int_edges).otherwise(
        F.array(F.floor(mn).cast("double"), (F.floor(mx) + 1).cast("double"))
    )
    edges = F.when(all_int, int_edges).otherwise(lin)
    return cols.where(F.col("kind") == "numeric").select(
        "ord", "column_name", "num_count", "num_min", "num_max",
        is_year_name(F.col("column_name")).alias("is_year"),
        mode.alias("mode"),
        all_int.alias("int_edges"),
        edges.alias("edges"),
    ).where(F.col("mode").isNotNull())


def _histograms(m: TableMetrics) -> DataFrame:
    plan = histogram_plan(m.columns)
    is_year = F.col("is_year")
    mn, mx = F.col("num_min"), F.col("num_max")

    # constant column → one bar; infinite values → one bucket over the whole range
    single = plan.where(F.col("mode").isin("constant", "single")).select(
        "ord",
        F.lit("histogram").alias("type"),
        F.lit(1).alias("position"),
        F.when(F.col("mode") == "constant", format_label(mn, is_year))
        .otherwise(F.concat(format_label(mn, is_year), F.lit(" – "), format_label(mx, is_year))).alias("value"),
        F.lit(None).cast("string").alias("label"),
        mn.alias("lower"), mx.alias("upper"),
        F.col("num_count").cast("long").alias("count"),
        F.lit(100.0).alias("percentage"),
    ).withColumn("label", F.col("value"))

    # plan: one row per numeric column — bounded by the schema width
    small_plan = F.broadcast(plan.where(F.col("mode").isin("discrete", "bins")))
    vc = m.value_counts.where(F.col("num").isNotNull()).join(small_plan, "ord")

    w_disc = Window.partitionBy("ord").orderBy("num")
    discrete = vc.where(F.col("mode") == "discrete").select(
        "ord",
        F.lit("histogram").alias("type"),
        F.row_number().over(w_disc).alias("position"),
        format_int_label(F.col("num"), is_year).alias("value"),
        F.lit(None).cast("string").alias("label"),
        F.col("num").alias("lower"), F.col("num").alias("upper"),
        F.col("n").cast("long").alias("count"),
        _pct1(F.col("n"), F.col("num_count")).alias("percentage"),
    ).withColumn("label", F.col("value"))

    binned = vc.where(F.col("mode") == "bins").select(
        "ord",
        F.size(F.filter(
            F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0))),
            lambda e: F.col("num") > e,
        )).alias("bin"),
        "n",
    ).groupBy("ord", "bin").agg(F.sum("n").alias("cnt"))
    skeleton = plan.where(F.col("mode") == "bins").select(
        "ord", "num_count", "is_year", "int_edges",
        F.posexplode(F.slice("edges", 1, F.size("edges") - 1)).alias("bin", "lower"),
        "edges",
    ).withColumn("upper", F.element_at("edges", F.col("bin") + 2))
    lo, hi = F.col("lower"), F.col("upper")
    int_label = F.when(
        lo != hi,
        F.concat(format_int_edge(lo, is_year), F.lit(" – "), format_int_edge(hi, is_year)),
    ).otherwise(format_int_edge(lo, is_year))
    float_label = F.concat(format_label(lo, is_year), F.lit(" – "), format_label(hi, is_year))
    cnt = F.coalesce(F.col("cnt"), F.lit(0)).cast("long")
    bars = skeleton.join(binned, ["ord", "bin"], "left").select(
        "ord",
        F.lit("histogram").alias("type"),
        (F.col("bin") + 1).alias("position"),
        F.when(F.col("int_edges"), int_label).otherwise(float_label).alias("value"),
        F.lit(None).cast("string").alias("label"),
        lo.alias("lower"), hi.alias("upper"),
        cnt.alias("count"),
        _pct1(cnt, F.col("num_count")).alias("percentage"),
    ).withColumn("label", F.col("value"))
    return single.unionByName(discrete).unionByName(bars)


def _time_ords(cols: DataFrame) -> DataFrame:
    detected = (F.col("kind") == "string") & (F.col("dt_rate") >= DATETIME_MIN_RATE) & (F.col("nondigit") > 0)
    return cols.where((F.col("kind") == "datetime") | detected).select("ord")


def _times(m: TableMetrics) -> DataFrame:
    # the selected ords: one row per column — bounded by the schema width
    ts = parse_date(F.col("key"))
    vc = m.value_counts.join(F.broadcast(_time_ords(m.columns)), "ord").select(
        "ord", ts.alias("ts"), "n"
    ).where(F.col("ts").isNotNull())
    span = vc.groupBy("ord").agg(
        F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.sum("n").alias("total")
    ).select(
        "ord", "total",
        F.floor((F.unix_micros("t1") - F.unix_micros("t0")) / F.lit(86_400_000_000)).alias("span_days"),
    )
    periods = vc.join(F.broadcast(span), "ord").select(
        "ord", "total",
        F.when(F.col("span_days") > 730, F.date_format("ts", "yyyy"))
        .when(F.col("span_days") > 60, F.date_format("ts", "yyyy-MM"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("period"),
        "n",
    ).groupBy("ord", "period").agg(F.sum("n").alias("cnt"), F.max("total").alias("total"))
    last = periods.withColumn(
        "rk", F.row_number().over(Window.partitionBy("ord").orderBy(F.col("period").desc()))
    ).where(F.col("rk") <= MAX_CATEGORIES)
    return last.select(
        "ord",
        F.lit("time").alias("type"),
        F.row_number().over(Window.partitionBy("ord").orderBy("period")).alias("position"),
        F.col("period").alias("value"),
        F.col("period").alias("label"),
        F.lit(None).cast("double").alias("lower"),
        F.lit(None).cast("double").alias("upper"),
        F.col("cnt").cast("long").alias("count"),
        _pct1(F.col("cnt"), F.col("total")).alias("percentage"),
    )


def category_label(key: Column) -> Column:
    """Trimmed text; blank → "Empty" (missing values never reach this step)."""
    s = F.trim(key)
    return F.when(s == "", F.lit("Empty")).otherwise(s)


def _frequencies(m: TableMetrics, max_categories: int = MAX_CATEGORIES) -> DataFrame:
    cols = m.columns
    time_ords = _time_ords(cols)
    freq_ords = cols.where(F.col("kind").isin("string", "boolean")).select("ord").join(time_ords, "ord", "left_anti")
    # the selected ords: one row per column — bounded by the schema width
    vc = m.value_counts.join(F.broadcast(freq_ords), "ord")
    labelled = vc.groupBy("ord", category_label(F.col("key")).alias("value")).agg(F.sum("n").alias("cnt"))
    totals = labelled.groupBy("ord").agg(F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("distinct"))
    top = labelled.withColumn(
        "position",
        F.row_number().over(Window.partitionBy("ord").orderBy(F.col("cnt").desc(), F.col("value"))),
    ).where(F.col("position") <= max_categories)
    top = top.join(F.broadcast(totals), "ord")
    kept = top.select(
        "ord",
        F.lit("frequency").alias("type"),
        F.col("position").cast("int").alias("position"),
        "value",
        F.col("value").alias("label"),
        F.lit(None).cast("double").alias("lower"),
        F.lit(None).cast("double").alias("upper"),
        F.col("cnt").cast("long").alias("count"),
        _pct1(F.col("cnt"), F.col("total")).alias("percentage"),
    )
    other = top.groupBy("ord").agg(
        F.sum("cnt").alias("kept"), F.max("total").alias("total"), F.max("distinct").alias("distinct")
    ).where((F.col("distinct") > max_categories) & (F.col("total") > F.col("kept"))).select(
        "ord",
        F.lit("frequency").alias("type"),
        F.lit(max_categories + 1).alias("position"),
        F.lit("Other").alias("value"),
        F.format_string("Other (%d values)", F.col("distinct") - max_categories).alias("label"),
        F.lit(None).cast("double").alias("lower"),
        F.lit(None).cast("double").alias("upper"),
        (F.col("total") - F.col("kept")).cast("long").alias("count"),
        _pct1(F.col("total") - F.col("kept"), F.col("total")).alias("percentage"),
    )
    return kept.unionByName(other)


def distributions(df_or_metrics) -> DataFrame:
    """All chart data, one row per bar: column_name, ordinal, type
    (time / histogram / frequency), position, value, label, lower, upper,
    count, percentage."""
    m = metrics_of(df_or_metrics)
    parts = _times(m).unionByName(_histograms(m)).unionByName(_frequencies(m))
    names = m.schema_frame.select("ord", "column_name")
    return parts.join(F.broadcast(names), "ord").select(
        "column_name",
        F.col("ord").cast("long").alias("ordinal"),
        "type",
        F.col("position").cast("int").alias("position"),
        "value", "label", "lower", "upper", "count", "percentage",
    )
