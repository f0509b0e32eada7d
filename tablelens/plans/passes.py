"""The shared passes every profiling operator reads from.

Every column is read **once**, whatever the table's width: the columns of one
class of types (integers, floats, dates, times, the rest) are unpivoted into
``(ord, value)`` and grouped by it in that type, so neither the rows nor the
exchange hold texts of numbers and times.  From the distinct values follow
``(ord, key, num, n)`` (``key``: the value as text; ``num``: the value as a
double for numeric and boolean columns; both null when the value is missing).
Partial aggregation collapses repeated values map-side (a value holding a
third of all rows becomes one row per task) and the exchange is hashed on the
value, so high-cardinality columns spread evenly.
The resulting value-count frame (one row per distinct value per column,
plus one row per column for its missing values) is kept — cached, or
checkpointed into the shared checkpoint folder — because everything else
reads it:

* moments — counts, min/max, sum, mean, and centred second and third
  moments from a second, weighted pass over the value counts (two-pass, so
  no catastrophic cancellation on large values);
* text tests (identifier patterns, lengths, date parsing) — run once per
  distinct value and weighted by its count, not once per row;
* distinct counts, modes, top-k tables, quantiles, histograms and outlier
  counts.

Everything downstream works on the value-count frame or on the
per-column frame (one row per column), never on raw rows again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.dates import parse_date
from tablelens.functions.naming import PREFIX_ID_PATTERN, UUID_PATTERN
from tablelens.functions.quantiles import exact_quantiles
from tablelens.session import materialize

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
QUANTILES = [0.25, 0.5, 0.75]


@dataclass(frozen=True)
class ColumnSpec:
    ordinal: int
    name: str
    dtype: str  # Spark simpleString
    kind: str  # numeric | boolean | string | datetime | complex
    integral: bool
    floating: bool

    @property
    def is_numeric(self) -> bool:
        """Numeric and not boolean (the profile's notion of a measure)."""
        return self.kind == "numeric"

    @property
    def is_textual(self) -> bool:
        """Values judged by their text: strings and date/times."""
        return self.kind in ("string", "datetime")


def column_specs(df: DataFrame) -> list[ColumnSpec]:
    specs = []
    for i, f in enumerate(df.schema.fields):
        t = f.dataType
        if isinstance(t, T.BooleanType):
            kind = "boolean"
        elif isinstance(t, NUMERIC_TYPES):
            kind = "numeric"
        elif isinstance(t, T.StringType):
            kind = "string"
        elif isinstance(t, DATETIME_TYPES):
            kind = "datetime"
        else:
            kind = "complex"
        specs.append(
            ColumnSpec(
                ordinal=i,
                name=f.name,
                dtype=t.simpleString(),
                kind=kind,
                integral=isinstance(t, INTEGRAL_TYPES),
                floating=isinstance(t, FLOAT_TYPES),
            )
        )
    return specs


def col_ref(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def clean_numeric(spec: ColumnSpec, c: Column) -> Column:
    """Numeric value as double; NaN is missing; -0.0 folds into 0.0."""
    if spec.floating:
        d = c.cast("double")
        return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d + F.lit(0.0))
    return c.cast("double")


def value_class(spec: ColumnSpec) -> str:
    """The type that a column's values are grouped in; ``other``: as text and number."""
    if spec.kind == "datetime":
        # the text of a time is that of its local time, also where a clock is set back
        return "date" if spec.dtype == "date" else "timestamp_ntz"
    return "bigint" if spec.integral else "double" if spec.floating else "other"


def value_key(spec: ColumnSpec, c: Column) -> tuple[Column, Column]:
    """(key, num) of a column of the class ``other``: key is null exactly when the value is missing."""
    null_d = F.lit(None).cast("double")
    if spec.kind == "numeric":
        # decimals are told apart by their exact text
        return c.cast("string"), clean_numeric(spec, c)
    if spec.kind == "boolean":
        key = F.when(c, F.lit("True")).when(~c, F.lit("False"))
        return key, c.cast("double")
    if spec.kind == "string":
        return c, null_d
    # complex values: only presence is profiled
    return F.when(c.isNotNull(), F.lit("")), null_d


def _unpivoted(df: DataFrame, entries: list[Column]) -> DataFrame:
    return df.select(F.inline(F.array(*entries)))


def class_counts(df: DataFrame, specs: list[ColumnSpec], kind: str) -> DataFrame:
    """(ord, key, num, n) of the columns of one class: a row for each distinct value, and one for missing ones."""
    n = F.count(F.lit(1)).alias("n")
    if kind == "other":
        pairs = [(s, *value_key(s, col_ref(s.name))) for s in specs]
        return _unpivoted(df, [F.struct(F.lit(s.ordinal).alias("ord"), key.alias("key"), num.alias("num")) for s, key, num in pairs]) \
            .groupBy("ord", "key", "num").agg(n)
    value = {s: clean_numeric(s, col_ref(s.name)) if kind == "double" else col_ref(s.name).cast(kind) for s in specs}
    counts = _unpivoted(df, [F.struct(F.lit(s.ordinal).alias("ord"), v.alias("v")) for s, v in value.items()]).groupBy("ord", "v").agg(n)
    num = F.col("v").cast("double") if kind in ("bigint", "double") else F.lit(None).cast("double")
    return counts.select("ord", F.col("v").cast("string").alias("key"), num.alias("num"), "n")


def counted_values(df: DataFrame, specs: list[ColumnSpec]) -> DataFrame:
    """(ord, key, num, n) of all columns: an aggregate for each class of types, at most five."""
    of_class: dict[str, list[ColumnSpec]] = {}
    for s in specs:
        of_class.setdefault(value_class(s), []).append(s)
    made: DataFrame | None = None
    for kind, own in of_class.items():
        part = class_counts(df, own, kind)
        made = part if made is None else made.unionByName(part)
    return made if made is not None else df.sparkSession.createDataFrame([], "ord int, key string, num double, n long")


def _rebuilt(small: DataFrame) -> DataFrame:
    """A per-column frame (one row per column, bounded by the schema) as a
    fresh frame with a short plan.

    Every later rule is planned against this frame; rebuilding it from its
    rows keeps the analysis of those rules independent of the width of the
    unpivot and identifier expressions below it.
    """
    rows = small.collect()
    return small.sparkSession.createDataFrame(rows, small.schema).cache()


def _inf(c: Column) -> Column:
    return F.abs(c) == F.lit(float("inf"))


class TableMetrics:
    """Per-column metrics of one DataFrame, computed once and shared.

    ``columns`` is a small Spark frame, one row per column; ``value_counts``
    is the kept value-count frame.  ``rows`` collects ``columns`` (one row
    per column, bounded by the schema) for decisions that shape later plans.
    """

    def __init__(self, df: DataFrame, quantile_map_limit: int = 2_000_000, reliable: bool = False,
                 with_quantiles: bool = True):
        self.df = df
        # without quantiles the column frame carries null q25 / median / q75
        # (enough for identifier, constant and leakage rules)
        self.with_quantiles = with_quantiles
        self.spark = df.sparkSession
        self.specs = column_specs(df)
        self.quantile_map_limit = quantile_map_limit
        self.reliable = reliable

    # -- helpers -----------------------------------------------------------
    def spec(self, name: str) -> ColumnSpec:
        for s in self.specs:
            if s.name == name:
                return s
        raise KeyError(name)

    def ords(self, *kinds: str) -> list[int]:
        return [s.ordinal for s in self.specs if s.kind in kinds]

    @cached_property
    def schema_frame(self) -> DataFrame:
        rows = [(s.ordinal, s.name, s.dtype, s.kind, s.integral) for s in self.specs]
        schema = "ord int, column_name string, data_type string, kind string, integral boolean"
        return self.spark.createDataFrame(rows, schema)

    # -- the shared scan: value counts ------------------------------------------
    @cached_property
    def counts_all(self) -> DataFrame:
        """(ord, key, num, n) including one row per column for its missing values."""
        vc = counted_values(self.df, self.specs)
        return materialize(vc, reliable=self.reliable)

    @cached_property
    def value_counts(self) -> DataFrame:
        """(ord, key, n, num): one row per distinct non-missing value per column."""
        complex_ords = self.ords("complex")
        vc = self.counts_all.where(F.col("key").isNotNull())
        if complex_ords:
            vc = vc.where(~F.col("ord").isin(complex_ords))
        return vc.select("ord", "key", "n", "num")

    # -- moments from the value counts -----------------------------------------
    @cached_property
    def moments(self) -> DataFrame:
        text_ords = self.ords("string", "datetime")
        str_ords = self.ords("string")
        is_text = F.col("ord").isin(text_ords) if text_ords else F.lit(False)
        is_str = F.col("ord").isin(str_ords) if str_ords else F.lit(False)
        key, num, n = F.col("key"), F.col("num"), F.col("n")
        tkey = F.trim(key)
        present_text = is_text & key.isNotNull()
        finite = num.isNotNull() & ~_inf(num)

        def wsum(cond: Column, value: Column | None = None) -> Column:
            return F.sum(F.when(cond, n * value if value is not None else n))

        def wavg(cond: Column, value: Column) -> Column:
            return F.try_divide(wsum(cond, value), wsum(cond))

        vc = self.counts_all
        first = vc.groupBy("ord").agg(
            F.sum(n).alias("n_rows"),
            F.coalesce(wsum(key.isNotNull()), F.lit(0)).alias("present"),
            F.coalesce(wsum(num.isNotNull()), F.lit(0)).alias("num_count"),
            F.min(num).alias("num_min"),
            F.max(num).alias("num_max"),
            wsum(num.isNotNull(), num).alias("num_sum"),
            F.coalesce(wsum(finite & ((num % 1) != 0)), F.lit(0)).alias("num_nonint"),
            F.coalesce(wsum(num.isNotNull() & _inf(num)), F.lit(0)).alias("num_inf"),
            wavg(present_text, F.length(tkey)).alias("avg_len"),
            wavg(present_text, tkey.rlike(UUID_PATTERN).cast("int")).alias("uuid_rate"),
            wavg(present_text, tkey.rlike(PREFIX_ID_PATTERN).cast("int")).alias("prefix_rate"),
            wavg(is_str & key.isNotNull(), parse_date(key).isNotNull().cast("int")).alias("dt_rate"),
            F.coalesce(wsum(is_str & key.isNotNull() & ~tkey.rlike("^[0-9]+$")), F.lit(0)).alias("nondigit"),
            F.count(key).alias("unique_count"),
            F.min(F.when(key.isNotNull(), n)).alias("min_freq"),
            F.max(F.when(key.isNotNull(), n)).alias("max_freq"),
        ).withColumn("num_mean", F.try_divide(F.col("num_sum"), F.col("num_count")))
        # the mode (ties: smallest value) and the smallest text: minima over the few
        # rows that can hold them, so the aggregate above holds numbers only
        present = vc.where(key.isNotNull()).select("ord", "key", "n")
        most = present.groupBy("ord").agg(F.max("n").alias("top_freq"))
        modes = present.join(F.broadcast(most), "ord").where(n == F.col("top_freq")).groupBy("ord", "top_freq").agg(F.min("key").alias("top_value"))
        least = present.where(is_text).groupBy("ord").agg(F.min("key").alias("min_text"))
        first = first.join(modes, "ord", "left").join(least, "ord", "left")
        # second pass over the (small) value counts: centred moments
        centred = vc.where(num.isNotNull()).join(F.broadcast(first.select("ord", "num_mean")), "ord").select(
            "ord", "n", (num - F.col("num_mean")).alias("d")
        ).groupBy("ord").agg(
            F.sum(F.col("n") * F.col("d") * F.col("d")).alias("m2"),
            F.sum(F.col("n") * F.col("d") * F.col("d") * F.col("d")).alias("m3"),
        )
        out = first.join(centred, "ord", "left")
        cnt, m2, m3 = F.col("num_count"), F.col("m2"), F.col("m3")
        # one row per column: kept, since quantile planning and the column frame both read it
        return out.select(
            "*",
            F.when(cnt > 1, F.sqrt(m2 / (cnt - 1))).alias("num_std"),
            F.when(cnt > 1, m2 / (cnt - 1)).alias("num_var"),
            F.when(cnt > 0, F.sqrt(m2 / cnt)).alias("num_std_pop"),
            # population g1 = √n · m3 / m2^1.5 (undefined for a constant column)
            F.when(m2 > 0, F.sqrt(cnt) * m3 / F.pow(m2, 1.5)).alias("num_skew_pop"),
        ).drop("m2", "m3").cache()

    @cached_property
    def value_stats(self) -> DataFrame:
        """(ord, unique_count, top_value, top_freq, min_freq, max_freq)."""
        return self.moments.select("ord", "unique_count", "top_value", "top_freq", "min_freq", "max_freq")

    @cached_property
    def quantiles(self) -> DataFrame:
        """(ord, q25, median, q75) for numeric columns, exact (linear interpolation)."""
        num_ords = self.ords("numeric")
        vc = self.value_counts.where(F.col("ord").isin(num_ords) & F.col("num").isNotNull()) if num_ords \
            else self.value_counts.limit(0)
        uniq = {r["ord"]: r["unique_count"] for r in self.value_stats.where(F.col("ord").isin(num_ords)).collect()} \
            if num_ords else {}
        large = [o for o, u in uniq.items() if u > self.quantile_map_limit]
        # about a million distinct values per bucket on the widest column
        buckets = max(256, min(16384, max((uniq[o] for o in large), default=0) // 1_000_000))
        q = exact_quantiles(vc.select("ord", "num", "n"), QUANTILES, large_ords=large, buckets=buckets)
        return q.select(
            "ord",
            F.col("q")[0].alias("q25"),
            F.col("q")[1].alias("median"),
            F.col("q")[2].alias("q75"),
        )

    @cached_property
    def exact_ranges(self) -> DataFrame:
        """(ord, exact_min, exact_max, exact_sum) of integer and decimal columns, as text without rounding.

        One columnar aggregate; one row of results.
        """
        out = "ord int, exact_min string, exact_max string, exact_sum string"
        chosen = [s for s in self.specs if s.is_numeric and not s.floating]
        if not chosen:
            return self.spark.createDataFrame([], out)
        wide = {s.ordinal: f"decimal(38,{s.dtype.split(',')[1].strip(' )')})" if s.dtype.startswith("decimal") else "decimal(38,0)" for s in chosen}
        row = self.df.agg(*[
            f(col_ref(s.name) if f is not F.try_sum else col_ref(s.name).cast(wide[s.ordinal])).cast("string").alias(f"{name}{s.ordinal}")
            for s in chosen for name, f in (("a", F.min), ("b", F.max), ("c", F.try_sum))
        ]).first()
        return self.spark.createDataFrame([(s.ordinal, *[row[f"{x}{s.ordinal}"] for x in "abc"]) for s in chosen], out)

    def sample_values(self, n: int = 5) -> DataFrame:
        """(ord, sample_values): the ``n`` smallest distinct values of each column, as text."""
        order = Window.partitionBy("ord").orderBy(F.col("num").asc_nulls_last(), F.col("key"))
        # a top-n of each column: limited before the shuffle
        smallest = self.value_counts.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= n)
        return smallest.groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "key"))), lambda x: x["key"]).alias("sample_values"))

    def release(self) -> None:
        """Drop what this object keeps, and nothing of anybody else's."""
        for name in ("counts_all", "moments", "columns", "identified"):
            if name in self.__dict__:
                self.__dict__.pop(name).unpersist()

    # -- the per-column frame -------------------------------------------------
    @cached_property
    def columns(self) -> DataFrame:
        m = self.moments
        joined = (
            self.schema_frame
            .join(m, "ord", "left")
            .join(self.quantiles if self.with_quantiles
                  else self.spark.createDataFrame([], "ord int, q25 double, median double, q75 double"),
                  "ord", "left")
        )
        # every column's group holds one entry per row, so n_rows is the table's row count
        out = joined.withColumn("total_rows", F.coalesce(F.col("n_rows"), F.lit(0)).cast("long")).drop("n_rows")
        out = out.select(
            "*",
            (F.col("total_rows") - F.coalesce(F.col("present"), F.lit(0))).alias("missing_count"),
        ).fillna(0, subset=["present", "num_count", "num_nonint", "num_inf", "nondigit"])
        out = out.withColumn(
            "unique_count",
            F.when(F.col("kind") == "complex", F.lit(None).cast("long"))
            .otherwise(F.coalesce(F.col("unique_count"), F.lit(0)).cast("long")),
        )
        return _rebuilt(out)

    @cached_property
    def identified(self) -> DataFrame:
        """The per-column frame with identifier fields (cached: the name rules
        are long expressions that every later rule would otherwise inline)."""
        from tablelens.operators.identifiers import identifier_columns

        return _rebuilt(identifier_columns(self.columns))

    @cached_property
    def rows(self) -> dict[str, Row]:
        return {r["column_name"]: r for r in self.columns.collect()}

    @cached_property
    def total_rows(self) -> int:
        rows = self.rows
        if rows:
            return int(next(iter(rows.values()))["total_rows"])
        return self.df.count()
