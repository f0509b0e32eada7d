"""Column roles and ready aggregate templates.

Each template is a DataFrame function (a group-by with partial aggregation,
or a top-N that Spark runs as ``TakeOrderedAndProject``) and has a matching
SQL text for :func:`tablelens.operators.sqlrun.run_sql` over a view named
``dataset``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.cleaning import sanitize
from tablelens.functions.naming import SQL_ID_NAMES, SQL_ID_SUFFIX_PATTERN
from tablelens.operators.sqlrun import sql_type
from tablelens.plans.passes import col_ref

DEFAULT_N = 10


def is_id_name(name: str) -> bool:
    """The template generator's identifier rule: any name ending in "id"
    (so "paid" and "grid" too), or an id/uuid/guid/key/code/index/no/num word."""
    c = name.strip().lower()
    return c in SQL_ID_NAMES or re.search(SQL_ID_SUFFIX_PATTERN, c) is not None or (c.endswith("id") and len(c) > 2)


def column_roles(df: DataFrame) -> DataFrame:
    """One row per column: column_name, ordinal, sql_type, role
    (date / id / measure / category / other) — from the schema only."""
    rows = []
    for i, f in enumerate(df.schema.fields):
        t = sql_type(f.dataType.simpleString())
        if t == "DATETIME":
            role = "date"
        elif is_id_name(f.name):
            role = "id"
        elif t in ("INTEGER", "REAL"):
            role = "measure"
        elif t == "TEXT":
            role = "category"
        else:
            role = "other"
        rows.append((f.name, i, t, role))
    return df.sparkSession.createDataFrame(rows, "column_name string, ordinal long, sql_type string, role string")


def roles(df: DataFrame) -> dict[str, list[str]]:
    """Role → column names, in column order (schema-derived, no data read)."""
    out: dict[str, list[str]] = {"id": [], "measure": [], "category": [], "date": []}
    for f in df.schema.fields:
        t = sql_type(f.dataType.simpleString())
        is_id = is_id_name(f.name)
        if is_id:
            out["id"].append(f.name)
        if t in ("INTEGER", "REAL") and not is_id:
            out["measure"].append(f.name)
        if t == "TEXT" and not is_id:
            out["category"].append(f.name)
        if t == "DATETIME":
            out["date"].append(f.name)
    return out


# -- DataFrame templates ------------------------------------------------------

def browse(df: DataFrame, n: int = DEFAULT_N) -> DataFrame:
    return sanitize(df.limit(n))


def total_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_rows"))


def count_by(df: DataFrame, category: str, n: int = DEFAULT_N) -> DataFrame:
    """Rows per category value, most frequent first (ties by value)."""
    c = col_ref(category)
    return (df.groupBy(c.alias(category)).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), col_ref(category).asc_nulls_first()).limit(n))


def sum_by(df: DataFrame, category: str, measure: str, n: int = DEFAULT_N) -> DataFrame:
    name = f"total_{measure}"
    return sanitize(
        df.groupBy(col_ref(category).alias(category)).agg(F.sum(col_ref(measure)).alias(name))
        .orderBy(F.col(name).desc_nulls_last(), col_ref(category).asc_nulls_first()).limit(n)
    )


def avg_by(df: DataFrame, category: str, measure: str, n: int = DEFAULT_N) -> DataFrame:
    name = f"avg_{measure}"
    return sanitize(
        df.groupBy(col_ref(category).alias(category)).agg(F.round(F.avg(col_ref(measure)), 2).alias(name))
        .orderBy(F.col(name).desc_nulls_last(), col_ref(category).asc_nulls_first()).limit(n)
    )


def overall_avg(df: DataFrame, measure: str) -> DataFrame:
    return sanitize(df.agg(F.round(F.avg(col_ref(measure)), 2).alias(f"avg_{measure}")))


def top_n(df: DataFrame, measure: str, n: int = DEFAULT_N, tie_breakers: list[str] | None = None) -> DataFrame:
    """The ``n`` rows with the largest ``measure`` (TakeOrderedAndProject:
    each task keeps its own top ``n``; no full sort)."""
    keys = [col_ref(measure).desc_nulls_last()] + [col_ref(c).asc() for c in (tie_breakers or [])]
    return sanitize(df.orderBy(*keys).limit(n))


def trend_by(df: DataFrame, date: str, measure: str, unit: str = "month") -> DataFrame:
    """Total ``measure`` per ``unit`` period of ``date``, in time order."""
    period = F.date_trunc(unit, col_ref(date))
    name = f"total_{measure}"
    return sanitize(
        df.groupBy(period.alias("period")).agg(F.sum(col_ref(measure)).alias(name)).orderBy("period")
    )


# -- SQL text of the same shapes --------------------------------------------

def _q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def template_sql(kind: str, category: str | None = None, measure: str | None = None,
                 n: int = DEFAULT_N, table: str = "dataset") -> str:
    """SQL for one template over ``table`` (double-quoted identifiers)."""
    if kind == "browse":
        return f"SELECT * FROM {table} LIMIT {n}"
    if kind == "total_rows":
        return f"SELECT COUNT(*) AS total_rows FROM {table}"
    if kind == "count_by":
        return (f"SELECT {_q(category)}, COUNT(*) AS count FROM {table} GROUP BY {_q(category)} "
                f"ORDER BY count DESC, {_q(category)} LIMIT {n}")
    if kind == "sum_by":
        alias = _q(f"total_{measure}")
        return (f"SELECT {_q(category)}, SUM({_q(measure)}) AS {alias} FROM {table} GROUP BY {_q(category)} "
                f"ORDER BY {alias} DESC, {_q(category)} LIMIT {n}")
    if kind == "avg_by":
        alias = _q(f"avg_{measure}")
        return (f"SELECT {_q(category)}, ROUND(AVG({_q(measure)}), 2) AS {alias} FROM {table} "
                f"GROUP BY {_q(category)} ORDER BY {alias} DESC, {_q(category)} LIMIT {n}")
    if kind == "overall_avg":
        return f"SELECT ROUND(AVG({_q(measure)}), 2) AS {_q('avg_' + measure)} FROM {table}"
    if kind == "top_n":
        return f"SELECT * FROM {table} ORDER BY {_q(measure)} DESC LIMIT {n}"
    raise ValueError(f"unknown template {kind!r}")


def suggest_aggregates(df: DataFrame, n: int = DEFAULT_N) -> dict[str, DataFrame]:
    """Up to five ready results chosen from the column roles, in the order a
    first look asks for them (counts per category, totals and averages of
    the first measure, top rows, the trend over the first date, then the
    first rows and the row count)."""
    r = roles(df)
    found = {role: names[0] for role, names in r.items() if names}
    out: dict[str, DataFrame] = {}
    for needs, name, build in SUGGESTIONS:
        lacks = {x[1:] for x in needs if x[0] == "-"}
        if len(out) < 5 and {x for x in needs if x[0] != "-"} <= set(found) and not lacks & set(found):
            out[name.format(n=n, **found)] = build(df, found, n)
    return out


#: What a suggestion needs ("-": must lack), its name, and what makes it, in the order of a first look.
SUGGESTIONS = (
    (("category",), "count_by_{category}", lambda df, f, n: count_by(df, f["category"], n)),
    (("measure", "category"), "total_{measure}_by_{category}", lambda df, f, n: sum_by(df, f["category"], f["measure"], n)),
    (("measure", "category"), "avg_{measure}_by_{category}", lambda df, f, n: avg_by(df, f["category"], f["measure"], n)),
    (("measure", "-category"), "top_{n}_by_{measure}", lambda df, f, n: top_n(df, f["measure"], n)),
    (("measure", "-category"), "avg_{measure}", lambda df, f, n: overall_avg(df, f["measure"])),
    (("date", "measure"), "total_{measure}_by_{date}", lambda df, f, n: trend_by(df, f["date"], f["measure"])),
    ((), "first_rows", lambda df, f, n: browse(df, n)),
    ((), "total_rows", lambda df, f, n: total_rows(df)),
)
