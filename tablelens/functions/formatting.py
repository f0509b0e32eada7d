"""Human-readable number labels as Spark Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _strip_zeros(s: Column) -> Column:
    """"12.50" → "12.5", "3.00" → "3" (the text always holds a decimal point)."""
    return F.regexp_replace(F.regexp_replace(s, r"0+$", ""), r"\.$", "")


def _plain(x: Column, places: int) -> Column:
    """Fixed decimals without thousands separators."""
    return F.regexp_replace(F.format_number(x, places), ",", "")


def format_label(x: Column, is_year: Column | bool = False) -> Column:
    """Label of a numeric value.

    Whole numbers: plain for year columns and 1900–2100, else with thousands
    separators.  Fractions: one decimal for year-like values; two decimals
    with separators at or above a million; one decimal (trailing zeros
    dropped) at or above a thousand; four decimals below 0.01; two otherwise.
    """
    is_year = F.lit(is_year) if isinstance(is_year, bool) else is_year
    whole = x == F.floor(x)
    yearish = is_year | ((x >= 1900) & (x <= 2100))
    ax = F.abs(x)
    return (
        F.when(x.isNull(), F.lit(""))
        .when(F.isnan(x) | (ax == F.lit(float("inf"))), x.cast("string"))
        .when(whole & yearish, x.cast("long").cast("string"))
        .when(whole, F.format_number(x, 0))
        .when(yearish, _plain(x, 1))
        .when(ax >= 1_000_000, F.format_number(x, 2))
        .when(ax >= 1_000, _strip_zeros(F.format_number(x, 1)))
        .when((ax < 0.01) & (x != 0), _strip_zeros(_plain(x, 4)))
        .otherwise(_strip_zeros(_plain(x, 2)))
    )


def format_int_label(v: Column, is_year: Column | bool = False) -> Column:
    """Label of a discrete integer bar: plain for years, separators from 10,000."""
    is_year = F.lit(is_year) if isinstance(is_year, bool) else is_year
    plain = v.cast("long").cast("string")
    return (
        F.when(is_year | ((v >= 1900) & (v <= 2100)), plain)
        .when(F.abs(v) >= 10_000, F.format_number(v.cast("long"), 0))
        .otherwise(plain)
    )


def format_int_edge(v: Column, is_year: Column | bool = False) -> Column:
    """Integer bin edge: plain for year columns, separators otherwise."""
    is_year = F.lit(is_year) if isinstance(is_year, bool) else is_year
    return F.when(is_year, v.cast("long").cast("string")).otherwise(F.format_number(v.cast("long"), 0))
