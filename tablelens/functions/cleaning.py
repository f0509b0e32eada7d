"""Value cleaning and result emission expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """Null for NaN and ±Inf, the value otherwise."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(d)


def r4(c: Column) -> Column:
    """Emit a float with 4 decimals; non-finite is null; -0.0 folds into 0.0."""
    return F.round(finite(c), 4) + F.lit(0.0)


def emit(df, names: list[str]):
    """Apply :func:`r4` to the named columns in their own projection, so the
    rounding expression works on plain column references."""
    wanted = set(names)
    return df.select(*[
        r4(F.col(c)).alias(c) if c in wanted else F.col(c) for c in df.columns
    ])


def r2(c: Column) -> Column:
    return F.round(finite(c), 2)


def pct(part: Column, whole: Column, places: int = 2) -> Column:
    """round(part / whole * 100, places), 0.0 when whole is 0."""
    return F.when(whole > 0, F.round(part / whole * 100.0, places)).otherwise(F.lit(0.0))


def sanitize(df, places: int = 4):
    """Emission step for query results: floats rounded, non-finite → null.

    Decimals are rounded as decimals and keep every digit before the point;
    everything but float, double and decimal columns passes as is.
    """
    out = []
    for f in df.schema.fields:
        name = "`" + f.name.replace("`", "``") + "`"
        t = f.dataType.simpleString()
        if t.startswith("decimal"):
            out.append(F.round(F.col(name), places).alias(f.name) if f.dataType.scale > places else F.col(name))
        elif t in ("double", "float"):
            out.append(F.round(finite(F.col(name)), places).alias(f.name))
        else:
            out.append(F.col(name))
    return df.select(*out)
