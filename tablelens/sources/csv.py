"""CSV source: typed read with spreadsheet-style inference, and structural
validation (S1, S2, S4, S5).

Inference is one distributed pass: the file is read as text columns, NA
tokens become null, the values are unpivoted to (column, value) and one
grouped aggregate counts, per column, how many present values parse as
boolean / integer / double (the plan does not grow with the width).  The final projection
applies ``try_cast`` with the chosen types; nothing is collected but one
row of counts per file.
"""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.plans.passes import col_ref
from tablelens.sources import records as R

# ---------------------------------------------------------------------------
# The text that counts as a missing value, and the boolean
# spellings, as the reproduced reader defines them.
# ---------------------------------------------------------------------------
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]
# ---------------------------------------------------------------------------

INT_PATTERN = r"^\s*[+-]?[0-9]+\s*$"


def _header_names(top: str, sep: str) -> list[str]:
    """Column names of a header record: the reader's own rules for empty and repeated names."""
    names = next(csv.reader(io.StringIO(top), delimiter=sep), [])
    low = [n.lower() for n in names]
    return [f"_c{i}" if not n.strip() else f"{n}{i}" if low.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def _parsed(rows: DataFrame, columns: list[str], options: dict, corrupt: str | None = None) -> DataFrame:
    """The frame's columns but ``record``, and the record's fields."""
    fields = [f"`{c.replace('`', '``')}` string" for c in [*columns, *([corrupt] if corrupt else [])]]
    how = {"mode": "PERMISSIVE", "escape": '"', "multiLine": "true", **({"columnNameOfCorruptRecord": corrupt} if corrupt else {}), **options}
    made = rows.withColumn("__r", F.from_csv("record", ", ".join(fields), {k: str(v) for k, v in how.items()}))
    return made.select(*[c for c in rows.columns if c != "record"], "__r.*")


def _text_frame(spark: SparkSession, path: str, **options) -> DataFrame:
    sep = options.get("sep", ",")
    # records that span lines are put together split by split; else a line is a record
    states = R.spanning(spark, path, sep)
    if states:
        rows = R.records(spark, path, states, sep)
        names = _header_names(R.first_record(spark, path, states, sep), sep)
        hidden = [f"__{i}" for i in range(len(names))]
        df = _parsed(rows.filter("not first"), hidden, options).select(*[F.col(h).alias(n) for h, n in zip(hidden, names)])
    else:
        reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("escape", '"').option("inferSchema", False)
        for k, v in options.items():
            reader = reader.option(k, v)
        df = reader.csv(path)
    # text columns with NA tokens as null
    return df.select(*[
        F.when(col_ref(c).isNull() | col_ref(c).isin(NA_TOKENS), F.lit(None).cast("string"))
        .otherwise(col_ref(c)).alias(c)
        for c in df.columns
    ])


def infer_types(text: DataFrame) -> dict[str, str]:
    """Column → Spark type name from one aggregate over all rows.

    boolean: every value is a boolean spelling and none is missing; bigint:
    every present value is an integer and none is missing; double: every
    present value parses as a number (integers with missing values too, and
    columns with no value at all); string otherwise.
    """
    cols = text.columns
    if not cols:
        return {}
    # one pass whatever the width: values unpivoted to (i, v), counted per column
    long = text.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("i"), col_ref(c).alias("v")) for i, c in enumerate(cols)
    ])))
    v = F.col("v")
    counts = long.groupBy("i").agg(
        F.count(v).alias("p"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(v.isin(TRUE_TOKENS + FALSE_TOKENS)).alias("b"),
        F.count_if(v.rlike(INT_PATTERN) & v.try_cast("long").isNotNull()).alias("i_ok"),
        F.count_if(v.try_cast("double").isNotNull()).alias("d"),
    ).collect()  # one row per column
    r: dict = {}
    for row in counts:
        i = row["i"]
        r.update({f"p{i}": row["p"], f"n{i}": row["n"], f"b{i}": row["b"], f"i{i}": row["i_ok"], f"d{i}": row["d"]})
    if not counts:  # no rows at all
        r = {f"{k}{i}": 0 for i in range(len(cols)) for k in "pnbid"}
    out = {}
    for i, c in enumerate(cols):
        present, rows = r[f"p{i}"], r[f"n{i}"]
        if present == 0:
            out[c] = "double"
        elif r[f"b{i}"] == present and present == rows:
            out[c] = "boolean"
        elif r[f"i{i}"] == present:
            out[c] = "bigint" if present == rows else "double"
        elif r[f"d{i}"] == present:
            out[c] = "double"
        else:
            out[c] = "string"
    return out


def read_csv(spark: SparkSession, path: str, types: dict[str, str] | None = None, **options) -> DataFrame:
    """Typed DataFrame of a headed CSV file (or folder of files)."""
    text = _text_frame(spark, path, **options)
    chosen = types or infer_types(text)
    out = []
    for c in text.columns:
        v = col_ref(c)
        t = chosen.get(c, "string")
        if t == "boolean":
            out.append(F.when(v.isin(TRUE_TOKENS), F.lit(True)).when(v.isin(FALSE_TOKENS), F.lit(False)).alias(c))
        elif t == "string":
            out.append(v.alias(c))
        else:
            out.append(F.trim(v).try_cast(t).alias(c))
    return text.select(*out)


def _header(lines: DataFrame) -> list[str] | None:
    """The fields of the first line of one file."""
    top = lines.where("start = 0").limit(1).collect()
    if not top:
        return None
    line = top[0]["value"].lstrip("\ufeff")
    return [h.strip() for h in next(csv.reader([line]), [])]


def _names_of(top: str | None) -> list[str] | None:
    """The fields of the first record."""
    return [h.strip() for h in next(csv.reader(io.StringIO(top)), [])] if top is not None else None


def validate_csv(spark: SparkSession, path: str) -> DataFrame:
    """One row: row_count, column_count, bad_rows, header_ok, is_valid, message.

    Every file must be UTF-8 and start with the same header.  Rows whose field
    count differs from the header's are bad.  A quoted field may hold line breaks;
    one that is never closed makes the table invalid.
    """
    try:
        states = R.spanning(spark, path)
    except R.Unclosed:
        return spark.createDataFrame([(0, 0, 0, False, False, "A quoted field is never closed.")], _VALIDATION_SCHEMA)
    whole = R.records(spark, path, states) if states else None
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    found = _header(lines) if whole is None else _names_of(R.first_record(spark, path, states))
    if found is None:
        return spark.createDataFrame([(0, 0, 0, False, False, "The file is empty.")], _VALIDATION_SCHEMA)
    names = found
    if not any(names):
        return spark.createDataFrame([(0, 0, 0, False, False, "The first line names no column.")], _VALIDATION_SCHEMA)
    text = lines.agg(F.count_distinct("file").alias("files"), F.count_if(~F.is_valid_utf8("value")).alias("garbled"))
    columns = [f"c{i}" for i in range(len(names))]
    schema = ", ".join(f"{c} string" for c in [*columns, "_corrupt_record"])
    if whole is not None:
        rows = _parsed(whole.select("file", "record"), columns, {}, "_corrupt_record")
    else:
        rows = (spark.read.option("mode", "PERMISSIVE").option("escape", '"').option("columnNameOfCorruptRecord", "_corrupt_record")
                .schema(schema).csv(path).select("*", F.col("_metadata.file_path").alias("file")))
    # the parser drops a byte order mark or leaves it in the first field
    is_header = F.lit(True)
    for i, (c, name) in enumerate(zip(columns, names)):
        field = F.regexp_replace(F.col(c), "^\ufeff", "") if i == 0 else F.col(c)
        is_header &= F.trim(F.coalesce(field, F.lit(""))) == name
    judged = rows.select("file", is_header.alias("is_header"), F.col("_corrupt_record").isNotNull().alias("bad"))
    # one row a file: its first header line is no record
    per_file = judged.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"), F.max(F.col("is_header").cast("int")).alias("headed"))
    total = per_file.agg(F.sum(F.col("n") - F.col("headed")).alias("row_count"), F.sum("bad").alias("bad_rows"), F.sum("headed").alias("headed"))
    headed = (F.col("headed") == F.col("files"))
    return total.crossJoin(text).select(  # one row each
        F.col("row_count").cast("long"), F.lit(len(names)).cast("long").alias("column_count"), F.col("bad_rows").cast("long"), headed.alias("header_ok"),
        ((F.col("bad_rows") == 0) & (F.col("row_count") > 0) & headed & (F.col("garbled") == 0)).alias("is_valid"),
        F.when(F.col("garbled") > 0, F.format_string("%d line(s) are not UTF-8.", F.col("garbled")))
        .when(~headed, F.lit("Not every file starts with the same header."))
        .when(F.col("row_count") == 0, "There are no rows below the header.")
        .when(F.col("bad_rows") > 0, F.format_string("%d row(s) do not match the header width.", F.col("bad_rows")))
        .otherwise("OK").alias("message"),
    )


_VALIDATION_SCHEMA = ("row_count long, column_count long, bad_rows long, header_ok boolean, is_valid boolean, "
                      "message string")


def write_csv(df: DataFrame, path: str) -> None:
    """Headed CSV folder (the sink the read side accepts)."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
