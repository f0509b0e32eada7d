"""Dates in mixed formats, against pandas' reading of each text; decimals in results of queries."""

import decimal

import pandas as pd
from pyspark.sql import functions as F

from tablelens.functions.cleaning import sanitize
from tablelens.functions.dates import parse_date
from tablelens.operators.distributions import distributions

TEXTS = [
    "03/15/2024", "3/5/2024", "15/03/2024", "15-03-2024", "15.3.2024", "3/15/24", "2024/03/15", "2024.3.5", "2024-03-15",
    "15 Mar 2024", "15 March 2024", "15-Mar-2024", "Mar 15, 2024", "March 15 2024", "Sept 5, 2023", "September 5th, 2023",
    "Fri, 15 Mar 2024", "Friday, March 15, 2024 3:05 PM", "03/15/2024 15:05:59", "15 Mar 2024 12:00 am", "12/31/1999 11:59 PM",
    "March 2024", "2024-03-15T10:20:30", " 15 Mar 2024 ",
]
NOT = ["", "  ", "13/13/2024", "02/30/2024", "Marble 5 2024", "15 Mrz 2024", "hello", "1/2", "x" * 5000, "15 Mar 2024 25:00", "15 Mar 2024 13:00 PM", None]


def test_each_text_as_pandas_reads_it(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = {r.t: r.d for r in df.select("t", F.date_format(parse_date(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("d")).collect()}
    for t in TEXTS:
        assert got[t] == str(pd.to_datetime(t.strip())), t
    none = spark.createDataFrame([(t,) for t in NOT], "t string").select("t", parse_date(F.col("t")).alias("d")).collect()
    assert [r for r in none if r.d is not None] == []


def test_a_column_of_mixed_dates_is_a_time_column(spark):
    rows = [("03/15/2024", "03/15/2024"), ("15 Mar 2024", "no"), ("2024-03-16", "2024-03-16"), ("Mar 17, 2024", "none"), ("unknown", "x")] * 3
    bars = distributions(spark.createDataFrame(rows, "good string, bad string")).collect()
    good = sorted((r.position, r.value, r["count"]) for r in bars if r.column_name == "good")
    assert good == [(1, "2024-03-15", 6), (2, "2024-03-16", 3), (3, "2024-03-17", 3)]
    assert {r.type for r in bars if r.column_name == "bad"} == {"frequency"}


def test_decimals_keep_their_digits(spark):
    df = spark.sql("SELECT CAST('12345678901234567890123456.78' AS DECIMAL(38,2)) AS a, CAST('0.123456' AS DECIMAL(10,6)) AS b, CAST(NULL AS DECIMAL(38,2)) AS c, 1.23456D AS d")
    r = sanitize(df).first()
    assert r.a == decimal.Decimal("12345678901234567890123456.78") and r.b == decimal.Decimal("0.1235") and r.c is None and r.d == 1.2346
