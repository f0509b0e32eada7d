"""CSV source and the driver entry points."""

import os

from tablelens.sources.csv import read_csv, validate_csv


def test_csv_inference(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("﻿name,age,score,flag,note\nann,25,1.5,True,x\nbob,NA,2,False,null\n,31,,True,None\n"
                  .encode("utf-8"))
    df = read_csv(spark, str(p))
    types = dict(df.dtypes)
    assert types == {"name": "string", "age": "double", "score": "double", "flag": "boolean", "note": "string"}
    rows = df.collect()
    assert rows[1]["age"] is None and rows[2]["name"] is None and rows[1]["note"] is None


def test_csv_validation(spark, tmp_path):
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b,c\n1,2,3\n4,5\n6,7,8,9\n")
    r = validate_csv(spark, str(bad)).first()
    assert r["row_count"] == 3 and r["bad_rows"] == 2 and not r["is_valid"]
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    assert not validate_csv(spark, str(empty)).first()["is_valid"]


def test_csv_headers_and_encoding(spark, tmp_path):
    one = tmp_path / "one.csv"
    one.write_text('\ufeff"a,x",b\n"1,2",3\n4,5\n', encoding="utf-8")
    r = validate_csv(spark, str(one)).first()
    assert r["column_count"] == 2 and r["bad_rows"] == 0 and r["row_count"] == 2 and r["is_valid"]
    raw = tmp_path / "latin.csv"
    raw.write_bytes("a,b\n1,caf\u00e9\n".encode("latin-1"))
    r = validate_csv(spark, str(raw)).first()
    assert not r["is_valid"] and "UTF-8" in r["message"]
    two = tmp_path / "two"
    two.mkdir()
    (two / "x.csv").write_text("a,b\n1,2\n")
    (two / "y.csv").write_text("a,c\n1,2\n")
    r = validate_csv(spark, str(two)).first()
    assert not r["header_ok"] and not r["is_valid"]


def test_entry_contract(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and "column_name" in df.columns
    qs, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 90
    for name in ("profile_lineitem", "sql_group", "class_metrics"):
        assert name in sql
    assert os.path.exists("/root/testdata/sf0.001/lineitem.parquet")
