"""Checkpointed shared frames, model persistence and the SQL run summary."""

import numpy as np

from conftest import rows_by
from tablelens.operators.automl import SMALL_SIZES, benchmark, load, read_leaderboard, save
from tablelens.operators.insights import analyze, release
from tablelens.operators.scoring import score
from tablelens.operators.sqlrun import sql_summary


def test_reliable_analysis(spark):
    df = spark.createDataFrame([(i, f"c{i % 3}", float(i % 7)) for i in range(50)], "k int, c string, v double")
    res = analyze(df, reliable=True)
    st = rows_by(res["statistics"])
    assert st["v"]["max"] == 6.0 and st["c"]["unique_count"] == 3
    release(res)


def test_save_load_score(spark, tmp_path):
    rng = np.random.default_rng(42)
    rows = [(f"r{i}", float(rng.normal()), ["x", "y"][i % 2], "yes" if i % 3 else "no") for i in range(120)]
    df = spark.createDataFrame(rows, "rid string, f double, g string, label_col string")
    b = benchmark(df, "label_col", sizes=SMALL_SIZES, models=["Logistic Regression"], split_key=["rid"])
    path = str(tmp_path / "model")
    save(b, path)
    prep, model, meta = load(spark, path)
    assert meta["champion"] == "Logistic Regression" and prep.target_classes == ["no", "yes"]
    a = score(df.limit(5), b.prep, b.champion).select("prediction").collect()
    c = score(df.limit(5), prep, model).select("prediction").collect()
    assert a == c
    assert read_leaderboard(spark, path).count() == 1
    assert read_leaderboard(spark, str(tmp_path / "absent")) is None


def test_sql_summary(spark):
    df = spark.range(2500).selectExpr("id", "id % 4 AS g")
    sql = "SELECT g, COUNT(*) AS n FROM dataset GROUP BY g"
    s = sql_summary(spark, sql, df, {"dataset": df}).first()
    assert s["row_count"] == 4 and s["total_dataset_rows"] == 2500 and s["is_aggregate"]
    assert s["scanned_percentage"] == 100.0 and s["sql"] == sql and not s["truncated"]
    s = sql_summary(spark, "SELECT id, 'COUNT(' AS x FROM dataset", df, {"dataset": df}, default_limit=1000).first()
    assert s["row_count"] == 1000 and s["truncated"] and not s["is_aggregate"] and s["sql"].endswith(" LIMIT 1000")
