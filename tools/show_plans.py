"""Print the formatted physical plans of the headline operators.

Usage: python tools/show_plans.py [sf_dir] > plans.txt

What to look for: ``PushedFilters`` / ``ReadSchema`` on the Parquet scans,
partial + final ``HashAggregate`` around each ``Exchange``,
``WindowGroupLimit`` before the exchange of every per-column top-k,
``TakeOrderedAndProject`` for top-N, ``BroadcastExchange`` only over
per-column frames in the profiling plans.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablelens.operators.distributions import distributions  # noqa: E402
from tablelens.operators.sqlrun import run_sql  # noqa: E402
from tablelens.operators.templates import top_n  # noqa: E402
from tablelens.plans.catalog_sql import SQL_QUERIES  # noqa: E402
from tablelens.plans.passes import TableMetrics  # noqa: E402
from tablelens.session import local_session  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session("local[8]")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    m = TableMetrics(li)
    sections = {
        "shared scan (value counts)": m.long.groupBy("ord", "key", "num").count(),
        "distributions (from the kept value counts)": distributions(m),
        "top_n template": top_n(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_totalprice", 10, ["o_orderkey"]),
    }
    views = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
             for t in ("region", "nation", "customer", "supplier", "orders", "lineitem", "part")}
    for q in ("sql_join", "sql_multi_join", "sql_window_running"):
        sections[q] = run_sql(spark, SQL_QUERIES[q][0], views=views)
    for title, df in sections.items():
        print("=" * 100)
        print(title)
        print("=" * 100)
        df.explain("formatted")


if __name__ == "__main__":
    main()
