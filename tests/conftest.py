import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablelens.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session("local[4]", app="tablelens-tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()


def rows_by(df, key="column_name"):
    return {r[key]: r for r in df.collect()}
