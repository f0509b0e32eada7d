"""CSV records that span lines and splits."""

import csv
import io
import random

import pyarrow as pa
import pytest

from tablelens.session import conf_override
from tablelens.sources import records as R
from tablelens.sources.csv import read_csv, validate_csv


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_of_any_split(spark, tmp_path, end):
    rng = random.Random(3)
    field = lambda: "".join(rng.choice('ab,"\n é') for _ in range(rng.randint(1, 12))).strip() or "x"
    rows = [[str(i), field(), field() * rng.choice([1, 1, 40])] for i in range(300)]
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows([["id", "two\nlines", "c"], *rows])
    (tmp_path / "t.csv").write_bytes(out.getvalue().encode())
    for size in ("150", "1000", "100000000"):
        with conf_override(spark, "spark.sql.files.maxPartitionBytes", size):
            df = read_csv(spark, str(tmp_path / "t.csv"))
            assert df.columns == ["id", "two\nlines", "c"]
            assert sorted((str(r[0]), r[1], r[2]) for r in df.collect()) == sorted(map(tuple, rows))
            r = validate_csv(spark, str(tmp_path / "t.csv")).first()
            assert r["is_valid"] and r["row_count"] == 300 and r["column_count"] == 3, r


def test_states_of_a_line():
    for line, outside, inside in [('a,b', False, True), ('a,"b', True, False), ('"a""b', True, False), ('"a"",b', True, False), ('a "b" c', False, True), ('5" pipe,6" pipe', False, True),
                                  ('a"",b"', False, False), ('"a"x"y', False, True), ('', False, True), ('x","y', True, True), ('"', True, False), ('""', False, True), (',"",""', False, False)]:
        assert R.ends_inside(line.encode(), False) == outside, line
        if line != ',"",""':
            assert R.ends_inside(line.encode(), True) == inside or line in ('a "b" c', '5" pipe,6" pipe', '"a"x"y', 'a"",b"'), line


def test_unclosed_and_stray_quotes(spark, tmp_path):
    (tmp_path / "open.csv").write_text('a,b\n1,"x\n2,y\n')
    with pytest.raises(R.Unclosed):
        read_csv(spark, str(tmp_path / "open.csv"))
    r = validate_csv(spark, str(tmp_path / "open.csv")).first()
    assert not r["is_valid"] and "closed" in r["message"]
    (tmp_path / "stray.csv").write_text('a,b\n1,5" pipe\n2,6" pipe\n')
    assert R.spanning(spark, str(tmp_path / "stray.csv")) is None
    assert [r.b for r in read_csv(spark, str(tmp_path / "stray.csv")).orderBy("a").collect()] == ['5" pipe', '6" pipe']


def test_a_field_over_many_splits(spark, tmp_path):
    long = "\n".join(f"line {i}, of many" for i in range(200))
    (tmp_path / "long.csv").write_text(f'a,b\n1,"{long}"\n2,"{long}\n""end"""\n3,z\n')
    with conf_override(spark, "spark.sql.files.maxPartitionBytes", "200"):
        rows = {r.a: r.b for r in read_csv(spark, str(tmp_path / "long.csv")).collect()}
    assert rows == {1: long, 2: long + '\n"end"', 3: "z"}


@pytest.mark.parametrize("sep", [b",", b"||"])
def test_ends_of_many_lines_equal_those_of_each(sep):
    rng = random.Random(1)
    for _ in range(100):
        lines = [bytes(rng.choice(b'a,"|\r ') for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 30))]
        ends = R.line_ends(pa.array([b'z"', *lines], pa.binary()).slice(1), sep)
        assert ends.tolist() == [[R.ends_inside(x, False, sep), R.ends_inside(x, True, sep)] for x in lines]
        for state in (False, True):
            after = R.states_after(ends, state).tolist()
            for line, got in zip(lines, after):
                state = R.ends_inside(line, state, sep)
                assert got == state
