import hashlib
import random
import re

import pytest
from llm_fixtures import docs_of  # noqa: F401

from tablelens.llm import decontaminate as D

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows, items, n=10):
    out = []
    for i, t in rows:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            if item is None or not (q := words(text)):
                continue
            for s in range(max(1, len(q) - n + 1)):
                g = q[s : s + n]
                for p in range(len(w) - len(g) + 1):
                    if w[p : p + len(g)] == g:
                        hit.update(range(p, p + len(g)))
                        ids.add(str(item))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "a", "of", "Éa", "x1", "b", "rare%d" % rng.randrange(40)])
    items = [(k, " ".join(word() for _ in range(rng.randint(11, 25)))) for k in range(12)] + [(90, "Short item, here!"), (91, None), (None, "a b"), (92, "..."), (7, "the the the the the the the the the the the")]
    items.append(items[0])
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(60)]
    for k in range(25):
        q = words(items[rng.randrange(12)][1])
        s = rng.randrange(len(q) - 9)
        rows.append((100 + k, rows[k][1] + " - " + "; ".join(q[s : s + rng.choice([9, 10, 11, 30])]).upper().replace("É", "é") + "\n" + rows[k + 1][1]))
    rows += [(200, None), (201, ""), (202, "!!!"), (None, items[2][1]), (203, "short ITEM.here"), (203, "short ITEM.here"), (204, "short item"), (205, "the " * 5000)]
    return rows, items


@pytest.mark.parametrize("block", [1_000_000, 60])
def test_exact_phrases(spark, docs_of, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    monkeypatch.setattr(D, "STARTS", 500)
    rows, items = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination(docs_of(rows), bench).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, items)


def test_proximity(spark, docs_of):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    docs = docs_of([(1, "one two three four extra five six seven eight nine ten"), (2, "one two"), (3, "three four five six seven eight nine ten")])
    near = {r.doc_id: r.contaminated for r in D.contamination(docs, bench, slack=1).collect()}
    exact = {r.doc_id: r.contaminated for r in D.contamination(docs, bench).collect()}
    assert near == {1: True, 2: False, 3: False} and not any(exact.values())


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in D.contamination(docs_of([(1, "a b")]), none).collect()] == [False]
    assert D.contamination(docs_of([]), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0


def test_tables_are_stored_by_batches_of_bounded_bytes(spark):
    """A task's memory follows from bytes, not from how long 10,000 rows happen to be."""
    import pyarrow as pa

    from tablelens.llm import frames

    rows = spark.range(0, 6000, 1, 1).selectExpr("repeat('abcdefghij', 200) AS t")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    made = [r.n for r in frames.stored(rows.mapInArrow(sizes, "n long")).collect()]
    assert max(made) <= 1.1 * frames.BATCH_BYTES and len(made) > 1
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_stored_tables_have_pages_of_bounded_bytes(spark):
    """Rows of a MB, as those of the index, must not share a page of a hundred: it is compressed and read in one piece."""
    from tablelens.llm import frames

    made = frames.stored(spark.range(0, 30, 1, 1).selectExpr("id", "repeat(sha2(cast(id AS string), 256), 16000) AS t"))
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    path = jvm.org.apache.hadoop.fs.Path(made.inputFiles()[0])
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, conf))
    try:
        pages = sum(reader.readOffsetIndex(b.getColumns()[1]).getPageCount() for b in reader.getFooter().getBlocks())
    finally:
        reader.close()
    assert pages >= 10 and made.count() == 30
