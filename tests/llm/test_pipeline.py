import pytest
from pyspark.sql import functions as F
from test_decontaminate import brute as contaminated
from test_lshforest import brute as components

import corpus_pipeline as C
from llm_fixtures import SF_SMALL, docs_of, ranks  # noqa: F401

from tablelens.llm import bpe, language, secrets, toxicity
from tablelens.llm.frames import stored


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = [docs]
    for _, f in C.STAGES:
        out.append(stored(f(spark, out[-1], SF_SMALL)))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    for s in stages[1:-1]:
        assert s.dtypes == stages[0].dtypes
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "tokens"]


def test_toxicity_stage(spark, stages):
    teaches = ~language.held_out("doc_id", 5, 0)
    model = toxicity.train(stages[0], spark.read.parquet(f"{SF_SMALL}/labels.parquet"), teaches)
    a = toxicity.automaton(*model[:2])
    keep = [r.doc_id for r in stages[0].collect() if toxicity.probability(toxicity.np.array([toxicity.features(r.text, a)]), model[2])[0] < 0.5]
    assert ids(stages[1]) == sorted(keep) and len(keep) > 0.8 * stages[0].count()


def test_near_duplicate_stage(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert ids(stages[2]) == sorted(i for i, _, root, kept in components(rows, 5) if kept)


def test_decontamination_stage(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    assert ids(stages[3]) == sorted(r[0] for r in contaminated(rows, items) if not r[-1])


def test_secret_and_token_stages(stages, ranks):
    before = {r.doc_id: r.text for r in stages[3].collect()}
    after = {r.doc_id: r for r in stages[4].collect()}
    assert set(before) == set(after)
    for i, r in after.items():
        assert not secrets.base_spans(r.text) and r.n_chars == len(r.text)
        assert r.text == before[i] or secrets.base_spans(before[i]) or "[secret]" in r.text
    back = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(stages[5], ranks).collect()}
    assert back == {i: r.text for i, r in after.items()}
    assert stages[5].filter(F.col("n_tokens") != F.size("ids")).count() == 0


def test_empty_table(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_stages_judge_rows(spark, docs_of, tmp_path):
    """A null id does not save a contaminated row or a copy; a shared id does not condemn a clean one."""
    passage = " ".join(f"bench{i}" for i in range(12))
    copied = "this text of ten or so words is here several times"
    rows = [(None, f"before {passage} after"), (7, f"{passage} again"), (7, "a clean text that shares its id"), (8, copied), (None, copied), (8, "other words are here under the same id")]
    spark.createDataFrame([("b1", passage)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = docs_of(rows)
    got = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    clean = C.benchmark_out(spark, docs, str(tmp_path))
    assert got(clean) == sorted(rows[2:], key=str) and clean.columns == docs.columns
    one = C.near_duplicates_out(spark, stored(docs), str(tmp_path))
    assert got(one) == sorted([*rows[:4], rows[5]], key=str) and one.columns == docs.columns


def test_stages_written_by_the_caller_pass_batches_of_bounded_bytes(spark):
    """The driver writes each stage itself: its batches too must follow from bytes, not from 10,000 rows however long."""
    import pyarrow as pa

    from tablelens.llm import frames

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = spark.range(0, 6000, 1, 1).selectExpr("repeat('abcdefghij', 200) AS t")
    before = spark.conf.get(frames.ARROW_BYTES)
    try:
        for stage in (C.toxic_out, C.secrets_out, C.tokens):
            spark.conf.unset(frames.ARROW_BYTES)
            stage(spark, docs, SF_SMALL)
            made = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
            assert max(made) <= 1.1 * frames.BATCH_BYTES and len(made) > 1
    finally:
        spark.conf.set(frames.ARROW_BYTES, before)
