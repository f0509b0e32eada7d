import random

import numpy as np
from pyspark.sql import functions as F
from llm_fixtures import SF_SMALL, docs_of  # noqa: F401

from tablelens.llm import language as G


def greedy(train: bytes, text: bytes) -> int:
    """Phrases by the definition: the longest piece that occurs, else a single byte."""
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in train:
            k += 1
        n, at = n + 1, at + k
    return n


def test_phrases_are_longest_matches():
    rng = random.Random(4)
    learn = [("x", "".join(rng.choice("abc d") for _ in range(300))), ("y", "".join(rng.choice("abce ") for _ in range(300)))]
    model = G.train(learn)
    texts = [G.fold("".join(rng.choice("abcdez ") for _ in range(rng.randint(1, 100)))) or b"a" for _ in range(50)]
    got = G.phrases(model, texts)
    for lang, (_, t) in enumerate(learn):
        assert got[:, lang].tolist() == [greedy(G.fold(t), x) for x in texts]


def test_long_texts_take_all_rows():
    model = G.train([("a", "ab" * 50), ("b", "cd" * 50)])
    assert G.classify(model, ["ab" * 1000 + "cd" * 3000, "cd" * 1000 + "ab" * 3000])[0] == ["b", "a"]


def test_undetermined():
    model = G.train([("en", "the words")])
    assert G.classify(model, [None, "", "123 !?", "the"]) == (["und", "und", "und", "en"], [0.0, 0.0, 0.0, 1.0])
    assert G.classify(G.train([]), ["word"]) == (["und"], [0.0])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    held = G.held_out("doc_id", 4, 2)
    got = G.languages(docs, ~held).join(docs.select("doc_id", "lang"), "doc_id").filter(held)
    right, rows, low, high = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*"), F.min("score"), F.max("score")).first()
    assert rows > 30 and right >= 0.95 and 0 <= low <= high <= 1


def test_null_labels_and_ids(docs_of):
    docs = docs_of([(1, "some words here"), (2, None), (None, "some words"), (3, "123")]).withColumn("lang", F.when(F.col("doc_id") == 1, "en"))
    got = {r.doc_id: r.lang_pred for r in G.languages(docs, F.lit(True)).collect()}
    assert got == {1: "en", 2: "und", None: "en", 3: "und"}
    assert np.isclose(G.languages(docs_of([]), F.lit(True)).count(), 0)
