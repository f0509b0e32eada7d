from pyspark.sql import functions as F
from llm_fixtures import SF_SMALL, docs_of  # noqa: F401

from tablelens.llm import language
from tablelens.llm import toxicity as T


def test_folding():
    assert T.fold("You 1D10T! $cum, m0r0n ｉｄｉｏｔ") == " you idiot scum moron idiot "
    assert T.fold("раthetic $$$ l@me") == " pathetic lame "  # Cyrillic letters; rows of signs are no letters
    assert T.fold("123 !") == " ieast " or T.fold("!") == " "


def test_hits_and_exceptions():
    a = T.automaton({" clown ": 2.0, " idio": 3.0}, ["clown fish"])
    assert T.features("a clown fish", a) == (0.0, 0.0, 0.0)
    one, two = T.features("a clown and a clown fish", a), T.features("idiots, idiocy", a)
    assert one[2] == 1.0 and two[0] > one[0] and T.features("clowns fidiot", a)[2] == 0.0
    assert T.features("clown " + "word " * 500, a)[1] < T.features("clown word", a)[1]  # length counts


def test_held_out_accuracy(spark):
    sf = SF_SMALL.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = language.held_out("doc_id", 5, 0)
    got = T.scored(docs, T.train(docs, labels, ~held)).join(labels, "doc_id").filter(held)
    right, rows = got.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")), F.count("*")).first()
    assert rows > 50 and right >= 0.95


def test_without_labels_the_seed_serves(spark, docs_of):
    docs = docs_of([(1, "you idiot, you moron, stupid worthless scum"), (2, None), (3, ""), (4, "kind words for all of you")])
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in T.scored(docs, T.train(docs, labels, F.lit(True))).collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 0}
