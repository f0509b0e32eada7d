"""From raw documents to tokens: five stages, each written as Parquet and read again.

Toxic documents go, one document of each group of near duplicates stays,
documents that hold a benchmark passage go, secrets are replaced by a mark,
and what is left is encoded with a byte-level BPE vocabulary.  All stages but
the last return the columns of ``documents``.

Every decision is made for a row and carried out on that row, told by its
place in the stage's table, never by ``doc_id``: rows without an id are judged
like all others, and rows that share one are judged one by one.

The stages that hand texts to Python bound the session's Arrow batches by bytes,
as their frames run when the caller writes them.

Defined results: documents without text pass every stage and have no tokens;
of repeated rows one stays (rows without both id and text all stay); an empty
table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm import bpe, decontaminate, language, lshforest, secrets, toxicity
from tablelens.llm.frames import ROW, bound_batches, stored, with_rows, without

#: SQL cannot express the learned and the iterative stages; tests/llm checks them against brute force.
ORACLE_SQL = None
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score as toxic."""
    bound_batches(spark)
    teaches = F.coalesce(~language.held_out("doc_id", 5, 0), F.lit(False))
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), teaches)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    made = toxicity.scored(docs, model, carry=(row,), keep="text").filter("predicted = 0")
    return made.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity of 0.8 or more."""
    return lshforest.one_of_each(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item."""
    rows = with_rows(docs)
    found = decontaminate.contamination(rows, _table(spark, sf_dir, "benchmark"), key=ROW)
    return without(rows, found.filter("contaminated"), ROW)


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a mark in place of each secret, and their new length."""
    bound_batches(spark)
    made = secrets.redact(docs, RANKS)
    return made.select(*[
        F.col("clean").alias(c) if c == "text" else F.length("clean").cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns
    ])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, offsets (of the tokens' bytes) of each document."""
    bound_batches(spark)
    made = bpe.encode(docs, RANKS, carry=("lang", "source"))
    return made.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "offsets")


STAGES = [
    ("toxicity", toxic_out),
    ("near_duplicates", near_duplicates_out),
    ("decontamination", benchmark_out),
    ("secrets", secrets_out),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
