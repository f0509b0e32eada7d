"""Registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm import bpe, decontaminate, infill, language, licenses, lshforest, neighbours, packing, pagetext, resampling, secrets, sharding, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@_query("op4_byte_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


_OP1_SQL = r"""
WITH low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM low),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, w[s : s + least(len(w), 10) - 1] AS gram FROM i, unnest(range(1, greatest(2, len(w) - 8))) AS r(s) WHERE len(w) > 0),
dg AS (SELECT doc_id, z.n, r.s, w[r.s : r.s + z.n - 1] AS gram FROM d, (SELECT DISTINCT n FROM g) z, unnest(range(1, len(w) - z.n + 2)) AS r(s)),
m AS (SELECT dg.doc_id, dg.s, dg.n, g.item_id FROM dg JOIN g ON g.n = dg.n AND g.gram = dg.gram),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@_query("op1_decontamination", _OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op10_minhash_neardup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lshforest.near_duplicates(_table(spark, sf_dir, "documents"), size=2)


@_query("op2_secret_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.counted(secrets.find_secrets(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken")))


@_query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = language.held_out("doc_id", 4, 2)
    return language.languages(docs, F.coalesce(~held, F.lit(False))).withColumn("held_out", F.coalesce(held, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score")


@_query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = F.coalesce(language.held_out("doc_id", 5, 0), F.lit(False))
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), ~held)
    return toxicity.scored(docs, model).withColumn("held_out", held).select("doc_id", "held_out", "score", "predicted")


@_query("op7_html_extraction")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.main_text(_table(spark, sf_dir, "pages"))


@_query("op8_nearest_neighbours")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@_query("op9_license_scan", licenses.sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


@_query("op6_sharding")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir, "documents"))


_OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(x, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
             CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS lo, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS hi,
             CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(w[1:lo], '') AS a, array_to_string(w[lo + 1:hi], '') AS m, array_to_string(w[hi + 1:], '') AS z FROM c)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n, form,
       CASE WHEN form = 'plain' THEN NULL ELSE CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form = 'plain' THEN NULL ELSE CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM p
"""


@_query("op13_fill_in_middle", _OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(_table(spark, sf_dir, "documents"))


@_query("op12_packing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query("op11_importance_resampling")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
