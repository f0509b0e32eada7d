"""Registered target, preparation, metric, benchmark and scoring queries.

Oracles: targets / leakage / feature intelligence restate the rules in SQL;
the split orders each class by the same md5 hash in DuckDB; fitted medians, modes,
vocabularies and scaler statistics are recomputed on the DuckDB train rows;
metrics run on rule-made predictions.  Model fits are rows-only checks.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tablelens.operators.automl import SMALL_SIZES, benchmark, fold_ranks
from tablelens.operators.metrics import (
    class_report,
    classification_metrics,
    confusion,
    regression_diagnostics,
    regression_metrics,
)
from tablelens.operators.prep import fitted_state, hash_unit, prepare, scaler_state
from tablelens.operators.scoring import score
from tablelens.operators.targets import feature_intelligence, leakage, target_candidates
from tablelens.functions.naming import POST_OUTCOME_PATTERNS, TARGET_KEYWORDS
from tablelens.operators import extratrees
from tablelens.operators.permutation import permutation_importance
from tablelens.operators.quota import parts
from tablelens.operators.boosting import HistBoosting, Settings, boost
from tablelens.plans import oracle as O
from tablelens.plans.catalog import register, table

# ---------------------------------------------------------------------------
# inputs
# ---------------------------------------------------------------------------

LABELLED_DOCS_SQL = ("(SELECT l.doc_id, l.quality, l.toxic, d.lang, d.source, d.n_chars "
                     "FROM labels l JOIN documents d ON l.doc_id = d.doc_id)")
LABELLED_DOCS_COLS = [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int"), ("lang", "string"),
                      ("source", "string"), ("n_chars", "bigint")]

LINE_FEATURES = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag",
                 "l_linestatus", "l_extendedprice"]
LINE_SQL = "(SELECT " + ", ".join(LINE_FEATURES) + " FROM lineitem)"
LINE_COLS = [(n, d) for n, d in O.TABLES["lineitem"] if n in LINE_FEATURES]
LINE_KEY = ["l_orderkey", "l_linenumber"]
#: Tells the lines apart; the two above do not.
LINE_IDS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def labelled_docs(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(
        table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id"
    ).select(*[n for n, _ in LABELLED_DOCS_COLS])


def line_features(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*LINE_FEATURES)


# ---------------------------------------------------------------------------
# targets, leakage, feature intelligence
# ---------------------------------------------------------------------------

def _class_stats_sql(src: str, cols) -> str:
    parts = []
    for i, (n, d) in enumerate(cols):
        c = O.q(n)
        parts.append(f"SELECT {i} AS ord, min(cnt) AS min_n, max(cnt) AS maj_n FROM "
                     f"(SELECT count(*) AS cnt FROM {src} WHERE {c} IS NOT NULL GROUP BY {c}) g")
    return " UNION ALL ".join(parts)


def target_candidates_sql(src: str, cols) -> str:
    ids = O.identifier_sql(O.colstats_sql(src, cols))
    kw = " OR ".join(f"contains(lower(column_name), {O.lit(k)})" for k in TARGET_KEYWORDS)
    return f"""
SELECT column_name, CAST(ord AS BIGINT) AS ordinal, suggested_task, status, quality_verdict, eligible,
       score, CAST(row_number() OVER (ORDER BY eligible DESC, score DESC NULLS LAST, ord) AS INTEGER) AS rank
FROM (
  SELECT *, status IN ('recommended', 'warning') AND NOT is_identifier AS eligible,
    CASE WHEN status IN ('recommended', 'warning') AND NOT is_identifier THEN
      (CASE WHEN {kw} THEN 50.0 ELSE 0.0 END)
      + (CASE WHEN suggested_task = 'classification' THEN
           (CASE WHEN unique_count = 2 THEN 30.0 WHEN unique_count <= 5 THEN 20.0 ELSE 10.0 END) ELSE 15.0 END)
      + (CASE WHEN status = 'recommended' THEN 20.0 ELSE 0.0 END) END::DOUBLE AS score
  FROM (
    SELECT *,
      CASE WHEN ineligible OR is_identifier THEN 'not_recommended'
           WHEN cls AND (unique_count > 30 OR imbalanced) THEN 'warning'
           WHEN cls THEN 'recommended'
           WHEN num_count < 5 OR sd = 0 THEN 'not_recommended' ELSE 'recommended' END AS status,
      CASE WHEN ineligible THEN 'Ineligible' WHEN is_identifier THEN 'Candidate Identifier'
           WHEN cls AND imbalanced THEN 'Class Imbalance Warning'
           WHEN cls AND unique_count > 30 THEN 'High Cardinality Warning'
           WHEN cls THEN 'Recommended Target' WHEN num_count < 5 THEN 'Insufficient Numeric Data'
           WHEN sd = 0 THEN 'Zero Variance' ELSE 'Recommended Target' END AS quality_verdict
    FROM (
      SELECT x.*, (unique_count <= 1 OR missing_count = total_rows) AS ineligible,
        CASE WHEN present = 0 OR kind <> 'numeric' OR unique_count <= 15 THEN 'classification'
             ELSE 'regression' END AS suggested_task,
        (present = 0 OR kind <> 'numeric' OR unique_count <= 15) AS cls,
        CASE WHEN num_count > 1 THEN num_std ELSE 0.0 END AS sd,
        coalesce(cs.min_n IS NOT NULL AND unique_count >= 2 AND (
          round(cs.min_n / present * 100.0, 1) < 10.0 OR round(cs.min_n / cs.maj_n, 3) < 0.15), false) AS imbalanced
      FROM ({ids}) x LEFT JOIN ({_class_stats_sql(src, cols)}) cs ON x.ord = cs.ord
    ) a
  ) b
) c
"""


def leakage_sql(src: str, cols, target: str) -> str:
    tkind = O.kind_of(dict(cols)[target])
    pat = O.lit("|".join(f"(?:{p})" for p in POST_OUTCOME_PATTERNS))
    parts = []
    for i, (n, d) in enumerate(cols):
        if n == target:
            continue
        kind = O.kind_of(d)
        name_low = f"regexp_replace(lower({O.lit(n)}), '[- ]', '_', 'g')"
        if tkind == "numeric" and kind in ("numeric", "boolean"):
            x = f"CAST({O.q(n)} AS DOUBLE)"
            y = f"CAST({O.q(target)} AS DOUBLE)"
            corr = (f"(SELECT CASE WHEN count(*) FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL) > 10 "
                    f"AND abs(corr({x}, {y})) >= 0.95 THEN true ELSE false END FROM {src} s)")
        else:
            corr = "false"
        parts.append(
            f"SELECT {O.lit(n)} AS column_name, CAST({i} AS BIGINT) AS ordinal, "
            f"CASE WHEN regexp_matches({name_low}, {pat}) OR {corr} THEN 'high' ELSE 'none' END AS leakage_risk"
        )
    return " UNION ALL ".join(parts)


def feature_intelligence_sql(src: str, cols, target: str) -> str:
    ids = O.identifier_sql(O.colstats_sql(src, cols))
    return f"""
SELECT x.column_name, CAST(x.ord AS BIGINT) AS ordinal, is_identifier,
       coalesce(unique_count, 0) <= 1 AS is_constant, coalesce(l.leakage_risk, 'none') AS leakage_risk,
       (is_identifier OR coalesce(unique_count, 0) <= 1 OR coalesce(l.leakage_risk, 'none') = 'high')
         AS is_excluded_by_default
FROM ({ids}) x LEFT JOIN ({leakage_sql(src, cols, target)}) l ON x.column_name = l.column_name
"""


_TC_COLS = ["column_name", "ordinal", "suggested_task", "status", "quality_verdict", "eligible", "score", "rank"]
_FI_COLS = ["column_name", "ordinal", "is_identifier", "is_constant", "leakage_risk", "is_excluded_by_default"]

for _name, _build, _src, _cols, _target in (
    ("labelled_documents", labelled_docs, LABELLED_DOCS_SQL, LABELLED_DOCS_COLS, "quality"),
    ("lineitem", lambda s, d: table(s, d, "lineitem"), "lineitem", O.TABLES["lineitem"], "l_extendedprice"),
    ("orders", lambda s, d: table(s, d, "orders"), "orders", O.TABLES["orders"], "o_totalprice"),
):
    register(f"target_candidates_{_name}", target_candidates_sql(_src, _cols))(
        (lambda b: lambda spark, sf_dir: target_candidates(b(spark, sf_dir)).select(*_TC_COLS))(_build))
    register(f"leakage_{_name}", leakage_sql(_src, _cols, _target))(
        (lambda b, t: lambda spark, sf_dir: leakage(b(spark, sf_dir), t).drop("leakage_reason"))(_build, _target))
    register(f"feature_intelligence_{_name}", feature_intelligence_sql(_src, _cols, _target))(
        (lambda b, t: lambda spark, sf_dir: feature_intelligence(b(spark, sf_dir), t).select(*_FI_COLS))(
            _build, _target))


# ---------------------------------------------------------------------------
# preparation: split, fitted state, scaler
# ---------------------------------------------------------------------------

def _u_sql(keys: list[str], seed: int = 42) -> str:
    text = "concat_ws('|', " + ", ".join(f"CAST({O.q(k)} AS VARCHAR)" for k in keys) + f", '{seed}')"
    return f"(CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT) / 4294967296.0)"


def _split_rows(src: str, keys: list[str], target: str) -> str:
    """Rows with ``nth``, their place in their class by the hash of the keys, and ``least``, the number of test rows of the class."""
    return (f"(SELECT *, row_number() OVER (PARTITION BY {target} ORDER BY {_u_sql(keys)}) AS nth, "
            f"CAST(ceil(round(0.2 * count(*) OVER (PARTITION BY {target}), 9)) AS BIGINT) AS least FROM {src} WHERE {target} IS NOT NULL)")


SPLIT_SQL = f"""
SELECT CASE WHEN nth <= least THEN 'test' ELSE 'train' END AS split,
       CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS DOUBLE) AS label, count(*) AS n
FROM {_split_rows("lineitem", LINE_KEY, "l_returnflag")} s GROUP BY 1, 2
"""


@register("split_stratified_lineitem", SPLIT_SQL)
def q_split(spark, sf_dir):
    prep = prepare(line_features(spark, sf_dir), "l_returnflag", split_key=LINE_KEY)
    return prep.frame.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


# a rare class keeps its share, and the label does not leak into the rows chosen
SPLIT_RARE_SQL = f"""
SELECT CASE WHEN nth <= least THEN 'test' ELSE 'train' END AS split, CAST(toxic AS DOUBLE) AS label, count(*) AS n
FROM {_split_rows(LABELLED_DOCS_SQL, ["doc_id"], "toxic")} s GROUP BY 1, 2
"""


@register("split_rare_class_documents", SPLIT_RARE_SQL)
def q_split_rare(spark, sf_dir):
    prep = prepare(labelled_docs(spark, sf_dir), "toxic", split_key=["doc_id"])
    return prep.frame.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


# the rows of each class in five folds, told by sums over their keys and prices
FOLDS_SQL = f"""
SELECT l_returnflag, CAST((nth - 1) * 5 // n AS INTEGER) AS fold, count(*) AS n_rows, CAST(sum(l_orderkey) AS BIGINT) AS keys, CAST(sum(l_linenumber) AS BIGINT) AS lines
FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY {_u_sql(LINE_IDS, 49)}) AS nth, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) s
GROUP BY 1, 2
"""


@register("folds_stratified_lineitem", FOLDS_SQL)
def q_folds(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    of_class = {r["l_returnflag"]: r["count"] for r in rows.groupBy("l_returnflag").count().collect()}
    made = parts(rows, F.col("l_returnflag"), hash_unit(LINE_IDS, 49), fold_ranks(of_class, 5), "fold")
    return made.groupBy("l_returnflag", "fold").agg(F.count("*").alias("n_rows"), F.sum("l_orderkey").alias("keys"), F.sum(F.col("l_linenumber").cast("long")).alias("lines"))


def _train_rows(src: str) -> str:
    return f"(SELECT * FROM {_split_rows(src, LINE_KEY, 'l_returnflag')} t WHERE nth > least)"


def fitted_state_sql() -> str:
    tr = _train_rows("lineitem")
    num = ["l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice"]
    cat = ["l_linestatus"]
    parts = []
    for c in num:
        parts.append(f"SELECT {O.lit(c)} AS feature, 'numeric' AS kind, "
                     f"(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM {tr} a) AS median, "
                     f"CAST(NULL AS VARCHAR) AS mode, CAST(NULL AS VARCHAR[]) AS vocab")
    for c in cat:
        g = f"(SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {tr} a WHERE {c} IS NOT NULL GROUP BY 1)"
        parts.append(f"SELECT {O.lit(c)} AS feature, 'categorical' AS kind, CAST(NULL AS DOUBLE) AS median, "
                     f"(SELECT v FROM {g} g1 ORDER BY n DESC, v LIMIT 1) AS mode, "
                     f"(SELECT list(v ORDER BY n DESC, v) FROM (SELECT * FROM {g} g2 ORDER BY n DESC, v LIMIT 10) g3) "
                     f"AS vocab")
    return " UNION ALL ".join(parts)


def scaler_state_sql() -> str:
    tr = _train_rows("lineitem")
    num = ["l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice"]
    exprs = []
    for c in num:
        med = f"(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM {tr} m)"
        exprs.append((c, f"coalesce(CAST({c} AS DOUBLE), {med})"))
    g = f"(SELECT l_linestatus AS v, count(*) AS n FROM {tr} a GROUP BY 1 ORDER BY n DESC, v LIMIT 10)"
    mode = f"(SELECT v FROM {g} g0 ORDER BY n DESC, v LIMIT 1)"
    order = f"(SELECT list(v ORDER BY n DESC, v) FROM {g} g1)"
    parts = []
    for pos, (name, e) in enumerate(exprs):
        parts.append(f"SELECT {O.lit(name)} AS feature, {pos} AS position, {e} AS x FROM {tr} t")
    body = " UNION ALL ".join(parts)
    num_part = (f"SELECT feature, CAST(position AS INTEGER) AS position, round(avg(x), 6) AS mean, "
                f"round(CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1.0 END, 6) AS scale "
                f"FROM ({body}) b GROUP BY feature, position")
    k = len(exprs)
    cat_part = f"""
SELECT 'l_linestatus_' || v AS feature, CAST({k} + i - 1 AS INTEGER) AS position, round(avg(x), 6) AS mean,
       round(CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1.0 END, 6) AS scale
FROM (SELECT u.v, u.i, CASE WHEN coalesce(t.l_linestatus, {mode}) = u.v THEN 1.0 ELSE 0.0 END AS x
      FROM {tr} t, (SELECT unnest({order}) AS v, generate_subscripts({order}, 1) AS i) u) c
GROUP BY v, i
UNION ALL
SELECT 'l_linestatus_Other' AS feature, CAST({k} + len({order}) AS INTEGER) AS position, 0.0 AS mean, 1.0 AS scale
"""
    return num_part + " UNION ALL " + cat_part


_PREP_COLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_linestatus",
              "l_extendedprice", "l_returnflag"]


def _prep_lineitem(spark, sf_dir):
    # keys are excluded by the caller so the fitted features are the measures and one category
    return prepare(table(spark, sf_dir, "lineitem").select(*_PREP_COLS), "l_returnflag",
                   excluded=["l_orderkey"], split_key=LINE_KEY)


@register("impute_vocab_lineitem", fitted_state_sql())
def q_fitted(spark, sf_dir):
    prep = _prep_lineitem(spark, sf_dir)
    return fitted_state(prep, spark)


@register("standardize_lineitem", scaler_state_sql())
def q_scaler(spark, sf_dir):
    prep = _prep_lineitem(spark, sf_dir)
    return scaler_state(prep, spark)


# ---------------------------------------------------------------------------
# metrics on rule-made predictions
# ---------------------------------------------------------------------------

CLS_PRED_SQL = ("(SELECT l_returnflag AS label, CASE WHEN l_quantity > 30 THEN 'R' WHEN l_discount > 0.05 "
                "THEN 'A' ELSE 'N' END AS prediction FROM lineitem)")
REG_PRED_SQL = "(SELECT l_quantity AS label, l_extendedprice / 2100.0 AS prediction FROM lineitem)"


def cls_pred(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_returnflag").alias("label"), F.when(F.col("l_quantity") > 30, "R")
                     .when(F.col("l_discount") > 0.05, "A").otherwise("N").alias("prediction"))


def reg_pred(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_quantity").alias("label"), (F.col("l_extendedprice") / 2100.0).alias("prediction"))


PER_CLASS_SQL = f"""
(SELECT c AS class_name,
   coalesce((SELECT count(*) FROM {CLS_PRED_SQL} p WHERE p.label = c AND p.prediction = c), 0) AS tp,
   coalesce((SELECT count(*) FROM {CLS_PRED_SQL} p WHERE p.label = c), 0) AS sup,
   coalesce((SELECT count(*) FROM {CLS_PRED_SQL} p WHERE p.prediction = c), 0) AS prd
 FROM (SELECT label AS c FROM {CLS_PRED_SQL} a UNION SELECT prediction FROM {CLS_PRED_SQL} b) cl)
"""


@register("class_metrics", f"""
SELECT round(sum(tp) / sum(sup), 4) AS accuracy,
  round(sum(CASE WHEN prd > 0 THEN tp / prd ELSE 0 END * sup) / sum(sup), 4) AS precision,
  round(sum(CASE WHEN sup > 0 THEN tp / sup ELSE 0 END * sup) / sum(sup), 4) AS recall,
  round(sum(CASE WHEN (CASE WHEN prd > 0 THEN tp / prd ELSE 0 END) + (CASE WHEN sup > 0 THEN tp / sup ELSE 0 END) > 0
    THEN 2 * (CASE WHEN prd > 0 THEN tp / prd ELSE 0 END) * (CASE WHEN sup > 0 THEN tp / sup ELSE 0 END)
         / ((CASE WHEN prd > 0 THEN tp / prd ELSE 0 END) + (CASE WHEN sup > 0 THEN tp / sup ELSE 0 END))
    ELSE 0 END * sup) / sum(sup), 4) AS f1_score
FROM {PER_CLASS_SQL} pc
""")
def q_class_metrics(spark, sf_dir):
    return classification_metrics(cls_pred(spark, sf_dir))


@register("confusion", f"SELECT label AS actual, prediction AS predicted, count(*) AS count FROM {CLS_PRED_SQL} p "
                       f"GROUP BY 1, 2")
def q_confusion(spark, sf_dir):
    return confusion(cls_pred(spark, sf_dir))


@register("class_report", f"""
SELECT class_name, CASE WHEN prd > 0 THEN round(tp / prd * 100.0, 1) ELSE 0.0 END AS precision_pct,
       CASE WHEN sup > 0 THEN round(tp / sup * 100.0, 1) ELSE 0.0 END AS recall_pct, CAST(sup AS BIGINT) AS support
FROM {PER_CLASS_SQL} pc
""")
def q_class_report(spark, sf_dir):
    return class_report(cls_pred(spark, sf_dir))


@register("regression_metrics", f"""
SELECT round(mse, 4) AS mse, round(sqrt(round(mse, 4)), 4) AS rmse, round(mae, 4) AS mae,
       round(CASE WHEN ss_tot > 0 THEN 1 - ss_res / ss_tot WHEN ss_res = 0 THEN 1.0 ELSE 0.0 END, 4) AS r2_score
FROM (SELECT avg((label - prediction) * (label - prediction)) AS mse, avg(abs(label - prediction)) AS mae,
             sum((label - prediction) * (label - prediction)) AS ss_res, var_pop(label) * count(*) AS ss_tot
      FROM {REG_PRED_SQL} p) m
""")
def q_regression_metrics(spark, sf_dir):
    return regression_metrics(reg_pred(spark, sf_dir))


@register("regression_diagnostics", f"""
SELECT CASE WHEN isnan(mape) OR mape > 1000 THEN NULL ELSE round(mape, 2) END AS mape_pct,
       over_prediction_pct, under_prediction_pct, max_residual_error, mean_residual, residual_std
FROM (SELECT avg(abs(label - prediction) / abs(CASE WHEN label = 0 THEN 1e-6 ELSE label END)) * 100.0 AS mape,
             round(avg(CASE WHEN label - prediction < 0 THEN 1.0 ELSE 0.0 END) * 100.0, 1) AS over_prediction_pct,
             round(avg(CASE WHEN label - prediction > 0 THEN 1.0 ELSE 0.0 END) * 100.0, 1) AS under_prediction_pct,
             round(max(abs(label - prediction)), 2) AS max_residual_error,
             round(avg(label - prediction), 2) AS mean_residual,
             round(stddev_pop(label - prediction), 2) AS residual_std
      FROM {REG_PRED_SQL} p) d
""")
def q_regression_diagnostics(spark, sf_dir):
    return regression_diagnostics(reg_pred(spark, sf_dir), 0.5).drop("grade", "readiness", "executive_narrative")


# ---------------------------------------------------------------------------
# histogram boosting: the first trees, and the probabilities that follow from them
# ---------------------------------------------------------------------------

BOOST_X = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
BOOST_CLASSES = ["A", "N", "R"]


def _long_sql(src: str) -> str:
    """Rows of (k, node, f, v, g, h) of ``src`` (k, node, g, h and the features), unpivoted and summed by value."""
    return " UNION ALL ".join(f"SELECT k, node, {i} AS f, CAST({c} AS DOUBLE) AS v, sum(g) AS g, sum(h) AS h, count(*) AS n FROM {src} GROUP BY k, node, v" for i, c in enumerate(BOOST_X))


def _best_sql(long: str, least: int = 5, l2: float = 0.05) -> str:
    """Best split of each (k, node): f, cut, gain and the two sides' sums."""
    own, upto = "PARTITION BY k, node, f", "PARTITION BY k, node, f ORDER BY v"
    return f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, node ORDER BY gain DESC, f, v) AS nth FROM (
  SELECT k, node, f, v, cut, gl, hl, gt - gl AS gr, ht - hl AS hr,
         gl * gl / (hl + {l2}) + (gt - gl) * (gt - gl) / (ht - hl + {l2}) - gt * gt / (ht + {l2}) AS gain
  FROM (SELECT k, node, f, v, (v + lead(v) OVER ({upto})) / 2 AS cut, sum(g) OVER ({upto}) AS gl, sum(h) OVER ({upto}) AS hl, sum(n) OVER ({upto}) AS nl,
               sum(g) OVER ({own}) AS gt, sum(h) OVER ({own}) AS ht, sum(n) OVER ({own}) AS nt FROM ({long}) lo) c
  WHERE cut IS NOT NULL AND nl >= {least} AND nt - nl >= {least}) s WHERE gain > 0) r WHERE nth = 1"""


def _goes_right(best: str) -> str:
    return f"CASE {best}.f " + " ".join(f"WHEN {i} THEN CAST({c} AS DOUBLE)" for i, c in enumerate(BOOST_X)) + f" END > {best}.cut"


HIST_TREE_SQL = f"""
WITH r0 AS (SELECT *, 0 AS k, 0 AS node, (SELECT avg(l_extendedprice) FROM lineitem) - l_extendedprice AS g, 1.0 AS h FROM lineitem),
b0 AS ({_best_sql(_long_sql("r0"))}),
r1 AS (SELECT {", ".join("r0." + c for c in BOOST_X)}, r0.k, CASE WHEN {_goes_right("b0")} THEN 2 ELSE 1 END AS node, r0.g, r0.h FROM r0 CROSS JOIN b0),
b1 AS ({_best_sql(_long_sql("r1"))})
SELECT CAST(node AS BIGINT) AS node, CAST(f AS BIGINT) AS feature, round(cut, 6) AS cut, round(gain / 1e6, 2) AS gain_millions,
       round(-0.1 * gl / (hl + 0.05), 4) AS left_value, round(-0.1 * gr / (hr + 0.05), 4) AS right_value
FROM (SELECT * FROM b0 UNION ALL SELECT * FROM b1) b
"""


def _boost_frame(spark, sf_dir, label):
    return table(spark, sf_dir, "lineitem").select(F.array(*[F.col(c).cast("double") for c in BOOST_X]).alias("x"), label.alias("label"), "l_returnflag")


@register("hist_boosting_tree_lineitem", HIST_TREE_SQL)
def q_hist_tree(spark, sf_dir):
    made = boost(_boost_frame(spark, sf_dir, F.col("l_extendedprice")), Settings(rounds=1, depth=2))
    t = made.rounds[0][0]
    rows = [(i, t.feature[i], t.cut[i], t.gain[i], t.value[2 * i + 1], t.value[2 * i + 2]) for i in range(3) if t.feature[i] >= 0]
    return spark.createDataFrame(rows, "node long, feature long, cut double, gain double, l double, r double").select(
        "node", "feature", F.round("cut", 6).alias("cut"), F.round(F.col("gain") / 1e6, 2).alias("gain_millions"), F.round("l", 4).alias("left_value"), F.round("r", 4).alias("right_value"))


def _class_shares(spark, sf_dir, estimator):
    """For each class: its rows, their mean probabilities, and what is predicted for them."""
    rank = F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(2.0)
    rows = _boost_frame(spark, sf_dir, rank).withColumn("features", array_to_vector("x"))
    made = estimator.fit(rows).transform(rows).withColumn("p", vector_to_array("probability"))
    return made.groupBy("l_returnflag").agg(
        F.count("*").alias("n_rows"), *[F.round(F.avg(F.col("p")[i]), 8).alias(f"p_{c.lower()}") for i, c in enumerate(BOOST_CLASSES)],
        *[F.count_if(F.col("prediction") == i).alias(f"is_{c.lower()}") for i, c in enumerate(BOOST_CLASSES)])


# one round of three trees: priors, splits, leaf values, and each row's probabilities
SOFTMAX_SQL = f"""
WITH c AS (SELECT *, row_number() OVER () AS id, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y FROM lineitem),
p AS (SELECT y AS k, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM c) AS p FROM c GROUP BY y),
z AS (SELECT k, p, ln(p) - (SELECT avg(ln(p)) FROM p) AS base FROM p),
r AS (SELECT c.*, z.k, 0 AS node, z.p - CASE WHEN y = z.k THEN 1 ELSE 0 END AS g, z.p * (1 - z.p) AS h FROM c CROSS JOIN z),
b AS ({_best_sql(_long_sql("r"))}),
s AS (SELECT r.id, r.y, r.k, z.base + coalesce(CASE WHEN {_goes_right("b")} THEN -0.1 * gr / (hr + 0.05) ELSE -0.1 * gl / (hl + 0.05) END, 0) AS raw
      FROM r JOIN z ON z.k = r.k LEFT JOIN b ON b.k = r.k),
w AS (SELECT id, y, max(CASE WHEN k = 0 THEN exp(raw) END) AS a, max(CASE WHEN k = 1 THEN exp(raw) END) AS n, max(CASE WHEN k = 2 THEN exp(raw) END) AS q FROM s GROUP BY 1, 2)
SELECT CASE y WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS l_returnflag, count(*) AS n_rows, round(avg(a / (a + n + q)), 8) AS p_a, round(avg(n / (a + n + q)), 8) AS p_n,
       round(avg(q / (a + n + q)), 8) AS p_r, count(*) FILTER (a >= n AND a >= q) AS is_a, count(*) FILTER (n > a AND n >= q) AS is_n, count(*) FILTER (q > a AND q > n) AS is_r
FROM w GROUP BY y
"""


@register("softmax_boosting_lineitem", SOFTMAX_SQL)
def q_softmax(spark, sf_dir):
    return _class_shares(spark, sf_dir, HistBoosting(Settings(classes=3, rounds=1, depth=1)))


# ---------------------------------------------------------------------------
# extra trees: cuts drawn by a hash, scored on all rows
# ---------------------------------------------------------------------------

def _unit_sql(purpose: str) -> str:
    return f"(CAST(('0x' || substr(md5('42:{purpose}:' || tree || ':' || node || ':' || f), 1, 8)) AS BIGINT) / 4294967296.0)"


def _drawn_best_sql(rows: str, tries: int, classes: bool, least: int = 2) -> str:
    """Best drawn cut of each (tree, node) of ``rows`` (tree, node, y and the features): f, cut, gain, nl, nr and lists of the sums by class."""
    long = " UNION ALL ".join(f"SELECT tree, node, y, {i} AS f, CAST({c} AS DOUBLE) AS v FROM {rows}" for i, c in enumerate(BOOST_X))
    k, w = ("y", "1.0") if classes else ("0", "y")
    return f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY gain DESC, f) AS nth FROM (
  SELECT tree, node, f, cut, sum(nl) AS nl, sum(nr) AS nr, round(sum(vl * vl) / sum(nl) + sum(vr * vr) / sum(nr) - sum((vl + vr) * (vl + vr)) / sum(nl + nr), 9) AS gain,
         list(vl ORDER BY k) AS ls, list(vr ORDER BY k) AS rs
  FROM (SELECT lo.tree, lo.node, lo.f, d.cut, {k} AS k, sum(CASE WHEN v <= d.cut THEN {w} ELSE 0.0 END) AS vl, sum(CASE WHEN v > d.cut THEN {w} ELSE 0.0 END) AS vr,
               CAST(count(*) FILTER (v <= d.cut) AS DOUBLE) AS nl, CAST(count(*) FILTER (v > d.cut) AS DOUBLE) AS nr
        FROM ({long}) lo JOIN (
          SELECT tree, node, f, least(a + {_unit_sql("cut")} * (b - a), b) AS cut FROM (
            SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY {_unit_sql("feature")}, f) AS pick
            FROM (SELECT tree, node, f, min(v) AS a, max(v) AS b FROM ({long}) m GROUP BY tree, node, f) g WHERE a < b) p WHERE pick <= {tries}) d
          ON d.tree = lo.tree AND d.node = lo.node AND d.f = lo.f GROUP BY ALL) e
  GROUP BY tree, node, f, cut HAVING sum(nl) >= {least} AND sum(nr) >= {least}) s WHERE gain > 0) r WHERE nth = 1"""


# two trees of depth 2: the children of the root are nodes 1 and 2
EXTRA_TREES_SQL = f"""
WITH r0 AS (SELECT l.*, t.tree, 0 AS node, l.l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem) AS y FROM lineitem l CROSS JOIN (VALUES (0), (1)) t(tree)),
b0 AS ({_drawn_best_sql("r0", 4, False)}),
r1 AS (SELECT r0.* EXCLUDE (node), CASE WHEN {_goes_right("b0")} THEN 2 ELSE 1 END AS node FROM r0 JOIN b0 ON b0.tree = r0.tree),
b1 AS ({_drawn_best_sql("r1", 4, False)})
SELECT CAST(tree AS BIGINT) AS tree, CAST(node AS BIGINT) AS node, CAST(f AS BIGINT) AS feature, round(cut, 6) AS cut, round(gain / 1e6, 2) AS gain_millions,
       round((SELECT avg(l_extendedprice) FROM lineitem) + ls[1] / nl, 4) AS left_value, round((SELECT avg(l_extendedprice) FROM lineitem) + rs[1] / nr, 4) AS right_value
FROM (SELECT * FROM b0 UNION ALL SELECT * FROM b1) b
"""


@register("extra_trees_lineitem", EXTRA_TREES_SQL)
def q_extra_trees(spark, sf_dir):
    made = extratrees.grow(_boost_frame(spark, sf_dir, F.col("l_extendedprice")), extratrees.Settings(trees=2, depth=2))
    rows = [(n, i, t.feature[i], t.cut[i], t.gain[i], t.value[t.left[i]][0], t.value[t.left[i] + 1][0]) for n, t in enumerate(made.trees) for i in range(len(t.feature)) if t.feature[i] >= 0]
    return spark.createDataFrame(rows, "tree long, node long, feature long, cut double, gain double, l double, r double").select(
        "tree", "node", "feature", F.round("cut", 6).alias("cut"), F.round(F.col("gain") / 1e6, 2).alias("gain_millions"), F.round("l", 4).alias("left_value"), F.round("r", 4).alias("right_value"))


# three trees of depth 1 that try two features each, and the forest's probabilities of every row
EXTRA_CLASSES_SQL = f"""
WITH c AS (SELECT *, row_number() OVER () AS id, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y FROM lineitem),
r AS (SELECT c.*, t.tree, 0 AS node FROM c CROSS JOIN (VALUES (0), (1), (2)) t(tree)),
b AS ({_drawn_best_sql("r", 2, True)}),
s AS (SELECT r.id, r.y, avg(CASE WHEN {_goes_right("b")} THEN rs[1] / nr ELSE ls[1] / nl END) AS a, avg(CASE WHEN {_goes_right("b")} THEN rs[2] / nr ELSE ls[2] / nl END) AS n,
             avg(CASE WHEN {_goes_right("b")} THEN rs[3] / nr ELSE ls[3] / nl END) AS q FROM r JOIN b ON b.tree = r.tree GROUP BY 1, 2)
SELECT CASE y WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS l_returnflag, count(*) AS n_rows, round(avg(a), 8) AS p_a, round(avg(n), 8) AS p_n, round(avg(q), 8) AS p_r,
       count(*) FILTER (a >= n AND a >= q) AS is_a, count(*) FILTER (n > a AND n >= q) AS is_n, count(*) FILTER (q > a AND q > n) AS is_r
FROM s GROUP BY y
"""


@register("extra_trees_classes_lineitem", EXTRA_CLASSES_SQL)
def q_extra_classes(spark, sf_dir):
    return _class_shares(spark, sf_dir, extratrees.ExtraTrees(extratrees.Settings(classes=3, trees=3, depth=1)))


# ---------------------------------------------------------------------------
# permutation importance of a rule over all rows
# ---------------------------------------------------------------------------

PERM_X = ["l_quantity", "l_discount", "l_linenumber"]
PERM_LABEL = "l_quantity * (1 - l_discount) * (1 + l_tax)"


def _perm_order_sql(number: int, side: str) -> str:
    return "md5(concat_ws(':', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in LINE_IDS) + f", '{number}{side}'))"


def _perm_sql() -> str:
    x = [f"CAST({c} AS DOUBLE)" for c in PERM_X]
    rounds = []
    for r in range(2):
        paired = (f"(SELECT a.*, d.* FROM (SELECT {x[0]} AS a0, {x[1]} AS a1, {x[2]} AS a2, {PERM_LABEL} AS y, row_number() OVER (ORDER BY {_perm_order_sql(r, 'a')}) AS p FROM lineitem) a "
                  f"JOIN (SELECT {x[0]} AS d0, {x[1]} AS d1, {x[2]} AS d2, row_number() OVER (ORDER BY {_perm_order_sql(r, 'b')}) AS q FROM lineitem) d ON a.p = d.q)")
        for f in (-1, 0, 1, 2):
            args = [f"d{i}" if i == f else f"a{i}" for i in range(2)]
            rounds.append(f"SELECT {r} AS round, {f} AS f, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS score FROM (SELECT y, {args[0]} * (1 - {args[1]}) AS p FROM {paired} j) k")
    return f"""
WITH s AS ({" UNION ALL ".join(rounds)})
SELECT CAST(a.f AS INTEGER) AS feature, round(avg(b.score - a.score), 8) AS importance, round(stddev_pop(b.score - a.score), 8) AS spread
FROM s a JOIN s b ON a.round = b.round AND b.f = -1 WHERE a.f >= 0 GROUP BY a.f
"""


@register("permutation_importance_lineitem", _perm_sql())
def q_permutation(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    frame = rows.select(array_to_vector(F.array(*[F.col(c).cast("double") for c in PERM_X])).alias("features"), F.expr(PERM_LABEL).alias("label"), *LINE_IDS)

    def rule(df):
        x = vector_to_array("features")
        return df.withColumn("prediction", x[0] * (1 - x[1]))

    def orders(number):
        return tuple([F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in LINE_IDS], F.lit(f"{number}{side}")))] for side in "ab")

    made = permutation_importance(frame, rule, len(PERM_X), False, orders, repeats=2)
    return made.select("feature", F.round("importance", 8).alias("importance"), F.round("spread", 8).alias("spread"))


# ---------------------------------------------------------------------------
# benchmark and scoring (rows-only: model numbers are not SQL)
# ---------------------------------------------------------------------------

@register("leaderboard_labelled_documents")
def q_leaderboard(spark, sf_dir):
    return benchmark(labelled_docs(spark, sf_dir), "quality", sizes=SMALL_SIZES, split_key=["doc_id"]).leaderboard


@register("score_labelled_documents")
def q_score(spark, sf_dir):
    df = labelled_docs(spark, sf_dir)
    b = benchmark(df, "quality", sizes=SMALL_SIZES, split_key=["doc_id"],
                  models=["Logistic Regression", "Decision Tree"])
    return score(df, b.prep, b.champion, b.champion_name)


@register("leaderboard_lineitem_regression")
def q_leaderboard_reg(spark, sf_dir):
    return benchmark(line_features(spark, sf_dir), "l_extendedprice", sizes=SMALL_SIZES, split_key=LINE_KEY,
                     models=["Ridge Regression", "Decision Tree Regressor", "Gradient Boosting Regressor"]).leaderboard
