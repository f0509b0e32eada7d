"""Independent DuckDB SQL for quality, distribution and correlation results.

Like :mod:`tablelens.plans.oracle`, each measure is restated in SQL over
the raw table, per column, joined with ``UNION ALL``.
"""

from __future__ import annotations

from tablelens.plans.oracle import colstats_sql, identifier_sql, kind_of, lit, q


def _year(name: str) -> bool:
    low = name.lower()
    return "year" in low or "yr" in low


def _strip(s: str) -> str:
    return f"regexp_replace(regexp_replace({s}, '0+$', ''), '\\.$', '')"


def label_sql(x: str, is_year: bool) -> str:
    yearish = "true" if is_year else f"({x} >= 1900 AND {x} <= 2100)"
    return (
        f"(CASE WHEN {x} IS NULL THEN '' "
        f"WHEN {x} = floor({x}) AND {yearish} THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) "
        f"WHEN {x} = floor({x}) THEN format('{{:,.0f}}', {x}) "
        f"WHEN {yearish} THEN format('{{:.1f}}', {x}) "
        f"WHEN abs({x}) >= 1000000 THEN format('{{:,.2f}}', {x}) "
        f"WHEN abs({x}) >= 1000 THEN {_strip(f'format({chr(39)}{{:,.1f}}{chr(39)}, {x})')} "
        f"WHEN abs({x}) < 0.01 AND {x} <> 0 THEN {_strip(f'format({chr(39)}{{:.4f}}{chr(39)}, {x})')} "
        f"ELSE {_strip(f'format({chr(39)}{{:.2f}}{chr(39)}, {x})')} END)"
    )


def int_label_sql(x: str, is_year: bool) -> str:
    plain = f"CAST(CAST({x} AS BIGINT) AS VARCHAR)"
    yearish = "true" if is_year else f"({x} >= 1900 AND {x} <= 2100)"
    return f"(CASE WHEN {yearish} THEN {plain} WHEN abs({x}) >= 10000 THEN format('{{:,.0f}}', {x}) ELSE {plain} END)"


def int_edge_sql(x: str, is_year: bool) -> str:
    return f"CAST(CAST({x} AS BIGINT) AS VARCHAR)" if is_year else f"format('{{:,.0f}}', {x})"


def _num(c: str) -> str:
    return f"CAST({c} AS DOUBLE)"


# ---------------------------------------------------------------------------
# quality
# ---------------------------------------------------------------------------

def outliers_sql(src: str, cols) -> str:
    """(ord, outlier_count, lower_bound, upper_bound) for numeric columns with ≥ 4 values."""
    parts = []
    for i, (name, dtype) in enumerate(cols):
        if kind_of(dtype) != "numeric":
            continue
        c = q(name)
        v = f"(SELECT {_num(c)} AS x FROM {src} WHERE {c} IS NOT NULL AND NOT isnan({_num(c)}))"
        parts.append(f"""
SELECT {i} AS ord, CAST(count(*) FILTER (WHERE x < lo OR x > hi) AS BIGINT) AS outlier_count,
       round(coalesce(lo, q1), 2) AS lower_bound, round(coalesce(hi, q3), 2) AS upper_bound
FROM {v} d, (
  SELECT q1, q3,
    CASE WHEN q3 - q1 > 0 THEN q1 - 1.5 * (q3 - q1) WHEN sd > 0 THEN mu - 2.5 * sd END AS lo,
    CASE WHEN q3 - q1 > 0 THEN q3 + 1.5 * (q3 - q1) WHEN sd > 0 THEN mu + 2.5 * sd END AS hi
  FROM (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, avg(x) AS mu,
               stddev_samp(x) AS sd, count(x) AS n FROM {v} v0) b0
  WHERE n >= 4
) b
GROUP BY q1, q3, lo, hi""")
    if not parts:
        return "SELECT 0 AS ord, 0::BIGINT AS outlier_count, 0.0 AS lower_bound, 0.0 AS upper_bound WHERE false"
    return "\nUNION ALL\n".join(parts)


def quality_columns_sql(src: str, cols) -> str:
    ids = identifier_sql(colstats_sql(src, cols))
    return f"""
SELECT column_name, CAST(x.ord AS BIGINT) AS ordinal, data_type,
  CAST(missing_count AS BIGINT) AS missing_count,
  CASE WHEN total_rows > 0 THEN round(missing_count / total_rows * 100.0, 2) ELSE 0.0 END AS missing_pct,
  CAST(unique_count AS BIGINT) AS unique_count,
  (coalesce(unique_count, 0) + CASE WHEN missing_count > 0 THEN 1 ELSE 0 END) <= 1 AS is_constant,
  present = 0 AS is_empty,
  is_identifier AS is_id_candidate,
  coalesce(kind NOT IN ('numeric', 'boolean') AND total_rows >= 10 AND unique_count / total_rows > 0.8, false)
    AS is_high_cardinality,
  CASE WHEN kind = 'numeric' THEN coalesce(o.outlier_count, 0) END AS outlier_count,
  CASE WHEN kind = 'numeric' THEN
    CASE WHEN num_count > 0 THEN round(coalesce(o.outlier_count, 0) / num_count * 100.0, 2) ELSE 0.0 END
  END AS outlier_pct,
  CASE WHEN kind = 'numeric' THEN o.lower_bound END AS lower_bound,
  CASE WHEN kind = 'numeric' THEN o.upper_bound END AS upper_bound
FROM ({ids}) x LEFT JOIN ({outliers_sql(src, cols)}) o ON x.ord = o.ord
"""


def duplicates_sql(src: str, cols) -> str:
    keys = ", ".join(q(n) for n, _ in cols)
    return (
        f"SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows "
        f"FROM (SELECT count(*) AS n FROM {src} GROUP BY {keys}) g"
    )


def quality_summary_sql(src: str, cols) -> str:
    qc = quality_columns_sql(src, cols)

    def names(cond: str) -> str:
        return (f"coalesce(list(column_name ORDER BY ordinal) FILTER (WHERE {cond}), "
                f"CAST([] AS VARCHAR[]))")

    return f"""
SELECT row_count, column_count, total_cells, missing_cells, missing_pct, duplicate_rows, duplicate_pct,
  empty_columns, constant_columns, id_columns, high_cardinality_columns, outlier_columns, total_outliers,
  health_score,
  CASE WHEN health_score >= 85 THEN 'Excellent' WHEN health_score >= 70 THEN 'Good'
       WHEN health_score >= 50 THEN 'Fair' ELSE 'Poor' END AS health_status
FROM (
  SELECT *, greatest(0.0, least(100.0, round(100.0
      - least(35.0, missing_pct * 1.5)
      - least(20.0, duplicate_pct * 2.0)
      - least(15.0, len(empty_columns) * 10.0)
      - least(15.0, len(constant_columns) * 5.0)
      - CASE WHEN total_cells > 0 THEN least(15.0, total_outliers / total_cells * 100.0 * 3.0) ELSE 0.0 END, 1)))
    AS health_score
  FROM (
    SELECT *, CAST(row_count * column_count AS BIGINT) AS total_cells,
      CASE WHEN row_count * column_count > 0 THEN round(missing_cells / (row_count * column_count) * 100.0, 2)
           ELSE 0.0 END AS missing_pct,
      CASE WHEN row_count > 0 THEN round(duplicate_rows / row_count * 100.0, 2) ELSE 0.0 END AS duplicate_pct
    FROM (
      SELECT (SELECT CAST(count(*) AS BIGINT) FROM {src} r) AS row_count,
        CAST(count(*) AS BIGINT) AS column_count,
        CAST(sum(missing_count) AS BIGINT) AS missing_cells,
        {names('is_empty')} AS empty_columns,
        {names('is_constant')} AS constant_columns,
        {names('is_id_candidate')} AS id_columns,
        {names('is_high_cardinality AND NOT is_id_candidate')} AS high_cardinality_columns,
        {names('coalesce(outlier_count, 0) > 0')} AS outlier_columns,
        CAST(coalesce(sum(outlier_count), 0) AS BIGINT) AS total_outliers,
        (SELECT duplicate_rows FROM ({duplicates_sql(src, cols)}) d) AS duplicate_rows
      FROM ({qc}) qc
    ) a
  ) b
) c
"""


# ---------------------------------------------------------------------------
# distributions
# ---------------------------------------------------------------------------

def _row(name: str, i: int, type_: str, pos: str, value: str, lower: str, upper: str, cnt: str, pct: str) -> str:
    return (
        f"SELECT {lit(name)} AS column_name, CAST({i} AS BIGINT) AS ordinal, {lit(type_)} AS type, "
        f"CAST({pos} AS INTEGER) AS position, {value} AS value, {value} AS label, "
        f"CAST({lower} AS DOUBLE) AS lower, CAST({upper} AS DOUBLE) AS upper, CAST({cnt} AS BIGINT) AS count, "
        f"{pct} AS percentage"
    )


def _pct1(part: str, whole: str) -> str:
    # Spark rounds the shortest decimal text of a double, half up
    return (f"CASE WHEN {whole} > 0 THEN CAST(round(CAST(CAST(({part}) / ({whole}) * 100.0 AS VARCHAR) "
            f"AS DECIMAL(38, 18)), 1) AS DOUBLE) ELSE 0.0 END")


def histogram_sql(src: str, i: int, name: str) -> str:
    c = q(name)
    yr = _year(name)
    v = f"(SELECT {_num(c)} AS x FROM {src} WHERE {c} IS NOT NULL AND NOT isnan({_num(c)}))"
    plan = f"""(SELECT *, CASE WHEN allint THEN (CASE WHEN len(ie) >= 2 THEN ie
                                   ELSE [floor(mn), floor(mx) + 1] END) ELSE lin END AS edges
  FROM (SELECT *, list_sort(list_distinct(list_transform(lin, lambda e: round_even(e, 0)))) AS ie
    FROM (SELECT *, list_transform(range(0, k + 1),
                     lambda j: CASE WHEN j = k THEN mx ELSE mn + CAST(j AS DOUBLE) * ((mx - mn) / k) END) AS lin
      FROM (SELECT *, (nonint = 0 AND ninf = 0) AS allint,
                   CASE WHEN n = 0 THEN NULL WHEN mn = mx THEN 'constant' WHEN ninf > 0 THEN 'single'
                        WHEN nonint = 0 AND ninf = 0 AND u <= 14 THEN 'discrete' ELSE 'bins' END AS mode,
                   CAST(least(8, greatest(2, least(u, 8))) AS INTEGER) AS k
        FROM (SELECT count(*) AS n, min(x) AS mn, max(x) AS mx, count(DISTINCT x) AS u,
                     count(*) FILTER (WHERE isinf(x)) AS ninf,
                     count(*) FILTER (WHERE NOT isinf(x) AND x <> floor(x)) AS nonint FROM {v} v0) s0) s1) s2) s3)"""
    constant = _row(name, i, "histogram", "1", label_sql("mn", yr), "mn", "mx", "n", "100.0") + \
        f" FROM {plan} p WHERE mode = 'constant'"
    single = _row(name, i, "histogram", "1", f"({label_sql('mn', yr)} || ' – ' || {label_sql('mx', yr)})",
                  "mn", "mx", "n", "100.0") + f" FROM {plan} p WHERE mode = 'single'"
    discrete = _row(name, i, "histogram", "row_number() OVER (ORDER BY x)", int_label_sql("x", yr), "x", "x",
                    "cnt", _pct1("cnt", "n")) + \
        f" FROM (SELECT x, count(*) AS cnt FROM {v} v1 GROUP BY x) d, {plan} p WHERE mode = 'discrete'"
    int_lab = (f"(CASE WHEN lo <> hi THEN {int_edge_sql('lo', yr)} || ' – ' || {int_edge_sql('hi', yr)} "
               f"ELSE {int_edge_sql('lo', yr)} END)")
    float_lab = f"({label_sql('lo', yr)} || ' – ' || {label_sql('hi', yr)})"
    bins = _row(name, i, "histogram", "b + 1", f"(CASE WHEN allint THEN {int_lab} ELSE {float_lab} END)",
                "lo", "hi", "coalesce(cnt, 0)", _pct1("coalesce(cnt, 0)", "n")) + f"""
 FROM (SELECT b, edges[b + 1] AS lo, edges[b + 2] AS hi, n, allint
       FROM (SELECT unnest(range(0, len(edges) - 1)) AS b, edges, n, allint FROM {plan} p WHERE mode = 'bins') sk0) sk
 LEFT JOIN (SELECT len(list_filter(edges[2:len(edges) - 1], lambda e: x > e)) AS b, count(*) AS cnt
            FROM {v} v2, {plan} p WHERE mode = 'bins' GROUP BY 1) bc USING (b)"""
    return "\nUNION ALL\n".join([constant, single, discrete, bins])


def time_sql(src: str, i: int, name: str, ts: str | None = None) -> str:
    """``ts``: SQL of the timestamp, null where the value is none; a cast if not given."""
    c = q(name)
    t = f"(SELECT * FROM (SELECT {ts or f'CAST({c} AS TIMESTAMP)'} AS ts FROM {src} WHERE {c} IS NOT NULL) t9 WHERE ts IS NOT NULL)"
    g = f"""(SELECT CASE WHEN span > 730 THEN strftime(ts, '%Y') WHEN span > 60 THEN strftime(ts, '%Y-%m')
                 ELSE strftime(ts, '%Y-%m-%d') END AS period, count(*) AS cnt, any_value(total) AS total
       FROM {t} t0, (SELECT count(*) AS total,
                            floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000) AS span FROM {t} t1) s
       GROUP BY 1)"""
    return _row(name, i, "time", "row_number() OVER (ORDER BY period)", "period", "NULL", "NULL", "cnt",
                _pct1("cnt", "total")) + \
        f" FROM (SELECT *, row_number() OVER (ORDER BY period DESC) AS rk FROM {g} g0) g1 WHERE rk <= 10"


def frequency_sql(src: str, i: int, name: str, dtype: str) -> str:
    c = q(name)
    txt = f"(CASE WHEN {c} THEN 'True' ELSE 'False' END)" if dtype == "boolean" else f"CAST({c} AS VARCHAR)"
    g = (f"(SELECT CASE WHEN trim({txt}) = '' THEN 'Empty' ELSE trim({txt}) END AS value, count(*) AS cnt "
         f"FROM {src} WHERE {c} IS NOT NULL GROUP BY 1)")
    r = f"(SELECT *, row_number() OVER (ORDER BY cnt DESC, value ASC) AS pos FROM {g} g0)"
    tot = f"(SELECT sum(cnt) AS total, count(*) AS d FROM {g} g1)"
    top = _row(name, i, "frequency", "pos", "value", "NULL", "NULL", "cnt", _pct1("cnt", "total")) + \
        f" FROM {r} r0, {tot} t WHERE pos <= 10"
    other = (
        f"SELECT {lit(name)} AS column_name, CAST({i} AS BIGINT) AS ordinal, 'frequency' AS type, "
        f"CAST(11 AS INTEGER) AS position, 'Other' AS value, 'Other (' || CAST(d - 10 AS VARCHAR) || ' values)' AS label, "
        f"CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper, CAST(total - kept AS BIGINT) AS count, "
        f"{_pct1('total - kept', 'total')} AS percentage "
        f"FROM {tot} t, (SELECT sum(cnt) AS kept FROM {r} r1 WHERE pos <= 10) k WHERE d > 10 AND total > kept"
    )
    return top + "\nUNION ALL\n" + other


def distributions_sql(src: str, cols) -> str:
    """Typed columns only (string columns are assumed not to hold date text)."""
    parts = []
    for i, (name, dtype) in enumerate(cols):
        kind = kind_of(dtype)
        if kind == "datetime":
            parts.append(time_sql(src, i, name))
        elif kind == "numeric":
            parts.append(histogram_sql(src, i, name))
        elif kind in ("string", "boolean"):
            parts.append(frequency_sql(src, i, name, dtype))
    return "\nUNION ALL\n".join(f"SELECT * FROM ({p}) p{k}" for k, p in enumerate(parts))


# ---------------------------------------------------------------------------
# correlations
# ---------------------------------------------------------------------------

def _strength(r: str) -> str:
    a = f"round(abs({r}), 4)"
    tier = (f"(CASE WHEN {a} >= 0.80 THEN 'Very Strong' WHEN {a} >= 0.60 THEN 'Strong' "
            f"WHEN {a} >= 0.40 THEN 'Moderate' WHEN {a} >= 0.20 THEN 'Weak' ELSE 'Very Weak' END)")
    direction = f"(CASE WHEN {r} >= 0 THEN 'Positive' ELSE 'Negative' END)"
    return f"{tier} || ' ' || {direction} AS strength, {direction} AS direction, {tier} AS tier"


def correlations_sql(src: str, cols) -> str:
    """All pairs of eligible numeric columns (eligibility from the identifier SQL)."""
    numeric = [(i, n) for i, (n, d) in enumerate(cols) if kind_of(d) == "numeric"]
    ids = identifier_sql(colstats_sql(src, cols))
    elig = f"(SELECT ord FROM ({ids}) e WHERE kind = 'numeric' AND unique_count > 1 AND NOT is_identifier)"
    parts = []
    for a in range(len(numeric)):
        for b in range(a + 1, len(numeric)):
            (i, x), (j, y) = numeric[a], numeric[b]
            cx, cy = q(x), q(y)
            vx = f"CASE WHEN isnan({_num(cx)}) THEN NULL ELSE {_num(cx)} END"
            vy = f"CASE WHEN isnan({_num(cy)}) THEN NULL ELSE {_num(cy)} END"
            parts.append(
                f"SELECT {i} AS ord1, {j} AS ord2, {lit(x)} AS column1, {lit(y)} AS column2, "
                f"count(*) FILTER (WHERE xa IS NOT NULL AND ya IS NOT NULL) AS n, corr(xa, ya) AS r "
                f"FROM (SELECT {vx} AS xa, {vy} AS ya FROM {src}) t"
            )
    if not parts:
        return ("SELECT 0 AS ord1, 0 AS ord2, '' AS column1, '' AS column2, 0.0 AS correlation, "
                "0.0 AS abs_correlation, '' AS strength, '' AS direction, '' AS tier WHERE false")
    allp = "\nUNION ALL\n".join(parts)
    rr = "(CASE WHEN r IS NULL OR isnan(r) OR isinf(r) OR n < 3 THEN 0.0 ELSE round(r, 3) END + 0.0)"
    return f"""
SELECT CAST(ord1 AS INTEGER) AS ord1, CAST(ord2 AS INTEGER) AS ord2, column1, column2,
       r3 AS correlation, abs(r3) AS abs_correlation, {_strength('r3')}
FROM (SELECT *, {rr} AS r3 FROM ({allp}) p) p2
WHERE ord1 IN {elig} AND ord2 IN {elig}
"""


def top_correlations_sql(src: str, cols, top: int = 12) -> str:
    pc = correlations_sql(src, cols)
    return f"""
SELECT CAST(rank AS INTEGER) AS rank, ord1, ord2, column1, column2, correlation, abs_correlation,
       strength, direction, tier
FROM (
  SELECT *, row_number() OVER (ORDER BY abs_correlation DESC, ord1, ord2) AS rank
  FROM ({pc}) p, (SELECT count(*) FILTER (WHERE abs_correlation >= 0.05) AS nm FROM ({pc}) p0) m
  WHERE nm < 3 OR abs_correlation >= 0.05
) r WHERE rank <= {top}
"""
