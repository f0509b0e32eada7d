"""Independent SQL (DuckDB dialect) for the registered queries.

These strings restate each measure directly in SQL over the raw tables, one
``SELECT`` per column joined by ``UNION ALL``; they share no code with the
Spark operators, only the written rules.  Used as the correctness oracle.
"""

from __future__ import annotations

from tablelens.functions.naming import (
    ENTITY_ID_PATTERNS,
    EXACT_ID_NAMES,
    NON_ID_WORDS,
    PREFIX_ID_PATTERN,
    TEXT_PII_PATTERNS,
    UUID_PATTERN,
)

# (name, spark simpleString) for the driver tables the queries use.
TABLES: dict[str, list[tuple[str, str]]] = {
    "lineitem": [
        ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
        ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
        ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
        ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"),
    ],
    "orders": [
        ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
        ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"),
    ],
    "customer": [
        ("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
        ("c_acctbal", "double"), ("c_mktsegment", "string"),
    ],
    "part": [
        ("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
        ("p_size", "int"), ("p_retailprice", "double"),
    ],
    "supplier": [
        ("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double"),
    ],
    "events": [
        ("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
        ("event_type", "string"), ("value", "double"), ("props", "string"),
    ],
    "documents": [
        ("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"),
    ],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string")],
}

NUMERIC = {"bigint", "int", "smallint", "tinyint", "double", "float"}


def kind_of(dtype: str) -> str:
    if dtype in NUMERIC or dtype.startswith("decimal"):
        return "numeric"
    if dtype == "boolean":
        return "boolean"
    if dtype == "string":
        return "string"
    if dtype.startswith("timestamp") or dtype == "date":
        return "datetime"
    return "complex"


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def colstats_sql(src: str, cols: list[tuple[str, str]]) -> str:
    """One row per column of ``src`` with the base measures, as a SQL query."""
    parts = []
    for i, (name, dtype) in enumerate(cols):
        kind = kind_of(dtype)
        c = q(name)
        num = f"CAST({c} AS DOUBLE)" if kind == "numeric" else "CAST(NULL AS DOUBLE)"
        txt = f"CAST({c} AS VARCHAR)"
        textual = kind in ("string", "datetime")
        key = txt
        if textual:
            avg_len = f"avg(length(trim({txt})))"
            uuid = f"avg(CASE WHEN {c} IS NOT NULL THEN CAST(regexp_matches(trim({txt}), {lit(UUID_PATTERN)}) AS INT) END)"
            pref = f"avg(CASE WHEN {c} IS NOT NULL THEN CAST(regexp_matches(trim({txt}), {lit(PREFIX_ID_PATTERN)}) AS INT) END)"
            min_text = f"min({txt})"
        else:
            avg_len = uuid = pref = "CAST(NULL AS DOUBLE)"
            min_text = "CAST(NULL AS VARCHAR)"
        exact = "".join(f"{f'CAST({fn}({c}) AS VARCHAR)' if dtype in ('tinyint', 'smallint', 'int', 'bigint') or dtype.startswith('decimal') else 'CAST(NULL AS VARCHAR)'} AS exact_{fn}, " for fn in ("min", "max", "sum"))
        integral = "true" if dtype in ("tinyint", "smallint", "int", "bigint") else "false"
        top = (
            f"(SELECT {{sel}} FROM (SELECT {key} AS v, count(*) AS n FROM {src} WHERE {c} IS NOT NULL "
            f"GROUP BY 1 ORDER BY n DESC, v ASC LIMIT 1))"
        )
        parts.append(
            f"SELECT {i} AS ord, {lit(name)} AS column_name, {lit(dtype)} AS data_type, {lit(kind)} AS kind, "
            f"count(*) AS total_rows, count({c}) AS present, count(*) - count({c}) AS missing_count, "
            f"count(DISTINCT {key}) AS unique_count, count({num}) AS num_count, "
            f"min({num}) AS num_min, max({num}) AS num_max, avg({num}) AS num_mean, sum({num}) AS num_sum, "
            f"stddev_samp({num}) AS num_std, var_samp({num}) AS num_var, skewness({num}) AS num_skew, "
            f"quantile_cont({num}, 0.25) AS q25, quantile_cont({num}, 0.5) AS median, "
            f"quantile_cont({num}, 0.75) AS q75, "
            f"{avg_len} AS avg_len, {uuid} AS uuid_rate, {pref} AS prefix_rate, {min_text} AS min_text, "
            f"{integral} AS integral, {exact} {top.format(sel='v')} AS top_value, {top.format(sel='n')} AS top_freq "
            f"FROM {src}"
        )
    return "\nUNION ALL\n".join(parts)


def r4(x: str) -> str:
    """Four decimals, missing for what is no finite number."""
    return f"(CASE WHEN isnan({x}) OR isinf({x}) THEN NULL ELSE round({x}, 4) + 0.0 END)"


def comparable_sql(sql: str, names: list[str]) -> str:
    """The query with the columns in ten significant digits (see ``catalog.comparable``)."""
    each = ", ".join(f"CASE WHEN abs({c}) < 1e6 THEN {c} ELSE round({c} / pow(10.0, floor(log10(abs({c}))) - 9), 0) * pow(10.0, floor(log10(abs({c}))) - 9) END AS {c}" for c in names)
    return f"SELECT * REPLACE ({each}) FROM ({sql}) exact_rows"


def _re_any(patterns: list[str]) -> str:
    return lit("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def _in_list(values: list[str]) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


# SQL expressions over a ``column_name`` column
CLEAN = "regexp_replace(lower(regexp_replace(trim(column_name), '[^a-zA-Z0-9]', '_', 'g')), '^_+|_+$', '', 'g')"
CAMEL = (
    "regexp_replace(regexp_replace(lower(regexp_replace(trim(column_name), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), "
    "'[^a-zA-Z0-9]', '_', 'g'), '^_+|_+$', '', 'g')"
)


def name_id_sql() -> str:
    return (
        f"(CASE WHEN {CLEAN} = '' THEN false WHEN {CLEAN} IN {_in_list(EXACT_ID_NAMES)} THEN true "
        f"WHEN {CLEAN} IN {_in_list(NON_ID_WORDS)} THEN false "
        f"ELSE regexp_matches({CLEAN}, {_re_any(ENTITY_ID_PATTERNS)}) "
        f"OR regexp_matches({CAMEL}, {_re_any(ENTITY_ID_PATTERNS)}) END)"
    )


def pii_sql() -> str:
    return f"regexp_matches({CAMEL}, {_re_any(TEXT_PII_PATTERNS)})"


def exact_sql() -> str:
    return f"({CLEAN} IN {_in_list(EXACT_ID_NAMES)})"


def identifier_sql(colstats: str) -> str:
    """Adds ratio, is_sequential, id_rule, is_identifier to a colstats query."""
    return f"""
    SELECT *, (id_rule IS NOT NULL) AS is_identifier FROM (
      SELECT *,
        CASE WHEN NOT usable THEN NULL
             WHEN name_id AND (unique_count >= 4 OR unique_count = total_rows) THEN 'A'
             WHEN pii AND unique_count >= 3 THEN 'B'
             WHEN seq AND total_rows >= 20 AND ratio >= 0.90 THEN 'C'
             WHEN textual AND (coalesce(uuid_rate, 0) > 0.8 OR coalesce(prefix_rate, 0) > 0.7)
                  AND unique_count >= 10 AND ratio >= 0.05 THEN 'D'
             WHEN textual AND unique_count >= 25 AND (coalesce(avg_len, 0) >= 22 OR ratio >= 0.90) THEN 'E'
             WHEN textual AND total_rows >= 20 AND ratio >= 0.98 THEN 'F'
             WHEN exact_name AND unique_count > 1 THEN 'G'
        END AS id_rule
      FROM (
        SELECT *,
          (present > 0 AND total_rows > 0 AND kind <> 'complex') AS usable,
          kind IN ('string', 'datetime') AS textual,
          CASE WHEN total_rows > 0 THEN round(unique_count / total_rows, 4) ELSE 0.0 END AS ratio,
          coalesce(integral AND num_count > 1 AND unique_count / (num_max - num_min + 1) > 0.85, false) AS seq,
          {name_id_sql()} AS name_id, {pii_sql()} AS pii, {exact_sql()} AS exact_name
        FROM ({colstats}) s0
      ) s1
    ) s2
    """
