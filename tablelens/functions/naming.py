"""Column-name rules as Spark Column expressions.

All rules here run on a small frame of column names (one row per column),
never on the data itself.  They are written with ``rlike`` /
``regexp_replace`` so that the decision lives inside the Spark plan next to
the data metrics it is combined with.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These lists and patterns must equal the behaviour being
# reproduced, so they are stated literally and in their original order.
# ---------------------------------------------------------------------------

# Whole names that always denote an identifier.
EXACT_ID_NAMES = [
    "id", "pk", "key", "uuid", "guid", "ssn", "hash", "token", "index",
    "row_id", "row_number", "row_num", "rownum", "record_id", "record_num",
    "unnamed: 0", "unnamed_0", "unnamed: 0.1",
]

# English words ending in "id" that are not identifiers.
NON_ID_WORDS = [
    "grid", "fluid", "liquid", "solid", "acid", "hybrid", "pyramid", "android",
    "lipid", "squid", "valid", "orchid", "morbid", "vivid", "torpid", "candid",
    "lucid", "frigid", "humid", "pallid", "rabid", "arid", "fetid", "placid",
    "tepid", "viscid", "squalid", "turbid", "timid", "rapid", "stupid", "lurid",
    "rigid", "putrid", "horrid", "splendid", "intrepid", "insipid", "gelid",
]

# Entity-identifier name patterns (matched case-insensitively).
ENTITY_ID_PATTERNS = [
    r"^(.*_)?(customer|user|client|account|employee|patient|subscriber|member|order|transaction|trans|record|row|session|visitor|device|item|product|store|vendor|ticket|invoice|case|sample|lead|policy|claim|student|driver|agent|host|listing|post|comment|article|sale|payment|contract|dept|department|org|organization|company|partner|entity|person|subject|participant|respondent|household|cardholder|merchant)_?ids?$",
    r"^(.*_)?(cust|usr|acct|emp|ord|txn|trans|rec|sub|cli|pat|dev|sess|idx)_?ids?$",
    r"^id$",
    r"^.*_id$",
    r"^id_.*$",
    r"^.*_pk$",
    r"^pk_.*$",
    r"^.*_key$",
    r"^key_.*$",
    r"^.*_code$",
    r"^.*_uuid$",
    r"^.*_guid$",
    r"^uuid$",
    r"^guid$",
    r"^ssn$",
    r"^.*_num$",
    r"^.*_number$",
]

# Free-text / personal-attribute name patterns (matched case-insensitively).
TEXT_PII_PATTERNS = [
    r"^(.*_)?(name|full_name|first_name|last_name|customer_name|client_name|patient_name|employee_name|person_name|user_name|username)$",
    r"^(.*_)?(address|street|street_address|shipping_address|billing_address|address_line_1|address_line_2|zip_code|postal_code|postcode)$",
    r"^(.*_)?(email|phone|telephone|mobile|fax|contact_number|ip_address|user_agent)$",
    r"^(.*_)?(description|notes|comments|remarks|summary|text|message|review|feedback|url|website|image|photo|avatar)$",
]

# Value patterns.
UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
PREFIX_ID_PATTERN = r"^[a-zA-Z_\-]+[0-9]+$"

# Post-outcome (target leakage) name patterns, searched anywhere in the
# lower-cased name with "-" and " " turned into "_".
POST_OUTCOME_PATTERNS = [
    r"reason$", r"date$", r"time$", r"cancellation", r"churn_reason",
    r"exit_date", r"exit_reason", r"resolved", r"resolution", r"refund",
    r"discharge", r"death", r"closed_date",
]

# Business keywords that make a column a likely prediction target.
TARGET_KEYWORDS = [
    "churn", "target", "label", "converted", "default", "fraud", "status",
    "outcome", "purchased", "result", "sale_price", "price", "revenue",
    "amount", "salary", "score",
]

# Whole names the SQL template generator treats as identifiers.
SQL_ID_NAMES = ["id", "index", "uuid", "guid", "row_id", "row_number", "key", "code", "no", "num"]
SQL_ID_SUFFIX_PATTERN = r"(^|[_\s])(id|uuid|guid|key|code|index|no|num)$"

# ---------------------------------------------------------------------------


def _alt(patterns: list[str]) -> str:
    """One case-insensitive alternation of full-anchored patterns."""
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def clean_name(name: Column) -> Column:
    """trim → non-alphanumeric to "_" → lower → strip leading/trailing "_"."""
    s = F.regexp_replace(F.trim(name), r"[^a-zA-Z0-9]", "_")
    return F.regexp_replace(F.lower(s), r"^_+|_+$", "")


def camel_clean_name(name: Column) -> Column:
    """Split camelCase first ("CustomerID" → "customer_id"), then clean."""
    split = F.lower(F.regexp_replace(F.trim(name), r"([a-z0-9])([A-Z])", "$1_$2"))
    return F.regexp_replace(F.regexp_replace(split, r"[^a-zA-Z0-9]", "_"), r"^_+|_+$", "")


def is_exact_id_name(name: Column) -> Column:
    return clean_name(name).isin(EXACT_ID_NAMES)


def is_name_matched_id(name: Column) -> Column:
    """Identifier naming convention (exact names, then exception words, then patterns)."""
    plain = clean_name(name)
    camel = camel_clean_name(name)
    pattern = _alt(ENTITY_ID_PATTERNS)
    by_pattern = plain.rlike(pattern) | camel.rlike(pattern)
    return (
        F.when(plain == "", F.lit(False))
        .when(plain.isin(EXACT_ID_NAMES), F.lit(True))
        .when(plain.isin(NON_ID_WORDS), F.lit(False))
        .otherwise(by_pattern)
    )


def is_text_pii_name(name: Column) -> Column:
    """Free-text / personal attribute naming convention."""
    return camel_clean_name(name).rlike(_alt(TEXT_PII_PATTERNS))


def leakage_name_hit(name: Column) -> Column:
    """Post-outcome naming convention (search, not full match)."""
    low = F.regexp_replace(F.lower(name), r"[- ]", "_")
    return low.rlike("|".join(f"(?:{p})" for p in POST_OUTCOME_PATTERNS))


def target_keyword_hit(name: Column) -> Column:
    low = F.lower(name)
    return F.exists(F.array(*[F.lit(k) for k in TARGET_KEYWORDS]), lambda k: F.instr(low, k) > 0)


def is_year_name(name: Column) -> Column:
    low = F.lower(name)
    return (F.instr(low, "year") > 0) | (F.instr(low, "yr") > 0)
