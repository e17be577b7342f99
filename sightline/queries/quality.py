"""Trust, type repair and personal-data scans of the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import personal_data as pii
from sightline.operators import trust, type_repair
from sightline.queries.registry import TABLES, query, table, view


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


TRUST_CUSTOMER = """WITH f AS (SELECT count(*)::DOUBLE AS n FROM customer),
    v AS (SELECT avg(s) AS variance FROM (
        SELECT least(1.0, stddev_samp(c_custkey) / (abs(avg(c_custkey)) + 1e-9) / 10) AS s FROM customer UNION ALL
        SELECT least(1.0, stddev_samp(c_nationkey) / (abs(avg(c_nationkey)) + 1e-9) / 10) FROM customer UNION ALL
        SELECT least(1.0, stddev_samp(c_acctbal) / (abs(avg(c_acctbal)) + 1e-9) / 10) FROM customer)),
    b AS (SELECT avg(s) AS balance FROM (
        SELECT 1 - (max(k) - min(k)) / sum(k)::DOUBLE AS s FROM (SELECT count(*) AS k FROM customer GROUP BY c_name) UNION ALL
        SELECT 1 - (max(k) - min(k)) / sum(k)::DOUBLE FROM (SELECT count(*) AS k FROM customer GROUP BY c_mktsegment))),
    u AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT * FROM customer)) / n AS uniqueness FROM f),
    s AS (SELECT 1.0::DOUBLE AS completeness, 1.0::DOUBLE AS consistency, greatest(0.1, least(1.0, variance)) AS variance,
          balance, uniqueness FROM v, b, u)
    SELECT unnest(['completeness', 'consistency', 'variance', 'balance', 'uniqueness', 'overall']) AS dimension,
    unnest([completeness, consistency, round(variance, 6), round(balance, 6), round(uniqueness, 6),
    round(0.3 * completeness + 0.25 * consistency + 0.2 * variance + 0.15 * balance + 0.1 * uniqueness, 6)]) AS score FROM s"""


@query("trust_dimensions", TRUST_CUSTOMER)
def _(spark, sf):
    return trust.trust_dimensions(table(spark, sf, "customer"))


@query(
    "trust_dimensions_nulls",
    """WITH m AS (SELECT count(*)::DOUBLE AS n, (sum((l_quantity IS NULL)::INT) + sum((l_extendedprice IS NULL)::INT)
        + sum((l_returnflag IS NULL)::INT))::DOUBLE AS missing FROM fx_nulls),
    v AS (SELECT avg(s) AS variance FROM (
        SELECT least(1.0, stddev_samp(l_orderkey) / (abs(avg(l_orderkey)) + 1e-9) / 10) AS s FROM fx_nulls UNION ALL
        SELECT least(1.0, stddev_samp(l_linenumber) / (abs(avg(l_linenumber)) + 1e-9) / 10) FROM fx_nulls UNION ALL
        SELECT least(1.0, stddev_samp(l_quantity) / (abs(avg(l_quantity)) + 1e-9) / 10) FROM fx_nulls UNION ALL
        SELECT least(1.0, stddev_samp(l_extendedprice) / (abs(avg(l_extendedprice)) + 1e-9) / 10) FROM fx_nulls UNION ALL
        SELECT 0.0)),
    b AS (SELECT 1 - (max(k) - min(k)) / sum(k)::DOUBLE AS balance FROM
        (SELECT count(*) AS k FROM fx_nulls WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag)),
    u AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT * FROM fx_nulls)) / n AS uniqueness FROM m),
    s AS (SELECT 1 - missing / (n * 7) AS completeness, 1.0::DOUBLE AS consistency, greatest(0.1, least(1.0, variance)) AS variance,
          balance, uniqueness FROM m, v, b, u)
    SELECT unnest(['completeness', 'consistency', 'variance', 'balance', 'uniqueness', 'overall']) AS dimension,
    unnest([round(completeness, 6), consistency, round(variance, 6), round(balance, 6), round(uniqueness, 6),
    round(0.3 * completeness + 0.25 * consistency + 0.2 * variance + 0.15 * balance + 0.1 * uniqueness, 6)]) AS score FROM s""",
)
def _(spark, sf):
    return trust.trust_dimensions(view(spark, sf, "fx_nulls"))


@query(
    "trust_consistency",
    """WITH m AS (SELECT count(*) AS n, count(TRY_CAST(mixed_text AS DOUBLE)) AS c FROM fx_types)
    SELECT 'consistency' AS dimension, round(1 - least(n - c, c) / (n * 2.0), 6) AS score FROM m""",
)
def _(spark, sf):
    mixed = view(spark, sf, "fx_types").select("order_id", "mixed_text")
    return trust.trust_dimensions(mixed).where(F.col("dimension") == "consistency")


@query(
    "trust_score",
    TRUST_CUSTOMER.split("SELECT unnest(")[0]
    + """SELECT o AS overall, CASE WHEN o >= 0.82 THEN 'Reliable for ML' WHEN o >= 0.62 THEN 'Needs Cleaning' ELSE 'Unsafe for Modeling' END AS label,
    CASE WHEN o >= 0.82 THEN 'reliable' WHEN o >= 0.62 THEN 'warning' ELSE 'danger' END AS status
    FROM (SELECT round(0.3 * completeness + 0.25 * consistency + 0.2 * variance + 0.15 * balance + 0.1 * uniqueness, 6) AS o FROM s)""",
)
def _(spark, sf):
    return trust.trust_score(table(spark, sf, "customer")).select("overall", "label", "status")


@query("trust_summary")
def _(spark, sf):
    return trust.trust_score(table(spark, sf, "customer")).select("status", "summary")


@query(
    "trust_flags",
    """SELECT 'completeness' AS kind, NULL AS "column", format('{} missing values across 3 column(s)',
        sum((l_quantity IS NULL)::INT + (l_extendedprice IS NULL)::INT + (l_returnflag IS NULL)::INT)) AS flag,
        'Impute or drop null values in: l_quantity, l_extendedprice, l_returnflag' AS recommendation FROM fx_nulls
        HAVING sum((l_quantity IS NULL)::INT + (l_extendedprice IS NULL)::INT + (l_returnflag IS NULL)::INT) > 0.05 * 7 * count(*)
    UNION ALL SELECT 'variance', 'constant_col', 'Column ''constant_col'' has zero variance', 'Drop constant column ''constant_col'''
    UNION ALL SELECT 'uniqueness', NULL, format('{} duplicate rows', k), format('Remove {} duplicate rows before analysis', k)
        FROM (SELECT (SELECT count(*) FROM fx_nulls) - (SELECT count(*) FROM (SELECT DISTINCT * FROM fx_nulls)) AS k) WHERE k > 0
    UNION ALL SELECT 'pii', 'l_shipdate', 'Possible PII: ''l_shipdate'' (matches ''ip'')', 'Review flagged columns for PII before sharing data'""",
)
def _(spark, sf):
    return trust.trust_flags(view(spark, sf, "fx_nulls"))


@query(
    "trust_name_hints",
    """SELECT * FROM (VALUES ('c_name', 'name')) AS t("column", hint)""",
)
def _(spark, sf):
    return trust.name_hints(table(spark, sf, "customer"))


@query(
    "type_detect",
    """WITH t AS (SELECT * FROM fx_types)
    SELECT 'order_id' AS "column", 'bigint' AS current_type, 'object (ID/category)' AS suggested_type, 0.75 AS confidence,
        'Appears to be an ID column' AS reason, 'to_string' AS fix_type
    UNION ALL SELECT 'flag01', 'int', 'bool', 0.85, 'Only contains 0 and 1', 'int_to_bool'
    UNION ALL SELECT 'price_text', 'string', 'float64 (currency)', round_even(avg(regexp_matches(price_text, '^[$]?-?[0-9,]+[.]?[0-9]*$')::INT), 2),
        'Detected currency format ($)', 'currency' FROM t
    UNION ALL SELECT 'cust_text', 'string', 'float64 (currency)', round_even(avg(regexp_matches(cust_text, '^-?[0-9,]+[.]?[0-9]*$')::INT), 2),
        'Detected currency format ()', 'currency' FROM t
    UNION ALL SELECT 'bool_text', 'string', 'bool', round_even(avg((lower(bool_text) IN ('yes', 'no'))::INT), 2),
        'Boolean-like values detected (no, yes)', 'boolean' FROM t
    UNION ALL SELECT 'date_text', 'string', 'datetime64', round_even(avg((TRY_CAST(date_text AS DATE) IS NOT NULL)::INT), 2),
        'Date/time values stored as text', 'datetime' FROM t
    UNION ALL SELECT 'pct_text', 'string', 'float64 (percentage)', round_even(avg(regexp_matches(pct_text, '^[0-9]+%$')::INT), 2),
        'Percentage values stored as text', 'percentage' FROM t""",
)
def _(spark, sf):
    return type_repair.detect_type_issues(view(spark, sf, "fx_types"), ["order_id"]).drop("samples")


@query(
    "type_samples",
    """SELECT 'price_text' AS "column", (SELECT string_agg(price_text, '|' ORDER BY order_id) FROM
    (SELECT * FROM fx_types ORDER BY order_id LIMIT 3)) AS samples""",
)
def _(spark, sf):
    found = type_repair.detect_type_issues(view(spark, sf, "fx_types"), ["order_id"])
    return found.where(F.col("column") == "price_text").select("column", F.array_join("samples", "|").alias("samples"))


FIXES = {
    "order_id": "to_string",
    "price_text": "currency",
    "cust_text": "numeric",
    "bool_text": "boolean",
    "date_text": "datetime",
    "pct_text": "percentage",
    "flag01": "int_to_bool",
}


@query(
    "type_fix",
    """SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(replace(price_text, '$', '') AS DOUBLE) AS price_text,
    CAST(cust_text AS DOUBLE) AS cust_text, lower(bool_text) = 'yes' AS bool_text, CAST(date_text AS TIMESTAMP) AS date_text,
    round(CAST(replace(pct_text, '%', '') AS DOUBLE) / 100, 6) AS pct_text, flag01 = 1 AS flag01, mixed_text FROM fx_types""",
)
def _(spark, sf):
    fixed = type_repair.apply_type_fixes(view(spark, sf, "fx_types"), FIXES)
    return fixed.withColumn("date_text", F.col("date_text").cast("timestamp_ntz"))


def _pii_sql(tab, column, threshold=False) -> str:
    parts = []
    for kind, pattern, risk, category, _ in pii.VALUE_RULES:
        text = pattern.replace("'", "''")
        parts.append(
            f"""SELECT '{column}' AS "column", '{kind}' AS pii_type, '{risk}' AS risk, '{category}' AS category,
            count(*) FILTER (regexp_matches({column}, '{text}')) AS match_count,
            round(100.0 * count(*) FILTER (regexp_matches({column}, '{text}'))::DOUBLE / count({column}), 6) AS match_percentage FROM {tab}"""
        )
    return _union(parts)


FIELDS = ("column", "pii_type", "risk", "category", "match_count", "match_percentage")


@query("pii_values", _pii_sql("documents", "text"))
def _(spark, sf):
    return pii.value_matches(table(spark, sf, "documents").select("text")).select(*FIELDS)


@query(
    "pii_detections",
    "SELECT * FROM (" + _union(_pii_sql("fx_pii", c) for c in ("contact", "host", "note")) + ") WHERE match_percentage > 10",
)
def _(spark, sf):
    return pii.scan_values(view(spark, sf, "fx_pii")).select(*FIELDS)


def _name_sql() -> str:
    columns = " UNION ALL ".join(
        f"SELECT '{t}' AS tab, column_name AS c FROM (DESCRIBE SELECT * FROM {t})" for t in TABLES
    )
    rules = ", ".join(
        f"('{k}', [{', '.join(repr(w) for w in words)}], '{risk}', '{cat}')" for k, words, risk, cat in pii.NAME_RULES
    )
    return f"""SELECT tab AS table_name, c AS "column", kind AS pii_type, risk, category FROM ({columns}) x,
    (VALUES {rules}) AS r(kind, words, risk, category)
    WHERE len(list_filter(words, lambda w: contains(lower(c), w))) > 0"""


@query("pii_names", _name_sql())
def _(spark, sf):
    out = None
    for t in TABLES:
        one = pii.scan_names(table(spark, sf, t)).withColumn("table_name", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "pii_mask",
    """SELECT doc_id, md5(CASE WHEN length(text) <= 4 THEN '***' ELSE left(text, 2) || repeat('*', length(text) - 4) || right(text, 2) END) AS masked,
    length(CASE WHEN length(text) <= 4 THEN '***' ELSE left(text, 2) || repeat('*', length(text) - 4) || right(text, 2) END) AS masked_length
    FROM documents""",
)
def _(spark, sf):
    masked = pii.mask_columns(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return masked.select("doc_id", F.md5("text").alias("masked"), F.char_length("text").cast("bigint").alias("masked_length"))


@query(
    "pii_risks",
    """SELECT * FROM (VALUES ('c_custkey', 'Low', 0), ('contact', 'High', 1), ('host', 'Medium', 1), ('note', 'Critical', 1))
    AS t("column", risk_level, detections)""",
)
def _(spark, sf):
    return pii.column_risks(view(spark, sf, "fx_pii"))


@query(
    "pii_summary",
    """SELECT 'Critical' AS overall_risk, 3 AS total_pii_columns, 4 AS total_columns, 1 AS low, 1 AS medium, 1 AS high, 1 AS critical
    FROM (SELECT count(*) FROM fx_pii)""",
)
def _(spark, sf):
    return pii.risk_summary(view(spark, sf, "fx_pii"))


@query(
    "pii_matrix",
    """SELECT 'contact' AS "column", 0 AS identity, 2 AS contact, 0 AS financial, 0 AS location, 0 AS health, 0 AS demographic, 0 AS technical
    UNION ALL SELECT 'host', 0, 0, 0, 0, 0, 0, 1 UNION ALL SELECT 'note', 3, 0, 0, 0, 0, 0, 0""",
)
def _(spark, sf):
    return pii.risk_matrix(view(spark, sf, "fx_pii"))
