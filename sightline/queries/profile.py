"""Profiles of the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import correlation, outliers, profile
from sightline.queries.registry import query, table, view

LINE_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


def _describe_sql(tab: str, cols) -> str:
    return _union(
        f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}::DOUBLE), 4) AS mean,
        round(stddev_samp({c}::DOUBLE), 4) AS std, min({c})::DOUBLE AS "min",
        round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q1, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median,
        round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q3, max({c})::DOUBLE AS "max",
        round(max({c})::DOUBLE - min({c})::DOUBLE, 4) AS "range",
        round(quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25), 4) AS iqr,
        round(skewness({c}::DOUBLE), 4) AS skewness, round(kurtosis({c}::DOUBLE), 4) AS kurtosis,
        (SELECT {c} FROM {tab} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)::DOUBLE AS mode
        FROM {tab}"""
        for c in cols
    )


@query("prf_describe", _describe_sql("lineitem", LINE_NUMBERS), places=4)
def _(spark, sf):
    return profile.describe_numeric(table(spark, sf, "lineitem"))


@query("prf_describe_nulls", _describe_sql("fx_nulls", ("l_quantity", "l_extendedprice")), places=4)
def _(spark, sf):
    return profile.describe_numeric(view(spark, sf, "fx_nulls").select("l_quantity", "l_extendedprice"))


ORDER_TYPES = (
    ("o_orderkey", "bigint", "Numeric"),
    ("o_custkey", "bigint", "Numeric"),
    ("o_orderstatus", "string", None),
    ("o_totalprice", "double", "Numeric"),
    ("o_orderdate", "timestamp_ntz", "DateTime"),
    ("o_orderpriority", "string", None),
)


@query(
    "prf_columns",
    _union(
        f"""SELECT '{c}' AS "column", '{t}' AS data_type,
        {f"'{k}'" if k else f"CASE WHEN count(DISTINCT {c}) <= 20 THEN 'Categorical' ELSE 'Text' END"} AS category,
        count(*) - count({c}) AS missing, round(100.0 * (count(*) - count({c})) / count(*), 6)::DOUBLE AS missing_pct,
        count(DISTINCT {c}) AS distinct_count FROM orders"""
        for c, t, k in ORDER_TYPES
    ),
)
def _(spark, sf):
    return profile.column_info(table(spark, sf, "orders"))


@query(
    "prf_basic_info",
    """SELECT count(*) AS "rows", 5::BIGINT AS "columns",
    sum(8 + strlen(c_name) + 4 + 8 + strlen(c_mktsegment))::BIGINT AS bytes,
    (SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM customer)))::BIGINT FROM customer) AS duplicate_rows,
    0::BIGINT AS missing_cells FROM customer""",
)
def _(spark, sf):
    return profile.table_info(table(spark, sf, "customer"))


NULL_COLS = ("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice", "l_returnflag", "constant_col")


@query(
    "prf_missing",
    _union(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
        round_even(100.0::DOUBLE * (count(*) - count({c})) / count(*), 2) AS missing_pct, count({c}) AS present_count,
        round_even(100.0::DOUBLE - round_even(100.0::DOUBLE * (count(*) - count({c})) / count(*), 2), 2) AS present_pct FROM fx_nulls"""
        for c in NULL_COLS
    ),
)
def _(spark, sf):
    return profile.missing_analysis(view(spark, sf, "fx_nulls"))


@query(
    "prf_duplicates",
    """SELECT sum(n - 1)::BIGINT AS duplicate_rows FROM
    (SELECT count(*) AS n FROM fx_dups GROUP BY c_custkey, c_mktsegment, c_acctbal)""",
)
def _(spark, sf):
    from sightline.plans.longform import duplicate_rows

    return duplicate_rows(view(spark, sf, "fx_dups"))


@query(
    "prf_categorical",
    _union(
        f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS "value", count(*) AS "count",
        round_even(count(*)::DOUBLE / (SELECT count(*) FROM lineitem) * 100.0, 2) AS percentage
        FROM lineitem GROUP BY {c} HAVING (SELECT count(DISTINCT {c}) FROM lineitem) <= 20"""
        for c in ("l_linenumber", "l_returnflag", "l_linestatus")
    ),
)
def _(spark, sf):
    return profile.categorical_stats(table(spark, sf, "lineitem").select("l_linenumber", "l_returnflag", "l_linestatus", "l_partkey"))


def _corr_sql(tab, cols, fn="corr") -> str:
    return _union(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round({fn}({a}, {b}), 6) + 0.0 AS r FROM {tab}" for a in cols for b in cols
    )


@query("prf_corr", _corr_sql("lineitem", MEASURES))
def _(spark, sf):
    return correlation.correlation(table(spark, sf, "lineitem"), MEASURES)


@query("prf_corr_nulls", _corr_sql("fx_nulls", ("l_quantity", "l_extendedprice")))
def _(spark, sf):
    return correlation.correlation(view(spark, sf, "fx_nulls"), ("l_quantity", "l_extendedprice"))


def _rank_sql(tab, col, out) -> str:
    return f"rank() OVER (ORDER BY {col}) + (count(*) OVER (PARTITION BY {col}) - 1) / 2.0 AS {out}"


@query(
    "prf_spearman",
    "WITH r AS (SELECT "
    + ", ".join(_rank_sql("lineitem", c, f"r_{c}") for c in ("l_quantity", "l_extendedprice", "l_discount"))
    + " FROM lineitem) "
    + _union(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(r_{a}, r_{b}), 6) + 0.0 AS r FROM r"
        for a in ("l_quantity", "l_extendedprice", "l_discount")
        for b in ("l_quantity", "l_extendedprice", "l_discount")
    ),
)
def _(spark, sf):
    return correlation.correlation(table(spark, sf, "lineitem"), ("l_quantity", "l_extendedprice", "l_discount"), "spearman")


KENDALL_X = "value"
KENDALL_Y = "user_id"


@query(
    "prf_kendall",
    """WITH g AS (SELECT s_nationkey::DOUBLE AS x, s_acctbal AS y FROM supplier),
    s AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s,
                 sum(CASE WHEN a.x <> b.x THEN 1 ELSE 0 END) AS nx, sum(CASE WHEN a.y <> b.y THEN 1 ELSE 0 END) AS ny
          FROM g a, g b)
    SELECT round(s / sqrt(nx::DOUBLE * ny::DOUBLE), 6) AS r, (SELECT count(*) FROM g) AS n FROM s""",
)
def _(spark, sf):
    return correlation.kendall_pair(table(spark, sf, "supplier"), "s_nationkey", "s_acctbal")


@query(
    "prf_kendall_events",
    """WITH g AS (SELECT user_id AS x, value AS y FROM events),
    s AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s, count(*) FILTER (a.x <> b.x) AS nx, count(*) FILTER (a.y <> b.y) AS ny FROM g a, g b)
    SELECT round(s / sqrt(nx::DOUBLE * ny::DOUBLE), 6) AS r, (SELECT count(*) FROM g) AS n FROM s""",
)
def _(spark, sf):
    return correlation.kendall_pair(table(spark, sf, "events"), "user_id", "value")


@query(
    "prf_strong_pairs",
    """SELECT 'l_quantity' AS col_a, 'y' AS col_b, round(corr(l_quantity, 2 * l_quantity + l_tax), 6) AS r,
    'positive' AS direction FROM lineitem""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", "l_tax", (F.col("l_quantity") * 2 + F.col("l_tax")).alias("y"))
    return correlation.strong_pairs(li)


@query("prf_vif")
def _(spark, sf):
    return correlation.variance_inflation(table(spark, sf, "lineitem"), MEASURES)


@query(
    "prf_vif_two",
    """WITH g AS (SELECT sum(l_quantity * l_quantity) AS aa, sum(l_tax * l_tax) AS bb, sum(l_quantity * l_tax) AS ab FROM lineitem),
    v AS (SELECT aa * bb / (aa * bb - ab * ab) AS vif FROM g)
    SELECT unnest(['l_quantity', 'l_tax']) AS "column", round(vif, 2) AS vif,
    CASE WHEN vif > 10 THEN 'high' WHEN vif > 5 THEN 'moderate' ELSE 'low' END AS level FROM v""",
)
def _(spark, sf):
    return correlation.variance_inflation(table(spark, sf, "lineitem"), ("l_quantity", "l_tax"))


def _fence_sql(tab, cols) -> str:
    return _union(
        f"""SELECT '{c}' AS "column", count(*) FILTER ({c} < lo OR {c} > hi) AS outlier_count,
        round(100.0 * count(*) FILTER ({c} < lo OR {c} > hi)::DOUBLE / count({c}), 6) AS outlier_pct,
        round(any_value(lo), 6) AS lower_bound, round(any_value(hi), 6) AS upper_bound
        FROM {tab}, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
        (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {tab}))"""
        for c in cols
    )


@query("prf_outliers_iqr", _fence_sql("events", ("value",)))
def _(spark, sf):
    return outliers.iqr_outliers(table(spark, sf, "events"), ["value"])


@query("prf_outliers_iqr_documents", _fence_sql("documents", ("n_chars",)))
def _(spark, sf):
    return outliers.iqr_outliers(table(spark, sf, "documents"), ["n_chars"])


def _z_sql(tab, c) -> str:
    return f"""SELECT '{c}' AS "column", count(*) FILTER (abs({c} - m) > 3 * s) AS outlier_count,
    round(100.0 * count(*) FILTER (abs({c} - m) > 3 * s)::DOUBLE / count({c}), 6) AS outlier_pct
    FROM {tab}, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM {tab})"""


@query("prf_outliers_z", _z_sql("events", "value"))
def _(spark, sf):
    return outliers.zscore_outliers(table(spark, sf, "events"), ["value"])


@query("prf_outliers_z_documents", _z_sql("documents", "n_chars"))
def _(spark, sf):
    return outliers.zscore_outliers(table(spark, sf, "documents"), ["n_chars"])


@query(
    "prf_semantic",
    """SELECT * FROM (VALUES ('event_id', 'integer'), ('ts', 'datetime'), ('user_id', 'integer'), ('value', 'float'))
    AS t("column", semantic_type)
    UNION ALL SELECT 'event_type', CASE WHEN count(DISTINCT event_type) / count(*) < 0.05 OR count(DISTINCT event_type) <= 20
    THEN 'categorical' ELSE 'text' END FROM events
    UNION ALL SELECT 'props', CASE WHEN count(DISTINCT props) / count(*) < 0.05 OR count(DISTINCT props) <= 20
    THEN 'categorical' ELSE 'text' END FROM events""",
)
def _(spark, sf):
    return profile.semantic_types(table(spark, sf, "events"))


TEXT_KINDS = _union(
    f"""SELECT '{c}' AS c, CASE WHEN count(DISTINCT {c}) / count(*) < 0.05 OR count(DISTINCT {c}) <= 20
    THEN 'categorical' ELSE 'text' END AS kind FROM fx_types"""
    for c in ("bool_text", "cust_text", "mixed_text", "pct_text", "price_text")
)


@query(
    "prf_type_groups",
    f"""SELECT kind, string_agg(c, ',' ORDER BY c) AS "columns" FROM ({TEXT_KINDS}) GROUP BY kind
    UNION ALL SELECT 'datetime', 'date_text' UNION ALL SELECT 'numeric', 'flag01,order_id'""",
)
def _(spark, sf):
    return profile.type_groups(view(spark, sf, "fx_types"))


@query(
    "prf_quality",
    """WITH m AS (SELECT count(*) AS n, count(*) * 7 AS cells,
        sum((l_quantity IS NULL)::INT + (l_extendedprice IS NULL)::INT + (l_returnflag IS NULL)::INT)::BIGINT AS missing FROM fx_nulls),
    d AS (SELECT (SELECT count(*) FROM fx_nulls) - (SELECT count(*) FROM (SELECT DISTINCT * FROM fx_nulls)) AS dups)
    SELECT round_even((cells - missing)::DOUBLE / cells * 100, 2) AS completeness,
    round_even((n - dups)::DOUBLE / n * 100, 2) AS uniqueness,
    round_even(((cells - missing)::DOUBLE / cells * 100 + (n - dups)::DOUBLE / n * 100) / 2, 2) AS overall_score,
    cells AS total_cells, missing AS missing_cells, dups AS duplicate_rows FROM m, d""",
)
def _(spark, sf):
    return profile.quality_score(view(spark, sf, "fx_nulls"))


@query(
    "prf_distribution",
    """WITH s AS (SELECT count(*) AS n, avg(value) AS m, stddev_samp(value) AS sd, stddev_pop(value) AS sp, skewness(value) AS sk, kurtosis(value) AS ku,
    quantile_cont(value, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q FROM events)
    SELECT 'value' AS "column", any_value(n) AS n, round(any_value(m), 6) AS mean, round(any_value(q[3]), 6) AS median, round(any_value(sd), 6) AS std,
    round(any_value(sk), 6) AS skewness, CASE WHEN abs(any_value(sk)) < 0.5 THEN 'approximately symmetric' WHEN any_value(sk) > 0.5 THEN 'right-skewed (positive)'
    ELSE 'left-skewed (negative)' END AS skewness_label, round(any_value(ku), 6) AS kurtosis,
    count(*) FILTER (value < q[2] - 1.5 * (q[4] - q[2]) OR value > q[4] + 1.5 * (q[4] - q[2])) AS iqr_outliers,
    count(*) FILTER (abs(value - m) > 3 * sp) AS zscore_outliers, round(any_value(q[1]), 6) AS p5, round(any_value(q[2]), 6) AS p25,
    round(any_value(q[4]), 6) AS p75, round(any_value(q[5]), 6) AS p95 FROM events, s""",
)
def _(spark, sf):
    out = profile.distribution(table(spark, sf, "events"), "value")
    return out.drop("normality_test", "normality_p", "normal", "transform_advice")


@query("prf_distribution_normality")
def _(spark, sf):
    out = profile.distribution(table(spark, sf, "customer"), "c_acctbal")
    return out.select("column", "normality_test", "normality_p", "normal", "transform_advice")


@query(
    "prf_duplicate_list",
    """SELECT c_custkey, c_mktsegment, c_acctbal, count(*) - 1 AS repeats FROM fx_dups GROUP BY 1, 2, 3 HAVING count(*) > 1""",
)
def _(spark, sf):
    return profile.repeated_rows(view(spark, sf, "fx_dups"))


@query(
    "prf_insight_numeric",
    """SELECT 'value' AS "column", 'skewed' AS finding,
    format('Heavily right-skewed (skew={:.2f}): consider a log transform', skewness(value)) AS text FROM events""",
)
def _(spark, sf):
    return profile.quick_insight(table(spark, sf, "events"), "value")


@query(
    "prf_insight_text",
    """WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
    t AS (SELECT (SELECT count(*) FROM c) AS kinds, lang, 100.0 * n / (SELECT sum(n) FROM c) AS pct FROM c ORDER BY n DESC, lang LIMIT 1)
    SELECT 'lang' AS "column", CASE WHEN pct > 70 THEN 'dominated' ELSE 'categories' END AS finding,
    CASE WHEN pct > 70 THEN format('Dominated by ''{}'' ({:.0f}%): highly imbalanced', lang, pct::DOUBLE)
    ELSE format('{} categories, top=''{}'' ({:.0f}%)', kinds, lang, pct::DOUBLE) END AS text FROM t""",
)
def _(spark, sf):
    return profile.quick_insight(table(spark, sf, "documents"), "lang")


@query(
    "prf_dictionary",
    _union(
        f"""SELECT '{c}' AS "column", '{t}' AS data_type, count({c}) AS non_null, count(DISTINCT {c}) AS distinct_count,
        0.0::DOUBLE AS missing_pct,
        (SELECT string_agg(CAST({c} AS VARCHAR), ', ' ORDER BY c_custkey) FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 3)) AS samples,
        {d} AS description FROM customer"""
        for c, t, d in (
            ("c_custkey", "bigint", "CASE WHEN count(DISTINCT c_custkey) <= 2 THEN 'flag with two values' WHEN count(DISTINCT c_custkey) <= 10 THEN concat('code or rank, ', count(DISTINCT c_custkey), ' values') ELSE 'row identifier' END"),
            ("c_name", "string", "CASE WHEN count(DISTINCT c_name) <= 2 THEN 'flag with two values' WHEN count(DISTINCT c_name) <= 20 THEN concat('category, ', count(DISTINCT c_name), ' values') ELSE 'name' END"),
            ("c_nationkey", "int", "CASE WHEN count(DISTINCT c_nationkey) <= 2 THEN 'flag with two values' WHEN count(DISTINCT c_nationkey) <= 10 THEN concat('code or rank, ', count(DISTINCT c_nationkey), ' values') ELSE 'row identifier' END"),
            ("c_acctbal", "double", "format('measure from {:.2f} to {:.2f}', min(c_acctbal), max(c_acctbal))"),
            ("c_mktsegment", "string", "concat('category, ', count(DISTINCT c_mktsegment), ' values')"),
        )
    ),
)
def _(spark, sf):
    return profile.data_dictionary(table(spark, sf, "customer"), ["c_custkey"])


@query(
    "prf_numeric_summary",
    _union(
        f"""SELECT '{c}' AS "column", round_even(avg({c}), 4) AS mean, round_even(stddev_samp({c}), 4) AS std,
        round_even(min({c}), 4) AS "min", round_even(quantile_cont({c}, 0.5), 4) AS median, round_even(max({c}), 4) AS "max",
        round_even(skewness({c}), 4) AS skewness FROM lineitem"""
        for c in ("l_quantity", "l_extendedprice")
    ),
)
def _(spark, sf):
    return profile.numeric_summary(table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice"))


@query("prf_context")
def _(spark, sf):
    return profile.dataset_context(table(spark, sf, "customer"), ["c_custkey"])


@query(
    "prf_rule_answers",
    """WITH o AS (SELECT min_by(o_totalprice, o_orderkey) AS f, max_by(o_totalprice, o_orderkey) AS l,
    avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders)
    SELECT 'trend' AS question_class, unnest(['column', 'trend', 'first', 'last', 'mean', 'std']) AS fact,
    unnest(['o_totalprice', CASE WHEN l > f THEN 'increasing' ELSE 'decreasing' END, format('{:.2f}', f), format('{:.2f}', l),
    format('{:.3f}', m), format('{:.3f}', s)]) AS "value" FROM o""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_totalprice", F.col("o_orderkey").cast("string").alias("k"), "o_orderkey")
    return profile.rule_based_facts(orders.select("o_totalprice", "o_orderkey"), "What trends exist?", ["o_orderkey"])


@query(
    "prf_chart_facts",
    """SELECT 'value' AS "column", CASE WHEN any_value(sk) > 0.5 THEN 'right-skewed' WHEN any_value(sk) < -0.5 THEN 'left-skewed'
    ELSE 'approximately normal' END AS shape, round(any_value(sk), 6) AS skewness, round(any_value(m), 6) AS mean,
    round(any_value(s), 6) AS std, count(*) FILTER (abs(value - m) > 3 * s) AS beyond_3_std, abs(any_value(sk)) > 1 AS log_advised
    FROM events, (SELECT skewness(value) AS sk, avg(value) AS m, stddev_samp(value) AS s FROM events)""",
)
def _(spark, sf):
    return profile.chart_facts(table(spark, sf, "events"), "value")


@query(
    "prf_preview",
    "SELECT * FROM (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 10)",
)
def _(spark, sf):
    return profile.preview(table(spark, sf, "orders"), ["o_orderkey"], 10, "tail")


@query("prf_preview_head", "SELECT * FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 10)")
def _(spark, sf):
    return profile.preview(table(spark, sf, "orders"), ["o_orderkey"], 10)


@query("prf_sample")
def _(spark, sf):
    return profile.sample_rows(table(spark, sf, "customer"), ["c_custkey"], 100)


@query(
    "prf_filter_columns",
    """SELECT 'l_returnflag' AS "column", 'string' AS data_type, 'Categorical' AS category, count(*) - count(l_returnflag) AS missing,
    round(100.0 * (count(*) - count(l_returnflag)) / count(*), 6)::DOUBLE AS missing_pct, count(DISTINCT l_returnflag) AS distinct_count FROM fx_nulls""",
)
def _(spark, sf):
    return profile.filter_columns(profile.column_info(view(spark, sf, "fx_nulls")), ["Categorical"], only_missing=True)


@query(
    "prf_select_kind",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
)
def _(spark, sf):
    from sightline.functions.columns import select_kind

    return select_kind(table(spark, sf, "orders"), "numeric")
