"""Cleaning, audit and anomaly queries over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import anomaly, cleaning, encoding
from sightline.operators.audit import AuditTrail, summarise_log
from sightline.plans.storage import scratch_path
from sightline.queries.registry import query, table, view


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


NULLED = ("l_quantity", "l_extendedprice", "l_returnflag")


@query(
    "clean_issues",
    _union(
        f"""SELECT 'missing' AS issue, '{c}' AS "column", count(*) - count({c}) AS amount,
        round_even((count(*) - count({c}))::DOUBLE / count(*) * 100.0, 2) AS pct FROM fx_nulls"""
        for c in NULLED
    )
    + """ UNION ALL SELECT 'duplicates', NULL, k, NULL FROM
        (SELECT (SELECT count(*) FROM fx_nulls) - (SELECT count(*) FROM (SELECT DISTINCT * FROM fx_nulls)) AS k) WHERE k > 0
    UNION ALL SELECT 'constant', 'constant_col', 1, NULL""",
)
def _(spark, sf):
    return cleaning.cleaning_issues(view(spark, sf, "fx_nulls"))


@query(
    "clean_issues_events",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
    SELECT 'outliers' AS issue, 'value' AS "column", count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS amount,
    NULL AS pct FROM events, q
    UNION ALL SELECT 'high_cardinality', 'props', count(DISTINCT props), NULL FROM events HAVING count(DISTINCT props) > 50""",
)
def _(spark, sf):
    return cleaning.cleaning_issues(table(spark, sf, "events").select("event_id", "value", "event_type", "props"))


@query("clean_score", "SELECT CAST(100 - 6 - 2 AS INT) AS score FROM (SELECT count(*) FROM fx_nulls)")
def _(spark, sf):
    return cleaning.cleaning_score(view(spark, sf, "fx_nulls"))


@query("clean_readiness", "SELECT CAST(100 - 20 - 15 AS INT) AS score FROM (SELECT count(*) FROM fx_nulls)")
def _(spark, sf):
    return cleaning.readiness_score(view(spark, sf, "fx_nulls"))


@query(
    "clean_fill",
    """WITH s AS (SELECT avg(l_quantity) AS m, quantile_cont(l_extendedprice, 0.5) AS d FROM fx_nulls),
    f AS (SELECT l_returnflag AS mo FROM fx_nulls WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT l_orderkey, l_linenumber, l_shipdate, round(coalesce(l_quantity, m), 6) AS l_quantity,
    round(coalesce(l_extendedprice, d), 6) AS l_extendedprice, coalesce(l_returnflag, mo) AS l_returnflag, constant_col
    FROM fx_nulls, s, f""",
)
def _(spark, sf):
    return cleaning.fill_missing(
        view(spark, sf, "fx_nulls"), {"l_quantity": "mean", "l_extendedprice": "median", "l_returnflag": "mode"}
    )


@query(
    "clean_fill_zero_drop",
    """SELECT l_orderkey, l_linenumber, l_shipdate, coalesce(l_quantity, 0) AS l_quantity, l_extendedprice, l_returnflag, constant_col
    FROM fx_nulls WHERE l_extendedprice IS NOT NULL""",
)
def _(spark, sf):
    return cleaning.fill_missing(view(spark, sf, "fx_nulls"), {"l_quantity": "zero", "l_extendedprice": "drop"})


GAPPY = """SELECT event_id, ts, event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM events"""


def _gappy(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    return events.withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value")))


@query(
    "clean_ffill",
    f"""SELECT event_id, ts, event_type,
    last_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
    FROM ({GAPPY})""",
)
def _(spark, sf):
    return cleaning.fill_missing(_gappy(spark, sf), {"value": "ffill"}, ["ts", "event_id"])


@query(
    "clean_bfill_keyed",
    f"""SELECT event_id, ts, event_type,
    first_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value
    FROM ({GAPPY})""",
)
def _(spark, sf):
    return cleaning.fill_missing(_gappy(spark, sf), {"value": "bfill"}, ["ts", "event_id"], ["event_type"])


IQR = "SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events"


@query(
    "clean_iqr_clip",
    f"""SELECT event_id, round(greatest(least(value, b + 1.5 * (b - a)), a - 1.5 * (b - a)), 6) AS value FROM events, ({IQR})""",
)
def _(spark, sf):
    return cleaning.treat_outliers(table(spark, sf, "events").select("event_id", "value"), "iqr_clip", ["value"])


@query(
    "clean_iqr_drop",
    """WITH q AS (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.75) AS b FROM documents),
    s AS (SELECT doc_id, n_chars, n_chars % 97 AS r FROM documents, q WHERE n_chars BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)),
    p AS (SELECT quantile_cont(r, 0.25) AS a, quantile_cont(r, 0.75) AS b FROM s)
    SELECT doc_id, n_chars, r FROM s, p WHERE r BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", (F.col("n_chars") % 97).alias("r"))
    return cleaning.treat_outliers(docs, "iqr_drop", ["n_chars", "r"])


@query(
    "clean_zscore_clip",
    """SELECT event_id, round(greatest(least(value, m + 3 * s), m - 3 * s), 6) AS value
    FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)""",
)
def _(spark, sf):
    return cleaning.treat_outliers(table(spark, sf, "events").select("event_id", "value"), "zscore_clip", ["value"])


@query(
    "clean_winsorize",
    """SELECT event_id, round(greatest(least(value, b), a), 6) AS value FROM events,
    (SELECT quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b FROM events)""",
)
def _(spark, sf):
    return cleaning.treat_outliers(table(spark, sf, "events").select("event_id", "value"), "winsorize", ["value"])


@query(
    "clean_onehot",
    """SELECT c_custkey, """
    + ", ".join(
        f"c_mktsegment = '{s}' AS \"c_mktsegment_{s}\""
        for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    )
    + " FROM customer",
)
def _(spark, sf):
    return encoding.one_hot(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"))


@query(
    "clean_label",
    """WITH d AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce(l_returnflag, 'nan') AS v FROM fx_nulls))
    SELECT l_orderkey, l_linenumber, code AS l_returnflag FROM fx_nulls JOIN d ON d.v = coalesce(l_returnflag, 'nan')""",
)
def _(spark, sf):
    return encoding.label_encode(view(spark, sf, "fx_nulls").select("l_orderkey", "l_linenumber", "l_returnflag"))


@query(
    "clean_label_parts",
    """WITH b AS (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code, p_partkey FROM part),
    n AS (SELECT p_name, dense_rank() OVER (ORDER BY p_name) - 1 AS code, p_partkey FROM part)
    SELECT p_partkey, b.code AS p_brand, n.code AS p_name FROM b JOIN n USING (p_partkey)""",
)
def _(spark, sf):
    return encoding.label_encode(table(spark, sf, "part").select("p_partkey", "p_brand", "p_name"))


@query(
    "clean_frequency",
    """WITH f AS (SELECT l_returnflag AS v, count(*)::DOUBLE / (SELECT count(l_returnflag) FROM fx_nulls) AS s FROM fx_nulls
    WHERE l_returnflag IS NOT NULL GROUP BY 1)
    SELECT l_orderkey, l_linenumber, round(s, 6) AS l_returnflag FROM fx_nulls LEFT JOIN f ON v = l_returnflag""",
)
def _(spark, sf):
    return encoding.frequency_encode(view(spark, sf, "fx_nulls").select("l_orderkey", "l_linenumber", "l_returnflag"))


@query(
    "clean_minmax",
    """SELECT event_id, round((value - a) / (b - a + 1e-9), 6) AS value FROM events, (SELECT min(value) AS a, max(value) AS b FROM events)""",
)
def _(spark, sf):
    return cleaning.scale(table(spark, sf, "events").select("event_id", "value"), "minmax", ["value"])


@query(
    "clean_zscore",
    """SELECT event_id, round((value - m) / (s + 1e-9), 6) + 0.0 AS value FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)""",
)
def _(spark, sf):
    return cleaning.scale(table(spark, sf, "events").select("event_id", "value"), "zscore", ["value"])


@query(
    "clean_robust",
    """SELECT event_id, round((value - m) / (b - a + 1e-9), 6) + 0.0 AS value FROM events,
    (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b FROM events)""",
)
def _(spark, sf):
    return cleaning.scale(table(spark, sf, "events").select("event_id", "value"), "robust", ["value"])


@query("clean_drop_duplicates", "SELECT DISTINCT c_custkey, c_mktsegment, c_acctbal FROM fx_dups")
def _(spark, sf):
    return cleaning.drop_duplicates(view(spark, sf, "fx_dups"))


@query(
    "clean_keep_first",
    """SELECT event_id, event_type, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS k FROM events)
    WHERE k = 1""",
)
def _(spark, sf):
    first = cleaning.drop_duplicates(table(spark, sf, "events"), ["ts", "event_id"], ["event_type", "user_id"])
    return first.select("event_id", "event_type", "user_id")


@query(
    "clean_drop_constants",
    "SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity, l_extendedprice, l_returnflag FROM fx_nulls",
)
def _(spark, sf):
    return cleaning.drop_constants(view(spark, sf, "fx_nulls"))


@query(
    "clean_date_features",
    """SELECT o_orderkey, year(o_orderdate)::INT AS o_orderdate_year, month(o_orderdate)::INT AS o_orderdate_month,
    day(o_orderdate)::INT AS o_orderdate_day, (isodow(o_orderdate) - 1)::INT AS o_orderdate_dayofweek,
    quarter(o_orderdate)::INT AS o_orderdate_quarter, (isodow(o_orderdate) >= 6)::INT AS o_orderdate_is_weekend FROM orders""",
)
def _(spark, sf):
    return cleaning.date_features(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"))


PLAN = {
    "remove_duplicates": True,
    "drop_constants": True,
    "missing_strategy": {"l_quantity": "mean", "l_extendedprice": "median", "l_returnflag": "mode"},
    "outlier_strategy": "iqr_clip",
    "encode_method": "label",
    "scale_method": "minmax",
}


@query(
    "clean_plan",
    """WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM fx_nulls),
    s AS (SELECT avg(l_quantity) AS m, quantile_cont(l_extendedprice, 0.5) AS me FROM d),
    mo AS (SELECT l_returnflag AS mo FROM d WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    f AS (SELECT l_orderkey::DOUBLE AS ok, l_linenumber::DOUBLE AS ln, coalesce(l_quantity, m) AS q, coalesce(l_extendedprice, me) AS p,
          coalesce(l_returnflag, mo) AS r FROM d, s, mo),
    b AS (SELECT quantile_cont(ok, .25) AS o1, quantile_cont(ok, .75) AS o3, quantile_cont(ln, .25) AS n1, quantile_cont(ln, .75) AS n3,
          quantile_cont(q, .25) AS q1, quantile_cont(q, .75) AS q3, quantile_cont(p, .25) AS p1, quantile_cont(p, .75) AS p3 FROM f),
    c AS (SELECT greatest(least(ok, o3 + 1.5 * (o3 - o1)), o1 - 1.5 * (o3 - o1)) AS ok, greatest(least(ln, n3 + 1.5 * (n3 - n1)), n1 - 1.5 * (n3 - n1)) AS ln,
          greatest(least(q, q3 + 1.5 * (q3 - q1)), q1 - 1.5 * (q3 - q1)) AS q, greatest(least(p, p3 + 1.5 * (p3 - p1)), p1 - 1.5 * (p3 - p1)) AS p,
          (dense_rank() OVER (ORDER BY r) - 1)::DOUBLE AS r FROM f, b),
    z AS (SELECT min(ok) AS o0, max(ok) AS o9, min(ln) AS n0, max(ln) AS n9, min(q) AS q0, max(q) AS q9, min(p) AS p0, max(p) AS p9, min(r) AS r0, max(r) AS r9 FROM c)
    SELECT round((ok - o0) / (o9 - o0 + 1e-9), 6) AS l_orderkey, round((ln - n0) / (n9 - n0 + 1e-9), 6) AS l_linenumber,
    round((q - q0) / (q9 - q0 + 1e-9), 6) AS l_quantity, round((p - p0) / (p9 - p0 + 1e-9), 6) AS l_extendedprice,
    round((r - r0) / (r9 - r0 + 1e-9), 6) AS l_returnflag FROM c, z""",
)
def _(spark, sf):
    return cleaning.apply_plan(view(spark, sf, "fx_nulls").drop("l_shipdate"), PLAN, audit=False).data


@query(
    "clean_plan_log",
    """WITH n AS (SELECT count(*) AS rows FROM (SELECT DISTINCT * EXCLUDE (l_shipdate) FROM fx_nulls))
    SELECT 0::INT AS step, 'input' AS action, '' AS detail, (SELECT count(*) FROM fx_nulls) AS "rows", 6::INT AS "columns"
    UNION ALL SELECT 1, 'remove_duplicates', '', rows, 6 FROM n
    UNION ALL SELECT 2, 'drop_constants', '["constant_col"]', rows, 5 FROM n
    UNION ALL SELECT 3, 'missing_strategy', '{"l_extendedprice": "median", "l_quantity": "mean", "l_returnflag": "mode"}', rows, 5 FROM n
    UNION ALL SELECT 4, 'outlier_strategy', '"iqr_clip"', rows, 5 FROM n
    UNION ALL SELECT 5, 'encode_method', '"label"', rows, 5 FROM n
    UNION ALL SELECT 6, 'scale_method', '"minmax"', rows, 5 FROM n""",
)
def _(spark, sf):
    return cleaning.apply_plan(view(spark, sf, "fx_nulls").drop("l_shipdate"), PLAN).log


@query("clean_auto_log")
def _(spark, sf):
    return cleaning.auto_clean(view(spark, sf, "fx_nulls")).log


@query(
    "audit_summary",
    """WITH d AS (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM fx_dups)) AS k FROM fx_dups)
    SELECT 2 AS total_operations, n - k AS total_rows_affected, 'Remove duplicates, Scale' AS operations FROM d""",
)
def _(spark, sf):
    df = view(spark, sf, "fx_dups")
    trail = AuditTrail(spark, scratch_path(spark, "audit"))
    trail.save_snapshot(df)
    unique = cleaning.drop_duplicates(df)
    trail.record("Remove duplicates", df.columns, df.count(), unique.count(), len(df.columns), len(unique.columns))
    trail.record("Scale", ["c_acctbal"])
    trail.undo()
    return summarise_log(trail.export_log()).select("total_operations", "total_rows_affected", "operations")


@query("audit_undo", "SELECT c_custkey, c_mktsegment, c_acctbal, true AS live_before, false AS live_after FROM fx_dups")
def _(spark, sf):
    """The rows that a second session gets back after the first one's change."""
    df = view(spark, sf, "fx_dups")
    folder = scratch_path(spark, "audit")
    trail = AuditTrail(spark, folder)
    trail.save_snapshot(df)
    trail.record("Remove duplicates", df.columns, df.count(), cleaning.drop_duplicates(df).count())
    other = AuditTrail(spark, folder)
    before = other.can_undo()
    back = other.undo()
    return back.select("*", F.lit(before).alias("live_before"), F.lit(trail.can_undo()).alias("live_after"))


# ---------------------------------------------------------------- anomalies

NUMBERS = ("value", "user_id")


@query(
    "anomaly_z",
    """WITH s AS (SELECT avg(value) AS m1, stddev_pop(value) AS s1, avg(user_id) AS m2, stddev_pop(user_id) AS s2 FROM events),
    z AS (SELECT event_id, greatest(abs((value - m1) / s1), abs((user_id - m2) / s2)) AS score FROM events, s),
    c AS (SELECT quantile_cont(score, 0.95) AS cut FROM z)
    SELECT event_id, round(score, 6) AS score, score > cut AS is_anomaly FROM z, c""",
)
def _(spark, sf):
    return anomaly.detect_anomalies(table(spark, sf, "events"), "event_id", "zscore", 0.05, NUMBERS)


Z_SQL = """s AS (SELECT avg(value) AS m1, stddev_pop(value) AS s1, avg(user_id) AS m2, stddev_pop(user_id) AS s2 FROM events),
    z AS (SELECT event_id, event_type, value, (value - m1) / s1 AS z1, (user_id - m2) / s2 AS z2,
          greatest(abs((value - m1) / s1), abs((user_id - m2) / s2)) AS score FROM events, s),
    c AS (SELECT quantile_cont(score, 0.95) AS cut FROM z)"""


@query(
    "anomaly_contributions",
    f"""WITH {Z_SQL}
    SELECT 'value' AS "column", round(abs(avg(z1) FILTER (score > cut) - avg(z1) FILTER (score <= cut)), 3) AS contribution FROM z, c
    UNION ALL SELECT 'user_id', round(abs(avg(z2) FILTER (score > cut) - avg(z2) FILTER (score <= cut)), 3) FROM z, c""",
)
def _(spark, sf):
    events = table(spark, sf, "events")
    found = anomaly.detect_anomalies(events, "event_id", "zscore", 0.05, NUMBERS)
    return anomaly.contributions(events, found, "event_id", NUMBERS)


@query(
    "anomaly_flagged",
    f"""WITH {Z_SQL} SELECT event_id, event_type, value, CASE WHEN score > cut THEN 'Anomaly' ELSE 'Normal' END AS _anomaly_flag,
    round(score, 6) AS _anomaly_score FROM z, c""",
)
def _(spark, sf):
    events = table(spark, sf, "events")
    found = anomaly.detect_anomalies(events, "event_id", "zscore", 0.05, NUMBERS)
    return anomaly.flag_anomalies(events.select("event_id", "event_type", "value"), found, "event_id")


@query("anomaly_removed", f"WITH {Z_SQL} SELECT event_id, event_type, value FROM z, c WHERE score <= cut")
def _(spark, sf):
    events = table(spark, sf, "events")
    found = anomaly.detect_anomalies(events, "event_id", "zscore", 0.05, NUMBERS)
    return anomaly.remove_anomalies(events.select("event_id", "event_type", "value"), found, "event_id")


@query("anomaly_forest")
def _(spark, sf):
    return anomaly.detect_anomalies(table(spark, sf, "events"), "event_id", "isolation_forest", 0.05, NUMBERS)


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])


LOF_SQL = """WITH x AS (SELECT vec_id, """ + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(64)) + """ FROM embeddings),
    st AS (SELECT """ + ", ".join(f"avg(e{i}) AS m{i}, stddev_pop(e{i}) AS s{i}" for i in range(64)) + """ FROM x),
    z AS (SELECT vec_id, """ + ", ".join(f"(e{i} - m{i}) / s{i} AS z{i}" for i in range(64)) + """ FROM x, st),
    p AS (SELECT a.vec_id AS id, b.vec_id AS nb, sqrt(""" + " + ".join(f"(a.z{i} - b.z{i}) ** 2" for i in range(64)) + """) AS d
          FROM z a, z b WHERE a.vec_id <> b.vec_id),
    n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nb) AS k FROM p) WHERE k <= 20),
    kd AS (SELECT id, max(d) AS kd FROM n GROUP BY id),
    l AS (SELECT n.id, 1.0 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM n JOIN kd ON kd.id = n.nb GROUP BY n.id),
    o AS (SELECT n.id AS vec_id, avg(b.lrd) / any_value(a.lrd) AS score FROM n JOIN l b ON b.id = n.nb JOIN l a ON a.id = n.id GROUP BY n.id)
    SELECT vec_id, round(score, 6) AS score, score > (SELECT quantile_cont(score, 0.95) FROM o) AS is_anomaly FROM o"""


@query("anomaly_lof", LOF_SQL)
def _(spark, sf):
    return anomaly.detect_anomalies(_vectors(spark, sf), "vec_id", "lof", 0.05)


@query("anomaly_ensemble")
def _(spark, sf):
    return anomaly.detect_anomalies(_vectors(spark, sf), "vec_id", "ensemble", 0.05)


@query(
    "anomaly_summary",
    f"""WITH {Z_SQL} SELECT count(*) AS n_total, count(*) FILTER (score > cut) AS n_anomalies,
    round(100.0 * count(*) FILTER (score > cut)::DOUBLE / count(*), 2) AS anomaly_percentage FROM z, c""",
)
def _(spark, sf):
    return anomaly.anomaly_summary(anomaly.detect_anomalies(table(spark, sf, "events"), "event_id", "zscore", 0.05, NUMBERS))
