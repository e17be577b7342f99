"""Time series made from the events and orders tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import timeseries as ts
from sightline.operators import ts_tests
from sightline.queries.registry import query, table, view

ORDERED = "ORDER BY ts, event_id"


def _keep_ts(df):
    return df.withColumn("ts", F.col("ts").cast("string"))


@query("ts_datetime_columns", """SELECT * FROM (VALUES ('ts', 'datetime')) AS t("column", kind)""")
def _(spark, sf):
    return ts.datetime_candidates(table(spark, sf, "events"))


@query("ts_datetime_text", """SELECT * FROM (VALUES ('date_text', 'parseable')) AS t("column", kind)""")
def _(spark, sf):
    return ts.datetime_candidates(view(spark, sf, "fx_types"))


@query(
    "ts_info_daily",
    """WITH s AS (SELECT date_diff('second', lag(d) OVER (ORDER BY d), d)::DOUBLE AS step, d FROM fx_daily),
    m AS (SELECT quantile_cont(step, 0.5) AS med FROM s)
    SELECT count(*) FILTER (step > 0) / count(step) > 0.8 AS is_time_series, NULL AS reason, 'D' AS frequency,
    count(*) FILTER (step = med) / count(step) > 0.9 AS is_regular, count(*) FILTER (step > 2 * med) AS gaps,
    any_value(med) AS median_seconds, date_diff('second', min(d), max(d))::DOUBLE AS span_seconds, count(*) AS n FROM s, m""",
)
def _(spark, sf):
    return ts.series_info(view(spark, sf, "fx_daily"), "d")


@query(
    "ts_info_gaps",
    """WITH s AS (SELECT date_diff('second', lag(d) OVER (ORDER BY d), d)::DOUBLE AS step, d FROM fx_gaps),
    m AS (SELECT quantile_cont(step, 0.5) AS med FROM s)
    SELECT count(*) FILTER (step > 0) / count(step) > 0.8 AS is_time_series, NULL AS reason, NULL AS frequency,
    count(*) FILTER (step = med) / count(step) > 0.9 AS is_regular, count(*) FILTER (step > 2 * med) AS gaps,
    any_value(med) AS median_seconds, date_diff('second', min(d), max(d))::DOUBLE AS span_seconds, count(*) AS n FROM s, m""",
)
def _(spark, sf):
    return ts.series_info(view(spark, sf, "fx_gaps"), "d")


@query(
    "ts_info_events",
    """WITH s AS (SELECT date_diff('microsecond', lag(ts) OVER (ORDER BY ts), ts) / 1e6 AS step, ts FROM events),
    m AS (SELECT quantile_cont(step, 0.5) AS med FROM s)
    SELECT count(*) FILTER (step > 0) / count(step) > 0.8 AS is_time_series, NULL AS reason, NULL AS frequency,
    count(*) FILTER (step = med) / count(step) > 0.9 AS is_regular, count(*) FILTER (step > 2 * med) AS gaps,
    round(any_value(med), 6) AS median_seconds, round(date_diff('microsecond', min(ts), max(ts)) / 1e6, 6) AS span_seconds, count(*) AS n FROM s, m""",
)
def _(spark, sf):
    return ts.series_info(table(spark, sf, "events"), "ts")


def _rolling_sql(tab, time, value, order, windows, partition="") -> str:
    cols = []
    for w in windows:
        frame = f"OVER ({partition} ORDER BY {order} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        cols.append(
            f"""CASE WHEN count({value}) {frame} = {w} THEN round(avg({value}) {frame}, 4) END AS rolling_mean_{w},
            CASE WHEN count({value}) {frame} = {w} THEN round(stddev_samp({value}) {frame}, 4) END AS rolling_std_{w}"""
        )
    return ", ".join(cols)


@query(
    "ts_rolling",
    f"SELECT event_id, ts, value, {_rolling_sql('events', 'ts', 'value', 'ts, event_id', (7, 14, 30))} FROM events",
    places=4,
)
def _(spark, sf):
    return ts.rolling(table(spark, sf, "events"), "ts", "value", tie_breakers=["event_id"])


@query(
    "ts_rolling_keyed",
    f"""SELECT event_type, event_id, ts, value,
    {_rolling_sql('events', 'ts', 'value', 'ts, event_id', (7,), 'PARTITION BY event_type')} FROM events""",
    places=4,
)
def _(spark, sf):
    return ts.rolling(table(spark, sf, "events"), "ts", "value", [7], ["event_type"], ["event_id"])


@query(
    "ts_trend",
    """WITH p AS (SELECT v, row_number() OVER (ORDER BY d) - 1 AS x FROM fx_order_days),
    f AS (SELECT regr_slope(v, x) AS b, regr_intercept(v, x) AS a, stddev_pop(v) AS s, count(*) AS n FROM p)
    SELECT CASE WHEN b > 0.01 * s THEN 'upward' WHEN b < -0.01 * s THEN 'downward' ELSE 'flat' END AS trend,
    round(b, 4) AS slope, round(a, 2) AS intercept, n FROM f""",
)
def _(spark, sf):
    out = ts.trend(view(spark, sf, "fx_order_days"), "d", "v")
    return out.select("trend", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), "n")


@query(
    "ts_trend_keyed",
    """WITH p AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS x FROM events),
    f AS (SELECT event_type, regr_slope(value, x) AS b, regr_intercept(value, x) AS a, stddev_pop(value) AS s, count(*) AS n FROM p GROUP BY event_type)
    SELECT event_type, CASE WHEN b > 0.01 * s THEN 'upward' WHEN b < -0.01 * s THEN 'downward' ELSE 'flat' END AS trend,
    round(b, 6) AS slope, round(a, 6) AS intercept, n FROM f""",
)
def _(spark, sf):
    return ts.trend(table(spark, sf, "events"), "ts", "value", ["event_type"], ["event_id"])


BINS = {
    "H": ("date_trunc('hour', ts)", "INTERVAL 1 HOUR"),
    "D": ("date_trunc('day', ts)", "INTERVAL 1 DAY"),
    "W": ("date_trunc('day', ts) + to_days(((7 - dayofweek(ts)) % 7)::INT)", "INTERVAL 7 DAY"),
    "M": ("last_day(ts)::TIMESTAMP", None),
    "Q": ("last_day(date_trunc('quarter', ts) + INTERVAL 2 MONTH)::TIMESTAMP", None),
    "Y": ("last_day(date_trunc('year', ts) + INTERVAL 11 MONTH)::TIMESTAMP", None),
}


def _resample_sql(tab, time, value, freq, agg) -> str:
    label, step = BINS[freq]
    expr = {
        "mean": f"round(avg({value}), 8)",
        "sum": f"round(sum({value}), 2)",
        "count": f"count({value})",
        "first": f"round(min_by({value}, (ts, k)), 4)",
        "last": f"round(max_by({value}, (ts, k)), 4)",
        "min": f"min({value})",
        "max": f"max({value})",
    }[agg]
    base = f"SELECT {label} AS bin, {expr} AS v FROM (SELECT {time}::TIMESTAMP AS ts, {value}, {'event_id' if tab == 'events' else '0'} AS k FROM {tab}) GROUP BY 1"
    default = {"sum": "coalesce(v, 0)", "count": "coalesce(v, 0)"}.get(agg, "v")
    if step is None:
        return f"SELECT bin AS ts, {default} AS value FROM ({base})"
    return f"""WITH b AS ({base}), s AS (SELECT unnest(generate_series((SELECT min(bin) FROM b), (SELECT max(bin) FROM b), {step})) AS bin)
    SELECT s.bin AS ts, {default} AS value FROM s LEFT JOIN b ON s.bin = b.bin"""


@query("ts_resample_day", _resample_sql("events", "ts", "value", "D", "mean"), places=8)
def _(spark, sf):
    return ts.resample(table(spark, sf, "events"), "ts", "value", "D", "mean")


@query("ts_resample_hour", _resample_sql("events", "ts", "value", "H", "count"))
def _(spark, sf):
    return ts.resample(table(spark, sf, "events"), "ts", "value", "H", "count")


@query("ts_resample_gaps", _resample_sql("fx_gaps", "d", "v", "D", "sum"), places=2)
def _(spark, sf):
    return ts.resample(view(spark, sf, "fx_gaps"), "d", "v", "D", "sum")


@query("ts_resample_week", _resample_sql("orders", "o_orderdate", "o_totalprice", "W", "sum"), places=2)
def _(spark, sf):
    return ts.resample(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "W", "sum")


@query("ts_resample_month", _resample_sql("orders", "o_orderdate", "o_totalprice", "M", "max"))
def _(spark, sf):
    return ts.resample(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "M", "max")


@query("ts_resample_quarter", _resample_sql("orders", "o_orderdate", "o_totalprice", "Q", "sum"), places=2)
def _(spark, sf):
    return ts.resample(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "Q", "sum")


@query("ts_resample_year", _resample_sql("orders", "o_orderdate", "o_totalprice", "Y", "min"))
def _(spark, sf):
    return ts.resample(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "Y", "min")


@query("ts_resample_first", _resample_sql("events", "ts", "value", "D", "first"), places=4)
def _(spark, sf):
    return ts.resample(table(spark, sf, "events"), "ts", "value", "D", "first", tie_breakers=["event_id"])


@query("ts_resample_last", _resample_sql("events", "ts", "value", "D", "last"), places=4)
def _(spark, sf):
    return ts.resample(table(spark, sf, "events"), "ts", "value", "D", "last", tie_breakers=["event_id"])


def _period_sql(expr) -> str:
    return f"""SELECT {expr} AS period, round_even(avg(value), 2) AS mean, round_even(stddev_samp(value), 2) AS std,
    round_even(min(value), 2) AS "min", round_even(max(value), 2) AS "max", count(value) AS "count" FROM events GROUP BY 1"""


@query("ts_period_weekday", _period_sql("dayname(ts)"))
def _(spark, sf):
    return ts.period_stats(table(spark, sf, "events"), "ts", "value", "dayofweek")


@query("ts_period_hour", _period_sql("CAST(hour(ts) AS VARCHAR)"))
def _(spark, sf):
    return ts.period_stats(table(spark, sf, "events"), "ts", "value", "hour")


@query("ts_period_month", _period_sql("monthname(ts)"))
def _(spark, sf):
    return ts.period_stats(table(spark, sf, "events"), "ts", "value", "month")


@query(
    "ts_seasonality",
    " UNION ALL ".join(
        f"""SELECT '{name}_pattern' AS pattern, round(stddev_samp(m), 6) AS spread, round(avg(m), 6) AS mean,
        coalesce(stddev_samp(m) > 0.1 * avg(m), false) AS detected
        FROM (SELECT avg(value) AS m FROM events GROUP BY {unit}) WHERE (SELECT count(*) FROM events) > {least}"""
        for name, unit, least in (("daily", "hour(ts)", 24), ("weekly", "dayofweek(ts)", 7), ("monthly", "month(ts)", 30))
    ),
)
def _(spark, sf):
    return ts.seasonality(table(spark, sf, "events"), "ts", "value")


@query("ts_summary")
def _(spark, sf):
    return ts.series_summary(view(spark, sf, "fx_daily"), "d", "v")


def _acf_sql(tab, time, value, lags) -> str:
    return f"""WITH s AS (SELECT {value} - (SELECT avg({value}) FROM {tab}) AS d, row_number() OVER (ORDER BY {time}) AS p FROM {tab}),
    k AS (SELECT unnest(generate_series(0, {lags})) AS lag)
    SELECT k.lag::INT AS lag, round(sum(a.d * b.d) / (SELECT sum(d * d) FROM s), 6) AS acf,
    round(1.96 / sqrt((SELECT count(*) FROM s)), 6) AS bound,
    k.lag > 0 AND abs(sum(a.d * b.d) / (SELECT sum(d * d) FROM s)) > 1.96 / sqrt((SELECT count(*) FROM s)) AS acf_significant
    FROM k JOIN s a ON true JOIN s b ON b.p = a.p - k.lag GROUP BY k.lag"""


@query("ts_acf", _acf_sql("fx_order_days", "d", "v", 40))
def _(spark, sf):
    out = ts_tests.autocorrelation(view(spark, sf, "fx_order_days"), "d", "v")
    return out.select("lag", "acf", "bound", "acf_significant")


@query("ts_acf_events", _acf_sql("events", "ts, event_id", "value", 40))
def _(spark, sf):
    out = ts_tests.autocorrelation(table(spark, sf, "events"), "ts", "value", tie_breakers=["event_id"])
    return out.select("lag", "acf", "bound", "acf_significant")


@query("ts_pacf")
def _(spark, sf):
    return ts_tests.autocorrelation(view(spark, sf, "fx_order_days"), "d", "v")


@query("ts_stationarity")
def _(spark, sf):
    return ts_tests.stationarity(view(spark, sf, "fx_order_days"), "d", "v")


def _decompose_sql(tab, m, additive=True) -> str:
    h = m // 2
    trend = f"""CASE WHEN count(v) OVER (ORDER BY p ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) = {m} THEN
        avg(v) OVER (ORDER BY p ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) END"""
    minus = "-" if additive else "/"
    return f"""WITH s AS (SELECT d, v, row_number() OVER (ORDER BY d) - 1 AS p FROM {tab}),
    t AS (SELECT *, {trend} AS trend FROM s), x AS (SELECT *, v {minus} trend AS l, p % {m} AS ph FROM t),
    f AS (SELECT ph, avg(l) AS m FROM x GROUP BY ph), g AS (SELECT avg(m) AS level FROM f)
    SELECT x.d::TIMESTAMP AS ts, round(v, 2) AS observed, round(trend, 2) AS trend, round(m {minus} level, 2) AS seasonal,
    round(l {minus} (m {minus} level), 2) AS residual, {m} AS period FROM x JOIN f ON x.ph = f.ph, g"""


@query("ts_decompose", _decompose_sql("fx_daily", 7), places=2)
def _(spark, sf):
    return ts_tests.decompose(view(spark, sf, "fx_daily"), "d", "v", 7)


@query("ts_decompose_multiplicative", _decompose_sql("fx_daily", 7, False), places=2)
def _(spark, sf):
    return ts_tests.decompose(view(spark, sf, "fx_daily"), "d", "v", 7, "multiplicative")


@query(
    "ts_trend_strength",
    _decompose_sql("fx_daily", 7).split("SELECT x.d::TIMESTAMP")[0]
    + """SELECT round(1 - var_samp(l - (m - level)) / var_samp(trend + l - (m - level)), 3) AS trend_strength
    FROM x JOIN f ON x.ph = f.ph, g WHERE trend IS NOT NULL""",
)
def _(spark, sf):
    return ts_tests.trend_strength(ts_tests.decompose(view(spark, sf, "fx_daily"), "d", "v", 7))


@query(
    "ts_period_detect",
    """WITH s AS (SELECT v - (SELECT avg(v) FROM fx_order_days) AS d, row_number() OVER (ORDER BY d) - 1 AS t,
    (SELECT count(*) FROM fx_order_days) AS n FROM fx_order_days),
    f AS (SELECT unnest(generate_series(2, (SELECT count(*) // 2 FROM fx_order_days))) AS f),
    m AS (SELECT f, any_value(n) AS n, sum(d * cos(2 * pi() * ((f * t) % n) / n)) ** 2 + sum(d * sin(2 * pi() * ((f * t) % n) / n)) ** 2 AS power FROM s, f GROUP BY f)
    SELECT n, least(greatest(2, n // arg_max(f, power)), n // 3)::INT AS period FROM m GROUP BY n""",
)
def _(spark, sf):
    return ts_tests.detect_period(view(spark, sf, "fx_order_days"), "d", "v")
