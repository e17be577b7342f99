"""Chart tables over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import chart_data as c
from sightline.operators import profile, timeseries
from sightline.queries.registry import query, table, view


@query(
    "chart_hist",
    """WITH s AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem),
    k AS (SELECT least(floor((l_extendedprice - a) / ((b - a) / 30)), 29)::INT AS bin, count(*) AS n FROM lineitem, s GROUP BY 1),
    e AS (SELECT unnest(generate_series(0, 29))::INT AS bin)
    SELECT e.bin, round(a + (b - a) / 30 * e.bin, 4) AS low, round(a + (b - a) / 30 * (e.bin + 1), 4) AS high,
    coalesce(n, 0) AS "count" FROM e CROSS JOIN s LEFT JOIN k ON k.bin = e.bin""",
    places=4,
)
def _(spark, sf):
    return c.histogram(table(spark, sf, "lineitem"), "l_extendedprice")


@query(
    "chart_box",
    """WITH q AS (SELECT event_type AS g, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
    SELECT g AS "group", count(*) AS n, min(value) AS "min", round(any_value(q1), 6) AS q1, round(any_value(m), 6) AS median, round(any_value(q3), 6) AS q3,
    max(value) AS "max", round(avg(value), 6) AS mean, min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS lower_whisker,
    max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS upper_whisker,
    count(*) FILTER (NOT value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers FROM events JOIN q ON g = event_type GROUP BY g""",
)
def _(spark, sf):
    return c.box(table(spark, sf, "events"), "value", "event_type")


@query(
    "chart_top",
    """SELECT p_name AS "value", count(*) AS "count", round(100.0 * count(*) / (SELECT count(*) FROM part), 6)::DOUBLE AS percentage FROM part
    GROUP BY p_name ORDER BY 2 DESC, 1 LIMIT 20""",
)
def _(spark, sf):
    return c.top_values(table(spark, sf, "part"), "p_name")


@query(
    "chart_pie",
    """SELECT o_orderpriority AS "value", count(*) AS "count", round(100.0 * count(*) / (SELECT count(*) FROM orders), 6)::DOUBLE AS percentage FROM orders
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def _(spark, sf):
    return c.top_values(table(spark, sf, "orders"), "o_orderpriority", 10)


@query("chart_points")
def _(spark, sf):
    return c.points(table(spark, sf, "events"), ["value", "event_type"], ["event_id"], 1000)


@query(
    "chart_trend_lines",
    """SELECT l_returnflag AS colour, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
    round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 4) + 0.0 AS r2 FROM lineitem GROUP BY 1""",
    places=4,
)
def _(spark, sf):
    return c.trend_lines(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")


@query(
    "chart_grouped_bar",
    "SELECT l_returnflag AS x, l_linestatus AS colour, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1, 2",
    places=2,
)
def _(spark, sf):
    return c.grouped_bar(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity", "l_linestatus")


@query(
    "chart_rollup",
    """SELECT (2 - (CASE WHEN grouping(r_name) = 1 THEN 1 ELSE 0 END) - (CASE WHEN grouping(n_name) = 1 THEN 1 ELSE 0 END))::INT AS depth,
    r_name, n_name, round(sum(c_acctbal), 2) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""",
    places=2,
)
def _(spark, sf):
    # nation and region have a row per country and continent
    named = (
        table(spark, sf, "customer")
        .join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return c.hierarchy(named, ["r_name", "n_name"], "c_acctbal")


@query("chart_time_line", "SELECT 'all' AS colour, d::TIMESTAMP AS ts, round(v, 2) AS value FROM fx_daily", places=2)
def _(spark, sf):
    return c.time_line(view(spark, sf, "fx_daily"), "d", "v")


@query(
    "chart_candles",
    """SELECT date_trunc('day', ts)::TIMESTAMP AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS "close",
    count(*) AS n FROM events GROUP BY 1""",
)
def _(spark, sf):
    return c.candles(table(spark, sf, "events"), "ts", "value", "1 day", ["event_id"])


@query(
    "chart_band",
    """WITH r AS (SELECT d::TIMESTAMP AS ts, v, count(v) OVER w AS n, avg(v) OVER w AS m, stddev_samp(v) OVER w AS s FROM fx_daily
    WINDOW w AS (ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
    SELECT ts, round(v, 2) AS value, CASE WHEN n = 7 THEN round(m, 2) END AS rolling_mean, CASE WHEN n = 7 THEN round(m - s, 2) END AS lower_band,
    CASE WHEN n = 7 THEN round(m + s, 2) END AS upper_band FROM r""",
    places=2,
)
def _(spark, sf):
    return timeseries.rolling_band(view(spark, sf, "fx_daily"), "d", "v", 7)


@query(
    "chart_frames",
    """SELECT year(o_orderdate)::INT AS frame, o_orderpriority AS x, o_orderstatus AS colour, round(sum(o_totalprice), 2) AS total, count(*) AS n
    FROM orders GROUP BY 1, 2, 3""",
    places=2,
)
def _(spark, sf):
    orders = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return c.frames(orders, "year", "o_orderpriority", "o_totalprice", "o_orderstatus")


@query("chart_null_pattern")
def _(spark, sf):
    return c.null_pattern(view(spark, sf, "fx_nulls"), ["l_orderkey", "l_linenumber"])


@query(
    "chart_null_bar",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS "column", round_even(100.0::DOUBLE * (count(*) - count({n})) / count(*), 2) AS missing_pct FROM fx_nulls"""
        for n in ("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_extendedprice", "l_returnflag", "constant_col")
    ),
)
def _(spark, sf):
    return profile.missing_analysis(view(spark, sf, "fx_nulls")).select("column", "missing_pct")


@query("chart_quantile_line")
def _(spark, sf):
    return c.quantile_plot(table(spark, sf, "events"), "value")[1]


@query("chart_quantile_points")
def _(spark, sf):
    return c.quantile_plot(table(spark, sf, "customer"), "c_acctbal")[0]
