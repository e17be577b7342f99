"""Hypothesis tests and regressions over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.operators import hypothesis as h
from sightline.queries.registry import query, table, view


def _two_types(spark, sf):
    return table(spark, sf, "events").where(F.col("event_type").isin("click", "view")).select("event_type", "value")


@query(
    "tst_anova",
    """WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY event_type),
    a AS (SELECT avg(value) AS grand FROM events)
    SELECT 'One-Way ANOVA' AS test, count(*) AS groups, sum(n)::BIGINT AS n, (count(*) - 1)::DOUBLE AS dof,
    round((sum(n * (m - grand) ** 2) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))), 6) AS statistic FROM g, a""",
)
def _(spark, sf):
    return h.anova(table(spark, sf, "events"), "value", "event_type").select("test", "groups", "n", "dof", "statistic")


RANKED = "rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0"


@query(
    "tst_kruskal",
    f"""WITH r AS (SELECT event_type, {RANKED.format(v='value')} AS rk FROM events),
    t AS (SELECT sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT count(*)::DOUBLE AS c FROM events GROUP BY value)),
    g AS (SELECT event_type, count(*)::DOUBLE AS n, sum(rk)::DOUBLE AS s FROM r GROUP BY event_type)
    SELECT 'Kruskal-Wallis H Test' AS test, count(*) AS groups, sum(n)::BIGINT AS n, (count(*) - 1)::DOUBLE AS dof,
    round((12 / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1)) /
          (1 - any_value(ties) / (sum(n) ** 3 - sum(n))), 6) AS statistic FROM g, t""",
)
def _(spark, sf):
    return h.kruskal_wallis(table(spark, sf, "events"), "value", "event_type").select("test", "groups", "n", "dof", "statistic")


@query(
    "tst_chi2",
    """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS o FROM lineitem GROUP BY 1, 2),
    r AS (SELECT a, sum(o) AS ra FROM c GROUP BY a), k AS (SELECT b, sum(o) AS cb FROM c GROUP BY b),
    t AS (SELECT sum(o) AS n FROM c),
    e AS (SELECT coalesce(o, 0) AS o, ra * cb / n AS e, n FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c ON c.a = r.a AND c.b = k.b)
    SELECT 'Chi-Square Test of Independence' AS test, round(sum((o - e) ** 2 / e), 6) AS statistic,
    round(sqrt(sum((o - e) ** 2 / e) / (any_value(n) * (least((SELECT count(*) FROM r), (SELECT count(*) FROM k)) - 1))), 6) AS effect_size,
    (((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM k) - 1))::DOUBLE AS dof, any_value(n)::BIGINT AS n FROM e""",
)
def _(spark, sf):
    return h.chi_square(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus").select(
        "test", "statistic", "effect_size", "dof", "n"
    )


@query(
    "tst_chi2_yates",
    """WITH c AS (SELECT quality AS a, toxic AS b, count(*)::DOUBLE AS o FROM labels GROUP BY 1, 2),
    r AS (SELECT a, sum(o) AS ra FROM c GROUP BY a), k AS (SELECT b, sum(o) AS cb FROM c GROUP BY b),
    t AS (SELECT sum(o) AS n FROM c),
    e AS (SELECT coalesce(o, 0) AS o, ra * cb / n AS e, n FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c ON c.a = r.a AND c.b = k.b)
    SELECT round(sum((abs(o - e) - least(0.5, abs(o - e))) ** 2 / e), 6) AS statistic, 1.0::DOUBLE AS dof,
    any_value(n)::BIGINT AS n FROM e""",
)
def _(spark, sf):
    return h.chi_square(table(spark, sf, "labels"), "quality", "toxic").select("statistic", "dof", "n")


@query(
    "tst_t",
    """WITH g AS (SELECT toxic, count(*) AS n, avg(n_chars) AS m, var_samp(n_chars) AS v FROM fx_text_labels GROUP BY toxic),
    p AS (SELECT a.m AS m1, b.m AS m2, a.n AS n1, b.n AS n2,
          ((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) AS s2 FROM g a, g b WHERE a.toxic = 0 AND b.toxic = 1)
    SELECT 'Independent t-test' AS test, round((m1 - m2) / sqrt(s2 * (1.0 / n1 + 1.0 / n2)), 6) AS statistic,
    round(abs((m1 - m2) / (sqrt(s2) + 1e-9)), 6) AS effect_size, (n1 + n2 - 2)::DOUBLE AS dof, n1 + n2 AS n FROM p""",
)
def _(spark, sf):
    return h.t_test(view(spark, sf, "fx_text_labels"), "n_chars", "toxic").select("test", "statistic", "effect_size", "dof", "n")


@query(
    "tst_mwu",
    f"""WITH r AS (SELECT quality, {RANKED.format(v='n_chars')} AS rk FROM fx_text_labels)
    SELECT 'Mann-Whitney U Test' AS test, round(sum(rk) FILTER (quality = 0) -
    count(*) FILTER (quality = 0) * (count(*) FILTER (quality = 0) + 1) / 2.0, 6)::DOUBLE AS statistic, count(*) AS n FROM r""",
)
def _(spark, sf):
    return h.mann_whitney(view(spark, sf, "fx_text_labels"), "n_chars", "quality").select("test", "statistic", "n")


@query(
    "tst_pearson",
    """SELECT 'Pearson Correlation' AS test, round(corr(l_quantity, l_extendedprice), 6) AS statistic,
    (count(*) - 2)::DOUBLE AS dof, count(*) AS n FROM lineitem""",
)
def _(spark, sf):
    return h.pearson_test(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select("test", "statistic", "dof", "n")


@query(
    "tst_spearman",
    f"""WITH r AS (SELECT {RANKED.format(v='n_chars')} AS a, {RANKED.format(v='quality')} AS b FROM fx_text_labels)
    SELECT 'Spearman Correlation' AS test, round(corr(a, b), 6) AS statistic, count(*) AS n FROM r""",
)
def _(spark, sf):
    return h.spearman_test(view(spark, sf, "fx_text_labels"), "n_chars", "quality").select("test", "statistic", "n")


@query("tst_normality")
def _(spark, sf):
    return h.normality(table(spark, sf, "events"), "value", ["event_type"])


@query("tst_recommend_numeric")
def _(spark, sf):
    return h.recommend_test(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@query("tst_recommend_groups")
def _(spark, sf):
    return h.recommend_test(table(spark, sf, "events"), "value", "event_type")


@query("tst_recommend_independence")
def _(spark, sf):
    return h.recommend_test(table(spark, sf, "documents"), "lang", "source")


@query("tst_hypothesis")
def _(spark, sf):
    return h.build_hypothesis(view(spark, sf, "fx_text_labels"), "n_chars", "differs by", "lang")


# ---------------------------------------------------------------- regression

from sightline.operators import regression as r  # noqa: E402

PRICE = ("l_quantity", "l_discount", "l_tax")


@query("reg_ols")
def _(spark, sf):
    return r.ols(table(spark, sf, "lineitem"), "l_extendedprice", PRICE).coefficients


@query(
    "reg_ols_fit",
    """WITH f AS (SELECT regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a, regr_r2(y, x1) AS r2, count(*)::DOUBLE AS n FROM fx_reg)
    SELECT unnest(['const', 'x1', 'r_squared', 'r_squared_adj', 'n_observations']) AS measure,
    unnest([round(a, 6), round(b, 6), round(r2, 6), round(1 - (1 - r2) * (n - 1) / (n - 2), 6), n]) AS value FROM f""",
)
def _(spark, sf):
    fit = r.ols(view(spark, sf, "fx_reg"), "y", ["x1"])
    terms = fit.coefficients.select(F.col("term").alias("measure"), F.col("coefficient").alias("value"))
    wanted = ["r_squared", "r_squared_adj", "n_observations"]
    return terms.unionByName(fit.summary.where(F.col("measure").isin(wanted)))


@query(
    "reg_ols_two",
    """WITH m AS (SELECT covar_pop(x1, x1) AS s11, covar_pop(x1, x2) AS s12, covar_pop(x2, x2) AS s22, covar_pop(x1, y) AS s1y,
    covar_pop(x2, y) AS s2y, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM fx_reg),
    b AS (SELECT (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2, * FROM m)
    SELECT unnest(['const', 'x1', 'x2']) AS term, unnest([round(my - b1 * m1 - b2 * m2, 5), round(b1, 5), round(b2, 5)]) AS coefficient FROM b""",
    places=5,
)
def _(spark, sf):
    return r.ols(view(spark, sf, "fx_reg"), "y", ["x1", "x2"]).coefficients.select("term", "coefficient")


@query("reg_ols_summary")
def _(spark, sf):
    return r.ols(table(spark, sf, "lineitem"), "l_extendedprice", PRICE).summary


@query(
    "reg_durbin_watson",
    """WITH f AS (SELECT regr_slope(value, user_id) AS b, regr_intercept(value, user_id) AS a FROM events),
    e AS (SELECT value - a - b * user_id AS e, ts, event_id FROM events, f),
    d AS (SELECT e, e - lag(e) OVER (ORDER BY ts, event_id) AS s FROM e)
    SELECT round(sum(s * s) / sum(e * e), 6) AS durbin_watson FROM d""",
)
def _(spark, sf):
    fit = r.ols(table(spark, sf, "events"), "value", ["user_id"], keep=["ts", "event_id"])
    return r.durbin_watson(fit, ["ts", "event_id"])


@query(
    "reg_ridge",
    """WITH g AS (SELECT avg(x1) AS m, avg(x1 * x1) AS q, avg(y) AS y, avg(x1 * y) AS xy FROM fx_reg)
    SELECT unnest(['const', 'x1']) AS term, unnest([round((y * (q + 1) - m * xy) / (2 * (q + 1) - m * m), 6),
    round((2 * xy - m * y) / (2 * (q + 1) - m * m), 6)]) AS coefficient FROM g""",
)
def _(spark, sf):
    return r.ridge(view(spark, sf, "fx_reg"), "y", ["x1"]).coefficients.select("term", "coefficient")


@query("reg_lasso")
def _(spark, sf):
    return r.lasso(view(spark, sf, "fx_reg"), "y", ["x1", "x2"]).coefficients.select("term", "coefficient")


@query("reg_logistic")
def _(spark, sf):
    return r.logistic(view(spark, sf, "fx_text_labels"), "quality", ["n_chars"]).coefficients


@query("reg_logistic_summary")
def _(spark, sf):
    return r.logistic(view(spark, sf, "fx_text_labels"), "quality", ["n_chars", "lang"]).summary


@query("reg_poisson")
def _(spark, sf):
    days = view(spark, sf, "fx_order_days").withColumn("weekday", F.weekday("d"))
    return r.poisson(days, "n", ["weekday"]).coefficients


@query(
    "reg_vif",
    """WITH g AS (SELECT sum(x1 * x1) AS a, sum(x2 * x2) AS b, sum(x1 * x2) AS c FROM fx_reg)
    SELECT unnest(['x1', 'x2']) AS "column", round(a * b / (a * b - c * c), 2) AS vif FROM g""",
)
def _(spark, sf):
    return r.ols(view(spark, sf, "fx_reg"), "y", ["x1", "x2"]).vif()


@query(
    "reg_residuals",
    """WITH f AS (SELECT regr_slope(value, user_id) AS b, regr_intercept(value, user_id) AS a FROM events),
    e AS (SELECT a + b * user_id AS fitted, value - a - b * user_id AS e FROM events, f)
    SELECT 'Breusch-Pagan' AS "check", round(count(*) * regr_r2(e * e, fitted), 6) AS statistic FROM e
    UNION ALL SELECT 'std_residual', round(stddev_pop(e), 6) FROM e""",
)
def _(spark, sf):
    fit = r.ols(table(spark, sf, "events"), "value", ["user_id"], keep=["event_id"])
    out = r.residual_diagnostics(fit, ["event_id"]).select("check", "statistic")
    return out.where(F.col("check").isin("Breusch-Pagan", "std_residual"))


@query("reg_residual_normality")
def _(spark, sf):
    fit = r.ols(table(spark, sf, "events"), "value", ["user_id"], keep=["event_id"])
    return r.residual_diagnostics(fit, ["event_id"])
