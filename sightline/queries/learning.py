"""Readiness, models, explanations and clusters over the shared tables."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from sightline.operators import clusters, models, neighbours, readiness, shapley, tree_shapley
from sightline.queries.registry import query, table, view

# ---------------------------------------------------------------- readiness


@query(
    "ml_readiness",
    """WITH t AS (SELECT count(*) AS n, count(DISTINCT doc_id) AS u FROM fx_text_labels),
    c AS (SELECT max(k)::DOUBLE / sum(k) AS top, count(*) AS kinds, sum(k) AS present FROM (SELECT count(*) AS k FROM fx_text_labels GROUP BY quality)),
    s AS (SELECT stddev_samp(n_chars) > 100 OR max(n_chars) - min(n_chars) > 1000 AS nc,
          stddev_samp(doc_id) > 100 OR max(doc_id) - min(doc_id) > 1000 AS di FROM fx_text_labels),
    h AS (SELECT count(DISTINCT source) > 50 AS many, (SELECT count(DISTINCT lang) > 50 FROM fx_text_labels) AS many_lang FROM fx_text_labels)
    SELECT CAST(100 - CASE WHEN n >= 1000 THEN 0 WHEN n >= 200 THEN 10 ELSE 25 END - CASE WHEN top > 0.85 THEN 20 WHEN top > 0.7 THEN 10 ELSE 0 END
    - CASE WHEN many OR many_lang THEN 5 ELSE 0 END AS INT) AS score, CASE WHEN kinds::DOUBLE / present < 0.05 AND kinds <= 20 THEN 'classification' ELSE 'regression' END AS problem_type,
    n AS "rows", 0.0::DOUBLE AS missing_pct, 0 AS duplicate_rows, round(top, 6) AS top_share, '' AS leakage,
    CASE WHEN many THEN 'source' ELSE '' END AS high_cardinality, 'lang,source' AS to_encode,
    concat_ws(',', CASE WHEN di THEN 'doc_id' END, CASE WHEN nc THEN 'n_chars' END) AS to_scale, 5 AS feature_count FROM t, c, s, h""",
)
def _(spark, sf):
    return readiness.readiness(view(spark, sf, "fx_text_labels"), "quality")


@query("ml_readiness_issues")
def _(spark, sf):
    return readiness.readiness_issues(view(spark, sf, "fx_text_labels"), "quality")


@query(
    "ml_feasibility",
    """WITH t AS (SELECT count(*) AS n FROM lineitem),
    d AS (SELECT n - (SELECT count(*) FROM (SELECT DISTINCT l_linenumber, l_quantity, l_tax, l_returnflag FROM lineitem)) AS dups, n FROM t),
    c AS (SELECT max(k)::DOUBLE / sum(k) AS top FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_returnflag)),
    p AS (SELECT 100 - CASE WHEN n >= 1000 THEN 0 WHEN n >= 200 THEN 10 ELSE 25 END - CASE WHEN dups > 0 THEN 5 ELSE 0 END
          - CASE WHEN top > 0.85 THEN 20 WHEN top > 0.7 THEN 10 ELSE 0 END AS score, n, top FROM d, c)
    SELECT CASE WHEN score >= 75 THEN 'High' WHEN score >= 50 THEN 'Medium' ELSE 'Low' END AS feasibility, score::INT AS score, 'classification' AS problem_type,
    CASE WHEN n >= 10000 THEN 'Excellent' WHEN n >= 1000 THEN 'Good' WHEN n >= 200 THEN 'Adequate' ELSE 'Insufficient' END AS data_sufficiency,
    'Logistic Regression,Random Forest,XGBoost' AS recommended_models FROM p""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_linenumber", "l_quantity", "l_tax", "l_returnflag")
    return readiness.feasibility(li, "l_returnflag").drop("baseline_accuracy", "expected_range")


@query("ml_feasibility_range")
def _(spark, sf):
    return readiness.feasibility(view(spark, sf, "fx_text_labels"), "quality")


@query(
    "ml_leakage",
    """SELECT 'copy' AS "column", round(abs(corr(coalesce(l_quantity, 0) * 2 + 1, coalesce(l_quantity, 0))), 6) AS correlation FROM fx_nulls""",
)
def _(spark, sf):
    df = view(spark, sf, "fx_nulls").select(
        "l_orderkey", "l_quantity", (F.coalesce("l_quantity", F.lit(0.0)) * 2 + 1).alias("copy"), "l_extendedprice"
    )
    return readiness.leakage(df, "l_quantity")


@query(
    "ml_scaling_hints",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(stddev_samp({c}), 4) AS std, (max({c}) - min({c}))::DOUBLE AS "range" FROM lineitem
        HAVING stddev_samp({c}) > 100 OR max({c}) - min({c}) > 1000"""
        for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ),
    places=4,
)
def _(spark, sf):
    return readiness.scaling_hints(table(spark, sf, "lineitem"))


@query(
    "ml_suggest_features",
    """SELECT 'DateTime Decomposition' AS kind, 'ts' AS "column", 'High' AS impact, 'year, month, day, dayofweek, quarter, is_weekend' AS detail
    UNION ALL SELECT 'Interaction Feature', 'event_id x user_id', 'Medium', 'event_id * user_id'
    UNION ALL SELECT CASE WHEN k > 50 THEN 'Frequency Encoding' ELSE 'One-Hot Encoding' END, c, 'Medium', format('{} unique values', k)
        FROM (SELECT 'event_type' AS c, count(DISTINCT event_type) AS k FROM events UNION ALL SELECT 'props', count(DISTINCT props) FROM events) WHERE k > 2
    UNION ALL SELECT 'Log Transform', 'value', 'High', format('skew={:.2f}', skewness(value)) FROM events HAVING min(value) > 0 AND abs(skewness(value)) > 1.5""",
)
def _(spark, sf):
    return readiness.suggest_features(table(spark, sf, "events"))


@query(
    "ml_apply_features",
    """WITH f AS (SELECT props, count(*)::DOUBLE / (SELECT count(*) FROM events) AS s FROM events GROUP BY props)
    SELECT event_id, user_id, value, round(ln(1 + value), 6) AS log_value, event_id * user_id AS event_id_x_user_id, year(ts)::INT AS ts_year,
    month(ts)::INT AS ts_month, day(ts)::INT AS ts_day, (isodow(ts) - 1)::INT AS ts_dayofweek, quarter(ts)::INT AS ts_quarter,
    (isodow(ts) >= 6)::INT AS ts_is_weekend, events.props, round(f.s, 6) AS props_freq, """
    + ", ".join(f"event_type = '{e}' AS event_type_{e}" for e in ("click", "error", "purchase", "signup", "view"))
    + " FROM events JOIN f USING (props)",
)
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "value", "ts", "event_type", "props")
    return readiness.apply_features(events, readiness.suggest_features(events))


# ---------------------------------------------------------------- models


def _labels(spark, sf):
    return view(spark, sf, "fx_text_labels").select("doc_id", "lang", "source", "n_chars", "quality")


def _parts(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")


@query("ml_prepare")
def _(spark, sf):
    p = models.prepare(_labels(spark, sf), "quality", ["doc_id"])
    return p.data.groupBy("is_test", "label").agg(F.count("*").alias("n"))


@query("ml_arena_classify")
def _(spark, sf):
    names = ["Logistic Regression", "Decision Tree", "Naive Bayes", "KNN", "SVM"]
    return models.run_arena(_labels(spark, sf), "quality", ["doc_id"], names, cross_validate=False).leaderboard


@query("ml_arena_regress")
def _(spark, sf):
    names = ["Linear Regression", "Ridge", "Lasso", "ElasticNet", "Decision Tree"]
    return models.run_arena(_parts(spark, sf), "p_retailprice", ["p_partkey"], names, cross_validate=False).leaderboard


@query("ml_forest_importance")
def _(spark, sf):
    return models.run_arena(_labels(spark, sf), "quality", ["doc_id"], ["Random Forest"], cross_validate=False).importance


@query("ml_boosting")
def _(spark, sf):
    p = models.prepare(_labels(spark, sf), "quality", ["doc_id"])
    _, predictions = models.train("Gradient Boosting", p)
    return models.metrics_table(predictions, True)


@query("ml_cross_validation")
def _(spark, sf):
    board = models.run_arena(_labels(spark, sf), "quality", ["doc_id"], ["Logistic Regression"]).leaderboard
    return board.select("algorithm", "metric", "value", "cv_mean", "cv_std")


@query("ml_single")
def _(spark, sf):
    done = models.run_single(_parts(spark, sf), "p_retailprice", ["p_partkey"], "Linear Regression")
    return done.predictions.select("key.p_partkey", "label", "prediction")


@query("ml_search")
def _(spark, sf):
    p = models.prepare(_parts(spark, sf), "p_retailprice", ["p_partkey"])
    return models.search(p, "Ridge", trials=4, folds=3).trials


@query(
    "ml_classification_metrics",
    """WITH c AS (SELECT quality AS l, toxic AS p, count(*)::DOUBLE AS n FROM labels GROUP BY 1, 2), t AS (SELECT sum(n) AS n FROM c),
    a AS (SELECT l, sum(n) AS support, coalesce(sum(n) FILTER (l = p), 0) AS hit FROM c GROUP BY l), g AS (SELECT p, sum(n) AS guessed FROM c GROUP BY p),
    m AS (SELECT support, hit, coalesce(hit / guessed, 0) AS pr, hit / support AS re FROM a LEFT JOIN g ON p = l)
    SELECT unnest(['accuracy', 'f1_score', 'precision', 'recall']) AS metric,
    unnest([round(sum(hit) / any_value(t.n), 6), round(sum(support * CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END) / any_value(t.n), 6),
    round(sum(support * pr) / any_value(t.n), 6), round(sum(support * re) / any_value(t.n), 6)]) AS value FROM m, t""",
)
def _(spark, sf):
    lab = table(spark, sf, "labels").select(
        F.col("quality").cast("double").alias("label"), F.col("toxic").cast("double").alias("prediction")
    )
    return models.metrics_table(lab, True)


@query(
    "ml_regression_metrics",
    """WITH e AS (SELECT l_extendedprice AS y, l_quantity * 1000 AS p FROM lineitem)
    SELECT unnest(['r2', 'rmse', 'mae']) AS metric, unnest([round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 4),
    round(sqrt(avg((y - p) ** 2)), 4), round(avg(abs(y - p)), 4)]) AS value FROM e""",
    places=4,
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1000).alias("prediction")
    )
    return models.metrics_table(li, False)


@query(
    "ml_roc_auc",
    """WITH r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS rk FROM fx_text_labels)
    SELECT round(((sum(rk) FILTER (quality = 1)) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0)
    / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)), 6)::DOUBLE AS roc_auc FROM r""",
)
def _(spark, sf):
    scored = view(spark, sf, "fx_text_labels").select(
        F.col("quality").cast("double").alias("label"), F.col("n_chars").cast("double").alias("rawPrediction")
    )
    return spark.createDataFrame([(float(models.roc_auc(scored)),)], "roc_auc double")


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("double").alias("label")
    )


NEAR = """p AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, b.label, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d
    FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
    n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbour) AS k FROM p) WHERE k <= 5)"""


@query("ml_neighbours", f"WITH {NEAR} SELECT id, neighbour, round(d, 6) AS distance, k::INT AS place FROM n")
def _(spark, sf):
    v = _vectors(spark, sf)
    return neighbours.nearest_neighbours(v, v, 5, exclude_self=True)


@query(
    "ml_knn_vote",
    f"""WITH {NEAR}, c AS (SELECT id, label, count(*) AS votes FROM n GROUP BY 1, 2)
    SELECT id, label::DOUBLE AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, label) AS r FROM c) WHERE r = 1""",
)
def _(spark, sf):
    v = _vectors(spark, sf)
    return neighbours.vote(neighbours.nearest_neighbours(v, v, 5, exclude_self=True), v.select("id", "label"))


@query("ml_knn_regress", f"WITH {NEAR} SELECT id, round(avg(label), 6)::DOUBLE AS prediction FROM n GROUP BY id")
def _(spark, sf):
    v = _vectors(spark, sf)
    return neighbours.vote(neighbours.nearest_neighbours(v, v, 5, exclude_self=True), v.select("id", "label"), False)


@query(
    "shap_linear",
    """WITH m AS (SELECT avg(l_quantity) AS m1, avg(l_discount) AS m2 FROM lineitem),
    t AS (SELECT l_orderkey AS id, l_quantity, l_discount, m1, m2 FROM lineitem, m)
    SELECT feature, round(avg(abs(v)), 6) AS mean_abs, count(*) AS n FROM (SELECT 'l_quantity' AS feature, 2.0 * (l_quantity - m1) AS v FROM t
    UNION ALL SELECT 'l_discount', -5.0 * (l_discount - m2) FROM t) GROUP BY feature""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("id", F.col("l_orderkey"))
    rows = VectorAssembler(inputCols=["l_quantity", "l_discount"], outputCol="raw").transform(li)
    values = shapley.linear_shapley(rows, rows, [2.0, -5.0], ["l_quantity", "l_discount"])
    return values.groupBy("feature").agg(F.avg(F.abs("shap_value")).alias("mean_abs"), F.count("*").alias("n"))


# a regression tree of depth 2 on two columns: each split is the midpoint between neighbouring values that leaves the least squares
SPLIT = """SELECT s, f, (v + nxt) / 2 AS cut FROM (
        SELECT s, f, v, lead(v) OVER w AS nxt, sum(n) OVER w AS ln, sum(t) OVER w AS lt, sum(n) OVER p AS total_n, sum(t) OVER p AS total_t
        FROM (SELECT s, f, v, count(*) AS n, sum(y) AS t FROM (SELECT s, 0 AS f, x1 AS v, y FROM {rows} UNION ALL SELECT s, 1, x2, y FROM {rows}) GROUP BY s, f, v)
        WINDOW w AS (PARTITION BY s, f ORDER BY v), p AS (PARTITION BY s, f))
    WHERE nxt IS NOT NULL QUALIFY row_number() OVER (PARTITION BY s ORDER BY lt * lt / ln + (total_t - lt) * (total_t - lt) / (total_n - ln) DESC) = 1"""
TREE = f"""t AS (SELECT l_quantity AS x1, l_discount AS x2, l_quantity * 0.1 + 40 * l_discount + l_quantity * l_discount + (l_partkey % 17 - 8) * 0.01 AS y FROM lineitem),
    r0 AS (SELECT 0 AS s, * FROM t), s0 AS ({SPLIT.format(rows="r0")}),
    r1 AS (SELECT CASE WHEN CASE WHEN f = 0 THEN x1 ELSE x2 END <= cut THEN 1 ELSE 2 END AS s, f AS f0, cut AS cut0, x1, x2, y FROM t, s0), s1 AS ({SPLIT.format(rows="r1")}),
    r2 AS (SELECT r1.s, CASE WHEN CASE WHEN f = 0 THEN x1 ELSE x2 END <= cut THEN 0 ELSE 1 END AS e, f0, cut0, f, cut, x1, x2, y FROM r1 JOIN s1 USING (s)),
    lv AS (
        SELECT s, e, f0, f, any_value(cut0) AS cut0, any_value(cut) AS cut, avg(y) AS v, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY s) AS z1, sum(count(*)) OVER (PARTITION BY s)::DOUBLE / sum(count(*)) OVER () AS z0
        FROM r2 GROUP BY s, e, f0, f),
    leaf AS (SELECT *, CASE WHEN f0 = 0 THEN z0 ELSE 1 END * CASE WHEN f = 0 THEN z1 ELSE 1 END AS za, CASE WHEN f0 = 1 THEN z0 ELSE 1 END * CASE WHEN f = 1 THEN z1 ELSE 1 END AS zb FROM lv),
    xs AS (SELECT DISTINCT x1, x2 FROM t),
    met AS (SELECT x1, x2, v, za, zb, (CASE WHEN f0 = 0 THEN x1 ELSE x2 END <= cut0) = (s = 1) AS k0, (CASE WHEN f = 0 THEN x1 ELSE x2 END <= cut) = (e = 0) AS k1, f0, f FROM xs, leaf),
    o AS (SELECT *, CASE WHEN (f0 <> 0 OR k0) AND (f <> 0 OR k1) THEN 1.0 ELSE 0.0 END AS oa, CASE WHEN (f0 <> 1 OR k0) AND (f <> 1 OR k1) THEN 1.0 ELSE 0.0 END AS ob FROM met),
    phi AS (SELECT x1, x2, sum(v * (oa - za) * (ob + zb) / 2) AS a, sum(v * (ob - zb) * (oa + za) / 2) AS b, sum(v * oa * ob) AS prediction, sum(v * za * zb) AS base FROM o GROUP BY x1, x2)"""


def _small_tree(spark, sf):
    li = table(spark, sf, "lineitem")
    y = F.col("l_quantity") * 0.1 + 40 * F.col("l_discount") + F.col("l_quantity") * F.col("l_discount") + (F.col("l_partkey") % 17 - 8) * 0.01
    rows = li.select(F.monotonically_increasing_id().alias("id"), "l_quantity", "l_discount", y.alias("label"))
    rows = VectorAssembler(inputCols=["l_quantity", "l_discount"], outputCol="raw").transform(rows)
    model = DecisionTreeRegressor(featuresCol="raw", labelCol="label", maxDepth=2, maxBins=64).fit(rows)
    return *tree_shapley.tree_shapley(model, rows, ["l_quantity", "l_discount"]), rows


@query(
    "shap_tree",
    f"WITH {TREE} SELECT feature, x AS feature_value, round(min(v), 6) AS lowest, round(max(v), 6) AS highest, CAST(sum(n) AS BIGINT) AS n FROM ("
    "SELECT 'l_quantity' AS feature, x1 AS x, a AS v, n FROM phi JOIN (SELECT x1, x2, count(*) AS n FROM t GROUP BY x1, x2) USING (x1, x2) "
    "UNION ALL SELECT 'l_discount', x2, b, n FROM phi JOIN (SELECT x1, x2, count(*) AS n FROM t GROUP BY x1, x2) USING (x1, x2)) GROUP BY feature, x",
)
def _(spark, sf):
    values, _, _ = _small_tree(spark, sf)
    return values.groupBy("feature", "feature_value").agg(F.min("shap_value").alias("lowest"), F.max("shap_value").alias("highest"), F.count("*").alias("n"))


@query(
    "shap_row",
    f"WITH {TREE}, one AS (SELECT * FROM phi ORDER BY x1, x2 LIMIT 1) SELECT round(base, 6) AS base_value, round(prediction, 6) AS prediction, feature, round(v, 6) AS shap_value, x AS feature_value, "
    "CASE WHEN v > 0 THEN 'increases' ELSE 'decreases' END AS direction FROM (SELECT base, prediction, 'l_quantity' AS feature, a AS v, x1 AS x FROM one UNION ALL SELECT base, prediction, 'l_discount', b, x2 FROM one)",
)
def _(spark, sf):
    values, base, rows = _small_tree(spark, sf)
    # the first row by its features, from the rows themselves; nulls come first, as in a sort
    first = F.min(F.struct("l_quantity", "l_discount", "id"))
    return shapley.shapley_row(values, rows.agg(first.alias("r")).first()["r"]["id"], base)


@query("shap_model")
def _(spark, sf):
    p = models.prepare(_labels(spark, sf), "quality", ["doc_id"])
    model, _ = models.train("Decision Tree", p)
    values, _ = shapley.explain(model, p, class_index=1)
    return shapley.shapley_summary(values)


# ---------------------------------------------------------------- clusters


# all dimensions of the vectors
DIMS = 64


def _cluster_frame(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(DIMS)])


E_NAMES = ", ".join(f"e{i}" for i in range(DIMS))
VECTORS = "SELECT vec_id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(DIMS)) + " FROM embeddings"


@query("cluster_kmeans")
def _(spark, sf):
    return clusters.run_kmeans(_cluster_frame(spark, sf).drop("label"), ["vec_id"], exact_silhouette=True).summary


@query("cluster_centres")
def _(spark, sf):
    return clusters.run_kmeans(_cluster_frame(spark, sf).drop("label"), ["vec_id"]).centres


@query(
    "cluster_silhouette",
    f"""WITH x AS ({VECTORS}), d AS (SELECT a.vec_id AS i, a.label AS own, b.label AS other, b.vec_id AS j,
    sqrt({' + '.join(f'(a.e{i} - b.e{i}) ** 2' for i in range(DIMS))}) AS d FROM x a, x b),
    s AS (SELECT i, own, other, sum(d) AS s, count(*) AS n FROM d GROUP BY 1, 2, 3),
    a AS (SELECT i, s / (n - 1) AS a FROM s WHERE own = other AND n > 1), b AS (SELECT i, min(s / n) AS b FROM s WHERE own <> other GROUP BY i)
    SELECT round(sum((b - a) / greatest(a, b)) / (SELECT count(*) FROM x), 6) AS silhouette FROM a JOIN b USING (i)""",
)
def _(spark, sf):
    rows = VectorAssembler(inputCols=[f"e{i}" for i in range(DIMS)], outputCol="features").transform(_cluster_frame(spark, sf))
    s = clusters.euclidean_silhouette(rows.select("features", F.col("label").alias("cluster")))
    return spark.createDataFrame([(s,)], "silhouette double")


@query(
    "cluster_silhouette_squared",
    f"""WITH x AS ({VECTORS}), l AS (UNPIVOT x ON {E_NAMES} INTO NAME feature VALUE v),
    c AS (SELECT label, feature, avg(v) AS m, sum(v * v) AS q, count(*) AS n FROM l GROUP BY 1, 2),
    d AS (SELECT l.vec_id AS i, l.label AS own, c.label AS other, any_value(c.n) AS n,
        sum(l.v * l.v - 2 * l.v * c.m + c.q / c.n) AS d FROM l JOIN c USING (feature) GROUP BY 1, 2, 3),
    s AS (SELECT i, max(n) FILTER (own = other) AS size, max(d * n / greatest(n - 1, 1)) FILTER (own = other) AS a, min(d) FILTER (own <> other) AS b
        FROM d GROUP BY i)
    SELECT round(avg(CASE WHEN size > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette FROM s""",
)
def _(spark, sf):
    rows = VectorAssembler(inputCols=[f"e{i}" for i in range(DIMS)], outputCol="features").transform(_cluster_frame(spark, sf))
    s = clusters.squared_silhouette(rows.select("features", F.col("label").cast("int").alias("cluster")))
    return spark.createDataFrame([(s,)], "silhouette double")


@query(
    "cluster_profile",
    f"""WITH x AS ({VECTORS}), l AS (UNPIVOT x ON {E_NAMES} INTO NAME feature VALUE v),
    g AS (SELECT feature, avg(v) AS gm, stddev_samp(v) AS gs FROM l GROUP BY feature),
    c AS (SELECT label AS cluster, feature, count(*) AS size, avg(v) AS mean, stddev_samp(v) AS std FROM l GROUP BY 1, 2)
    SELECT cluster, feature, size, round(100.0 * size / (SELECT count(*) FROM x), 6)::DOUBLE AS percentage, round(mean, 6) + 0.0 AS mean, round(std, 6) AS std,
    round(gm, 6) + 0.0 AS global_mean, round((mean - gm) / (gs + 1e-9), 6) + 0.0 AS z_score,
    CASE WHEN (mean - gm) / (gs + 1e-9) > 0.5 THEN 'above' WHEN (mean - gm) / (gs + 1e-9) < -0.5 THEN 'below' ELSE 'average' END AS direction,
    abs((mean - gm) / (gs + 1e-9)) > 0.5 AS distinguishing FROM c JOIN g USING (feature)""",
)
def _(spark, sf):
    frame = _cluster_frame(spark, sf).drop("vec_id")
    return clusters.profile_numeric(frame, "label").drop("place")


@query(
    "cluster_categorical",
    """WITH d AS (SELECT quality, lang, source FROM fx_text_labels), l AS (UNPIVOT d ON lang, source INTO NAME "column" VALUE "value"),
    c AS (SELECT quality AS cluster, "column", "value", count(*) AS n, sum(count(*)) OVER (PARTITION BY quality, "column") AS t FROM l GROUP BY 1, 2, 3)
    SELECT cluster, "column", place::INT AS place, "value", round(100.0 * n / t, 6)::DOUBLE AS percentage FROM
    (SELECT *, row_number() OVER (PARTITION BY cluster, "column" ORDER BY n DESC, "value") AS place FROM c) WHERE place <= 3""",
)
def _(spark, sf):
    return clusters.profile_categorical(view(spark, sf, "fx_text_labels").select("quality", "lang", "source"), "quality")


@query(
    "cluster_radar",
    f"""WITH x AS ({VECTORS}), l AS (UNPIVOT x ON {E_NAMES} INTO NAME feature VALUE v),
    g AS (SELECT feature, avg(v) AS gm, stddev_samp(v) AS gs FROM l GROUP BY feature),
    c AS (SELECT label AS cluster, feature, avg(v) AS mean FROM l GROUP BY 1, 2)
    SELECT cluster, feature, round(least(1, greatest(0, ((mean - gm) / (gs + 1e-9) + 3) / 6)), 6) AS level FROM c JOIN g USING (feature)""",
)
def _(spark, sf):
    frame = _cluster_frame(spark, sf).drop("vec_id")
    return clusters.radar(clusters.profile_numeric(frame, "label"), [f"e{i}" for i in range(DIMS)])


@query("cluster_personas")
def _(spark, sf):
    df = view(spark, sf, "fx_text_labels").select("quality", "lang", "n_chars")
    return clusters.personas(clusters.profile_numeric(df, "quality"), clusters.profile_categorical(df, "quality"))
