"""Exact values of trees beside the enumeration of all subsets of features."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from sightline.operators import shapley, tree_shapley

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (400, 4)).astype(float)
    y = x[:, 0] * x[:, 1] + 3 * (x[:, 2] > 5) + rng.normal(size=400)
    frame = pd.DataFrame(x, columns=FEATURES).assign(id=range(400), label=y, two=(y > 30).astype(float))
    return VectorAssembler(inputCols=FEATURES, outputCol="raw").transform(spark.createDataFrame(frame)).cache()


def enumerated(trees, weights, value, x):
    """Values of one row by the definition: every subset of features, unknown ones averaged by the counts of rows."""

    def output(nodes, at, known):
        node = nodes[at]
        if node["leftChild"] < 0:
            return value(node)
        left, right = node["leftChild"], node["rightChild"]
        f = node["split"]["featureIndex"]
        if f in known:
            return output(nodes, left if x[f] <= node["split"]["leftCategoriesOrThreshold"][0] else right, known)
        n, m = nodes[left]["rawCount"], nodes[right]["rawCount"]
        return (n * output(nodes, left, known) + m * output(nodes, right, known)) / (n + m)

    total = lambda known: sum(w * output(nodes, 0, known) for (_, nodes), w in zip(sorted(trees.items()), weights))
    phi = []
    for i in range(len(x)):
        others = [j for j in range(len(x)) if j != i]
        phi.append(
            sum(
                math.factorial(k) * math.factorial(len(x) - k - 1) / math.factorial(len(x)) * (total({*s, i}) - total(set(s)))
                for k in range(len(x))
                for s in itertools.combinations(others, k)
            )
        )
    return phi, total(set())


MODELS = {
    "tree": (lambda: DecisionTreeRegressor(featuresCol="raw", maxDepth=4), None),
    "boosted": (lambda: GBTRegressor(featuresCol="raw", maxDepth=3, maxIter=4), None),
    "forest": (lambda: RandomForestClassifier(featuresCol="raw", labelCol="two", numTrees=5, maxDepth=5, seed=1), 1),
    "boosted classes": (lambda: GBTClassifier(featuresCol="raw", labelCol="two", maxDepth=3, maxIter=4), 1),
    "a single leaf": (lambda: DecisionTreeRegressor(featuresCol="raw", maxDepth=0), None),
}


@pytest.mark.parametrize("name", MODELS)
def test_values_equal_all_subsets(spark, rows, name):
    kind, index = MODELS[name]
    model = kind().fit(rows)
    values, base = tree_shapley.tree_shapley(model, rows, FEATURES, class_index=index)
    got = values.toPandas().pivot(index="id", columns="feature", values="shap_value")[FEATURES]
    trees = tree_shapley.saved_nodes(model, spark)
    boosted = name.startswith("boosted")
    weights = list(model.treeWeights) if boosted else [1 / len(trees)] * len(trees)
    value = (lambda n: n["impurityStats"][1] / sum(n["impurityStats"])) if name == "forest" else (lambda n: n["prediction"])
    data = rows.select("id", vector_to_array("raw").alias("x")).orderBy("id").toPandas()
    for i in (0, 7, 111, 399):
        want, start = enumerated(trees, weights, value, data["x"][i])
        np.testing.assert_allclose(got.loc[i], want, atol=1e-9)
        assert base == pytest.approx(start)
    out = model.transform(rows)
    margin = vector_to_array("rawPrediction")[1] if name == "boosted classes" else vector_to_array("probability")[1] if index else F.col("prediction")
    told = out.select("id", margin.alias("p")).toPandas().set_index("id")["p"].sort_index()
    total = got.sort_index().sum(axis=1) + base
    np.testing.assert_allclose(total, told, atol=1e-9)


def test_empty_table_and_other_models(spark, rows):
    model = DecisionTreeRegressor(featuresCol="raw", maxDepth=2).fit(rows)
    assert tree_shapley.tree_shapley(model, rows.where("false"), FEATURES)[0].collect() == []
    linear = LinearRegression(featuresCol="raw").fit(rows)

    class Prepared:
        train, test, features = rows, rows.limit(3), FEATURES

    values, base = shapley.explain(linear, Prepared, background_rows=10)
    total = values.groupBy("id").agg((F.sum("shap_value") + F.lit(base)).alias("t")).join(linear.transform(rows), "id").select((F.col("t") - F.col("prediction")).alias("gap"))
    assert max(abs(r["gap"]) for r in total.collect()) < 1e-8


def test_a_row_is_looked_for_once(spark):
    read = spark.sparkContext.accumulator(0)
    values = spark.createDataFrame([(i, f, float(i), 1.0, 0.0) for i in range(5) for f in ("a", "b")], "id bigint, feature string, shap_value double, feature_value double, std_error double")

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b

    got = shapley.shapley_row(values.mapInPandas(seen, values.schema), 3, 0.5).collect()
    assert [(r.feature, r.prediction, r.base_value) for r in got] == [("a", 6.5, 0.5), ("b", 6.5, 0.5)] and read.value == 10
