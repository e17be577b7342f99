"""Shapley values of a model's predictions, in long form."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.tree_shapley import tree_shapley
from sightline.plans.storage import materialise

#: Background rows unless the caller says otherwise; the result's std_error shows what more would bring.
BACKGROUND_ROWS = 100


def sample_by_hash(df: DataFrame, rows: int, seed: int = 42) -> DataFrame:
    """A repeatable sample of up to ``rows`` rows by the hash of ``id``."""
    return df.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(rows)


def linear_shapley(data: DataFrame, explained: DataFrame, coefficients: Sequence[float], features: Sequence[str], column: str = "raw") -> DataFrame:
    """(id, feature, shap_value, feature_value, std_error): b (x - mean), exact for a linear predictor.

    The means are taken over all of ``data``.
    """
    means = data.agg(vector_to_array(Summarizer.mean(F.col(column))).alias("_m"))
    weights = F.array(*[F.lit(float(b)) for b in coefficients])
    names = F.array(*[F.lit(f) for f in features])
    x = vector_to_array(column)
    cells = F.arrays_zip(names.alias("feature"), weights.alias("b"), x.alias("x"), F.col("_m").alias("m"))
    return (
        explained.crossJoin(F.broadcast(means))
        .select("id", F.inline(cells))
        .select(
            "id",
            "feature",
            (F.col("b") * (F.col("x") - F.col("m"))).alias("shap_value"),
            F.col("x").alias("feature_value"),
            F.lit(0.0).alias("std_error"),
        )
    )


def permutation_shapley(
    model: Model,
    background: DataFrame,
    explained: DataFrame,
    features: Sequence[str],
    column: str = "raw",
    class_index: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """(id, feature, shap_value, feature_value, std_error) by walking from background rows to each row.

    For every background row given one seeded order of the features is
    walked forwards and backwards, switching one feature at a time; the change of
    the prediction belongs to the feature switched. The values of a row add up to its
    prediction less the mean prediction of the background. Rows scored: explained x
    background x 2 x (features + 1), spread over the cluster.
    """
    spark = explained.sparkSession
    d = len(features)
    rng = random.Random(seed)
    walks = []
    for i, r in enumerate(background.select(vector_to_array(column).alias("b")).collect()):
        order = list(range(d))
        rng.shuffle(order)
        walks.append((2 * i, r["b"], order))
        walks.append((2 * i + 1, r["b"], order[::-1]))
    table = F.broadcast(spark.createDataFrame(walks, "walk int, b array<double>, step_feature array<int>"))
    at = F.transform(
        F.sequence(F.lit(0), F.lit(d - 1)), lambda j: F.array_position(F.col("step_feature"), j.cast("int")).cast("int")
    )
    steps = (
        explained.select("id", vector_to_array(column).alias("x"))
        .crossJoin(table)
        .withColumn("at", at)
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("step"))
    )
    mixed = F.zip_with(
        F.zip_with("x", "b", lambda x, b: F.struct(x.alias("x"), b.alias("b"))),
        "at",
        lambda v, place: F.when(place <= F.col("step"), v["x"]).otherwise(v["b"]),
    )
    scored = model.transform(steps.withColumn(column, array_to_vector(mixed)))
    value = F.col("prediction") if class_index is None else vector_to_array("probability")[class_index]
    walk = Window.partitionBy("id", "walk").orderBy("step")
    changed = scored.select("id", "walk", "step", "step_feature", "x", value.alias("v"))
    changed = changed.withColumn("delta", F.col("v") - F.lag("v").over(walk)).where(F.col("step") > 0)
    which = F.get("step_feature", F.col("step") - 1)
    # the two walks of a background row are one antithetic observation
    pairs = changed.groupBy("id", which.alias("f"), F.floor(F.col("walk") / 2).alias("pair")).agg(
        F.avg("delta").alias("delta"), F.first(F.get("x", which)).alias("feature_value")
    )
    name = F.get(F.array(*[F.lit(f) for f in features]), F.col("f"))
    return pairs.groupBy("id", "f").agg(
        F.avg("delta").alias("shap_value"),
        F.first("feature_value").alias("feature_value"),
        F.coalesce(F.stddev_samp("delta") / F.sqrt(F.count("*")), F.lit(0.0)).alias("std_error"),
    ).select("id", name.alias("feature"), "shap_value", "feature_value", "std_error")


def base_value(model: Model, background: DataFrame, class_index: int | None = None) -> float:
    """Mean prediction over the background rows."""
    scored = model.transform(background)
    value = F.col("prediction") if class_index is None else vector_to_array("probability")[class_index]
    return scored.agg(F.avg(value)).first()[0]


def explain(
    model: Model, prepared, column: str = "raw", class_index: int | None = None, seed: int = 42, background_rows: int = BACKGROUND_ROWS, explained: DataFrame | None = None
) -> tuple[DataFrame, float]:
    """Values for all test rows, or those given, and the base value.

    Trees and sums of trees are explained exactly; other models against ``background_rows`` seeded training rows.
    """
    rows = prepared.test if explained is None else explained
    if hasattr(model, "treeWeights") or hasattr(model, "depth"):
        return tree_shapley(model, rows, prepared.features, column, class_index)
    background = sample_by_hash(prepared.train, background_rows, seed)
    values = permutation_shapley(model, background, rows, prepared.features, column, class_index, seed)
    return values, base_value(model, background, class_index)


def shapley_summary(values: DataFrame) -> DataFrame:
    """(feature, mean_abs, mean_signed, direction), largest first."""
    return (
        values.groupBy("feature")
        .agg(F.avg(F.abs("shap_value")).alias("mean_abs"), F.avg("shap_value").alias("mean_signed"))
        .withColumn("direction", F.when(F.col("mean_signed") > 0, "positive").otherwise("negative"))
        .orderBy(F.desc("mean_abs"), "feature")
    )


def shapley_row(values: DataFrame, row_id: int, base: float, top: int = 15) -> DataFrame:
    """(base_value, prediction, feature, shap_value, feature_value, direction) of one row, largest first."""
    one = materialise(values.where(F.col("id") == row_id))  # read twice, found once
    total = one.agg((F.sum("shap_value") + F.lit(float(base))).alias("prediction"))
    return (
        one.crossJoin(F.broadcast(total))
        .select(
            F.lit(float(base)).alias("base_value"),
            "prediction",
            "feature",
            "shap_value",
            "feature_value",
            F.when(F.col("shap_value") > 0, "increases").otherwise("decreases").alias("direction"),
        )
        .orderBy(F.desc(F.abs("shap_value")), "feature")
        .limit(top)
    )
