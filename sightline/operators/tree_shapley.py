"""Exact Shapley values of trees and sums of trees, from the rows that each node was grown on.

A leaf's value is v times a product over the features on its path: 1 or 0 whether the row
keeps to the path in that feature, or, where the feature is not known, the share z of rows that
the path keeps at the feature's splits. The weights of the subsets of a path of m features are
integrals of y^k (1 - y)^(m - 1 - k) over 0..1, so feature i gains

    v (o_i - z_i) * integral of the product over j <> i of (o_j y + z_j (1 - y)),

a polynomial that a Gauss-Legendre rule of m / 2 points integrates exactly. No background
rows are needed, and the cost grows with leaves times depth, not with subsets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.plans.storage import scratch_path

#: Rows that a task explains at once.
ROWS = 4096


@dataclass(frozen=True)
class Leaf:
    """Features on the path with the interval (low, high] and the share of rows that it keeps in each, and the leaf's value."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: float


def saved_nodes(model: Model, spark) -> dict[int, dict[int, dict]]:
    """The nodes of each tree by number, read from the model as MLlib saves it."""
    path = scratch_path(spark, "trees")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "nodeData" in nodes.columns:
        nodes = nodes.select("treeID", "nodeData.*")
    else:
        nodes = nodes.withColumn("treeID", F.lit(0))
    trees: dict[int, dict[int, dict]] = {}
    # a model fits on the driver, where MLlib keeps it
    for r in nodes.collect():
        trees.setdefault(r["treeID"], {})[r["id"]] = r.asDict(recursive=True)
    return trees


def leaves(model: Model, spark, class_index: int | None = None) -> list[Leaf]:
    """The leaves of a tree model, values scaled by the weight of their tree.

    The explained output is the prediction of a regression, the probability of ``class_index`` of a
    decision tree or forest, and the margin of boosted classification trees.
    """
    trees = saved_nodes(model, spark)
    boosted = hasattr(model, "treeWeights") and type(model).__name__.startswith("GBT")
    weights = list(model.treeWeights) if boosted else [1.0 / len(trees)] * len(trees)
    classes = class_index is not None and not boosted
    out: list[Leaf] = []

    def walk(nodes: dict[int, dict], at: int, path: dict[int, tuple[float, float, float]], weight: float) -> None:
        node = nodes[at]
        if node["leftChild"] < 0:
            stats = node["impurityStats"]
            value = stats[class_index] / sum(stats) if classes else node["prediction"]
            names = sorted(path)
            cells = [path[f] for f in names]
            out.append(Leaf(np.array(names, int), *(np.array([c[k] for c in cells], float) for k in range(3)), weight * value))
            return
        split = node["split"]
        if split["numCategories"] >= 0:
            raise ValueError("splits on categories are not supported")
        f, cut = split["featureIndex"], split["leftCategoriesOrThreshold"][0]
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        total = nodes[node["leftChild"]]["rawCount"] + nodes[node["rightChild"]]["rawCount"]
        for child, bounds in ((node["leftChild"], (low, min(high, cut))), (node["rightChild"], (max(low, cut), high))):
            walk(nodes, child, {**path, f: (*bounds, share * nodes[child]["rawCount"] / total)}, weight)

    for (_, nodes), weight in zip(sorted(trees.items()), weights):
        walk(nodes, 0, {}, float(weight))
    return out


def base(found: Sequence[Leaf]) -> float:
    """The mean output over the rows that the trees were grown on."""
    return float(sum(leaf.value * leaf.share.prod() for leaf in found))


def row_values(found: Sequence[Leaf], x: np.ndarray) -> np.ndarray:
    """A row of values, one for each feature, for each row of ``x``."""
    phi = np.zeros(x.shape)
    rules = {}
    for leaf in found:
        m = len(leaf.features)
        if not m:
            continue
        if m not in rules:
            points, weights = np.polynomial.legendre.leggauss((m + 1) // 2)
            rules[m] = (points + 1) / 2, weights / 2
        y, w = rules[m]
        own = x[:, leaf.features]
        keeps = (own > leaf.low) & (own <= leaf.high)
        # rows that keep to the path in the same features gain the same
        code = keeps @ (1 << np.arange(m)) if m < 63 else None
        if code is None:
            met, back = np.unique(keeps, axis=0, return_inverse=True)
        else:
            _, first, back = np.unique(code, return_index=True, return_inverse=True)
            met = keeps[first]
        o = met.astype(float)
        factor = o[:, :, None] * y + (leaf.share[:, None] * (1 - y))[None]
        rest = factor.prod(axis=1, keepdims=True) / factor
        gain = leaf.value * (o - leaf.share) * (rest @ w)
        phi[:, leaf.features] += gain[back.reshape(-1)]
    return phi


def tree_shapley(model: Model, explained: DataFrame, features: Sequence[str], column: str = "raw", class_index: int | None = None) -> tuple[DataFrame, float]:
    """((id, feature, shap_value, feature_value, std_error) for all rows of ``explained`` (id and a vector), base value).

    The values of a row add up to its output less the base value, which is the mean over the rows the
    trees were grown on. They are exact, so std_error is 0. Rows are explained where they lie; the leaves go to
    each task, as the model itself does when MLlib predicts. An empty table gives an empty result.
    """
    spark = explained.sparkSession
    found = leaves(model, spark, class_index)
    shared = spark.sparkContext.broadcast(found)
    kind = explained.schema["id"].dataType.simpleString()

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                rows = batch.iloc[at : at + ROWS]
                phi = row_values(shared.value, np.vstack(rows["x"].to_numpy()).astype(float))
                yield pd.DataFrame({"id": rows["id"].array, "x": rows["x"].array, "phi": list(phi)})

    done = explained.select("id", vector_to_array(column).alias("x")).mapInPandas(explain, f"id {kind}, x array<double>, phi array<double>")
    names = F.array(*[F.lit(f) for f in features])
    cells = F.arrays_zip(names.alias("feature"), F.col("phi").alias("shap_value"), F.col("x").alias("feature_value"))
    values = done.select("id", F.inline(cells)).select("id", "feature", "shap_value", "feature_value", F.lit(0.0).alias("std_error"))
    return values, base(found)
