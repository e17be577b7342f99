"""K-means, silhouettes and cluster profiles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.columns import nan_to_null, numeric_columns, quoted, require, text_columns
from sightline.operators.anomaly import standardised
from sightline.plans.longform import melt
from sightline.plans.storage import materialise

#: Distinct points of one block of the silhouette; a task holds two blocks.
SILHOUETTE_BLOCK = 32_000
#: Distances that a task holds at a time.
HELD_DISTANCES = 4_000_000
#: Pairs too close for a matrix product whose differences are held at a time.
PAIRS = 50_000


@dataclass(frozen=True)
class Clustering:
    labels: DataFrame
    centres: DataFrame
    sizes: DataFrame
    summary: DataFrame


def run_kmeans(
    df: DataFrame,
    key: Sequence[str],
    clusters: int = 3,
    columns: Sequence[str] | None = None,
    seed: int = 42,
    exact_silhouette: bool = False,
) -> Clustering:
    """Medians for gaps, standardised, k-means: labels by key, centres, sizes, inertia and silhouettes.

    ``silhouette_squared`` needs one scan: a cluster's count, sum and sum of squares give the mean squared distance
    to it. ``silhouette``, by plain distances, is quadratic in the rows and null unless ``exact_silhouette`` asks for it.
    """
    cols = list(columns) if columns is not None else [c for c in numeric_columns(df) if c not in key]
    require(df, *cols, *key)
    if not cols:
        raise ValueError("Insufficient numeric data for clustering")
    z = standardised(df, cols, key)
    names = [f"_z{i}" for i in range(len(cols))]
    points = materialise(VectorAssembler(inputCols=names, outputCol="features").transform(z).select(*[quoted(k) for k in key], "features"))
    rows = points.count()
    if rows < clusters:
        raise ValueError("Insufficient numeric data for clustering")
    model = KMeans(k=clusters, seed=seed, maxIter=100, predictionCol="cluster").fit(points)
    placed = model.transform(points)
    spark = df.sparkSession
    centres = [(i, c, float(v)) for i, centre in enumerate(model.clusterCenters()) for c, v in zip(cols, centre)]
    sizes = placed.groupBy("cluster").agg(F.count("*").alias("size"))
    several = sum(1 for s in model.summary.clusterSizes if s) > 1
    squared = squared_silhouette(placed) if several else 0.0
    exact = euclidean_silhouette(placed.select("features", "cluster")) if several and exact_silhouette else None
    summary = spark.createDataFrame(
        [(rows, clusters, float(model.summary.trainingCost), float(squared), exact)],
        "n bigint, n_clusters int, inertia double, silhouette_squared double, silhouette double",
    )
    return Clustering(
        placed.select(*[quoted(k) for k in key], "cluster"),
        spark.createDataFrame(centres, "cluster int, feature string, centre double"),
        sizes,
        summary,
    )


def squared_silhouette(placed: DataFrame) -> float:
    """Mean silhouette by squared distances, from one table of cluster sums: linear in the rows."""
    return float(ClusteringEvaluator(predictionCol="cluster", distanceMeasure="squaredEuclidean").evaluate(placed))


def euclidean_silhouette(placed: DataFrame, block: int = SILHOUETTE_BLOCK) -> float:
    """Mean silhouette by plain distances, exact at every size.

    Equal points of a cluster are one point with a weight. The points are dealt into blocks, each
    pair of blocks is one task's work, and only a distance sum for each point and cluster leaves it: the
    work is quadratic, as the definition is, but nothing is gathered in one place.
    """
    points = placed.groupBy(vector_to_array("features").alias("v"), "cluster").agg(F.count("*").alias("w"))
    points = materialise(points.withColumn("p", F.xxhash64("v", "cluster")).withColumn("q", F.xxhash64(F.lit(1), "v", "cluster")))
    blocks = max(1, -(-points.count() // block))
    dealt = points.withColumn("block", F.pmod(F.xxhash64("p", F.lit(2)), F.lit(blocks)).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    # a block of points meets each block once, in pieces when there are few blocks, so that tasks are many
    pieces = max(1, -(-2 * placed.sparkSession.sparkContext.defaultParallelism // blocks**2))
    piece = F.pmod(F.xxhash64("p", F.lit(3)), F.lit(pieces)).cast("int")
    asks = dealt.select("p", "q", "v", F.col("block").alias("i"), others.alias("j"), piece.alias("k"))
    spots = dealt.select("cluster", "w", "v", F.col("block").alias("j"), others.alias("i")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))

    def sums(ask: pd.DataFrame, spot: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"p": [], "q": [], "other": [], "total": []})
        if not len(ask) or not len(spot):
            return empty
        x, y = np.vstack(ask["v"].to_numpy()), np.vstack(spot["v"].to_numpy())
        kinds, column = np.unique(spot["cluster"].to_numpy(), return_inverse=True)
        weights = np.zeros((len(y), len(kinds)))
        weights[np.arange(len(y)), column] = spot["w"].to_numpy()
        out = []
        step = max(1, HELD_DISTANCES // len(y))
        for at in range(0, len(x), step):
            out.append(distances(x[at : at + step], y) @ weights)
        total = np.vstack(out)
        n = len(kinds)
        return pd.DataFrame({"p": np.repeat(ask["p"].to_numpy(), n), "q": np.repeat(ask["q"].to_numpy(), n), "other": np.tile(kinds, len(x)), "total": total.ravel()})

    where = ["i", "j", "k"]
    found = asks.groupBy(*where).cogroup(spots.groupBy(*where)).applyInPandas(sums, "p bigint, q bigint, other int, total double")
    found = found.groupBy("p", "q", "other").agg(F.sum("total").alias("total"))
    sizes = F.broadcast(points.groupBy(F.col("cluster").alias("other")).agg(F.sum("w").alias("size")))  # a row for each cluster
    own = points.select("p", "q", "cluster", "w")
    rows = found.join(sizes, "other").join(own, ["p", "q"])
    mine = F.col("other") == F.col("cluster")
    per = rows.groupBy("p", "q", "w").agg(
        F.max(F.when(mine, F.col("size"))).alias("members"),
        F.max(F.when(mine, F.col("total") / F.greatest(F.col("size") - 1, F.lit(1)))).alias("a"),
        F.min(F.when(~mine, F.col("total") / F.col("size"))).alias("b"),
    )
    top = F.greatest("a", "b")
    score = F.when((F.col("members") > 1) & (top > 0), (F.col("b") - F.col("a")) / top).otherwise(0.0)
    row = per.agg(F.sum(score * F.col("w")).alias("s"), F.sum("w").alias("n")).first()
    return float(row["s"] / row["n"])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Plain distances of all rows of x and y by one matrix product; those too small for its rounding are taken directly."""
    middle = y.mean(axis=0)
    x, y = x - middle, y - middle
    long, wide = (x * x).sum(axis=1), (y * y).sum(axis=1)
    out = x @ y.T
    out *= -2.0
    out += long[:, None]
    out += wide
    row, col = np.nonzero(out <= 1e-6 * (long.max(initial=0.0) + wide.max(initial=0.0)))
    # rows of differences, as many as a task may hold
    for at in range(0, len(row), PAIRS):
        i, j = row[at : at + PAIRS], col[at : at + PAIRS]
        out[i, j] = ((x[i] - y[j]) ** 2).sum(axis=1)
    return np.sqrt(out, out=out)


# ---------------------------------------------------------------- profiles


def profile_numeric(df: DataFrame, cluster: str, features: Sequence[str] | None = None) -> DataFrame:
    """cluster, feature, size, percentage, mean, std, global_mean, z_score, direction, distinguishing, place."""
    feats = list(features) if features is not None else [c for c in numeric_columns(df) if c != cluster]
    base = nan_to_null(df.select(quoted(cluster).alias("cluster"), *[quoted(c).cast("double").alias(c) for c in feats]))
    aggs = []
    for i, c in enumerate(feats):
        aggs += [F.avg(quoted(c)).alias(f"m{i}"), F.stddev_samp(quoted(c)).alias(f"s{i}")]
    whole = base.agg(F.count("*").alias("_all"), *aggs)
    per = base.groupBy("cluster").agg(F.count("*").alias("size"), *aggs)
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"p.m{i}").alias("mean"),
                F.col(f"p.s{i}").alias("std"),
                F.col(f"w.m{i}").alias("global_mean"),
                ((F.col(f"p.m{i}") - F.col(f"w.m{i}")) / (F.col(f"w.s{i}") + 1e-9)).alias("z_score"),
            )
            for i, c in enumerate(feats)
        ]
    )
    long = per.alias("p").crossJoin(F.broadcast(whole.alias("w"))).select(
        "cluster", "size", (F.col("size") / F.col("_all") * 100).alias("percentage"), F.inline(entries)
    )
    z = F.col("z_score")
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.abs("z_score")), "feature"))
    return long.select(
        "*",
        F.when(z > 0.5, "above").when(z < -0.5, "below").otherwise("average").alias("direction"),
        (F.abs(z) > 0.5).alias("distinguishing"),
        place.alias("place"),
    )


def distinguishing_features(profile: DataFrame, top: int = 10) -> DataFrame:
    """(cluster, place, feature, z_score, direction, value): features more than half a deviation off."""
    return profile.where(F.col("distinguishing") & (F.col("place") <= top)).select(
        "cluster",
        "place",
        "feature",
        "z_score",
        F.when(F.col("z_score") > 0, "high").otherwise("low").alias("direction"),
        F.col("mean").alias("value"),
    )


def profile_categorical(df: DataFrame, cluster: str, columns: Sequence[str] | None = None, top: int = 3) -> DataFrame:
    """(cluster, column, place, value, percentage): the most common values of each text column, or of ``columns``."""
    cols = list(columns) if columns is not None else [c for c in text_columns(df) if c != cluster]
    if not cols:
        kind = df.schema[cluster].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"cluster {kind}, column string, place int, value string, percentage double")
    base = df.select(quoted(cluster).alias("cluster"), *[quoted(c) for c in cols])
    counts = melt(base, cols, ["cluster"]).groupBy("cluster", "column", "value").agg(F.count("*").alias("n"))
    totals = counts.groupBy("cluster", "column").agg(F.sum("n").alias("all"))
    order = F.row_number().over(Window.partitionBy("cluster", "column").orderBy(F.desc("n"), "value"))
    best = counts.withColumn("place", order).where(F.col("place") <= top)
    return best.join(totals, ["cluster", "column"]).select(
        "cluster", "column", "place", "value", (F.col("n") / F.col("all") * 100).alias("percentage")
    )


def radar(profile: DataFrame, features: Sequence[str]) -> DataFrame:
    """(cluster, feature, level): z brought to 0..1 for the features given."""
    level = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("z_score") + 3) / 6))
    return profile.where(F.col("feature").isin(list(features))).select("cluster", "feature", level.alias("level"))


def personas(profile: DataFrame, categorical: DataFrame) -> DataFrame:
    """(cluster, persona): one sentence per cluster."""
    far = distinguishing_features(profile)

    def named(direction: str) -> DataFrame:
        picked = F.array_sort(F.collect_list(F.when(F.col("direction") == direction, F.struct("place", "feature"))))
        quotes = F.transform(F.slice(picked, 1, 3), lambda s: F.concat(F.lit("'"), s["feature"], F.lit("'")))
        return F.array_join(quotes, ", ").alias(direction)

    sides = far.groupBy("cluster").agg(named("high"), named("low"))
    sizes = profile.select("cluster", "size").distinct()
    first = categorical.where(F.col("place") == 1)
    lead = first.groupBy("cluster").agg(F.min_by(F.struct("column", "value", "percentage"), "column").alias("c"))
    joined = sizes.join(sides, "cluster", "left").join(lead, "cluster", "left")
    parts = F.concat_ws(
        "",
        F.format_string("Cluster %s (%d members): ", F.col("cluster").cast("string"), "size"),
        F.when(F.col("high") != "", F.concat(F.lit("Above-average in "), "high", F.lit(". "))),
        F.when(F.col("low") != "", F.concat(F.lit("Below-average in "), "low", F.lit(". "))),
        F.when(F.col("c").isNotNull(), F.format_string("Primarily '%s' (%.1f%%) in '%s'.", "c.value", "c.percentage", "c.column")),
    )
    plain = F.format_string(
        "Cluster %s: Average group (%d members) with no strongly distinguishing features.", F.col("cluster").cast("string"), "size"
    )
    nothing = F.col("high").isNull() & F.col("low").isNull()
    return joined.select("cluster", F.when(nothing, plain).otherwise(parts).alias("persona"))
