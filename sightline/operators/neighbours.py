"""Exact nearest neighbours, and the k-NN models built on them.

Space is cut into the cells of sampled pivots, at every size of the table. Each query first meets
its own cell, block by block; the k-th distance found there rules out every cell that lies
farther away, and from the others only points within it come back. Equal points count once for
what they can add to a result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.plans.lookup import attach
from sightline.plans.ranks import bucket_count
from sightline.plans.storage import materialise

# Points of a cell or slice that one task holds. What is shuffled is each row times the blocks that it meets, so they are large.
BLOCK_ROWS = 32_000
# Queries that are worth a task of their own.
LEAST_ROWS = 1000
# Distances that a task holds at a time.
HELD_DISTANCES = 4_000_000
MAX_PIVOTS = 4000


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "manhattan":
        total = np.zeros((len(a), len(b)))
        for j in range(a.shape[1]):
            total += np.abs(a[:, j, None] - b[None, :, j])
        return total
    gap = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(gap, 0.0))


def _closest(ids, a, bound, others, b, k: int, exclude_self: bool, metric: str) -> pd.DataFrame:
    """The k closest of ``b`` for each row of ``a`` within its bound, ties by id; distances of the finalists are taken directly."""
    out = []
    step = max(1, min(1000, HELD_DISTANCES // max(1, len(b))))
    for start in range(0, len(a), step):
        q, qid, most = a[start : start + step], ids[start : start + step], bound[start : start + step]
        d = _distances(q, b, metric)
        if exclude_self:
            d[qid[:, None] == others[None, :]] = np.inf
        last = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
        # all that can tie with the k-th, however many
        row, col = np.nonzero((d <= (last + 1e-6 * (1 + last))[:, None]) & np.isfinite(d))
        gap = q[row] - b[col]
        exact = np.abs(gap).sum(1) if metric == "manhattan" else np.sqrt((gap * gap).sum(1))
        near = exact <= most[row]
        row, col, exact = row[near], col[near], exact[near]
        order = np.lexsort((others[col], exact, row))
        row, col, exact = row[order], col[order], exact[order]
        starts = np.searchsorted(row, np.arange(len(q)))
        first = np.arange(len(row)) - starts[row] < k if len(row) else np.empty(0, bool)
        out.append(pd.DataFrame({"id": qid[row[first]], "neighbour": others[col[first]], "distance": exact[first]}))
    return pd.concat(out) if out else pd.DataFrame({"id": [], "neighbour": [], "distance": []})


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(float)


def nearest_neighbours(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    exclude_self: bool = False,
    metric: str = "euclidean",
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, neighbour, distance, place): the k nearest points of every query, ties by id.

    Both sides are (id, v array<double>). Of points with the same coordinates only
    the k + 1 first ids can ever be chosen, so only those are searched.
    """
    same = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    points = materialise(points.select("id", "v", same.alias("_copy")).where(F.col("_copy") <= k + 1).drop("_copy"))
    schema = (
        f"id {queries.schema['id'].dataType.simpleString()}, "
        f"neighbour {points.schema['id'].dataType.simpleString()}, distance double"
    )
    rows = points.count()
    if not rows:
        return queries.sparkSession.createDataFrame([], schema + ", place int")
    found = _by_cells(queries, points, rows, k, exclude_self, metric, block, schema)
    place = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def with_facts(near: DataFrame, facts: DataFrame, fields: list[str]) -> DataFrame:
    """``near`` with ``fields`` of each neighbour's row in ``facts`` (id first); a point may be the neighbour of any share of the rows."""
    asked = near.groupBy("neighbour").agg(F.count("*").alias("count"))
    known = asked.join(facts.select(F.col("id").alias("neighbour"), *fields), "neighbour")
    known = known.select(F.col("neighbour").alias("value"), "count", F.lit(near.count()).alias("n"), *fields)
    return attach(near, F.col("neighbour"), known, fields, bucket_count(near))


def _by_cells(queries, points, rows, k, exclude_self, metric, block, schema) -> DataFrame:
    spark = queries.sparkSession
    wanted = min(MAX_PIVOTS, max(2, math.ceil(rows / block)))
    picked = points.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(wanted).toPandas()
    pivots = spark.sparkContext.broadcast(_matrix(picked["v"]))

    @F.pandas_udf("struct<cell int, far double>")
    def home(v: pd.Series) -> pd.DataFrame:
        d = _distances(_matrix(v), pivots.value, metric)
        cell = d.argmin(1)
        return pd.DataFrame({"cell": cell.astype("int32"), "far": d[np.arange(len(d)), cell]})

    points = materialise(points.withColumn("_h", home("v")).select("id", "v", F.col("_h.cell").alias("cell"), F.col("_h.far").alias("far")))
    queries = materialise(queries.select("id", "v").withColumn("_h", home("v")).select("id", "v", F.col("_h.cell").alias("cell")))
    sizes = {r["cell"]: (r["n"], r["r"]) for r in points.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect()}
    radius = np.full(len(picked), -np.inf)
    slices = np.zeros(len(picked), int)
    for cell, (n, r) in sizes.items():
        radius[cell], slices[cell] = r, math.ceil(n / block)
    shared = spark.sparkContext.broadcast((radius, slices))
    slice_of = F.get(F.array(*[F.lit(int(s)) for s in np.maximum(slices, 1)]), F.col("cell"))
    placed = points.withColumn("slice", F.pmod(F.xxhash64("id"), slice_of).cast("int"))

    def meet(asks: DataFrame) -> DataFrame:
        """Queries (id, v, cell, bound) against the points of that cell, slice by slice; only points within the bound come back."""
        asked = {r["cell"]: r["n"] for r in asks.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        # few cells are asked in more parts, so that tasks are many
        more = math.ceil(2 * spark.sparkContext.defaultParallelism / max(1, sum(int(slices[c]) for c in asked)))
        counts = {c: max(math.ceil(n / block), min(more, math.ceil(n / LEAST_ROWS))) for c, n in asked.items()}
        parts = F.get(F.array(*[F.lit(int(counts.get(c, 1))) for c in range(len(slices))]), F.col("cell"))
        left = asks.select(
            "id", "v", "cell", "bound",
            F.explode(F.sequence(F.lit(0), slice_of - 1)).alias("slice"),
            F.pmod(F.xxhash64("id", F.lit(5)), parts).cast("int").alias("part"),
        )
        right = placed.select("id", "v", "cell", "slice", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))

        def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if a.empty or b.empty:
                return pd.DataFrame({"id": [], "neighbour": [], "distance": []})
            return _closest(a["id"].to_numpy(), _matrix(a["v"]), a["bound"].to_numpy(float), b["id"].to_numpy(), _matrix(b["v"]), k, exclude_self, metric)

        where = ["cell", "slice", "part"]
        return left.groupBy(*where).cogroup(right.groupBy(*where)).applyInPandas(search, schema)

    first = materialise(meet(queries.withColumn("bound", F.lit(float("inf")))))
    place = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour"))
    bound = (
        first.withColumn("p", place).where(F.col("p") == k).select("id", F.col("distance").alias("bound"))
    )

    @F.pandas_udf("array<int>")
    def others(v: pd.Series, cell: pd.Series, bound: pd.Series) -> pd.Series:
        radii, counts = shared.value
        d = _distances(_matrix(v), pivots.value, metric)
        own = cell.to_numpy(int)
        least = d - radii[None, :]
        # a cell's points are closer to its pivot than to any other
        least = np.maximum(least, (d - d[np.arange(len(d)), own][:, None]) / 2)
        open_cells = (least <= bound.to_numpy(float)[:, None] * (1 + 1e-9) + 1e-9) & (counts[None, :] > 0)
        open_cells[np.arange(len(d)), own] = False
        return pd.Series([np.flatnonzero(row).astype("int32") for row in open_cells])

    asks = queries.join(bound, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    asks = materialise(asks.select("id", "v", "bound", F.explode(others("v", "cell", "bound")).alias("cell")))
    return first.unionByName(meet(asks))


def vote(near: DataFrame, labels: DataFrame, classify: bool = True, weights: str = "uniform") -> DataFrame:
    """(id, prediction) from neighbours and the points' (id, label): majority, smallest on a tie, or mean."""
    near = materialise(near)  # read three times
    joined = with_facts(near, labels, ["label"]).where(F.col("label").isNotNull())
    w = F.lit(1.0) if weights == "uniform" else 1.0 / (F.col("distance") + 1e-12)
    if not classify:
        return joined.groupBy("id").agg((F.sum(F.col("label") * w) / F.sum(w)).alias("prediction"))
    votes = joined.groupBy("id", "label").agg(F.sum(w).alias("w"))
    return votes.groupBy("id").agg(F.min_by("label", F.struct(-F.col("w"), F.col("label"))).alias("prediction"))
