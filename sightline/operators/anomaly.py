"""Anomaly scores: z-score, isolation forest, local outlier factor and their ensemble."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.columns import nan_to_null, numeric_columns, quoted, require
from sightline.operators.neighbours import nearest_neighbours, with_facts
from sightline.plans.longform import aggregate_rows, spread
from sightline.plans.ranks import quantiles
from sightline.plans.storage import materialise

MIN_ROWS = 10
TREES = 100
TREE_ROWS = 256
NEIGHBOURS = 20


def standardised(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns plus _z0.. : medians for nulls, then (x - mean) / population deviation."""
    cols = list(cols)
    base = nan_to_null(df.select(*[quoted(k) for k in keep], *[quoted(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)]))
    names = [f"_x{i}" for i in range(len(cols))]
    holes = base.agg(*[F.count(F.when(F.col(n).isNull(), 1)) for n in names]).first()
    gaps = [n for n, h in zip(names, holes) if h]
    if gaps:
        middle = quantiles(base, gaps, [0.5]).select("column", F.col("q")[0].alias("m"))
        base = base.crossJoin(F.broadcast(spread(middle, gaps, "m", "_md")))
        base = base.withColumns({n: F.coalesce(F.col(n), F.col(f"_md{i}")) for i, n in enumerate(gaps)})
    row = base.agg(
        *[F.avg(n).alias(f"_m{i}") for i, n in enumerate(names)],
        *[F.stddev_pop(n).alias(f"_s{i}") for i, n in enumerate(names)],
    )
    def scaled(i: int):
        sd = F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(F.lit(1.0))
        return ((F.col(f"_x{i}") - F.col(f"_m{i}")) / sd).alias(f"_z{i}")
    return base.crossJoin(F.broadcast(row)).select(*[quoted(k) for k in keep], *[scaled(i) for i in range(len(cols))])


def _columns(df: DataFrame, columns: Sequence[str] | None, key: Sequence[str]) -> list[str]:
    cols = list(columns) if columns is not None else [c for c in numeric_columns(df) if c not in key]
    require(df, *cols, *key)
    if not cols or len(df.limit(MIN_ROWS).select(*[quoted(c) for c in cols]).take(MIN_ROWS)) < MIN_ROWS:
        raise ValueError("Insufficient numeric data for anomaly detection")
    return cols


def _flagged(scored: DataFrame, contamination: float) -> DataFrame:
    """``is_anomaly`` for scores beyond the (1 - contamination) percentile."""
    cut = quantiles(scored, ["score"], [1 - contamination]).select(F.col("q")[0].alias("_cut"))
    return scored.crossJoin(F.broadcast(cut)).withColumn("is_anomaly", F.col("score") > F.col("_cut")).drop("_cut")


def zscore_scores(df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """(key..., score): the largest absolute standardised value in the row."""
    cols = _columns(df, columns, key)
    z = standardised(df, cols, key)
    parts = [F.abs(f"_z{i}") for i in range(len(cols))]
    return z.select(*[quoted(k) for k in key], (F.greatest(*parts) if len(parts) > 1 else parts[0]).alias("score"))


# ---------------------------------------------------------------- isolation forest


def _path_length(n: int) -> float:
    """Mean depth of an unsuccessful search among n values."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (feature, threshold, left, right, depth value); a leaf has feature -1."""
    nodes: list[list] = []

    def build(rows: np.ndarray, depth: int) -> int:
        here = len(nodes)
        nodes.append([-1, 0.0, -1, -1, depth + _path_length(len(rows))])
        if depth >= limit or len(rows) <= 1:
            return here
        low, high = rows.min(0), rows.max(0)
        open_features = np.flatnonzero(high > low)
        if not len(open_features):
            return here
        f = int(rng.choice(open_features))
        t = float(rng.uniform(low[f], high[f]))
        side = rows[:, f] <= t
        if side.all() or not side.any():
            return here
        left = build(rows[side], depth + 1)
        right = build(rows[~side], depth + 1)
        nodes[here] = [f, t, left, right, 0.0]
        return here

    build(x, 0)
    return [tuple(n) for n in nodes]


def _sample_per_tree(z: DataFrame, names: Sequence[str], key: Sequence[str], rows: int, trees: int, size: int, seed: int) -> DataFrame:
    """About ``size`` rows for every tree, at every table size.

    How many trees draw a row is a binomial number, looked up from one seeded hash of its key; which ones is
    a walk of that many steps round them. So a row costs two hashes, whether it is drawn or not.
    """
    share = min(1.0, size / max(rows, 1))
    id_columns = [quoted(k) for k in key]
    # P(number <= m) for m = 0, 1, ...
    upto, total = [], 0.0
    for m in range(trees + 1):
        if share >= 1.0:
            total = 1.0 if m == trees else 0.0
        else:
            total += math.exp(math.lgamma(trees + 1) - math.lgamma(m + 1) - math.lgamma(trees - m + 1) + m * math.log(share) + (trees - m) * math.log1p(-share))
        upto.append(min(1.0, total))
    upto[-1] = 1.0
    u = F.pmod(F.xxhash64(*id_columns, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    drawn = z.select(*names, *id_columns, u.alias("_u")).where(F.col("_u") >= upto[0])
    limits = F.array(*[F.lit(p) for p in upto])
    many = F.size(F.filter(limits, lambda p: p <= F.col("_u")))
    # a walk round the trees by a step without a common divisor meets each once at most
    steps = F.array(*[F.lit(i) for i in range(1, trees + 1) if math.gcd(i, trees) == 1])
    h = F.xxhash64(*id_columns, F.lit(seed), F.lit(1))
    picked = drawn.withColumn("_m", many).withColumn("_at", F.pmod(h, F.lit(trees))).withColumn("_step", F.get(steps, F.pmod(F.shiftright(h, 20), F.size(steps))))
    walk = F.transform(F.sequence(F.lit(1), F.col("_m")), lambda i: F.pmod(F.col("_at") + i * F.col("_step"), F.lit(trees)).cast("int"))
    return picked.select(*names, F.explode(walk).alias("tree")).select("tree", *names)


def isolation_scores(
    df: DataFrame,
    key: Sequence[str],
    columns: Sequence[str] | None = None,
    trees: int = TREES,
    sample: int = TREE_ROWS,
    seed: int = 42,
) -> DataFrame:
    """(key..., score): higher is more isolated.

    Each tree grows in its own task on a small seeded sample; the forest (trees x
    2 x sample nodes at most) is broadcast to score every row.
    """
    cols = _columns(df, columns, key)
    z = standardised(df, cols, key)
    names = [f"_z{i}" for i in range(len(cols))]
    rows = z.count()
    limit = max(1, math.ceil(math.log2(max(2, min(sample, rows)))))

    def grow(batch: pd.DataFrame) -> pd.DataFrame:
        tree = int(batch["tree"].iloc[0])
        # order by value so that the tree does not depend on how rows arrived
        x = np.array(sorted(map(tuple, batch[names].to_numpy(float))))
        nodes = _grow(x, np.random.default_rng(seed + tree), limit)
        out = pd.DataFrame(nodes, columns=["feature", "threshold", "left", "right", "depth"])
        out.insert(0, "node", range(len(nodes)))
        out.insert(0, "size", len(x))
        out.insert(0, "tree", tree)
        return out

    schema = "tree int, size int, node int, feature int, threshold double, left int, right int, depth double"
    picked = _sample_per_tree(z, names, key, rows, trees, sample, seed)
    forest = picked.groupBy("tree").applyInPandas(grow, schema).toPandas()
    grown = [
        (g["feature"].to_numpy(), g["threshold"].to_numpy(), g["left"].to_numpy(), g["right"].to_numpy(), g["depth"].to_numpy())
        for _, g in forest.sort_values(["tree", "node"]).groupby("tree")
    ]
    usual = float(np.mean(forest.groupby("tree")["size"].first().map(_path_length))) if grown else 1.0
    shared = df.sparkSession.sparkContext.broadcast(grown)

    @F.pandas_udf("double")
    def score(*parts: pd.Series) -> pd.Series:
        x = np.column_stack([p.to_numpy(float) for p in parts])
        total = np.zeros(len(x))
        for feature, threshold, left, right, depth in shared.value:
            at = np.zeros(len(x), int)
            for _ in range(limit + 1):
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = x[np.flatnonzero(inner), f[inner]] <= threshold[at[inner]]
                at[inner] = np.where(go, left[at[inner]], right[at[inner]])
            total += depth[at]
        mean = total / max(1, len(shared.value))
        return pd.Series(np.power(2.0, -mean / max(usual, 1e-12)))

    # the threshold is applied to the score, so the constant shift of the decision value does not matter
    return z.select(*[quoted(k) for k in key], (score(*names) - 0.5).alias("score"))


# ---------------------------------------------------------------- local outlier factor


def lof_scores(
    df: DataFrame, key: str, columns: Sequence[str] | None = None, k: int = NEIGHBOURS
) -> DataFrame:
    """(key, score): local density of a row's neighbours over its own."""
    cols = _columns(df, columns, [key])
    z = standardised(df, cols, [key])
    names = [f"_z{i}" for i in range(len(cols))]
    points = materialise(z.select(quoted(key).alias("id"), F.array(*names).alias("v")))
    rows = points.count()
    near = materialise(nearest_neighbours(points, points, min(k, rows - 1), exclude_self=True))
    reach = near.groupBy("id").agg(F.max("distance").alias("_kd"))
    pairs = with_facts(near, reach, ["_kd"])
    density = materialise(pairs.groupBy("id").agg((1.0 / (F.avg(F.greatest("distance", "_kd")) + 1e-10)).alias("lrd")))
    factor = (
        with_facts(near, density.withColumnRenamed("lrd", "_nl"), ["_nl"])
        .groupBy("id")
        .agg(F.avg("_nl").alias("_nl"))
        .join(density, "id")
    )
    return factor.select(F.col("id").alias(key), (F.col("_nl") / F.col("lrd")).alias("score"))


def ensemble_scores(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(key, score): the mean of both scores after bringing each to 0..1."""
    forest = materialise(isolation_scores(df, [key], columns).withColumnRenamed("score", "a"))
    local = materialise(lof_scores(df, key, columns).withColumnRenamed("score", "b"))
    span = forest.agg(F.min("a").alias("a0"), F.max("a").alias("a1")).crossJoin(
        F.broadcast(local.agg(F.min("b").alias("b0"), F.max("b").alias("b1")))
    )
    both = forest.join(local, key).crossJoin(F.broadcast(span))
    a = (F.col("a") - F.col("a0")) / (F.col("a1") - F.col("a0") + 1e-9)
    b = (F.col("b") - F.col("b0")) / (F.col("b1") - F.col("b0") + 1e-9)
    return both.select(quoted(key), ((a + b) / 2).alias("score"))


# ---------------------------------------------------------------- results


def detect_anomalies(
    df: DataFrame,
    key: str,
    method: str = "isolation_forest",
    contamination: float = 0.05,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """(key, score, is_anomaly) for every row."""
    if method == "zscore":
        scored = zscore_scores(df, [key], columns)
    elif method == "isolation_forest":
        scored = isolation_scores(df, [key], columns)
    elif method == "lof":
        scored = lof_scores(df, key, columns)
    elif method == "ensemble":
        scored = ensemble_scores(df, key, columns)
    else:
        raise ValueError(f"unknown method {method!r}")
    if method != "zscore":
        scored = materialise(scored)
    return _flagged(scored, contamination)


def flag_anomalies(df: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The table with ``_anomaly_flag`` (Anomaly / Normal) and ``_anomaly_score``."""
    marks = found.select(
        key,
        F.when(F.col("is_anomaly"), "Anomaly").otherwise("Normal").alias("_anomaly_flag"),
        F.col("score").alias("_anomaly_score"),
    )
    return df.join(marks, key, "left")


def remove_anomalies(df: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The table without any flagged row."""
    return df.join(found.where("is_anomaly").select(key), key, "left_anti")


def contributions(df: DataFrame, found: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, contribution): distance between the mean z of flagged and of other rows."""
    cols = list(columns) if columns is not None else [c for c in numeric_columns(df) if c != key]
    z = standardised(df, cols, [key]).join(found.select(key, "is_anomaly"), key)
    rows = []
    for i, c in enumerate(cols):
        odd = F.avg(F.when(F.col("is_anomaly"), F.col(f"_z{i}")))
        usual = F.avg(F.when(~F.col("is_anomaly"), F.col(f"_z{i}")))
        rows.append([F.lit(c).alias("column"), F.abs(odd - usual).alias("contribution")])
    return aggregate_rows(z, rows).where(F.col("contribution").isNotNull()).select("column", F.round("contribution", 3).alias("contribution"))


def anomaly_summary(found: DataFrame) -> DataFrame:
    """n_total, n_anomalies, anomaly_percentage"""
    hits = F.count(F.when(F.col("is_anomaly"), 1))
    return found.agg(
        F.count("*").alias("n_total"),
        hits.alias("n_anomalies"),
        F.round(hits / F.count("*") * 100, 2).alias("anomaly_percentage"),
    )
