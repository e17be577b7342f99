"""Correlation matrices in long form, and variance inflation."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.columns import count_if, nan_to_null, numeric_columns, quoted
from sightline.plans.gram import centred_vif, cross_moments, uncentred_vif
from sightline.plans.longform import aggregate_rows
from sightline.plans.ranks import attach_ranks
from sightline.plans.storage import materialise

MATRIX = "col_a string, col_b string, r double"


def correlation(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """(col_a, col_b, r) for every ordered pair of numeric columns, pairwise complete."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    base = nan_to_null(df.select(*[quoted(c).cast("double").alias(c) for c in cols]))
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], MATRIX)
    if method == "pearson":
        upper = _pearson(base, cols)
    elif method == "spearman":
        upper = _spearman(base, cols)
    elif method == "kendall":
        upper = _kendall(base, cols)
    else:
        raise ValueError(f"unknown method {method!r}")
    r = F.when(F.isnan("r"), None).otherwise(F.col("r"))
    upper = upper.select("col_a", "col_b", r.alias("r"))
    off = F.col("col_a") != F.col("col_b")
    return upper.select(
        F.inline(
            F.when(
                off,
                F.array(
                    F.struct(F.col("col_a").alias("col_a"), F.col("col_b").alias("col_b"), F.col("r").alias("r")),
                    F.struct(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), F.col("r").alias("r")),
                ),
            ).otherwise(
                F.array(F.struct(F.col("col_a").alias("col_a"), F.col("col_b").alias("col_b"), F.col("r").alias("r")))
            )
        )
    )


def _pearson(base: DataFrame, cols: list[str]) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    return aggregate_rows(
        base, [[F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.corr(quoted(a), quoted(b)).alias("r")] for a, b in pairs]
    )


def _spearman(base: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson on average ranks.

    Columns without nulls are ranked once and share one aggregate; a pair with
    nulls is ranked anew within its complete rows.
    """
    holes = base.agg(*[count_if(quoted(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    full = [c for i, c in enumerate(cols) if holes[i] == 0]
    out = None
    if full:
        ranked = attach_ranks(base.select(*full), full)
        pairs = [(i, j) for i in range(len(full)) for j in range(i, len(full))]
        out = aggregate_rows(
            ranked,
            [
                [F.lit(full[i]).alias("col_a"), F.lit(full[j]).alias("col_b"), F.corr(f"_r{i}", f"_r{j}").alias("r")]
                for i, j in pairs
            ],
        )
    for i, a in enumerate(cols):
        for b in cols[i:]:
            if a in full and b in full:
                continue
            one = spearman_pair(base, a, b).select(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), "r")
            out = one if out is None else out.unionByName(one)
    return out


def spearman_pair(base: DataFrame, a: str, b: str) -> DataFrame:
    """One row (r, n) over the rows that have both columns."""
    rows = base.select(quoted(a).cast("double").alias("x"), quoted(b).cast("double").alias("y")).dropna()
    return attach_ranks(rows, ["x", "y"]).agg(F.corr("_r0", "_r1").alias("r"), F.count("*").alias("n"))


# ---------------------------------------------------------------- Kendall

# A block of at most this many distinct points is counted in one task.
PAIR_BLOCK_ROWS = 200_000
CUTS = 64
# Up to this many blocks their edges are broadcast.
BROADCAST_BLOCKS = 2000


def _inversions(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted concordant and discordant pairs of one block, x and y both differing.

    A Fenwick tree over y ranks, read and updated one run of equal x at a time.
    """
    order = np.lexsort((y, x))
    x, w = x[order], w[order]
    ranks = np.unique(y[order], return_inverse=True)[1] + 1
    size = int(ranks.max()) if len(ranks) else 0
    tree = [0] * (size + 1)
    total, con, dis = 0, 0, 0

    def upto(i: int) -> int:
        s = 0
        while i > 0:
            s += tree[i]
            i &= i - 1
        return s

    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.array([], int)
    bounds = [*starts.tolist(), len(x)]
    ranks, w = ranks.tolist(), w.tolist()
    for s, e in zip(bounds[:-1], bounds[1:]):
        for k in range(s, e):
            below = upto(ranks[k] - 1)
            con += w[k] * below
            dis += w[k] * (total - upto(ranks[k]))
        for k in range(s, e):
            i = ranks[k]
            while i <= size:
                tree[i] += w[k]
                i += i & -i
            total += w[k]
    return float(con), float(dis)


def _block(batch: pd.DataFrame) -> pd.DataFrame:
    con, dis = _inversions(batch["p"].to_numpy(), batch["q"].to_numpy(), batch["cnt"].to_numpy())
    return pd.DataFrame({"con": [con], "dis": [dis]})


def _grid(batch: pd.DataFrame) -> pd.DataFrame:
    """Pairs of one block whose buckets differ on both axes, from the bucket counts."""
    cells = np.zeros((int(batch["bp"].max()) + 1, int(batch["bq"].max()) + 1))
    cells[batch["bp"].to_numpy(), batch["bq"].to_numpy()] = batch["cnt"].to_numpy()
    below, above = np.zeros_like(cells), np.zeros_like(cells)
    below[1:, 1:] = cells.cumsum(0).cumsum(1)[:-1, :-1]
    above[1:, :-1] = cells[:, ::-1].cumsum(0).cumsum(1)[:, ::-1][:-1, 1:]
    return pd.DataFrame({"con": [float((cells * below).sum())], "dis": [float((cells * above).sum())]})


def _bucket(value: str, edges: str) -> Column:
    """Even numbers between edges, odd ones for values on an edge, which are alone there."""
    at = F.size(F.filter(edges, lambda e: e < F.col(value)))
    return (at * 2 + F.array_contains(edges, F.col(value)).cast("int")).cast("int")


def _pair_counts(points: DataFrame) -> tuple[float, float]:
    """Concordant and discordant pairs of (p, q, cnt), however many there are.

    A block too large for one task is cut into quantile buckets on both axes. Pairs
    that differ in both buckets follow from the bucket counts. Those sharing a p
    bucket form a block of their own, and those sharing only a q bucket another, with
    the p bucket in place of p; each is cut again while it is too large. A value
    common enough to be an edge is alone in its bucket, where all pairs are ties.
    """
    con = dis = 0.0
    blocks = materialise(points.select(F.lit("").alias("block"), "p", "q", "cnt"))
    while True:
        sizes = materialise(blocks.groupBy("block").agg(F.count("*").alias("rows")))
        large = sizes.where(F.col("rows") > PAIR_BLOCK_ROWS)
        number = large.count()
        hint = F.broadcast if number <= BROADCAST_BLOCKS else (lambda t: t)
        small = blocks.join(hint(large), "block", "left_anti")
        parts = [small.groupBy("block").applyInPandas(_block, "con double, dis double")]
        if number:
            big = blocks.join(hint(large.select("block")), "block", "left_semi")
            probs = [i / CUTS for i in range(1, CUTS)]
            edges = big.groupBy("block").agg(
                *[F.array_distinct(F.percentile_approx(c, probs, 20 * CUTS)).alias(f"e{c}") for c in ("p", "q")]
            )
            cut = big.join(hint(edges), "block").select(
                "block", "p", "q", "cnt", _bucket("p", "ep").alias("bp"), _bucket("q", "eq").alias("bq")
            )
            cells = cut.groupBy("block", "bp", "bq").agg(F.sum("cnt").alias("cnt"))
            parts.append(cells.groupBy("block").applyInPandas(_grid, "con double, dis double"))
        for part in parts:
            row = part.agg(F.sum("con"), F.sum("dis")).first()
            con, dis = con + (row[0] or 0.0), dis + (row[1] or 0.0)
        if not number:
            return con, dis

        def inside(axis: str, p: Column) -> DataFrame:
            name = F.concat("block", F.lit(axis), F.col(f"b{axis}").cast("string"), F.lit("/"))
            return cut.where(F.col(f"b{axis}") % 2 == 0).select(name.alias("block"), p.alias("p"), "q", "cnt")

        deeper = inside("p", F.col("p")).unionByName(inside("q", F.col("bp").cast("double")))
        blocks = materialise(deeper.groupBy("block", "p", "q").agg(F.sum("cnt").alias("cnt")))


def kendall_pair(base: DataFrame, a: str, b: str) -> DataFrame:
    """One row (r, n): tau-b with ties corrected. Equal points are one point with a weight."""
    rows = base.select(quoted(a).cast("double").alias("p"), quoted(b).cast("double").alias("q")).dropna()
    counted = materialise(rows.groupBy("p", "q").agg(F.count("*").alias("cnt")))
    con, dis = _pair_counts(counted)

    def ties(col: str):
        per = counted.groupBy(col).agg(F.sum("cnt").cast("double").alias("c"))
        return per.agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("t"), F.sum("c").alias("n")).first()

    x, y = ties("p"), ties("q")
    n = x["n"] or 0.0
    pairs = n * (n - 1) / 2
    span = math.sqrt((pairs - (x["t"] or 0)) * (pairs - (y["t"] or 0)))
    tau = (con - dis) / span if span > 0 else None
    return base.sparkSession.createDataFrame([(tau, int(n))], "r double, n bigint")


def _kendall(base: DataFrame, cols: list[str]) -> DataFrame:
    out = None
    for i, a in enumerate(cols):
        for b in cols[i:]:
            one = kendall_pair(base, a, b).select(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), "r")
            out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- derived


def strong_pairs(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.7, method: str = "pearson") -> DataFrame:
    """(col_a, col_b, r, direction) for each unordered pair at or beyond the threshold."""
    return (
        correlation(df, columns, method)
        .where((F.col("col_a") < F.col("col_b")) & (F.abs("r") >= threshold))
        .select("col_a", "col_b", "r", F.when(F.col("r") > 0, "positive").otherwise("negative").alias("direction"))
    )


def variance_inflation(df: DataFrame, columns: Sequence[str] | None = None, centred: bool = False) -> DataFrame:
    """(column, vif, level), largest first; constant columns are left out, infinite values dropped."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    m = cross_moments(df, cols)
    varied = [c for i, c in enumerate(cols) if m.n > 1 and m.cov[i, i] > 0]
    rows = []
    if len(varied) >= 2:
        fn = centred_vif if centred else uncentred_vif
        rows = [(c, round(v, 2)) for c, v in fn(m.pick(varied)).items() if np.isfinite(v)]
    table = df.sparkSession.createDataFrame(rows, "column string, vif double")
    level = F.when(F.col("vif") > 10, "high").when(F.col("vif") > 5, "moderate").otherwise("low")
    return table.select("column", "vif", level.alias("level")).orderBy(F.desc("vif"), "column")
