"""The tables behind charts: no raw rows leave Spark unless a chart is made of rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions.columns import as_timestamp, count_if, nan_to_null, quoted, require, share
from sightline.functions.tails import normal_ppf
from sightline.operators.profile import sample_rows
from sightline.plans.ranks import quantiles, value_ranks


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, count): equal bins from the minimum to the maximum, the last one closed, empty ones kept."""
    require(df, column)
    base = nan_to_null(df.select(quoted(column).cast("double").alias("x"))).where(F.col("x").isNotNull())
    span = base.agg(F.min("x").alias("a"), F.max("x").alias("b")).where(F.col("a").isNotNull())
    width = (F.col("b") - F.col("a")) / bins
    spot = F.when(F.col("b") > F.col("a"), F.floor((F.col("x") - F.col("a")) / width)).otherwise(F.lit(0))
    counts = (
        base.crossJoin(F.broadcast(span))
        .groupBy(F.least(spot, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count("*").alias("count"))
    )
    every = span.select("a", width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (F.col("a") + F.col("w") * F.col("bin")).alias("low"),
        (F.col("a") + F.col("w") * (F.col("bin") + 1)).alias("high"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
    )


def box(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """(group, n, min, q1, median, q3, max, mean, lower_whisker, upper_whisker, outliers)."""
    require(df, column, *([by] if by else []))
    group = quoted(by).cast("string") if by else F.lit("all")
    base = nan_to_null(df.select(group.alias("group"), quoted(column).cast("double").alias("x")))
    base = base.where(F.col("x").isNotNull())
    q = quantiles(base, ["x"], [0.25, 0.5, 0.75], ["group"]).select(
        "group", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    low, high = F.col("q1") - reach, F.col("q3") + reach
    x = F.col("x")
    joined = base.join(q, "group")
    inside = (x >= low) & (x <= high)
    return joined.groupBy("group").agg(
        F.count("*").alias("n"),
        F.min("x").alias("min"),
        F.max("q1").alias("q1"),
        F.max("median").alias("median"),
        F.max("q3").alias("q3"),
        F.max("x").alias("max"),
        F.avg("x").alias("mean"),
        F.min(F.when(inside, x)).alias("lower_whisker"),
        F.max(F.when(inside, x)).alias("upper_whisker"),
        count_if(~inside).alias("outliers"),
    )


def top_values(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    """(value, count, percentage): the most common values, ties by value; a bar takes 20, a pie 10."""
    require(df, column)
    counts = df.where(quoted(column).isNotNull()).groupBy(quoted(column).cast("string").alias("value")).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("all"))
    best = counts.orderBy(F.desc("count"), "value").limit(top)
    return best.crossJoin(F.broadcast(total)).select("value", "count", share(F.col("count"), F.col("all"), 100).alias("percentage"))


def points(df: DataFrame, columns: Sequence[str], key: Sequence[str], rows: int = 5000, seed: int = 42) -> DataFrame:
    """A repeatable sample of chosen columns, for scatter, line, bubble, pair and parallel charts."""
    require(df, *columns, *key)
    chosen = list(dict.fromkeys([*key, *columns]))
    return sample_rows(df.select(*[quoted(c) for c in chosen]), key, rows, seed)


def trend_lines(df: DataFrame, x: str, y: str, colour: str | None = None) -> DataFrame:
    """(colour, n, slope, intercept, r2): a least-squares line per colour group over all rows."""
    require(df, x, y, *([colour] if colour else []))
    group = quoted(colour).cast("string") if colour else F.lit("all")
    base = nan_to_null(
        df.select(group.alias("colour"), quoted(x).cast("double").alias("x"), quoted(y).cast("double").alias("y"))
    ).dropna(subset=["x", "y"])
    return base.groupBy("colour").agg(
        F.count("*").alias("n"),
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r2"),
    )


def grouped_bar(df: DataFrame, x: str, y: str, colour: str) -> DataFrame:
    """(x, colour, total)"""
    require(df, x, y, colour)
    return df.groupBy(quoted(x).alias("x"), quoted(colour).alias("colour")).agg(F.sum(quoted(y)).alias("total"))


def hierarchy(df: DataFrame, path: Sequence[str], values: str | None = None) -> DataFrame:
    """(depth, path columns..., value): a count or sum at each level of a path, the root included."""
    require(df, *path, *([values] if values else []))
    measure: Column = F.sum(quoted(values)) if values else F.count("*")
    levels = df.rollup(*[quoted(c) for c in path]).agg(measure.alias("value"), F.grouping_id().alias("_g"))
    # the k lowest bits are set where k levels are rolled up
    depth = F.lit(len(path)) - F.bit_count(F.col("_g"))
    return levels.select(depth.cast("int").alias("depth"), *[quoted(c) for c in path], "value")


def time_line(df: DataFrame, ts: str, value: str, colour: str | None = None) -> DataFrame:
    """(colour, ts, value) in time order, for line and area charts."""
    require(df, ts, value)
    group = quoted(colour).cast("string") if colour else F.lit("all")
    base = df.select(group.alias("colour"), as_timestamp(df, ts).alias("ts"), quoted(value).cast("double").alias("value"))
    return base.where(F.col("ts").isNotNull()).orderBy("ts", "colour", "value")


def candles(df: DataFrame, ts: str, value: str, width: str = "1 day", tie_breakers: Sequence[str] = ()) -> DataFrame:
    """(ts, open, high, low, close, n): one candle per window of ticks; works on a stream too."""
    require(df, ts, value, *tie_breakers)
    order = F.struct(quoted(ts), *[quoted(t) for t in tie_breakers], quoted(value))
    v = quoted(value).cast("double")
    return (
        df.where(quoted(value).isNotNull() & quoted(ts).isNotNull())
        .groupBy(F.window(quoted(ts), width).alias("w"))
        .agg(
            F.min_by(v, order).alias("open"),
            F.max(v).alias("high"),
            F.min(v).alias("low"),
            F.max_by(v, order).alias("close"),
            F.count("*").alias("n"),
        )
        .select(F.col("w.start").alias("ts"), "open", "high", "low", "close", "n")
    )


def frames(df: DataFrame, frame: str, x: str, y: str, colour: str | None = None) -> DataFrame:
    """(frame, x, colour, total, n): sums per animation frame."""
    require(df, frame, x, y)
    group = quoted(colour).cast("string") if colour else F.lit("all")
    return df.groupBy(quoted(frame).alias("frame"), quoted(x).alias("x"), group.alias("colour")).agg(
        F.sum(quoted(y)).alias("total"), F.count("*").alias("n")
    )


def null_pattern(df: DataFrame, key: Sequence[str], rows: int = 100, seed: int = 42) -> DataFrame:
    """The key and a 0/1 column per table column, for up to ``rows`` sampled rows."""
    picked = sample_rows(nan_to_null(df), key, rows, seed)
    return picked.select(
        *[quoted(k).alias(f"key_{k}") for k in key], *[quoted(c).isNull().cast("int").alias(c) for c in df.columns]
    )


# Runs of equal values up to this long are summed position by position.
SUMMED_RUN = 20_000


def _filliben(i: int, n: int) -> float:
    """Plotting position of the i-th of n ordered values."""
    top = 0.5 ** (1.0 / n)
    return 1.0 - top if i == 1 else top if i == n else (i - 0.3175) / (n + 0.365)


@F.pandas_udf(T.DoubleType())
def _normal_place(position: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([normal_ppf(_filliben(int(i), int(size))) for i, size in zip(position, n)], dtype=float)


def _run_sums(first: int, last: int, n: int) -> tuple[float, float]:
    """Sums of z and z^2 over positions first..last.

    A long run is summed at both ends and integrated between: there the positions are
    so dense that the midpoint rule is exact to rounding.
    """
    if last - first < SUMMED_RUN:
        z = [normal_ppf(_filliben(i, n)) for i in range(first, last + 1)]
        return sum(z), sum(v * v for v in z)
    edge = SUMMED_RUN // 2
    a, b = first + edge, last - edge
    low, high = (a - 0.5 - 0.3175) / (n + 0.365), (b + 0.5 - 0.3175) / (n + 0.365)
    zl, zh = normal_ppf(low), normal_ppf(high)
    dl, dh = (math.exp(-z * z / 2) / math.sqrt(2 * math.pi) for z in (zl, zh))
    parts = [_run_sums(first, a - 1, n), _run_sums(b + 1, last, n)]
    s = (n + 0.365) * (dl - dh)
    q = (n + 0.365) * (high - low - (zh * dh - zl * dl))
    return s + sum(p[0] for p in parts), q + sum(p[1] for p in parts)


@F.pandas_udf(T.StructType([T.StructField("s", T.DoubleType()), T.StructField("q", T.DoubleType())]))
def _normal_run(before: pd.Series, count: pd.Series, n: pd.Series) -> pd.DataFrame:
    sums = [_run_sums(int(b) + 1, int(b) + int(c), int(size)) for b, c, size in zip(before, count, n)]
    return pd.DataFrame(sums, columns=["s", "q"], dtype=float)


def quantile_plot(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Ordered values against normal quantiles (theoretical, value, count), and the line through them.

    A repeated value is one row with its range of positions: ``first`` and ``last`` are
    the quantiles of its first and last copy.
    """
    require(df, column)
    base = nan_to_null(df.select(quoted(column).cast("double").alias("x"))).where(F.col("x").isNotNull())
    ranks = value_ranks(base, ["x"])

    spots = ranks.select(
        "value",
        "count",
        _normal_place(F.col("before") + 1, "n").alias("first"),
        _normal_place(F.col("before") + F.col("count"), "n").alias("last"),
        _normal_run("before", "count", "n").alias("_z"),
        "n",
    )
    v = F.col("value")
    row = spots.agg(
        F.max("n").alias("n"),
        F.sum("_z.s").alias("sz"),
        F.sum("_z.q").alias("szz"),
        F.sum(v * F.col("count")).alias("sv"),
        F.sum(v * F.col("_z.s")).alias("svz"),
        F.sum(v * v * F.col("count")).alias("svv"),
    )
    n = F.col("n")
    szz, svz = F.col("szz") - F.col("sz") ** 2 / n, F.col("svz") - F.col("sz") * F.col("sv") / n
    svv = F.col("svv") - F.col("sv") ** 2 / n
    line = row.select(
        "n",
        (svz / szz).alias("slope"),
        ((F.col("sv") - svz / szz * F.col("sz")) / n).alias("intercept"),
        (svz / F.sqrt(szz * svv)).alias("r"),
    )
    return spots.select("value", "count", "first", "last"), line
