"""Outlier counts by the quartile fence or by standard deviations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.columns import count_if, nan_to_null, numeric_columns, quoted, share
from sightline.plans.longform import aggregate_rows, spreads
from sightline.plans.ranks import quantiles


def _numbers(df: DataFrame, columns: Sequence[str] | None) -> tuple[DataFrame, list[str]]:
    cols = list(columns) if columns is not None else numeric_columns(df)
    return nan_to_null(df.select(*[quoted(c).cast("double").alias(c) for c in cols])), cols


def fences(df: DataFrame, cols: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """(column, lower_bound, upper_bound): quartiles widened by 1.5 times their distance."""
    q1, q3 = F.col("q")[0], F.col("q")[1]
    reach = (q3 - q1) * 1.5
    return quantiles(df, cols, [0.25, 0.75], accuracy=accuracy).select(
        "column", (q1 - reach).alias("lower_bound"), (q3 + reach).alias("upper_bound")
    )


def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """column, outlier_count, outlier_pct, lower_bound, upper_bound"""
    base, cols = _numbers(df, columns)
    bounds = fences(base, cols, accuracy)
    row = spreads(bounds, cols, {"lower_bound": "_lo", "upper_bound": "_hi"})
    rows = []
    for i, c in enumerate(cols):
        x = quoted(c)
        out = count_if((x < F.col(f"_lo{i}")) | (x > F.col(f"_hi{i}")))
        rows.append([F.lit(c).alias("column"), out.alias("outlier_count"), share(out, F.count(x), 100).alias("outlier_pct")])
    counts = aggregate_rows(base.crossJoin(F.broadcast(row)), rows)
    return counts.join(F.broadcast(bounds), "column", "left").select(
        "column", "outlier_count", "outlier_pct", "lower_bound", "upper_bound"
    )


def zscore_outliers(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 3.0) -> DataFrame:
    """column, outlier_count, outlier_pct: values beyond ``threshold`` population deviations."""
    base, cols = _numbers(df, columns)
    row = base.agg(
        *[F.avg(quoted(c)).alias(f"_m{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(quoted(c)).alias(f"_s{i}") for i, c in enumerate(cols)],
    )
    rows = []
    for i, c in enumerate(cols):
        x = quoted(c)
        out = count_if(F.abs(x - F.col(f"_m{i}")) > F.col(f"_s{i}") * threshold)
        rows.append([F.lit(c).alias("column"), out.alias("outlier_count"), share(out, F.count(x), 100).alias("outlier_pct")])
    return aggregate_rows(base.crossJoin(F.broadcast(row)), rows)
