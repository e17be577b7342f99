"""Operators on a streaming DataFrame.

Type fixes (``apply_type_fixes``), masking (``mask_columns``) and candles work on a
stream as they are. Here are the two that need something a stream cannot look up:
bounds learned beforehand, and windows that close by watermark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.columns import quoted, require
from sightline.operators.timeseries import AGGREGATES, bin_aggregate


def zscore_bounds(history: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column of a table at rest: two numbers per column."""
    require(history, *columns)
    row = history.agg(
        *[F.avg(quoted(c)).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(quoted(c)).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


def flag_by_bounds(df: DataFrame, bounds: dict[str, tuple[float, float]], cut: float = 3.0) -> DataFrame:
    """``_anomaly_score`` (largest absolute z under fixed bounds) and ``_anomaly_flag``."""
    parts = [F.abs((quoted(c) - m) / (s or 1.0)) for c, (m, s) in bounds.items()]
    score = F.greatest(*parts) if len(parts) > 1 else parts[0]
    flag = F.when(score > cut, "Anomaly").otherwise("Normal")
    return df.withColumns({"_anomaly_score": score, "_anomaly_flag": flag})


def resample_stream(
    df: DataFrame, ts: str, value: str, width: str, agg: str = "mean", watermark: str | None = None
) -> DataFrame:
    """(ts, value): one row per window that has rows; with a watermark late rows are left out."""
    require(df, ts, value)
    if agg not in AGGREGATES:
        raise ValueError(f"unknown aggregate {agg!r}")
    base = df.select(quoted(ts).alias("ts"), quoted(value).cast("double").alias("value")).where(F.col("ts").isNotNull())
    if watermark is not None:
        base = base.withWatermark("ts", watermark)
    windows = base.groupBy(F.window("ts", width).alias("w")).agg(bin_aggregate(agg, F.struct("ts", "value")).alias("value"))
    return windows.select(F.col("w.start").alias("ts"), "value")
