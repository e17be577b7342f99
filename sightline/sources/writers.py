"""Writers: every sink is a folder of part files, one per task."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sightline.operators.profile import describe_all


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One object per row."""
    df.write.option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def write_statistics(df: DataFrame, path: str) -> None:
    """The statistics table: a few rows, so one file."""
    describe_all(df).coalesce(1).write.option("header", True).csv(path)
