"""Text to numbers: one-hot, label and frequency encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.columns import quoted, text_columns
from sightline.plans.lookup import attach
from sightline.plans.longform import distinct_counts, value_counts
from sightline.plans.ranks import bucket_count, row_positions

ONE_HOT_LIMIT = 20
NULL_TEXT = "nan"


def one_hot(df: DataFrame, columns: Sequence[str] | None = None, limit: int = ONE_HOT_LIMIT) -> DataFrame:
    """Columns ``{column}_{value}`` in value order for text columns with few values; the source is dropped."""
    cols = list(columns) if columns is not None else text_columns(df)
    if not cols:
        return df
    few = [r["column"] for r in distinct_counts(df, cols).where(F.col("distinct_count") <= limit).collect()]
    chosen = [c for c in cols if c in few]
    if not chosen:
        return df
    values: dict[str, list[str]] = {c: [] for c in chosen}
    # at most ``limit`` values per column
    for r in value_counts(df, chosen).select("column", "value").orderBy("column", "value").collect():
        values[r["column"]].append(r["value"])
    dummies = [
        F.coalesce(quoted(c) == v, F.lit(False)).alias(f"{c}_{v}") for c in chosen for v in values[c]
    ]
    kept = [quoted(c) for c in df.columns if c not in chosen]
    return df.select(*kept, *dummies)


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code, count, n): the position of each distinct text in sorted order; null is the text ``nan``."""
    text = F.coalesce(quoted(column).cast("string"), F.lit(NULL_TEXT)).alias("value")
    counts = df.select(text).groupBy("value").agg(F.count("*").alias("count"))
    numbered, _ = row_positions(counts, ["value"], "code")
    total = df.agg(F.count("*").alias("n"))
    return numbered.crossJoin(F.broadcast(total))


def label_encode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Each text column replaced by its code, as bigint, in place."""
    cols = list(columns) if columns is not None else text_columns(df)
    out = df
    for c in cols:
        key = F.coalesce(quoted(c).cast("string"), F.lit(NULL_TEXT))
        codes = label_codes(df, c).withColumnRenamed("code", "_code")
        out = attach(out, key, codes, ["_code"], bucket_count(df)).withColumn(c, F.col("_code")).drop("_code")
    return out.select(*[quoted(c) for c in df.columns])


def frequency_encode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Each text column replaced by its value's share of the non-null values; null stays null."""
    cols = list(columns) if columns is not None else text_columns(df)
    out = df
    for c in cols:
        counts = df.where(quoted(c).isNotNull()).groupBy(quoted(c).cast("string").alias("value")).agg(
            F.count("*").alias("count")
        )
        total = df.agg(F.count(quoted(c)).alias("n"))
        facts = counts.crossJoin(F.broadcast(total)).withColumn("_share", F.col("count") / F.col("n"))
        out = attach(out, quoted(c).cast("string"), facts, ["_share"], bucket_count(df))
        out = out.withColumn(c, F.col("_share")).drop("_share")
    return out.select(*[quoted(c) for c in df.columns])


def encode(df: DataFrame, method: str, columns: Sequence[str] | None = None) -> DataFrame:
    methods = {"onehot": one_hot, "label": label_encode, "frequency": frequency_encode}
    if method not in methods:
        raise ValueError(f"unknown encoding {method!r}")
    return methods[method](df, columns)
