"""Wide to long: one row per column, or per column and value."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.columns import quoted


def aggregate_rows(df: DataFrame, rows: Sequence[Sequence[Column]]) -> DataFrame:
    """One global aggregate in a single scan, handed back as one row per entry."""
    structs = [F.struct(*row) for row in rows]
    return df.agg(F.array(*structs).alias("rows")).select(F.inline("rows"))


def melt(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), dtype: str = "string") -> DataFrame:
    """(keys..., column, value) for non-null values, all cast to one type."""
    base = df.select(*[quoted(k) for k in keys], *[quoted(c).cast(dtype).alias(c) for c in cols])
    return base.unpivot(list(keys), list(cols), "column", "value").where(F.col("value").isNotNull())


def value_counts(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), dtype: str = "string") -> DataFrame:
    """(keys..., column, value, count): combined map-side, so a hot value is one row per task."""
    return melt(df, cols, keys, dtype).groupBy(*keys, "column", "value").agg(F.count("*").alias("count"))


def distinct_counts(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    """(column, distinct_count), with 0 for an all-null column."""
    if approximate:
        return aggregate_rows(
            df,
            [[F.lit(c).alias("column"), F.approx_count_distinct(quoted(c)).alias("distinct_count")] for c in cols],
        )
    names = _names(df, cols)
    found = value_counts(df, cols).groupBy("column").agg(F.count("*").alias("distinct_count"))
    return names.join(F.broadcast(found), "column", "left").select(
        "column", F.coalesce("distinct_count", F.lit(0).cast("bigint")).alias("distinct_count")
    )


def modes(df: DataFrame, cols: Sequence[str], dtype: str = "string") -> DataFrame:
    """(column, mode, mode_count): the most frequent value, the smallest on a tie."""
    counts = value_counts(df, cols, dtype=dtype)
    return counts.groupBy("column").agg(most_common().alias("mode"), F.max("count").alias("mode_count"))


def most_common() -> Column:
    """The value with the highest count in a counted group, the smallest on a tie."""
    return F.min_by(F.col("value"), F.struct(-F.col("count"), F.col("value")))


def _names(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column name, in table order, without reading the table."""
    spark = df.sparkSession
    entries = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column")) for i, c in enumerate(cols)])
    return spark.range(1, numPartitions=1).select(F.inline(entries))


def column_names(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(position, column)"""
    return _names(df, cols)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier row, nulls being equal."""
    counted = df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count("*").alias("_copies"))
    return counted.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def spread(table: DataFrame, cols: Sequence[str], field: str, prefix: str) -> DataFrame:
    """A (column, field) table as one row with a field per column, ready to broadcast."""
    return spreads(table, cols, {field: prefix})


def spreads(table: DataFrame, cols: Sequence[str], fields: Mapping[str, str]) -> DataFrame:
    """``spread`` of several fields, each with its prefix, in one pass over the table."""
    return table.agg(*[F.max(F.when(F.col("column") == c, F.col(f))).alias(f"{p}{i}") for f, p in fields.items() for i, c in enumerate(cols)])


HEAD_ROWS = 256


def first_values(df: DataFrame, cols: Sequence[str], order_by: Sequence[str], samples: int) -> DataFrame:
    """(column, samples): the first non-null values in a stated, unique order, as text.

    The first few hundred rows nearly always hold them. A column that is still short
    is searched through the whole table.
    """
    keys = [quoted(c) for c in order_by]
    texts = [quoted(c).cast("string").alias(f"c{i}") for i, c in enumerate(cols)]
    head = df.orderBy(*keys).select(*texts).limit(HEAD_ROWS).collect()
    found = {c: [r[i] for r in head if r[i] is not None][:samples] for i, c in enumerate(cols)}
    short = [c for c in cols if len(found[c]) < samples] if len(head) == HEAD_ROWS else []
    rows = [(c, v) for c, v in found.items() if c not in short]
    table = df.sparkSession.createDataFrame(rows, "column string, samples array<string>")
    return table.unionByName(_search_first(df, short, order_by, samples)) if short else table


def _search_first(df: DataFrame, cols: Sequence[str], order_by: Sequence[str], samples: int) -> DataFrame:
    """One scan per sample whatever the number of columns: each takes, for every column,
    the smallest (order, value) beyond the one found before."""
    order = F.struct(*[quoted(c) for c in order_by])
    base = df.select(
        *[
            F.when(quoted(c).isNotNull(), F.struct(order.alias("k"), quoted(c).cast("string").alias("v"))).alias(f"_c{i}")
            for i, c in enumerate(cols)
        ]
    )
    found = base.agg(*[F.min(f"_c{i}").alias(f"f0_{i}") for i in range(len(cols))])
    for j in range(1, samples):
        kept = [f"f{a}_{i}" for a in range(j) for i in range(len(cols))]
        found = base.crossJoin(F.broadcast(found)).agg(
            *[F.first(k, ignorenulls=True).alias(k) for k in kept],
            *[
                F.min(F.when(F.col(f"_c{i}") > F.col(f"f{j - 1}_{i}"), F.col(f"_c{i}"))).alias(f"f{j}_{i}")
                for i in range(len(cols))
            ],
        )
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.filter(F.array(*[F.col(f"f{j}_{i}.v") for j in range(samples)]), lambda v: v.isNotNull()).alias("samples"),
        )
        for i, c in enumerate(cols)
    ]
    return found.select(F.inline(F.array(*entries)))
