"""Windows over a long ordered series, cut into chunks that overlap by a few rows.

A window without keys, or with one very long key, would run in a single task.
Rows are numbered instead, cut into equal chunks by position, and the rows next
to a border are copied to the neighbouring chunk, where they are read but not
returned.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.columns import quoted
from sightline.plans.ranks import row_positions

MAX_CHUNK = 1_000_000


def chunk_rows(df: DataFrame, total: int, reach: int) -> int:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    even = -(-total // max(1, parts))
    return max(1, 4 * reach, min(MAX_CHUNK, max(even, 10_000)))


def over_neighbours(
    df: DataFrame,
    order_by: Sequence[str],
    columns: Callable[[Window], Mapping[str, Column]],
    back: int = 0,
    ahead: int = 0,
    keys: Sequence[str] = (),
    chunk: int | None = None,
) -> DataFrame:
    """``df`` plus window columns that look at most ``back`` rows behind and ``ahead`` rows on.

    ``columns`` builds the expressions from an ordered window. ``_pos`` (position in
    the whole) is kept.
    """
    numbered, total = row_positions(df, [*keys, *order_by])
    size = chunk or chunk_rows(df, total, max(back, ahead, 1))
    size = max(size, back, ahead, 1)
    return windowed(numbered, columns, size, back, ahead, keys)


def windowed(
    numbered: DataFrame,
    columns: Callable[[Window], Mapping[str, Column]],
    size: int,
    back: int,
    ahead: int,
    keys: Sequence[str] = (),
) -> DataFrame:
    home = F.floor(F.col("_pos") / size)
    offset = F.col("_pos") % size
    copies = [F.struct(home.alias("_chunk"), F.lit(False).alias("_edge"))]
    if back:
        copies.append(F.when(offset >= size - back, F.struct((home + 1).alias("_chunk"), F.lit(True).alias("_edge"))))
    if ahead:
        copies.append(
            F.when((offset < ahead) & (home > 0), F.struct((home - 1).alias("_chunk"), F.lit(True).alias("_edge")))
        )
    placed = numbered.select("*", F.inline(F.array_compact(F.array(*copies))))
    window = Window.partitionBy(*[quoted(k) for k in keys], "_chunk").orderBy("_pos")
    return placed.withColumns(dict(columns(window))).where(~F.col("_edge")).drop("_chunk", "_edge")


def key_positions(numbered: DataFrame, keys: Sequence[str], out: str = "_kpos") -> DataFrame:
    """Zero-based position inside each key; rows are numbered with the key leading."""
    if not keys:
        return numbered.withColumn(out, F.col("_pos"))
    starts = numbered.groupBy(*[quoted(k) for k in keys]).agg(F.min("_pos").alias("_first"))
    return numbered.join(starts, list(keys)).withColumn(out, F.col("_pos") - F.col("_first")).drop("_first")


def carry(
    df: DataFrame, order_by: Sequence[str], cols: Sequence[str], forward: bool = True, keys: Sequence[str] = ()
) -> DataFrame:
    """Nulls replaced by the nearest earlier (or later) non-null value in the order.

    Each chunk fills itself; what is still null takes the last value of an earlier
    chunk, found in a table of one row per key and chunk.
    """
    numbered, total = row_positions(df, [*keys, *order_by])
    size = chunk_rows(df, total, 1)
    placed = numbered.withColumn("_chunk", F.floor(F.col("_pos") / size))
    names = [quoted(k) for k in keys]
    pick = F.max_by if forward else F.min_by
    edge = placed.groupBy(*names, "_chunk").agg(
        *[pick(quoted(c), F.when(quoted(c).isNotNull(), F.col("_pos"))).alias(f"_e{i}") for i, c in enumerate(cols)]
    )
    order = F.col("_chunk").asc() if forward else F.col("_chunk").desc()
    earlier = Window.partitionBy(*names).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.select(
        *names, "_chunk", *[F.last(f"_e{i}", ignorenulls=True).over(earlier).alias(f"_e{i}") for i in range(len(cols))]
    )
    joined = placed.join(edge, [*keys, "_chunk"], "left")
    pos = F.col("_pos").asc() if forward else F.col("_pos").desc()
    inside = Window.partitionBy(*names, "_chunk").orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = {
        c: F.coalesce(F.last(quoted(c), ignorenulls=True).over(inside), F.col(f"_e{i}")) for i, c in enumerate(cols)
    }
    return joined.withColumns(filled).select(*[quoted(c) for c in df.columns])
