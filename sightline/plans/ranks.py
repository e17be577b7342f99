"""Ranks, order statistics and row positions with no single-task window.

Equal values are counted first, so that every (column, value) is one row however
skewed the column is. The counted rows are then sorted in ranges, whose number
follows their own count, and each range needs only the total of those before it:
a table of one row for each range and column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.columns import nan_to_null, quoted
from sightline.plans.longform import aggregate_rows
from sightline.plans.lookup import attach
from sightline.plans.storage import materialise

#: Rows of one range of a sort; what fits a task's memory many times over.
RANGE_ROWS = 1 << 20


def bucket_count(df: DataFrame) -> int:
    """A value with more than this share of the rows is looked up by broadcast."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(16, 2 * parts)


def range_count(df: DataFrame, rows: int) -> int:
    """Ranges for a sort of so many rows: as many as the data fill, and work for every core where there is enough."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(-(-rows // RANGE_ROWS), min(cores, -(-rows * 64 // RANGE_ROWS)), 1)


def counted_values(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., column, value, count) of the non-null values, in one scan; counted map-side before the shuffle."""
    base = nan_to_null(
        df.select(*[quoted(k) for k in keys], *[quoted(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)])
    )
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"_v{i}").alias("value")) for i, c in enumerate(cols)]
    long = base.select(*[quoted(k) for k in keys], F.inline(F.array(*entries))).where(F.col("value").isNotNull())
    return long.groupBy(*[quoted(k) for k in keys], "column", "value").agg(F.count("*").alias("count"))


def value_ranks(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """(keys..., column, value, count, before, rank, n) per distinct value.

    ``before`` counts the smaller values and ``rank`` is the average rank of the ties.
    Runs at once: the counted values are written, sorted in ranges and written again, so
    that the bounds of the ranges hold for all that read the result. The table itself is read once.
    """
    group = [*[quoted(k) for k in keys], "column"]
    counted = materialise(counted_values(df, cols, keys))
    parts = ranges or range_count(df, counted.count())
    order = [*group, "value"]
    placed = counted.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
    placed = materialise(placed)
    totals = placed.groupBy(*group, "_range").agg(F.sum("count").alias("_in"))
    earlier = Window.partitionBy(*group).orderBy("_range")
    totals = totals.select(
        *group,
        "_range",
        (F.sum("_in").over(earlier) - F.col("_in")).alias("_offset"),
        F.sum("_in").over(Window.partitionBy(*group)).alias("n"),
    )
    # the window needs a range and column in one task; their number of tasks is that of the ranges
    inside = Window.partitionBy("_range", *group).orderBy("value")
    running = placed.repartition(parts, "_range", *group).withColumn("_upto", F.sum("count").over(inside))
    before = F.col("_offset") + F.col("_upto") - F.col("count")
    same = F.lit(True)
    for c in [*keys, "column", "_range"]:
        same = same & F.col(f"a.{quote(c)}").eqNullSafe(F.col(f"b.{quote(c)}"))
    if not keys:
        # a row for each range and each column: the ranges follow each other through the columns
        totals = F.broadcast(totals)
    return (
        running.alias("a")
        .join(totals.alias("b"), same)
        .select(
            *[F.col(f"a.{quote(c)}") for c in [*keys, "column"]],
            "value",
            "count",
            before.alias("before"),
            (before + (F.col("count") + 1) / F.lit(2.0)).alias("rank"),
            "n",
        )
    )


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def value_moments(values: DataFrame) -> DataFrame:
    """(column, count, mean, std, min, max, skewness, kurtosis, mode) of a (column, value, count) table.

    Two scans of the counted values: the mean, then sums of powers of the distance from it. Skewness and
    kurtosis are corrected for bias, null below three and four values, 0 for a constant; the smallest of
    the most frequent values is the mode. A column without values has no row.
    """
    value, count = F.col("value"), F.col("count")
    first = values.groupBy("column").agg(
        F.sum("count").alias("_n"),
        (F.sum(value * count) / F.sum("count")).alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.min_by("value", F.struct(-count, value)).alias("mode"),
    )
    away = value - F.col("mean")
    second = (
        values.join(F.broadcast(first.select("column", "mean")), "column")  # a row for each column
        .groupBy("column")
        .agg(*[F.sum(F.pow(away, F.lit(float(p))) * count).alias(f"_m{p}") for p in (2, 3, 4)])
    )
    n = F.col("_n").cast("double")
    differ = (F.col("max") > F.col("min")) & (F.col("_m2") > 0)
    var = F.col("_m2") / n
    skew = F.col("_m3") / n / F.pow(var, F.lit(1.5)) * F.sqrt(n * (n - 1)) / (n - 2)
    heavy = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (F.col("_m4") / n / (var * var) - 3) + 6)
    return first.join(F.broadcast(second), "column").select(
        "column",
        F.col("_n").alias("count"),
        "mean",
        F.when(n > 1, F.when(F.col("max") > F.col("min"), F.sqrt(F.col("_m2") / (n - 1))).otherwise(0.0)).alias("std"),
        "min",
        "max",
        F.when(n > 2, F.when(differ, skew).otherwise(0.0)).alias("skewness"),
        F.when(n > 3, F.when(differ, heavy).otherwise(0.0)).alias("kurtosis"),
        "mode",
    )


def quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    keys: Sequence[str] = (),
    accuracy: int | None = None,
) -> DataFrame:
    """(keys..., column, q): exact linearly interpolated quantiles, ``q`` aligned with ``probs``.

    ``accuracy`` switches to the sketch-based approximation.
    """
    plist = [float(p) for p in probs]
    if accuracy is not None:
        return _direct(df, cols, keys, lambda c: F.percentile_approx(c, plist, accuracy))
    return selected_quantiles(value_ranks(df, cols, keys), plist, keys)


def _direct(df: DataFrame, cols: Sequence[str], keys: Sequence[str], fn) -> DataFrame:
    rows = [[F.lit(c).alias("column"), fn(quoted(c).cast("double")).alias("q")] for c in cols]
    if not keys:
        return aggregate_rows(df, rows)
    packed = F.array(*[F.struct(*r) for r in rows]).alias("_rows")
    return df.groupBy(*[quoted(k) for k in keys]).agg(packed).select(*[quoted(k) for k in keys], F.inline("_rows"))


def selected_quantiles(ranks: DataFrame, probs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Quantiles of a table of value ranks: at most two values are picked for each column and probability."""
    targets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(probs)])
    spot = (F.col("n") - 1) * F.col("t.p")
    low, high = F.floor(spot), F.ceil(spot)
    last = F.col("before") + F.col("count") - 1
    hits = (
        ranks.select("*", F.explode(targets).alias("t"))
        .where((F.col("before") <= high) & (last >= low))
        .groupBy(*keys, "column", F.col("t.i").alias("i"))
        .agg(
            F.max(F.when((F.col("before") <= low) & (last >= low), F.col("value"))).alias("lo"),
            F.max(F.when((F.col("before") <= high) & (last >= high), F.col("value"))).alias("hi"),
            F.first(spot - low).alias("f"),
        )
    )
    point = F.col("lo") + F.col("f") * (F.col("hi") - F.col("lo"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("i"), point.alias("v"))))
    return hits.groupBy(*keys, "column").agg(F.transform(ordered, lambda s: s["v"]).alias("q"))


def attach_ranks(df: DataFrame, cols: Sequence[str], prefix: str = "_r") -> DataFrame:
    """Every row with the average rank of each column's value, as ``prefix`` + index.

    The rank table is kept, since every column and both sides of the lookup read it.
    """
    heavy = bucket_count(df)
    ranks = materialise(value_ranks(df, cols))
    rows = df
    for i, c in enumerate(cols):
        mine = ranks.where(F.col("column") == c).withColumnRenamed("rank", f"{prefix}{i}")
        rows = attach(rows, quoted(c).cast("double"), mine, [f"{prefix}{i}"], heavy)
    return rows


def row_positions(df: DataFrame, order_by: Sequence[str], out: str = "_pos") -> tuple[DataFrame, int]:
    """Zero-based position of each row in a total order, and the row count.

    Range partitions, as many as the rows fill, a sort inside each, and one offset per partition. The frame
    is checkpointed so that partition numbers cannot change under a retry. Every
    column joins the sort, so the order does not depend on the input's layout.
    """
    rest = [c for c in df.columns if c not in order_by]
    keys = [quoted(c).asc_nulls_first() for c in [*order_by, *rest]]
    placed = df.repartitionByRange(range_count(df, df.count()), *keys).sortWithinPartitions(*keys)
    placed = materialise(placed.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_part")).count().collect()
    offsets, total = [], 0
    for r in sorted(sizes, key=lambda r: r["_part"]):
        offsets.append((r["_part"], total))
        total += r["count"]
    # one row per partition of the sort
    table = df.sparkSession.createDataFrame(offsets, "_part bigint, _start bigint")
    local = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.withColumn("_part", part).join(F.broadcast(table), "_part")
    return numbered.withColumn(out, F.col("_start") + local).select(*df.columns, out), total
