"""Attach a per-value fact to every row without one task owning a common value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.columns import quoted


def attach(rows: DataFrame, key: Column, facts: DataFrame, fields: Sequence[str], heavy: int) -> DataFrame:
    """``rows`` with ``fields`` of the row of ``facts`` whose ``value`` equals ``key``, null without one.

    ``facts`` also holds ``count`` (rows having the value) and ``n`` (all rows).
    Values holding more than 1/heavy of the rows, of which there are fewer than
    ``heavy``, are broadcast. Their rows, and rows without a key, carry a spread
    salt into the join by value, where they match nothing.
    """
    # not a plain literal: that would be folded and leave the salt out of the keys of the shuffle
    zero = F.when(F.col("count") >= 0, F.lit(0)).otherwise(F.lit(-1)).cast("bigint")
    common = F.col("count") * F.lit(heavy) > F.col("n")
    hot = facts.where(common).select(F.col("value").alias("_hv"), F.struct(*fields).alias("_hf"))
    cold = facts.where(~common).select(
        F.col("value").alias("_cv"), F.struct(*fields).alias("_cf"), zero.alias("_cs")
    )
    # a number for each row, so that identical rows part as well
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)) + 1
    keyed = rows.withColumn("_key", key).withColumn("_spread", spread)
    keyed = keyed.join(F.broadcast(hot), F.col("_key") == F.col("_hv"), "left")
    settled = F.col("_hf").isNotNull() | F.col("_key").isNull()
    keyed = keyed.withColumn("_salt", F.when(settled, F.col("_spread")).otherwise(F.lit(0).cast("bigint")))
    keyed = keyed.join(cold, F.col("_key").eqNullSafe(F.col("_cv")) & (F.col("_salt") == F.col("_cs")), "left")
    found = F.coalesce("_hf", "_cf")
    return keyed.select(*[quoted(c) for c in rows.columns], *[found[f].alias(f) for f in fields])

