"""What the operators of this subpackage share: table access, skew-safe lookups, per-batch text work."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.plans.storage import materialise

#: A key holding more than one HEAVY-th of all rows is broadcast; there are fewer than HEAVY such keys.
HEAVY = 1000


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table, read once per use and cut to the columns asked for."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def texts(docs: DataFrame, *more: Column | str) -> DataFrame:
    """(doc_id, text, more...) with null texts as empty ones; other columns are left behind, so their names can't clash."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def packed(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, _row): every column of ``docs`` inside one struct, where no name can clash, and what joins need; _row is a hash of the text."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    return docs.select(whole, "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_row"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows whose doc_id and text are those of a row of ``gone`` (doc_id, row), all columns as they are."""
    bad = gone.select(F.col("doc_id").alias("_d"), F.col("row").alias("_r")).distinct()
    left = packed(docs).join(bad, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_row") == F.col("_r")), "left_anti")
    return left.select("doc.*")


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """``fn`` over Arrow batches; what it returns for a batch is written at once, so memory stays at one batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in whole_ids(batches):
            if len(batch) and (out := fn(batch)) is not None and len(out):
                yield out

    return split_ids(df).mapInPandas(run, schema)


def split_ids(df: DataFrame) -> DataFrame:
    """doc_id without nulls and a mark for them: pandas would read a nullable number as a float, which rounds large ids."""
    if "doc_id" not in df.columns:
        return df
    return df.withColumn("_no_id", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0).cast("bigint")))


def whole_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of a frame from ``split_ids`` with doc_id as a nullable whole number again."""
    for batch in batches:
        if "_no_id" in batch:
            gone = batch.pop("_no_id").to_numpy(bool)
            batch["doc_id"] = pd.arrays.IntegerArray(batch["doc_id"].to_numpy(np.int64), gone)
        yield batch


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def attach(rows: DataFrame, facts: DataFrame, keys: Sequence[str], fields: Sequence[str], weight: str, total: int, spread: Column, heavy: int = HEAVY) -> DataFrame:
    """``rows`` with ``fields`` of the row of ``facts`` that has the same ``keys`` (never null), null without one.

    ``weight`` in ``facts`` says how many rows have the key, ``total`` how many rows there are. Keys
    with more than total/heavy rows, fewer than ``heavy`` of them, are broadcast; the others
    join by key, and rows already settled are dealt out by ``spread``, a number that differs from
    row to row, under which they match nothing.
    """
    hot_rows = F.col(weight) * F.lit(heavy) > F.lit(total)
    names = {k: f"_k_{k}" for k in keys}
    side = [F.col(k).alias(names[k]) for k in keys]
    hot = F.broadcast(facts.where(hot_rows).select(*side, F.struct(*fields).alias("_hot")))
    # a plain literal would be folded into the join condition and leave the salt out of the shuffle's keys
    zero = F.when(F.col(weight) >= 0, F.lit(0)).otherwise(F.lit(-1)).cast("bigint")
    cold = facts.where(~hot_rows).select(*side, F.struct(*fields).alias("_cold"), zero.alias("_at"))
    same = lambda: [F.col(k) == F.col(names[k]) for k in keys]
    first = rows.join(hot, same(), "left").drop(*names.values())
    first = first.withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.lit(1 << 20)) + 1).cast("bigint"))
    out = first.join(cold, [*same(), F.col("_salt") == F.col("_at")], "left")
    return out.select(*[F.col(c) for c in rows.columns], *[F.coalesce(F.col(f"_hot.{f}"), F.col(f"_cold.{f}")).alias(f) for f in fields])


def sorted_parts(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``df`` sorted over all in parts of about equal size, in storage, with ``part``, the number of a row's part.

    Rows equal in the whole order are told apart by their place in the input, so they don't all fall to one part.
    """
    keys = [*order, "_tie"]
    placed = df.withColumn("_tie", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys).drop("_tie")
    return materialise(placed.withColumn("part", F.spark_partition_id()))


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b bigint): label is the smallest node of its connected component.

    Alternating large-star and small-star rounds: each hangs neighbours under the smallest one
    seen, so the longest path shrinks by a factor and a few rounds do. Links stay in tables; a
    round ends in a checkpoint and two sums, which say when nothing changed. Hubs are looked up
    skew-safe. An empty table gives an empty result.
    """

    def mins(e: DataFrame, total: int) -> DataFrame:
        facts = e.groupBy("a").agg(F.min("b").alias("_least"), F.count("*").alias("_n"))
        facts = facts.select("a", F.least("a", "_least").alias("m"), "_n")
        return attach(e, facts, ["a"], ["m"], "_n", total, F.col("b"))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())

    down = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(down)
    for _ in range(limit):
        both = down.select("a", "b").unionByName(down.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = mins(both, 2 * before[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        kept = mins(large, before[0])
        small = kept.select("b", "m").union(kept.select("a", "m")).toDF("a", "b").where("a <> b").distinct()
        down = materialise(small)
        after = state(down)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    return down.select(F.col("a").alias("node"), F.col("b").alias("label")).union(down.select("b", "b").distinct())
