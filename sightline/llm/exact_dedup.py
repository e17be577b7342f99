"""Exact de-duplication by progressive refinement: length, then a prefix hash, then the full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import attach, documents, texts
from sightline.llm.registry import query
from sightline.plans.storage import materialise

PREFIX = 64


def exact_groups(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are compared as they are; null counts as empty, so null and empty texts are one group.
    The row with the largest doc_id of equal texts is kept, a null doc_id only if there is no
    other. Rows repeated with the same doc_id and text count in group_size and are all marked
    kept when theirs is the kept id. An empty table gives an empty result; only doc_id and text
    are read.

    Refinement: (1) rows are counted by length; (2) of lengths that occur twice, by length and a hash
    of the first ``prefix`` characters; (3) only texts whose length and prefix are shared are compared
    by their full SHA-256. Both counts combine before the shuffle, no text is shuffled, and
    what comes back to a row is looked up skew-safe, so a group may hold any share of the rows.
    The digest column, which the result owes every row, is taken in the same scan.
    """
    scanned = texts(docs).select(
        "doc_id",
        F.octet_length("text").cast("bigint").alias("_len"),
        F.xxhash64(F.substring("text", 1, prefix)).alias("_prefix"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )
    rows = materialise(scanned)
    total = rows.count()
    by_length = rows.groupBy("_len").agg(F.count("*").alias("_n")).where("_n > 1")
    by_prefix = attach(rows.groupBy("_len", "_prefix").agg(F.count("*").alias("_m")).where("_m > 1"), by_length, ["_len"], ["_n"], "_n", total, F.col("_prefix")).where("_n is not null")
    survivors = attach(rows, by_prefix, ["_len", "_prefix"], ["_m"], "_m", total, F.col("doc_id"))
    rows2 = materialise(survivors.withColumn("_open", F.col("_m").isNotNull()).drop("_m", "_prefix"))
    full = rows2.where("_open").groupBy("_len", "text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    out = attach(rows2, full, ["_len", "text_sha256"], ["keep_id", "group_size"], "group_size", total, F.col("doc_id"))
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


@query("op9_exact_dedup", SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir, "doc_id", "text"))
