"""Labelled training rows: the fold that may be learned from, a bounded sample of it, logistic fitting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on, at most: those with the smallest hash of doc_id.
SAMPLE = 12_000


def fold(folds: int) -> Column:
    """crc32 of the doc_id as text, modulo ``folds``; null for a null doc_id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)).cast("int")


def labelled(docs: DataFrame, labels: DataFrame, column: str, folds: int, held: int, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, label) of a bounded sample of the labelled documents outside fold ``held``.

    A label other than 0 and 1, null labels and rows without a doc_id are left out; of a document
    labelled twice the larger label counts. The sample is drawn from the label table, which is narrow.
    """
    known = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).alias("label"))
    chosen = known.where(fold(folds) != held).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most ``sample`` rows of two numbers
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")


def gather(frame: DataFrame) -> pd.DataFrame:
    """A bounded sample's features on the driver, in a fixed order."""
    got = frame.toPandas()
    return got.sort_values([c for c in got.columns if got[c].map(np.isscalar).all()]).reset_index(drop=True) if len(got) else got


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights (intercept first) by Newton steps with a ridge on all but the intercept."""
    design = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(design.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = sigmoid(design @ w)
        grad = design.T @ (p - y) + penalty * w
        step = np.linalg.solve((design * (p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag(penalty), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def logistic_rows(rows: DataFrame, fields: list[str], target: str, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """``logistic`` over all rows of a table: each step's gradient and curvature are summed by Spark, a few numbers reach the driver."""
    size = len(fields) + 1
    w, penalty = np.zeros(size), np.full(size, ridge)
    penalty[0] = 1e-6
    names = [f"s{i}" for i in range(size + size * size)]

    def sums(at: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(len(names))
            for batch in batches:
                design = np.column_stack([np.ones(len(batch)), batch[fields].to_numpy(float)])
                p = sigmoid(design @ at)
                curve = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design
                total += np.concatenate((design.T @ (p - batch[target].to_numpy(float)), curve.ravel()))
            yield pd.DataFrame([total], columns=names)

        made = rows.select(*fields, target).mapInPandas(run, ", ".join(f"{n} double" for n in names))
        return np.array(made.agg(*[F.sum(n) for n in names]).first(), float)

    for _ in range(rounds):
        found = sums(w)
        step = np.linalg.solve(found[size:].reshape(size, size) + np.diag(penalty), found[:size] + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w
