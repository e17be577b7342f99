"""Cross moments of a feature set in one scan; everything p x p after that is driver algebra."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.columns import nan_to_null, quoted

# Beyond this many columns one aggregate per pair costs more than a pass in numpy.
WIDE = 12


@dataclass(frozen=True)
class Moments:
    """Row count, means and population covariances of complete rows."""

    columns: tuple[str, ...]
    n: int
    mean: np.ndarray
    cov: np.ndarray

    def index(self, name: str) -> int:
        return self.columns.index(name)

    def raw(self) -> np.ndarray:
        """X'X without centring."""
        return self.n * (self.cov + np.outer(self.mean, self.mean))

    def pick(self, names: Sequence[str]) -> Moments:
        idx = [self.index(c) for c in names]
        return Moments(tuple(names), self.n, self.mean[idx], self.cov[np.ix_(idx, idx)])


def complete_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return nan_to_null(df.select(*[quoted(c).cast("double").alias(c) for c in cols])).dropna()


def cross_moments(df: DataFrame, cols: Sequence[str]) -> Moments:
    """Moments of the rows that have every column."""
    cols = list(cols)
    base = complete_rows(df, cols)
    return _wide(base, cols) if len(cols) > WIDE else _narrow(base, cols)


def _narrow(base: DataFrame, cols: list[str]) -> Moments:
    p = len(cols)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    row = base.agg(
        F.count("*").alias("n"),
        *[F.avg(quoted(c)).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.covar_pop(quoted(cols[i]), quoted(cols[j])).alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    mean = np.array([row[f"m{i}"] if row[f"m{i}"] is not None else np.nan for i in range(p)])
    cov = np.zeros((p, p))
    for i, j in pairs:
        v = row[f"c{i}_{j}"]
        cov[i, j] = cov[j, i] = np.nan if v is None else v
    return Moments(tuple(cols), row["n"], mean, cov)


def _wide(base: DataFrame, cols: list[str]) -> Moments:
    """Many features: each task sums its own outer products, centred on the global mean."""
    p = len(cols)
    means = base.agg(F.count("*"), *[F.avg(quoted(c)) for c in cols]).first()
    n, mean = means[0], np.array([np.nan if v is None else v for v in means[1:]])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((p, p))
        for batch in batches:
            x = batch[cols].to_numpy(float) - mean
            total += x.T @ x
        i, j = np.triu_indices(p)
        yield pd.DataFrame({"i": i, "j": j, "s": total[i, j]})

    sums = base.mapInPandas(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    cov = np.zeros((p, p))
    for r in sums:
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["s"] / max(n, 1)
    return Moments(tuple(cols), n, mean, cov)


def uncentred_vif(m: Moments) -> dict[str, float]:
    """Variance inflation without an intercept: G_ii times the i-th diagonal of G's inverse."""
    return _inflation(m.raw(), m.columns)


def centred_vif(m: Moments) -> dict[str, float]:
    return _inflation(m.cov * m.n, m.columns)


def _inflation(g: np.ndarray, names: Sequence[str]) -> dict[str, float]:
    scale = np.sqrt(np.diag(g))
    r = g / np.outer(scale, scale)
    if np.linalg.cond(r) > 1e14:
        return {c: float("inf") for c in names}
    inverse = np.linalg.inv(r)
    return {c: float(inverse[i, i]) for i, c in enumerate(names)}
