"""Regressions from one pass of cross moments, or from MLlib's generalised linear model."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions import tails
from sightline.functions.columns import is_text, nan_to_null, quoted, require
from sightline.operators.encoding import label_encode
from sightline.operators.hypothesis import normality
from sightline.plans.gram import Moments, cross_moments, uncentred_vif
from sightline.plans.ordered import over_neighbours

MIN_ROWS = 10

COEFFICIENTS = "term string, coefficient double, std_error double, statistic double, p_value double, significant boolean"
SUMMARY = "measure string, value double"


def complete(df: DataFrame, target: str, predictors: Sequence[str], keep: Sequence[str] = (), encode_target: bool = False) -> DataFrame:
    """Rows with every column, as doubles; text predictors become codes."""
    require(df, target, *predictors, *keep)
    base = nan_to_null(df.select(*[quoted(c) for c in dict.fromkeys([*predictors, target, *keep])]))
    base = base.dropna(subset=[*predictors, target])
    texts = [c for c in predictors if is_text(df.schema[c].dataType)]
    if encode_target and is_text(df.schema[target].dataType):
        texts.append(target)
    if texts:
        base = label_encode(base, texts)
    return base.withColumns({c: quoted(c).cast("double") for c in [*predictors, target]})


def _enough(n: int) -> None:
    if n < MIN_ROWS:
        raise ValueError("Insufficient data points (need at least 10)")


class Fit:
    """A fitted model: coefficient table, summary table, and fitted values on demand."""

    def __init__(self, spark, rows: DataFrame, target: str, predictors: Sequence[str], coefficients: list, summary: dict, link: str = "identity"):
        self.rows, self.target, self.predictors, self.link = rows, target, list(predictors), link
        self.values = [c[1] for c in coefficients]
        self.summary_values = summary
        self.coefficients = spark.createDataFrame(coefficients, COEFFICIENTS)
        self.summary = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in summary.items()], SUMMARY)

    def fitted(self) -> DataFrame:
        """The complete rows with ``fitted`` and ``residual``."""
        eta = F.lit(self.values[0])
        for c, b in zip(self.predictors, self.values[1:]):
            eta = eta + quoted(c) * b
        if self.link == "logit":
            eta = 1 / (1 + F.exp(-eta))
        elif self.link == "log":
            eta = F.exp(eta)
        return self.rows.withColumn("fitted", eta).withColumn("residual", quoted(self.target) - F.col("fitted"))

    def vif(self) -> DataFrame:
        """(column, vif) of the predictors, without an intercept."""
        m = cross_moments(self.rows, self.predictors)
        rows = [(c, round(v, 2)) for c, v in uncentred_vif(m).items()]
        return self.rows.sparkSession.createDataFrame(rows, "column string, vif double")


def _row(name: str, b: float, se: float | None, stat: float | None, p: float | None) -> tuple:
    clean = [None if v is None or not math.isfinite(v) else float(v) for v in (b, se, stat, p)]
    return (name, *clean, None if clean[3] is None else clean[3] < 0.05)


def ols(df: DataFrame, target: str, predictors: Sequence[str], keep: Sequence[str] = ()) -> Fit:
    """Least squares with a constant: standard errors, R2, F, AIC and BIC from one scan."""
    rows = complete(df, target, predictors, keep)
    m = cross_moments(rows, [*predictors, target])
    _enough(m.n)
    p, n = len(predictors), m.n
    scatter, cross = m.cov[:p, :p] * n, m.cov[:p, p] * n
    inverse = np.linalg.pinv(scatter)
    b = inverse @ cross
    total = m.cov[p, p] * n
    sse = max(0.0, float(total - b @ cross))
    dof = n - p - 1
    s2 = sse / dof
    const = float(m.mean[p] - b @ m.mean[:p])
    se = np.sqrt(s2 * np.diag(inverse))
    se0 = math.sqrt(s2 * (1 / n + m.mean[:p] @ inverse @ m.mean[:p]))
    table = []
    for name, value, error in [("const", const, se0), *zip(predictors, b, se)]:
        t = value / error if error > 0 else math.inf
        table.append(_row(name, value, error, t, tails.t_two_sided(t, dof)))
    r2 = 1 - sse / total if total > 0 else 0.0
    f = (total - sse) / p / s2 if s2 > 0 else math.inf
    ll = -n / 2 * (math.log(2 * math.pi) + math.log(max(sse, 1e-300) / n) + 1)
    k = p + 1
    summary = {
        "n_observations": n,
        "r_squared": r2,
        "r_squared_adj": 1 - (1 - r2) * (n - 1) / dof,
        "f_statistic": f if math.isfinite(f) else None,
        "f_pvalue": tails.f_sf(f, p, dof),
        "log_likelihood": ll,
        "aic": -2 * ll + 2 * k,
        "bic": -2 * ll + k * math.log(n),
    }
    return Fit(df.sparkSession, rows, target, predictors, table, summary)


def durbin_watson(fit: Fit, order_by: Sequence[str]) -> DataFrame:
    """One row (durbin_watson): squared steps of the residuals over their squares, in the stated order."""
    e = fit.fitted().select(*[quoted(c) for c in order_by], "residual")
    stepped = over_neighbours(e, order_by, lambda w: {"_before": F.lag("residual").over(w)}, back=1)
    step = F.col("residual") - F.col("_before")
    return stepped.agg((F.sum(step * step) / F.sum(F.col("residual") * F.col("residual"))).alias("durbin_watson"))


def _penalised(df: DataFrame, target: str, predictors: Sequence[str], keep: Sequence[str]) -> tuple[DataFrame, Moments, np.ndarray, np.ndarray]:
    """Gram matrix over n with the constant as the first column, and X'y over n."""
    rows = complete(df, target, predictors, keep)
    m = cross_moments(rows, [*predictors, target])
    _enough(m.n)
    p = len(predictors)
    raw = m.cov + np.outer(m.mean, m.mean)
    g = np.ones((p + 1, p + 1))
    g[0, 1:] = g[1:, 0] = m.mean[:p]
    g[1:, 1:] = raw[:p, :p]
    return rows, m, g, np.concatenate([[m.mean[p]], raw[:p, p]])


def _penalised_fit(df, target, predictors, rows, m: Moments, g, c, b) -> Fit:
    p = len(predictors)
    y2 = m.cov[p, p] + m.mean[p] ** 2
    sse, total = float(y2 - 2 * b @ c + b @ g @ b), float(m.cov[p, p])
    r2 = 1 - sse / total if total > 0 else 0.0
    table = [_row(name, v, None, None, None) for name, v in zip(["const", *predictors], b)]
    return Fit(df.sparkSession, rows, target, predictors, table, {"n_observations": m.n, "r_squared": r2})


def ridge(df: DataFrame, target: str, predictors: Sequence[str], alpha: float = 1.0, keep: Sequence[str] = ()) -> Fit:
    """Squared penalty on every coefficient, the constant included."""
    rows, m, g, c = _penalised(df, target, predictors, keep)
    b = np.linalg.solve(g + alpha * np.eye(len(c)), c)
    return _penalised_fit(df, target, predictors, rows, m, g, c, b)


def lasso(df: DataFrame, target: str, predictors: Sequence[str], alpha: float = 1.0, keep: Sequence[str] = ()) -> Fit:
    """Absolute penalty on every coefficient, by coordinate descent on the p x p Gram matrix."""
    rows, m, g, c = _penalised(df, target, predictors, keep)
    b = np.zeros(len(c))
    for _ in range(100_000):
        before = b.copy()
        for j in range(len(c)):
            rest = c[j] - g[j] @ b + g[j, j] * b[j]
            b[j] = math.copysign(max(abs(rest) - alpha, 0.0), rest) / g[j, j] if g[j, j] > 0 else 0.0
        if np.abs(b - before).max() <= 1e-12 * max(1.0, np.abs(b).max()):
            break
    return _penalised_fit(df, target, predictors, rows, m, g, c, b)


def _glm(df: DataFrame, target: str, predictors: Sequence[str], family: str, link: str, keep: Sequence[str]) -> tuple[DataFrame, object]:
    rows = complete(df, target, predictors, keep, encode_target=family == "binomial")
    features = VectorAssembler(inputCols=list(predictors), outputCol="_features").transform(rows)
    features = features.select("_features", quoted(target).alias("_label"))
    glm = GeneralizedLinearRegression(
        family=family, link=link, featuresCol="_features", labelCol="_label", maxIter=100, tol=1e-10
    )
    return rows, glm.fit(features)


def _glm_table(model, predictors: Sequence[str]) -> list[tuple]:
    s = model.summary
    # MLlib lists the intercept last
    order = [len(predictors), *range(len(predictors))]
    values = [*model.coefficients, model.intercept]
    names = ["const", *predictors]
    return [
        _row(name, float(values[i]), s.coefficientStandardErrors[i], s.tValues[i], s.pValues[i])
        for name, i in zip(names, order)
    ]


def logistic(df: DataFrame, target: str, predictors: Sequence[str], keep: Sequence[str] = ()) -> Fit:
    """Binary target: McFadden's R2, likelihood, AIC, BIC, accuracy at one half."""
    rows, model = _glm(df, target, predictors, "binomial", "logit", keep)
    s = model.summary
    n, k = s.numInstances, len(predictors) + 1
    _enough(n)
    ll, ll0 = -s.deviance / 2, -s.nullDeviance / 2
    hit = ((s.predictions["prediction"] > 0.5).cast("double") == F.col("_label")).cast("double")
    accuracy = s.predictions.agg(F.avg(hit)).first()[0]
    summary = {
        "n_observations": n,
        "pseudo_r_squared": 1 - ll / ll0 if ll0 else 0.0,
        "log_likelihood": ll,
        "aic": -2 * ll + 2 * k,
        "bic": -2 * ll + k * math.log(n),
        "accuracy": accuracy,
    }
    return Fit(df.sparkSession, rows, target, predictors, _glm_table(model, predictors), summary, "logit")


def poisson(df: DataFrame, target: str, predictors: Sequence[str], keep: Sequence[str] = ()) -> Fit:
    """Count target: one less the deviance ratio, and AIC."""
    rows, model = _glm(df, target, predictors, "poisson", "log", keep)
    s = model.summary
    _enough(s.numInstances)
    summary = {
        "n_observations": s.numInstances,
        "pseudo_r_squared": 1 - s.deviance / s.nullDeviance if s.nullDeviance else 0.0,
        "aic": s.aic,
    }
    return Fit(df.sparkSession, rows, target, predictors, _glm_table(model, predictors), summary, "log")


FITTERS = {"OLS": ols, "Logistic": logistic, "Ridge": ridge, "Lasso": lasso, "Poisson": poisson}


def run_regression(df: DataFrame, target: str, predictors: Sequence[str], kind: str = "OLS", keep: Sequence[str] = ()) -> Fit:
    if kind not in FITTERS:
        raise ValueError(f"Unknown regression type: {kind}")
    return FITTERS[kind](df, target, predictors, keep=keep)


def residual_diagnostics(fit: Fit, order_by: Sequence[str]) -> DataFrame:
    """(check, statistic, p_value, passed): Kolmogorov-Smirnov against the fitted normal over all residuals, Breusch-Pagan, mean and spread.

    ``order_by`` is not needed for any of them and kept for callers that pass it.
    """
    e = fit.fitted().select("fitted", "residual")
    row = e.agg(
        F.count("*").alias("n"),
        F.avg("residual").alias("mean"),
        F.stddev_pop("residual").alias("std"),
        F.regr_r2(F.col("residual") * F.col("residual"), F.col("fitted")).alias("r2"),
    ).first()
    out = []
    if row["n"] >= 8:
        told = normality(e, "residual").first()
        out.append((told["test"], told["statistic"], told["p_value"], told["passed"]))
    bp = row["n"] * (row["r2"] or 0.0)
    p = tails.chi2_sf(bp, 1)
    out.append(("Breusch-Pagan", float(bp), float(p), bool(p > 0.05)))
    out.append(("mean_residual", row["mean"], None, None))
    out.append(("std_residual", row["std"], None, None))
    return fit.rows.sparkSession.createDataFrame(out, "check string, statistic double, p_value double, passed boolean")
