"""Stationarity tests, autocorrelation, decomposition and period detection."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import tails
from sightline.operators.timeseries import prepare
from sightline.plans.gram import Moments, cross_moments
from sightline.plans.ordered import chunk_rows, windowed
from sightline.plans.ranks import row_positions

# MacKinnon's (1994) response surface for the p-value of the test with a constant.
ADF_SPLIT, ADF_LOW, ADF_HIGH = -1.61, -18.83, 2.74
ADF_SMALL_P = (2.1659, 1.4412, 0.038269)
ADF_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)

# MacKinnon's (2010) critical values with a constant, in powers of 1/n.
ADF_CRITICAL = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809, 0.0),
}

# Level-stationarity table of Kwiatkowski and others (1992).
KPSS_P = (0.10, 0.05, 0.025, 0.01)
KPSS_CRITICAL = (0.347, 0.463, 0.574, 0.739)

STATIONARITY = (
    "test string, statistic double, p_value double, lags int, nobs bigint, critical_1pct double, critical_5pct double, "
    "critical_10pct double, stationary boolean, conclusion string"
)
ACF = (
    "lag int, acf double, acf_lower double, acf_upper double, pacf double, pacf_lower double, pacf_upper double, "
    "bound double, acf_significant boolean, pacf_significant boolean"
)


class Series:
    """An ordered series without nulls: rows numbered once and kept."""

    def __init__(self, df: DataFrame, ts: str, value: str, tie_breakers: Sequence[str] = ()):
        base = prepare(df, ts, value, tie_breakers).where(F.col("value").isNotNull())
        numbered, self.n = row_positions(base, ["ts", *tie_breakers])
        self.rows = numbered.select("ts", "value", "_pos")
        self.spark = df.sparkSession

    def chunk(self, reach: int) -> int:
        return max(1, reach, chunk_rows(self.rows, self.n, max(reach, 1)))

    def centred(self) -> DataFrame:
        mean = self.rows.agg(F.avg("value").alias("_mean"))
        return self.rows.crossJoin(F.broadcast(mean)).select("_pos", (F.col("value") - F.col("_mean")).alias("d"))

    def lag_products(self, lags: int) -> np.ndarray:
        """Sums of d(t) d(t-k) for k = 0..lags, from one pass."""
        names = [f"_l{k}" for k in range(1, lags + 1)]
        shifted = windowed(
            self.centred(),
            lambda w: {f"_l{k}": F.lag("d", k).over(w) for k in range(1, lags + 1)},
            self.chunk(lags),
            lags,
            0,
        )
        row = shifted.agg(F.sum(F.col("d") * F.col("d")), *[F.sum(F.col("d") * F.col(c)) for c in names]).first()
        return np.array([v or 0.0 for v in row])


# ---------------------------------------------------------------- unit roots


def _fit(m: Moments, target: str, names: Sequence[str]) -> tuple[np.ndarray, float, np.ndarray]:
    """Slopes, residual sum of squares and inverse scatter of a fit with a constant."""
    idx, t = [m.index(c) for c in names], m.index(target)
    scatter = m.cov[np.ix_(idx, idx)] * m.n
    cross = m.cov[idx, t] * m.n
    inverse = np.linalg.pinv(scatter)
    b = inverse @ cross
    return b, float(m.cov[t, t] * m.n - b @ cross), inverse


def adf(series: Series, max_lag: int | None = None) -> dict:
    """Augmented Dickey-Fuller with a constant; the lag is chosen by AIC on a common sample."""
    n = series.n
    top = math.ceil(12.0 * (n / 100.0) ** 0.25) if max_lag is None else max_lag
    top = max(0, min(top, n // 2 - 2))

    def columns(w):
        out = {"_y": F.lag("value").over(w)}
        out["_dy"] = F.col("value") - out["_y"]
        for k in range(1, top + 1):
            out[f"_d{k}"] = F.lag("value", k).over(w) - F.lag("value", k + 1).over(w)
        return out

    frame = windowed(series.rows, columns, series.chunk(top + 1), top + 1, 0)
    names = ["_dy", "_y", *[f"_d{k}" for k in range(1, top + 1)]]
    m = cross_moments(frame, names)
    best, best_aic = 0, math.inf
    for lag in range(top + 1):
        _, sse, _ = _fit(m, "_dy", names[1 : 2 + lag])
        k = lag + 2
        aic = m.n * (math.log(2 * math.pi) + math.log(max(sse, 1e-300) / m.n) + 1) + 2 * k
        if aic < best_aic:
            best, best_aic = lag, aic
    final = m if best == top else cross_moments(frame, names[: 2 + best])
    b, sse, inverse = _fit(final, "_dy", names[1 : 2 + best])
    dof = final.n - (best + 2)
    stat = float(b[0] / math.sqrt(sse / dof * inverse[0, 0]))
    if stat > ADF_HIGH:
        p = 1.0
    elif stat < ADF_LOW:
        p = 0.0
    else:
        poly = ADF_SMALL_P if stat <= ADF_SPLIT else ADF_LARGE_P
        p = tails.normal_cdf(sum(c * stat**i for i, c in enumerate(poly)))
    critical = {k: sum(c / final.n**i for i, c in enumerate(cs)) for k, cs in ADF_CRITICAL.items()}
    return {"statistic": stat, "p_value": p, "lags": best, "nobs": final.n, "critical": critical, "stationary": p < 0.05}


def _prefix_energy(series: Series) -> float:
    """Sum of squared running sums of the centred series: chunk totals first, then inside each chunk."""
    size = series.chunk(1)
    placed = series.centred().withColumn("_chunk", F.floor(F.col("_pos") / size))
    totals = placed.groupBy("_chunk").agg(F.sum("d").alias("_t"))
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    # one row per chunk
    starts = totals.select("_chunk", F.coalesce(F.sum("_t").over(earlier), F.lit(0.0)).alias("_start"))
    inside = Window.partitionBy("_chunk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = placed.join(F.broadcast(starts), "_chunk").select((F.col("_start") + F.sum("d").over(inside)).alias("s"))
    return running.agg(F.sum(F.col("s") * F.col("s"))).first()[0] or 0.0


def kpss(series: Series) -> dict:
    """Level stationarity with the data-dependent lag rule of Hobijn and others."""
    n = series.n
    first = int(n ** (2.0 / 9.0))
    g = series.lag_products(first)
    s0, s1 = g[0] / n, 0.0
    for i in range(1, first + 1):
        part = g[i] / (n / 2.0)
        s0 += part
        s1 += i * part
    ratio = s1 / s0 if s0 else 0.0
    lags = min(int(1.1447 * (ratio * ratio) ** (1.0 / 3.0) * n ** (1.0 / 3.0)), n - 1)
    if lags > first:
        g = series.lag_products(lags)
    spread = g[0] + sum(2 * g[i] * (1 - i / (lags + 1)) for i in range(1, lags + 1))
    stat = _prefix_energy(series) / n**2 / (spread / n) if spread > 0 else 0.0
    p = float(np.interp(stat, KPSS_CRITICAL, KPSS_P))
    critical = {"10%": KPSS_CRITICAL[0], "5%": KPSS_CRITICAL[1], "1%": KPSS_CRITICAL[3]}
    return {"statistic": float(stat), "p_value": p, "lags": lags, "nobs": n, "critical": critical, "stationary": bool(p > 0.05)}


def stationarity(df: DataFrame, ts: str, value: str, tie_breakers: Sequence[str] = (), max_lag: int | None = None) -> DataFrame:
    """Rows for adf, kpss and their joint conclusion; at least 20 values."""
    series = Series(df, ts, value, tie_breakers)
    if series.n < 20:
        raise ValueError("Need at least 20 data points")
    a, k = adf(series, max_lag), kpss(series)
    joint = {
        (True, True): "Both tests agree: series is stationary.",
        (False, False): "Both tests agree: series is non-stationary. Apply differencing.",
        (True, False): "Tests disagree: series may be trend-stationary. Consider detrending.",
        (False, True): "Tests disagree: series may have a unit root with drift. Investigate further.",
    }[(a["stationary"], k["stationary"])]
    rows = []
    for name, t in (("adf", a), ("kpss", k)):
        c = t["critical"]
        word = "Series is stationary" if t["stationary"] else "Series is non-stationary"
        rows.append((name, t["statistic"], t["p_value"], t["lags"], t["nobs"], c["1%"], c["5%"], c["10%"], t["stationary"], word))
    both = a["stationary"] and k["stationary"]
    rows.append(("joint", None, None, None, series.n, None, None, None, both, joint))
    return df.sparkSession.createDataFrame(rows, STATIONARITY)


# ---------------------------------------------------------------- autocorrelation


def autocorrelation(df: DataFrame, ts: str, value: str, nlags: int = 40, tie_breakers: Sequence[str] = ()) -> DataFrame:
    """lag, acf and pacf with 95 % limits, and which lags pass 1.96 / sqrt(n)."""
    series = Series(df, ts, value, tie_breakers)
    n = series.n
    lags = min(nlags, n // 2 - 1)
    if lags < 2:
        raise ValueError("Insufficient data points")
    g = series.lag_products(lags)
    r = g / g[0]
    z = tails.normal_ppf(0.975)
    spread = [0.0, 1.0 / n] + [(1 + 2 * float((r[1:k] ** 2).sum())) / n for k in range(2, lags + 1)]
    partial = _levinson(np.array([g[0] / n] + [g[k] / (n - k) for k in range(1, lags + 1)]))
    bound, side = 1.96 / math.sqrt(n), z / math.sqrt(n)
    rows = []
    for k in range(lags + 1):
        half = z * math.sqrt(spread[k])
        edge = 0.0 if k == 0 else side
        rows.append(
            (
                k, float(r[k]), float(r[k] - half), float(r[k] + half), float(partial[k]), float(partial[k] - edge),
                float(partial[k] + edge), bound, bool(k > 0 and abs(r[k]) > bound), bool(k > 0 and abs(partial[k]) > bound),
            )
        )
    return df.sparkSession.createDataFrame(rows, ACF)


def _levinson(c: np.ndarray) -> np.ndarray:
    """Partial autocorrelations from autocovariances by the order recursion."""
    out = np.zeros(len(c))
    out[0] = 1.0
    phi = np.zeros(0)
    noise = c[0]
    for k in range(1, len(c)):
        reflection = (c[k] - phi @ c[k - 1 : 0 : -1]) / noise if k > 1 else c[1] / noise
        phi = np.append(phi - reflection * phi[::-1], reflection)
        noise *= 1 - reflection * reflection
        out[k] = reflection
    return out


# ---------------------------------------------------------------- decomposition


def decompose(
    df: DataFrame,
    ts: str,
    value: str,
    period: int | None = None,
    model: str = "additive",
    tie_breakers: Sequence[str] = (),
) -> DataFrame:
    """(ts, observed, trend, seasonal, residual, period): classical decomposition by a centred moving average."""
    if model not in ("additive", "multiplicative"):
        raise ValueError(f"unknown model {model!r}")
    series = Series(df, ts, value, tie_breakers)
    if series.n < 10:
        raise ValueError("Need at least 10 data points")
    if period is None:
        period = dominant_period(series)
    if period < 2 or period >= series.n // 2:
        period = min(12, series.n // 3)
    half = period // 2
    additive = model == "additive"

    def columns(w):
        if period % 2:
            frame = w.rowsBetween(-half, half)
            full = F.count("value").over(frame) == period
            return {"trend": F.when(full, F.avg("value").over(frame))}
        frame, core = w.rowsBetween(-half, half), w.rowsBetween(-(half - 1), half - 1)
        ends = F.lag("value", half).over(w) + F.lead("value", half).over(w)
        full = F.count("value").over(frame) == period + 1
        inner = F.sum("value").over(core)
        return {"trend": F.when(full, (inner + ends / 2) / period)}

    out = windowed(series.rows, columns, series.chunk(half), half, half)
    left = F.col("value") - F.col("trend") if additive else F.col("value") / F.col("trend")
    out = out.withColumns({"_phase": F.col("_pos") % period, "_left": left})
    phases = out.groupBy("_phase").agg(F.avg("_left").alias("_m"))  # one row per phase
    level = phases.agg(F.avg("_m").alias("_level"))
    seasonal = F.col("_m") - F.col("_level") if additive else F.col("_m") / F.col("_level")
    table = phases.crossJoin(F.broadcast(level)).select("_phase", seasonal.alias("seasonal"))
    out = out.join(F.broadcast(table), "_phase")
    rest = F.col("_left") - F.col("seasonal") if additive else F.col("_left") / F.col("seasonal")
    return out.select(
        "ts", F.col("value").alias("observed"), "trend", "seasonal", rest.alias("residual"), F.lit(period).alias("period")
    )


def trend_strength(parts: DataFrame) -> DataFrame:
    """One row (trend_strength): 1 - var(residual) / var(trend + residual)."""
    both = parts.where(F.col("residual").isNotNull() & F.col("trend").isNotNull())
    row = both.agg(F.var_samp("residual").alias("r"), F.var_samp(F.col("trend") + F.col("residual")).alias("t"))
    return row.select(
        F.when(F.col("r") > 0, F.round(1 - F.col("r") / F.nullif(F.col("t"), F.lit(0.0)), 3)).otherwise(F.lit(0.0)).alias("trend_strength")
    )


# ---------------------------------------------------------------- period

ONE_TASK_VALUES = 1 << 20


def _grid_transform(frame: DataFrame, n1: int, n2: int, inverse: bool) -> DataFrame:
    """The discrete Fourier transform of (i, re, im), i < n1 * n2, absent entries being zero.

    Index i = a * n2 + b. Columns of the grid are transformed in tasks by b, turned,
    and rows in tasks by the new index: two shuffles, groups of n1 and n2 values.
    """
    m = n1 * n2
    sign = 1.0 if inverse else -1.0
    fft = np.fft.ifft if inverse else np.fft.fft

    def first(batch: pd.DataFrame) -> pd.DataFrame:
        b = int(batch["b"].iloc[0])
        x = np.zeros(n1, complex)
        x[batch["a"].to_numpy()] = batch["re"].to_numpy() + 1j * batch["im"].to_numpy()
        k = np.arange(n1)
        y = fft(x) * np.exp(sign * 2j * np.pi * ((k * b) % m) / m)
        return pd.DataFrame({"k": k, "b": b, "re": y.real, "im": y.imag})

    def second(batch: pd.DataFrame) -> pd.DataFrame:
        k1 = int(batch["k"].iloc[0])
        x = np.zeros(n2, complex)
        x[batch["b"].to_numpy()] = batch["re"].to_numpy() + 1j * batch["im"].to_numpy()
        y = fft(x)
        return pd.DataFrame({"i": np.arange(n2) * n1 + k1, "re": y.real, "im": y.imag})

    cells = frame.select(F.floor(F.col("i") / n2).cast("bigint").alias("a"), (F.col("i") % n2).alias("b"), "re", "im")
    columns = cells.groupBy("b").applyInPandas(first, "k bigint, b bigint, re double, im double")
    return columns.groupBy("k").applyInPandas(second, "i bigint, re double, im double")


def spectrum(series: Series, one_task: int = ONE_TASK_VALUES) -> DataFrame:
    """(frequency, magnitude) for every frequency 0..n//2 of the centred series."""
    n = series.n
    centred = series.centred()
    if n <= one_task:

        def whole(batches):
            rows = pd.concat(list(batches)).sort_values("_pos")
            if len(rows):
                size = np.abs(np.fft.rfft(rows["d"].to_numpy()))
                yield pd.DataFrame({"frequency": np.arange(len(size)), "magnitude": size})

        return centred.coalesce(1).mapInPandas(whole, "frequency bigint, magnitude double")
    # any length, as a convolution with a chirp on a power-of-two grid
    bits = math.ceil(math.log2(2 * n - 1))
    n1, n2 = 1 << (bits // 2), 1 << (bits - bits // 2)
    m = n1 * n2

    @F.pandas_udf("struct<re double, im double>")
    def chirp(i: pd.Series, sign: pd.Series) -> pd.DataFrame:
        k = i.to_numpy(object)
        phase = np.array([(int(v) * int(v)) % (2 * n) for v in k], float) * np.pi / n
        return pd.DataFrame({"re": np.cos(phase), "im": sign.to_numpy(float) * np.sin(phase)})

    spun = centred.withColumn("c", chirp("_pos", F.lit(-1.0))).select(
        F.col("_pos").alias("i"), (F.col("d") * F.col("c.re")).alias("re"), (F.col("d") * F.col("c.im")).alias("im")
    )
    ahead = series.spark.range(n).select(F.col("id").alias("j")).withColumn("c", chirp("j", F.lit(1.0)))
    wave = ahead.select(F.col("j").alias("i"), "c.re", "c.im").unionByName(
        ahead.where("j > 0").select((F.lit(m) - F.col("j")).alias("i"), "c.re", "c.im")
    )
    a, b = _grid_transform(spun, n1, n2, False), _grid_transform(wave, n1, n2, False)
    product = a.alias("a").join(b.alias("b"), "i").select(
        "i",
        (F.col("a.re") * F.col("b.re") - F.col("a.im") * F.col("b.im")).alias("re"),
        (F.col("a.re") * F.col("b.im") + F.col("a.im") * F.col("b.re")).alias("im"),
    )
    back = _grid_transform(product, n1, n2, True).where(F.col("i") <= n // 2)
    return back.select(F.col("i").alias("frequency"), F.hypot("re", "im").alias("magnitude"))


def dominant_period(series: Series) -> int:
    """The length of the strongest cycle past the first two frequencies, kept within 2..n//3."""
    n = series.n
    if n < 20:
        return 7
    strongest = (
        spectrum(series)
        .where(F.col("frequency") >= 2)
        .agg(F.min_by("frequency", F.struct(-F.col("magnitude"), F.col("frequency"))).alias("f"))
        .first()["f"]
    )
    return min(max(2, n // int(strongest)), n // 3)


def detect_period(df: DataFrame, ts: str, value: str, tie_breakers: Sequence[str] = ()) -> DataFrame:
    """One row (n, period)."""
    series = Series(df, ts, value, tie_breakers)
    return df.sparkSession.createDataFrame([(series.n, dominant_period(series))], "n bigint, period int")
