"""Correlation, hypothesis tests and regressions against brute force and pandas."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from sightline.functions import tails
from sightline.operators import correlation, hypothesis, regression
from sightline.operators import timeseries as ts
from sightline.operators import ts_tests


def frame(spark, data, parts=3):
    return spark.createDataFrame(pd.DataFrame(data)).repartition(parts)


def tau_b(x, y):
    s = nx = ny = 0
    for (a, b), (c, d) in itertools.combinations(list(zip(x, y)), 2):
        s += np.sign(a - c) * np.sign(b - d)
        nx += a != c
        ny += b != d
    return s / math.sqrt(nx * ny)


@pytest.mark.parametrize("bucket", [8, 25, 10**6])
def test_kendall_matches_brute_force(spark, bucket, monkeypatch):
    monkeypatch.setattr(correlation, "PAIR_BLOCK_ROWS", bucket)
    monkeypatch.setattr(correlation, "CUTS", 3)
    rng = np.random.default_rng(2)
    x = np.where(rng.random(120) < 0.4, 3.0, rng.integers(0, 12, 120)).astype(float)
    y = (x + rng.integers(0, 9, 120)).astype(float)
    got = correlation.kendall_pair(frame(spark, {"x": x, "y": y}), "x", "y").first()
    assert got["n"] == 120
    assert got["r"] == pytest.approx(tau_b(x, y), abs=1e-12)


def test_spearman_with_nulls_is_pairwise(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.integers(0, 6, (80, 3)).astype(float), columns=list("abc"))
    pdf.loc[rng.random(80) < 0.2, "b"] = np.nan
    got = correlation.correlation(frame(spark, pdf), method="spearman").toPandas()
    for r in got.itertuples():
        both = pdf[[r.col_a, r.col_b]].dropna().to_numpy() if r.col_a != r.col_b else None
        want = 1.0 if both is None else pd.Series(both[:, 0]).rank().corr(pd.Series(both[:, 1]).rank())
        assert r.r == pytest.approx(want, abs=1e-9)


def test_kruskal_and_mann_whitney(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"g": ["a"] * 30 + ["b"] * 40, "v": np.r_[rng.integers(0, 9, 30), rng.integers(2, 12, 40)].astype(float)})
    got = hypothesis.mann_whitney(frame(spark, pdf), "v", "g").first()
    r = pdf["v"].rank()
    u = r[:30].sum() - 30 * 31 / 2
    t = pdf["v"].value_counts()
    sd = math.sqrt(30 * 40 / 12 * (71 - ((t**3 - t).sum()) / (70 * 69)))
    assert got["statistic"] == pytest.approx(u)
    assert got["p_value"] == pytest.approx(2 * tails.normal_sf((max(u, 1200 - u) - 600 - 0.5) / sd))
    # with two groups H is the squared z without continuity correction
    h = hypothesis.kruskal_wallis(frame(spark, pdf), "v", "g").first()
    assert h["statistic"] == pytest.approx(((u - 600) / sd) ** 2)


def test_mann_whitney_exact_small(spark):
    pdf = {"g": list("aaabbb"), "v": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]}
    got = hypothesis.mann_whitney(frame(spark, pdf), "v", "g").first()
    assert got["statistic"] == 0
    assert got["p_value"] == pytest.approx(2 / math.comb(6, 3))


def test_t_test_and_anova_agree(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": ["a"] * 20 + ["b"] * 25, "v": np.r_[rng.normal(size=20), rng.normal(0.7, 1, 25)]})
    t = hypothesis.t_test(frame(spark, pdf), "v", "g").first()
    f = hypothesis.anova(frame(spark, pdf), "v", "g").first()
    assert t["statistic"] ** 2 == pytest.approx(f["statistic"])
    assert t["p_value"] == pytest.approx(f["p_value"])


def test_chi_square_counts_empty_cells(spark):
    pdf = pd.DataFrame({"a": ["x"] * 10 + ["y"] * 10 + ["z"] * 5, "b": ["p"] * 10 + ["q"] * 10 + ["p"] * 5})
    ct = pd.crosstab(pdf.a, pdf.b).to_numpy().astype(float)
    e = np.outer(ct.sum(1), ct.sum(0)) / ct.sum()
    got = hypothesis.chi_square(frame(spark, pdf), "a", "b").first()
    assert got["statistic"] == pytest.approx(((ct - e) ** 2 / e).sum())
    assert got["dof"] == 2


def test_recommendation_follows_types_and_normality(spark):
    rng = np.random.default_rng(7)
    n = 60
    x = rng.normal(size=n)
    pdf = pd.DataFrame(
        {"x": x, "y": x + 0.1 * rng.normal(size=n), "e": rng.exponential(size=n) ** 3, "g2": rng.choice(["u", "w"], n),
         "g3": rng.choice(["u", "v", "w"], n), "one": "k"}
    )
    df = frame(spark, pdf)
    pick = lambda a, b: hypothesis.recommend_test(df, a, b).first()["test"]
    assert pick("x", "y") == "Pearson Correlation"
    assert pick("x", "e") == "Spearman Correlation"
    assert pick("x", "g2") == "Independent t-test"
    assert pick("g2", "e") == "Mann-Whitney U Test"
    assert pick("x", "g3") == "One-Way ANOVA"
    assert pick("e", "g3") == "Kruskal-Wallis H Test"
    assert pick("g2", "g3") == "Chi-Square Test of Independence"
    assert "one group" in hypothesis.recommend_test(df, "x", "one").first()["interpretation"]
    row = hypothesis.build_hypothesis(df, "x", "affects", "y").first()
    assert (row["reading"], row["decision"], row["test"]) == ("influence", "rejected", "Pearson Correlation")
    assert hypothesis.build_hypothesis(df, "x", "varies with", "g2").first()["reading"] == "association"
    assert hypothesis.build_hypothesis(df, "x", "differs by", "g2").first()["reading"] == "difference"


def test_normality_is_one_method_at_every_size(spark, monkeypatch):
    monkeypatch.setattr(hypothesis, "SHAPIRO_ROWS", 50)
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"g": ["n"] * 400 + ["e"] * 400 + ["s"] * 30, "v": np.r_[rng.normal(size=400), rng.exponential(size=400), rng.normal(size=30)]})
    got = {r["g"]: r for r in hypothesis.normality(frame(spark, pdf), "v", ["g"]).collect()}
    x = np.sort(pdf["v"][:400])
    c = np.array([tails.normal_cdf((v - x.mean()) / x.std(ddof=1)) for v in x])
    d = max((c - np.arange(400) / 400).max(), (np.arange(1, 401) / 400 - c).max())
    assert got["n"]["statistic"] == pytest.approx(d)
    assert got["n"]["passed"] and not got["e"]["passed"]
    assert {r["test"] for r in got.values()} == {"Kolmogorov-Smirnov"}
    with pytest.raises(ValueError):
        hypothesis.normality(frame(spark, pdf), "v", ["g"], method="shapiro")
    few = hypothesis.normality(frame(spark, pdf[-30:]), "v", ["g"], method="shapiro").first()
    assert few["test"] == "Shapiro-Wilk" and few["passed"] == (few["p_value"] > 0.05)


# ---------------------------------------------------------------- regression


@pytest.fixture(scope="module")
def design():
    rng = np.random.default_rng(21)
    x = rng.normal(size=(150, 2)) + [5, -3]
    y = 2 + x @ [1.5, -0.7] + rng.normal(size=150)
    return pd.DataFrame({"i": range(150), "a": x[:, 0], "b": x[:, 1], "y": y, "c": rng.poisson(np.exp(0.2 * x[:, 0])), "z": (y > y.mean()).astype(int)})


def test_ols_matches_least_squares(spark, design):
    fit = regression.ols(frame(spark, design), "y", ["a", "b"], keep=["i"])
    X = np.column_stack([np.ones(150), design[["a", "b"]]])
    b, *_ = np.linalg.lstsq(X, design["y"], rcond=None)
    e = design["y"] - X @ b
    s2 = (e @ e) / 147
    se = np.sqrt(s2 * np.diag(np.linalg.inv(X.T @ X)))
    got = fit.coefficients.toPandas()
    np.testing.assert_allclose(got["coefficient"], b, rtol=1e-8)
    np.testing.assert_allclose(got["std_error"], se, rtol=1e-8)
    ll = -75 * (math.log(2 * math.pi) + math.log((e @ e) / 150) + 1)
    summary = {r["measure"]: r["value"] for r in fit.summary.collect()}
    assert summary["aic"] == pytest.approx(-2 * ll + 6)
    assert summary["r_squared"] == pytest.approx(1 - (e @ e) / ((design.y - design.y.mean()) ** 2).sum())
    dw = regression.durbin_watson(fit, ["i"]).first()[0]
    assert dw == pytest.approx((e.diff().dropna() ** 2).sum() / (e**2).sum())
    checks = {r["check"]: r for r in regression.residual_diagnostics(fit, ["i"]).collect()}
    assert checks["mean_residual"]["statistic"] == pytest.approx(0, abs=1e-9)
    # the largest gap between the residuals' distribution and the normal one fitted to them
    ordered = np.sort((e - e.mean()) / e.std())
    cdf = np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in ordered])
    gap = max((np.arange(1, 151) / 150 - cdf).max(), (cdf - np.arange(150) / 150).max())
    assert checks["Kolmogorov-Smirnov"]["statistic"] == pytest.approx(gap, abs=1e-9) and checks["Kolmogorov-Smirnov"]["passed"]


def test_penalised_fits(spark, design):
    X = np.column_stack([np.ones(150), design[["a", "b"]]])
    got = regression.ridge(frame(spark, design), "y", ["a", "b"]).values
    np.testing.assert_allclose(got, np.linalg.solve(X.T @ X / 150 + np.eye(3), X.T @ design["y"] / 150), rtol=1e-8)
    b = np.array(regression.lasso(frame(spark, design), "y", ["a", "b"], alpha=0.5).values)
    slope = X.T @ (design["y"] - X @ b) / 150
    for g, v in zip(slope, b):
        assert abs(g) <= 0.5 + 1e-7 if v == 0 else g == pytest.approx(0.5 * np.sign(v), abs=1e-6)


def test_generalised_fits_solve_the_score(spark, design):
    X = np.column_stack([np.ones(150), design[["a", "b"]]])
    b = np.array(regression.logistic(frame(spark, design), "z", ["a", "b"]).values)
    np.testing.assert_allclose(X.T @ (design["z"] - 1 / (1 + np.exp(-X @ b))), 0, atol=1e-4)
    b = np.array(regression.poisson(frame(spark, design), "c", ["a", "b"]).values)
    np.testing.assert_allclose(X.T @ (design["c"] - np.exp(X @ b)), 0, atol=1e-3)


# ---------------------------------------------------------------- series


def _series(spark, values):
    pdf = pd.DataFrame({"t": pd.date_range("2024-01-01", periods=len(values), freq="D"), "v": values})
    return ts_tests.Series(frame(spark, pdf), "t", "v"), pdf


def test_adf_matches_direct_regression(spark):
    rng = np.random.default_rng(31)
    y = np.cumsum(rng.normal(size=80))
    series, _ = _series(spark, y)
    got = ts_tests.adf(series, max_lag=3)
    dy = np.diff(y)

    def design(lag, start):
        t = np.arange(start, len(dy))
        cols = [y[t], *[dy[t - k] for k in range(1, lag + 1)], np.ones(len(t))]
        return np.column_stack(cols), dy[t]

    def aic(lag):
        X, d = design(lag, 3)
        e = d - X @ np.linalg.lstsq(X, d, rcond=None)[0]
        n = len(d)
        return n * (math.log(2 * math.pi) + math.log(e @ e / n) + 1) + 2 * X.shape[1]

    best = min(range(4), key=aic)
    X, d = design(best, best)
    b = np.linalg.lstsq(X, d, rcond=None)[0]
    e = d - X @ b
    se = math.sqrt((e @ e) / (len(d) - X.shape[1]) * np.linalg.inv(X.T @ X)[0, 0])
    assert got["lags"] == best
    assert got["statistic"] == pytest.approx(b[0] / se)
    assert not got["stationary"]


def test_kpss_matches_definition(spark):
    rng = np.random.default_rng(32)
    y = np.cumsum(rng.normal(size=120)) * 0.2 + rng.normal(size=120)
    series, _ = _series(spark, y)
    got = ts_tests.kpss(series)
    r = y - y.mean()
    spread = (r @ r + sum(2 * (r[k:] @ r[:-k]) * (1 - k / (got["lags"] + 1)) for k in range(1, got["lags"] + 1))) / 120
    assert got["statistic"] == pytest.approx((np.cumsum(r) ** 2).sum() / 120**2 / spread)


def test_pacf_matches_yule_walker(spark):
    rng = np.random.default_rng(33)
    y = np.zeros(150)
    for i in range(2, 150):
        y[i] = 0.6 * y[i - 1] - 0.3 * y[i - 2] + rng.normal()
    _, pdf = _series(spark, y)
    got = ts_tests.autocorrelation(frame(spark, pdf), "t", "v", 10).toPandas().sort_values("lag")
    d = y - y.mean()
    c = np.array([d @ d / 150, *[(d[k:] @ d[:-k]) / (150 - k) for k in range(1, 11)]])
    for k in range(1, 11):
        m = np.array([[c[abs(i - j)] for j in range(k)] for i in range(k)])
        assert got["pacf"].iloc[k] == pytest.approx(np.linalg.solve(m, c[1 : k + 1])[-1], abs=1e-9)


@pytest.mark.parametrize("n", [60, 97, 128])
def test_distributed_spectrum(spark, n):
    rng = np.random.default_rng(n)
    y = np.sin(np.arange(n) * 2 * np.pi / 7) + 0.1 * rng.normal(size=n)
    series, _ = _series(spark, y)
    want = np.abs(np.fft.rfft(y - y.mean()))
    for one_task in (0, 1 << 20):
        got = ts_tests.spectrum(series, one_task).toPandas().sort_values("frequency")["magnitude"]
        np.testing.assert_allclose(got, want, atol=1e-8)
    assert ts_tests.dominant_period(series) in (6, 7, 8)


def test_even_period_decomposition(spark):
    y = np.tile([1.0, 2, 3, 4], 6) + np.arange(24) * 0.5
    _, pdf = _series(spark, y)
    got = ts_tests.decompose(frame(spark, pdf), "t", "v", 4).toPandas().sort_values("ts")
    weights = np.array([0.5, 1, 1, 1, 0.5]) / 4
    want = np.convolve(y, weights, mode="valid")
    np.testing.assert_allclose(got["trend"].dropna(), want)
    assert got["residual"].dropna().abs().max() < 1e-9
    assert got["seasonal"].iloc[:4].sum() == pytest.approx(0)


def test_frequency_names(spark):
    def name(index):
        return ts.series_info(frame(spark, {"t": index}), "t").first()["frequency"]

    assert name(pd.date_range("2024-01-01", periods=12, freq="D")) == "D"
    assert name(pd.date_range("2024-01-01", periods=12, freq="2h")) == "2h"
    assert name(pd.date_range("2024-01-01", periods=12, freq="MS")) == "MS"
    assert name(pd.date_range("2024-01-31", periods=8, freq="ME")) == "ME"
    assert name(pd.date_range("2024-01-01", periods=6, freq="QS")) == "QS"
    assert name(pd.date_range("2024-01-07", periods=6, freq="W-SUN")) == "W-SUN"
    assert name(pd.to_datetime(["2024-01-01", "2024-01-02", "2024-01-05", "2024-01-06"])) is None


@pytest.mark.parametrize("freq, pandas_freq", [("H", "h"), ("D", "D"), ("W", "W"), ("M", "ME"), ("Q", "QE"), ("Y", "YE")])
@pytest.mark.parametrize("agg", ["mean", "sum", "count", "first", "last"])
def test_resample_matches_pandas(spark, freq, pandas_freq, agg):
    rng = np.random.default_rng(41)
    step = 3600 if freq == "H" else 86400 * 9
    t = pd.Timestamp("2023-11-28 05:30") + pd.to_timedelta(rng.integers(0, 40, 25) * step, unit="s")
    pdf = pd.DataFrame({"t": t, "v": rng.normal(size=25)}).drop_duplicates("t")
    got = ts.resample(frame(spark, pdf), "t", "v", freq, agg).toPandas().sort_values("ts")
    want = pdf.set_index("t").sort_index()["v"].resample(pandas_freq).agg(agg)
    assert list(pd.to_datetime(got["ts"])) == list(want.index)
    np.testing.assert_allclose(got["value"].to_numpy(float), want.to_numpy(float))
