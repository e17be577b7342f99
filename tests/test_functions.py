"""Tail probabilities and Shapiro-Wilk against published values."""

import math

import numpy as np
import pytest

from sightline.functions import tails
from sightline.functions.shapiro import kolmogorov_sf, shapiro_wilk


@pytest.mark.parametrize(
    "got, want",
    [
        (tails.chi2_sf(3.841458820694124, 1), 0.05),
        (tails.chi2_sf(18.307038053275146, 10), 0.05),
        (tails.chi2_sf(0.0, 3), 1.0),
        (tails.t_two_sided(2.2281388519649385, 10), 0.05),
        (tails.t_two_sided(12.706204736432095, 1), 0.05),
        (tails.f_sf(4.964602743730711, 1, 10), 0.05),
        (tails.f_sf(3.3258345304130112, 5, 10), 0.05),
        (tails.normal_two_sided(1.959963984540054), 0.05),
        (tails.normal_ppf(0.975), 1.959963984540054),
        (tails.beta_cdf(0.5, 2, 2), 0.5),
        (tails.gamma_sf(1.0, 2.0), math.exp(-2)),
    ],
)
def test_tails(got, want):
    assert got == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_shapiro_published_example():
    # eleven weights of men, the example of Shapiro and Wilk (1965): W = 0.79
    w, p = shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert w == pytest.approx(0.79, abs=0.005)
    assert p == pytest.approx(0.0067, abs=0.001)


def test_shapiro_size():
    rng = np.random.default_rng(1)
    for n in (20, 200):
        hits = [shapiro_wilk(rng.normal(size=n))[1] < 0.05 for _ in range(400)]
        assert 0.02 < np.mean(hits) < 0.09
    assert shapiro_wilk(rng.exponential(size=200))[1] < 1e-6


def test_kolmogorov():
    # the 5 % point of the limit law is 1.3581
    assert kolmogorov_sf(1.3581 / math.sqrt(1e8), 10**8) == pytest.approx(0.05, abs=1e-3)
