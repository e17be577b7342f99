"""Shapiro-Wilk W and p for up to 5000 values, after Royston's 1995 approximation (AS R94)."""

from __future__ import annotations

import math

import numpy as np

from sightline.functions.tails import normal_ppf, normal_sf

# Royston's published polynomial coefficients, constant term first.
LAST_WEIGHT = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
SECOND_WEIGHT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_SHIFT = (-2.273, 0.459)
SMALL_MEAN = (0.5440, -0.39978, 0.025054, -6.714e-4)
SMALL_SCALE = (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
LARGE_SCALE = (-0.4803, -0.082676, 0.0030302)


def _poly(coefficients, x: float) -> float:
    return sum(c * x**i for i, c in enumerate(coefficients))


def _weights(n: int) -> np.ndarray:
    """Antisymmetric weights of the ordered values."""
    if n == 3:
        return np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    m = np.array([normal_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    energy = float(m @ m)
    u = 1.0 / math.sqrt(n)
    unit = m / math.sqrt(energy)
    last = _poly(LAST_WEIGHT, u) + unit[-1]
    a = np.empty(n)
    if n > 5:
        second = _poly(SECOND_WEIGHT, u) + unit[-2]
        rest = (energy - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
        a[2:-2] = m[2:-2] / math.sqrt(rest)
        a[-2], a[1] = second, -second
    else:
        rest = (energy - 2 * m[-1] ** 2) / (1 - 2 * last**2)
        a[1:-1] = m[1:-1] / math.sqrt(rest)
    a[-1], a[0] = last, -last
    return a


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """(W, p). A constant sample gives (1, 1)."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 3 or x[-1] == x[0]:
        return 1.0, 1.0
    centred = x - x.mean()
    w = min(1.0, float(_weights(n) @ x) ** 2 / float(centred @ centred))
    if n == 3:
        p = 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, min(1.0, max(0.0, p))
    y = math.log1p(-w) if w < 1.0 else -math.inf
    if y == -math.inf:
        return w, 1.0
    if n <= 11:
        gamma = _poly(SMALL_SHIFT, n)
        if y >= gamma:
            return w, 1e-99
        y = -math.log(gamma - y)
        mean, scale = _poly(SMALL_MEAN, n), math.exp(_poly(SMALL_SCALE, n))
    else:
        t = math.log(n)
        mean, scale = _poly(LARGE_MEAN, t), math.exp(_poly(LARGE_SCALE, t))
    return w, normal_sf((y - mean) / scale)


def kolmogorov_sf(d: float, n: int) -> float:
    """Tail of the one-sample Kolmogorov statistic: the limit law at Stephens' adjusted argument."""
    root = math.sqrt(n)
    z = d * (root + 0.12 + 0.11 / root)
    if z < 0.2:
        return 1.0
    total = sum((-1) ** (k - 1) * math.exp(-2.0 * k * k * z * z) for k in range(1, 101))
    return min(1.0, max(0.0, 2.0 * total))
