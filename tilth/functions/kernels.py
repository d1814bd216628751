"""Numeric kernels on arrays, used inside Arrow-batched and grouped pandas functions."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

N_POINTS = 256
_erfc = np.frompyfunc(math.erfc, 1, 1)


def ndtr(x):
    """Normal distribution function."""
    return 0.5 * _erfc(-np.asarray(x, float) / math.sqrt(2)).astype(float)


def log_ndtr(x):
    """Its logarithm; far below zero by the asymptotic series."""
    x = np.asarray(x, float)
    far = np.minimum(x, -10.0)
    tail = -far * far / 2 - np.log(-far) - 0.5 * math.log(2 * math.pi) + np.log1p(-1 / far**2 + 3 / far**4 - 15 / far**6)
    return np.where(x > -10, np.log(np.maximum(ndtr(np.maximum(x, -10)), 1e-300)), tail)


def ndtri(p: float) -> float:
    return NormalDist().inv_cdf(p)


def gaussian_crps(y, mu, sigma):
    """Closed form; a zero spread gives the absolute error, a negative one is an error."""
    y, mu, sigma = (np.asarray(v, float) for v in (y, mu, sigma))
    if (sigma < 0).any():
        raise ValueError("negative spread")
    s = np.where(sigma > 0, sigma, 1.0)
    z = (y - mu) / s
    full = s * (z * (2 * ndtr(z) - 1) + 2 * np.exp(-z * z / 2) / math.sqrt(2 * math.pi) - 1 / math.sqrt(math.pi))
    return np.where(sigma > 0, full, np.abs(y - mu))


def empirical_crps(sample, y):
    """Mean distance to the sample less half its mean pairwise distance, by sorting: O(log n) for each y."""
    x = np.sort(np.asarray(sample, float))
    y, n = np.asarray(y, float), len(x)
    if not n:
        return np.full(len(y), np.nan)
    sums = np.concatenate(([0], np.cumsum(x)))
    k = np.searchsorted(x, y, side="right")
    mean = (y * k - sums[k] + sums[-1] - sums[k] - y * (n - k)) / n
    spread = 2 * (x * (2 * np.arange(n) - n + 1)).sum() / n**2
    return np.where(np.isnan(y), np.nan, mean - spread / 2)


def crossing_probability(level, threshold, hours, mu, sigma):
    """Chance that a Brownian path with drift passes below the threshold within ``hours``: the reflection principle, its
    second term in logarithms. At or below it already: 1. Without spread: by the drift alone."""
    b = np.asarray(level, float) - threshold
    mu, sigma = np.broadcast_to(np.asarray(mu, float), b.shape), np.broadcast_to(np.asarray(sigma, float), b.shape)
    s = np.where(sigma > 0, sigma, 1.0) * math.sqrt(hours)
    first = ndtr((-b - mu * hours) / s)
    second = np.exp(np.minimum(0.0, -2 * mu * b / np.where(sigma > 0, sigma, 1.0) ** 2 + log_ndtr((-b + mu * hours) / s)))
    p = np.clip(first + second, 0, 1)
    p = np.where(sigma > 0, p, (b + mu * hours <= 0).astype(float))
    return np.where(np.isnan(b + mu + sigma), np.nan, np.where(b <= 0, 1.0, p))


def discretized(pool, points: int = N_POINTS, drift: float | None = None, least: int = 48):
    """Quantile points of a pool of increments at (k + 1/2) / n, re-centred on a drift if given; a small pool gives none."""
    pool = np.asarray(pool, float)
    pool = pool[np.isfinite(pool)]
    if len(pool) < least:
        return np.zeros(0)
    out = np.quantile(pool, (np.arange(points) + 0.5) / points)
    return out if drift is None else out - out.mean() + drift


def gaussian_increments(mu: float, sigma: float, points: int = N_POINTS):
    return mu + sigma * np.array([ndtri((k + 0.5) / points) for k in range(points)])


def filtered_increments(z_pool, mu: float, sigma: float, points: int = N_POINTS):
    """A standardized pool's shape, brought to mean 0 and (population) deviation 1, then to mu and sigma."""
    return brought_to(discretized(z_pool, points), mu, sigma)


def brought_to(points, mu: float, sigma: float):
    """Points moved and scaled to mean mu and (population) deviation sigma; none if they don't differ."""
    z = np.asarray(points, float)
    return mu + sigma * (z - z.mean()) / z.std() if len(z) and z.std() > 0 else np.zeros(0)


def weighted_shape(z, w, most: int = 512):
    """At most ``most`` quantiles of a weighted sample, interpolated at the midpoints of its weights."""
    z, w = np.asarray(z, float), np.asarray(w, float)
    keep = np.isfinite(z) & (w > 0)
    z, w = z[keep], w[keep]
    if not len(z):
        return z
    order = np.argsort(z, kind="stable")
    z, w = z[order], w[order]
    m = min(most, len(z))
    return np.interp((np.arange(m) + 0.5) / m, (np.cumsum(w) - w / 2) / w.sum(), z)


def level_grid(low: float, span: float, increments):
    """Levels from ``low`` over ``span`` in steps of a tenth of the increments' deviation, 200 to 6000 of them."""
    step = max(0.1 * float(np.std(increments)), 1e-9)
    return np.linspace(low, low + span, int(np.clip(math.ceil(span / step) + 1, 200, 6000)))


def mean_after(grid, value, increments, threshold, below: float):
    """Mean of the value one increment on, ``below`` once under the threshold; beyond the grid as at its end."""
    to = grid[:, None] + np.asarray(increments)[None, :]
    return np.where(to < threshold, below, np.interp(to, grid, value)).mean(1)


def crossing_curve(increments, threshold: float, hours: int, span: float | None = None, each: bool = False):
    """(grid, probability of passing below the threshold within ``hours``) for independent increments, by recursion over
    levels; with ``each``, a row of probabilities for every hour."""
    inc = np.asarray(increments, float)
    reach = span or max(6 * float(np.std(inc)) * math.sqrt(hours) + abs(float(inc.mean())) * hours, 1e-6)
    grid = level_grid(threshold, reach, inc)
    p, rows = np.zeros(len(grid)), []
    for _ in range(hours):
        p = mean_after(grid, p, inc, threshold, 1.0)
        rows.append(p)
    return grid, (np.array(rows) if each else p)


def empirical_crossing(levels, threshold: float, hours: int, increments):
    """crossing_curve() read off at levels."""
    levels = np.asarray(levels, float)
    grid, p = crossing_curve(increments, threshold, hours)
    out = np.where(levels < threshold, 1.0, np.interp(levels, grid, p, right=0.0))
    return np.where(np.isnan(levels), np.nan, out)


def exercise_boundary(increments, threshold: float, hours: int, cost: float, high: float, delay: int = 0):
    """For each hour of a window, the level at or below which acting now (at ``cost``) beats waiting (loss 1 below the
    threshold), by backward induction. Acting takes effect after ``delay`` hours, within which a loss still counts."""
    inc = np.asarray(increments, float)
    grid = level_grid(threshold, high - threshold, inc)
    risk = np.zeros(len(grid))
    for _ in range(delay):
        risk = mean_after(grid, risk, inc, threshold, 1.0)
    value, bounds = np.zeros(len(grid)), np.full(hours, np.nan)
    act = cost + (1 - cost) * risk if delay else np.full(len(grid), cost)
    for t in range(hours - 1, -1, -1):
        wait = mean_after(grid, value, inc, threshold, 1.0)
        better = act < wait
        if better.any():
            k = int(np.flatnonzero(better)[-1])
            if k + 1 < len(grid):
                a, b = wait[k] - act[k], wait[k + 1] - act[k + 1]
                bounds[t] = grid[k] + (grid[k + 1] - grid[k]) * (a / (a - b) if a != b else 0)
            else:
                bounds[t] = grid[k]
        else:
            bounds[t] = threshold
        value = np.minimum(act, wait)
    return bounds


def product_limit(time, event, hours: int):
    """S(1..hours) of the event; ones without rows."""
    time, event = np.asarray(time), np.asarray(event, bool)
    steps = np.arange(1, hours + 1)
    risk = (time[None, :] >= steps[:, None]).sum(1)
    gone = ((time[None, :] == steps[:, None]) & event[None, :]).sum(1)
    return np.cumprod(1 - np.divide(gone, risk, out=np.zeros(hours), where=risk > 0))


def censoring_curve(time, event, hours: int):
    """G(0..hours) of the censoring; who lasts longer than ``hours`` isn't censored."""
    return np.concatenate(([1.0], product_limit(time, ~np.asarray(event, bool), hours)))


def censored_brier(time, event, surv, g):
    """Brier score of survival curves (a row each) at every hour, weighted by the censoring curve just before an event or
    at the hour for those still there, floored at 1e-6; the divisor is all rows."""
    time, event, surv = np.asarray(time), np.asarray(event, bool), np.asarray(surv, float)
    hours = np.arange(1, surv.shape[1] + 1)
    g = np.maximum(g, 1e-6)
    died = event[:, None] & (time[:, None] <= hours[None, :])
    alive = time[:, None] > hours[None, :]
    at_event = 1 / g[np.clip(time - 1, 0, len(g) - 1)]
    return (np.where(died, surv**2 * at_event[:, None], 0) + np.where(alive, (1 - surv) ** 2 / g[hours][None, :], 0)).mean(0)


def drift_buckets(m, n: int):
    """(class, medians): equal-count classes by quantile edges; equal goes up, equal edges count once."""
    m = np.asarray(m, float)
    edges = np.unique(np.quantile(m, np.arange(1, n) / n))
    at = np.searchsorted(edges, m, side="right")
    present, at = np.unique(at, return_inverse=True)
    return at, [float(np.median(m[at == b])) for b in range(len(present))]


def person_periods(time, event, hours: int):
    """(row, period, died) for each hour at risk."""
    upto = np.minimum(time, hours)
    row = np.repeat(np.arange(len(upto)), upto)
    period = np.arange(len(row)) - np.repeat(np.cumsum(upto) - upto, upto) + 1
    return row, period, np.asarray(event, bool)[row] & (period == np.asarray(time)[row])


@F.pandas_udf(DoubleType())
def log_ndtr_udf(x: pd.Series) -> pd.Series:
    return pd.Series(log_ndtr(x)).where(x.notna(), None)


@F.pandas_udf(DoubleType())
def ndtr_udf(x: pd.Series) -> pd.Series:
    return pd.Series(ndtr(x)).where(x.notna(), None)


@F.pandas_udf(DoubleType())
def gaussian_crps_udf(y: pd.Series, mu: pd.Series, sigma: pd.Series) -> pd.Series:
    return pd.Series(gaussian_crps(y, mu, sigma)).where(y.notna() & mu.notna() & sigma.notna(), None)


def crossing_udf(threshold: float, hours: int):
    @F.pandas_udf(DoubleType())
    def p(level: pd.Series, mu: pd.Series, sigma: pd.Series) -> pd.Series:
        out = pd.Series(crossing_probability(level, threshold, hours, mu, sigma))
        return out.where(out.notna(), None)

    return p
