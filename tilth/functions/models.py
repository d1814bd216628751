"""Forecasters under one contract: fit(X_train, y_train, X_test) -> predictions. X are frames of features."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

FitPredict = Callable[[pd.DataFrame, np.ndarray, pd.DataFrame], np.ndarray]


def _complete(x: pd.DataFrame, y: np.ndarray) -> np.ndarray:
    return x.notna().all(axis=1).to_numpy() & np.isfinite(y)


def ridge(alpha: float = 1.0, least: int = 20) -> FitPredict:
    """Ridge on complete rows, columns standardized, those without a value left out; incomplete test rows get none."""

    def fit(x: pd.DataFrame, y: np.ndarray, test: pd.DataFrame) -> np.ndarray:
        cols = [c for c in x.columns if x[c].notna().any()]
        rows = _complete(x[cols], y)
        out = np.full(len(test), np.nan)
        if rows.sum() < least:
            return out
        a, b = x.loc[rows, cols].to_numpy(float), y[rows]
        mean, dev = a.mean(0), a.std(0)
        dev[dev == 0] = 1
        z = (a - mean) / dev
        w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (b - b.mean()))
        good = test[cols].notna().all(axis=1).to_numpy()
        out[good] = (test.loc[good, cols].to_numpy(float) - mean) / dev @ w + b.mean()
        return out

    return fit


def _stump_tree(x: np.ndarray, r: np.ndarray, depth: int, edges: list[np.ndarray], least: int, rng=None, share: float = 1.0):
    """A regression tree on binned features (missing values have a bin of their own), as a prediction function."""
    n, d = x.shape

    def grow(rows: np.ndarray, depth: int):
        value = r[rows].mean()
        if depth == 0 or len(rows) < 2 * least:
            return value
        best = (1e-12, -1, -1)
        for j in range(d) if rng is None or share >= 1 else rng.permutation(d)[: max(1, int(share * d))]:
            bins = len(edges[j]) + 2
            cnt = np.bincount(x[rows, j], minlength=bins).cumsum()[:-1]
            tot = np.bincount(x[rows, j], r[rows], bins).cumsum()
            left, right = cnt, len(rows) - cnt
            ok = (left >= least) & (right >= least)
            if ok.any():
                gain = np.where(ok, tot[:-1] ** 2 / np.maximum(left, 1) + (tot[-1] - tot[:-1]) ** 2 / np.maximum(right, 1) - tot[-1] ** 2 / len(rows), -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
        if best[1] < 0:
            return value
        low = x[rows, best[1]] <= best[2]
        return best[1], best[2], grow(rows[low], depth - 1), grow(rows[~low], depth - 1)

    tree = grow(np.arange(n), depth)

    def predict(t: np.ndarray) -> np.ndarray:
        out = np.empty(len(t))

        def walk(node, rows):
            if not isinstance(node, tuple):
                out[rows] = node
            elif len(rows):
                low = t[rows, node[0]] <= node[1]
                walk(node[2], rows[low])
                walk(node[3], rows[~low])

        walk(tree, np.arange(len(t)))
        return out

    return predict


def _binned(x: pd.DataFrame, edges: list[np.ndarray]) -> np.ndarray:
    cols = [np.where(np.isnan(v := x[c].to_numpy(float)), 0, np.searchsorted(e, v, side="right") + 1) for c, e in zip(x.columns, edges, strict=True)]
    return np.stack(cols, 1) if cols else np.zeros((len(x), 0), int)


def _edges(x: pd.DataFrame) -> list[np.ndarray]:
    return [np.unique(np.nanquantile(x[c], np.linspace(0, 1, 33)[1:-1])) if x[c].notna().any() else np.zeros(0) for c in x.columns]


def gbt(rate: float = 0.06, rounds: int = 100, depth: int = 3, least: int = 20) -> FitPredict:
    """Boosted trees on binned features; missing values are a bin, so incomplete rows take part."""

    def fit(x: pd.DataFrame, y: np.ndarray, test: pd.DataFrame) -> np.ndarray:
        rows = np.isfinite(y)
        if rows.sum() < 2 * least:
            return np.full(len(test), np.nan)
        edges = _edges(x.loc[rows])
        a, t, b = _binned(x.loc[rows], edges), _binned(test, edges), y[rows]
        now, out = np.full(len(b), b.mean()), np.full(len(test), b.mean())
        for _ in range(rounds):
            tree = _stump_tree(a, b - now, depth, edges, least)
            now += rate * tree(a)
            out += rate * tree(t)
        return out

    return fit


def forest(trees: int = 60, depth: int = 8, seed: int = 42) -> FitPredict:
    """Averaged trees on resampled complete rows and a third of the features at each split."""

    def fit(x: pd.DataFrame, y: np.ndarray, test: pd.DataFrame) -> np.ndarray:
        rows = _complete(x, y)
        good = test.notna().all(axis=1).to_numpy()
        out = np.full(len(test), np.nan)
        if rows.sum() < 20 or not good.any():
            return out
        rng, edges = np.random.default_rng(seed), _edges(x.loc[rows])
        a, t, b = _binned(x.loc[rows], edges), _binned(test.loc[good], edges), y[rows]
        total = np.zeros(int(good.sum()))
        for _ in range(trees):
            pick = rng.integers(0, len(b), len(b))
            total += _stump_tree(a[pick], b[pick], depth, edges, 3, rng, 1 / 3)(t)
        out[good] = total / trees
        return out

    return fit


def water_balance(h: int, level: str = "last", rain: str = "precip", evap: str = "et0", gate_mm: float | None = None, robust: bool = False) -> FitPredict:
    """Persistence plus a linear correction for water in and out, shrunk by the factor that does best on the last quarter
    of the training rows; a factor other than 0 must strictly beat persistence there. With a gate, corrections count
    only where forecast rain exceeds it. ``robust`` reweights by Huber's rule."""

    def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        w = np.ones(len(b))
        for _ in range(20 if robust else 1):
            s = np.sqrt(w)[:, None]
            coef = np.linalg.lstsq(a * s, b * s[:, 0], rcond=None)[0]
            res = np.abs(b - a @ coef)
            cut = 1.345 * max(np.median(res) / 0.6745, 1e-9)
            w = np.minimum(1, cut / np.maximum(res, 1e-12))
        return coef

    def fit(x: pd.DataFrame, y: np.ndarray, test: pd.DataFrame) -> np.ndarray:
        use = [evap, rain]
        rows = _complete(x[[level, *use]], y)
        out = test[level].to_numpy(float).copy()
        good = test[use].notna().all(axis=1).to_numpy() & np.isfinite(out)
        if gate_mm is not None:
            good &= np.nan_to_num(test[rain].to_numpy(float), nan=-1) > gate_mm
        if rows.sum() < 48:
            return out
        a = np.column_stack((np.ones(rows.sum()), x.loc[rows, use].to_numpy(float)))
        base, b = x.loc[rows, level].to_numpy(float), y[rows]
        cut = int(0.75 * len(b))
        inner = a[cut:] @ solve(a[:cut], (b - base)[:cut])
        grid = np.linspace(0, 1, 11)
        loss = np.array([np.abs(b[cut:] - base[cut:] - k * inner).mean() for k in grid])
        k = grid[int(loss.argmin())] if loss.min() < loss[0] else 0.0
        if k:
            coef = solve(a, b - base)
            out[good] += k * (np.column_stack((np.ones(good.sum()), test.loc[good, use].to_numpy(float))) @ coef)
        return out

    return fit


def harmonic(period: float = 24.0, order: int = 3, ridge_alpha: float = 1.0) -> FitPredict:
    """Trend and daily harmonics of a time column ``t`` in hours: an approximate stand-in for additive seasonal models."""

    def design(t: np.ndarray) -> pd.DataFrame:
        cols = {"t": t} | {f"{f.__name__}{k}": f(2 * np.pi * k * t / period) for k in range(1, order + 1) for f in (np.sin, np.cos)}
        return pd.DataFrame(cols)

    return lambda x, y, test: ridge(ridge_alpha)(design(x["t"].to_numpy(float)), y, design(test["t"].to_numpy(float)))


def autoregression(lags: list[str], alpha: float = 1e-3) -> FitPredict:
    """Direct h-step autoregression on lag columns: an approximate stand-in for ARIMA."""
    return lambda x, y, test: ridge(alpha)(x[lags], y, test[lags])


def logistic_hazard(x: np.ndarray, died: np.ndarray, c: float = 1.0, rounds: int = 50):
    """L2-penalized logistic fit of the hourly hazard on standardized columns, by Newton's method; None if all rows agree.
    Returns a function from rows to hazards."""
    died = np.asarray(died, float)
    if len(died) == 0 or died.min() == died.max():
        return None
    mean, dev = x.mean(0), x.std(0)
    dev[dev == 0] = 1
    a = np.column_stack((np.ones(len(x)), (x - mean) / dev))
    w = np.zeros(a.shape[1])
    penal = np.r_[0.0, np.full(x.shape[1], 1 / c)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penal + 1e-9), a.T @ (p - died) + penal * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return lambda rows: 1 / (1 + np.exp(-np.clip(np.column_stack((np.ones(len(rows)), (rows - mean) / dev)) @ w, -30, 30)))


def hazard_design(period: np.ndarray, hour: np.ndarray, mu: np.ndarray, depth: np.ndarray, edges=(3, 6, 12, 24)) -> np.ndarray:
    """Five period dummies, the hour's cycle, the drift and the log depth: nine columns."""
    band = np.searchsorted(edges, period, side="left")
    dummies = (band[:, None] == np.arange(5)[None, :]).astype(float)
    angle = 2 * np.pi * np.asarray(hour, float) / 24
    return np.column_stack((dummies, np.sin(angle), np.cos(angle), mu, np.log(np.maximum(depth, 1e-6))))


def hazard_survival(hazard, hour0, mu, depth, max_h: int) -> np.ndarray:
    """S(1..max_h) for each row: running products of 1 - hazard."""
    rows = []
    for k in range(1, max_h + 1):
        n = len(hour0)
        rows.append(1 - hazard(hazard_design(np.full(n, k), (hour0 + k) % 24, mu, depth)))
    return np.cumprod(np.array(rows), axis=0).T
