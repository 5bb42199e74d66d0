"""Scores of many candidates at once, for the walk of a blend through one fold.

Every function reads a target ``y`` and a matrix with a column of predictions
per candidate, and gives a number per column, NaN where the score is not
defined. The formulas are those of ``operators.scores``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tabloom.operators.scores import EPS


def _per_row(y: np.ndarray, p: np.ndarray, name: str) -> np.ndarray:
    y = y[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        if name == "mae":
            return np.abs(y - p)
        if name in ("mare", "mape"):  # rows with a target of zero are left out
            return np.where(y == 0, np.nan, np.abs(y - p) / np.abs(y))
        if name == "smape":
            both = np.abs(y) + np.abs(p)
            return np.where(both == 0, 0.0, 2 * np.abs(y - p) / both)
        if name == "rmsle":
            return (np.where(y > -1, np.log1p(y), np.nan) - np.log1p(np.maximum(p, 0.0))) ** 2
        of_true = np.where(y == 1, p, 1 - p)
        return np.log(np.clip(of_true, EPS, 1 - EPS))


MEANS = ("mae", "mare", "mape", "smape", "rmsle", "nll", "loglik", "kappa")


def sums(name: str, y: np.ndarray, p: np.ndarray) -> np.ndarray:
    """(sum, count) of a score's terms per column; NaN in the sum if a term is missing."""
    terms = _per_row(y, p, name)
    if name in ("mare", "mape"):
        there = ~np.isnan(terms) | np.isnan(p) | np.isnan(y)[:, None]
        return np.stack([np.where(there, terms, 0.0).sum(axis=0), there.sum(axis=0).astype(float)])
    terms = np.where(np.isnan(y)[:, None], np.nan, terms)
    return np.stack([terms.sum(axis=0), np.full(p.shape[1], float(len(y)))])


def finish(name: str, total: float, n: float) -> float:
    if not n or np.isnan(total):
        return np.nan
    value = total / n
    return {"rmsle": np.sqrt(max(value, 0.0)), "nll": -value}.get(name, value)


def _mean(name: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    return lambda y, p: np.array([finish(name, *s) for s in sums(name, y, p).T])


def _medae(y: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.median(np.abs(y[:, None] - p), axis=0)


def _auc_one(y: np.ndarray, p: np.ndarray) -> float:
    pos = y == 1
    if np.isnan(p).any() or not (pos | (y == 0)).all() or pos.all() or not pos.any():
        return np.nan
    order = np.argsort(p, kind="stable")
    v = p[order]
    opens = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    won = np.add.reduceat(pos[order].astype(float), opens)
    lost = np.add.reduceat((~pos[order]).astype(float), opens)
    return float((won * (np.cumsum(lost) - lost / 2)).sum() / (won.sum() * lost.sum()))


def _auc(y: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.array([_auc_one(y, p[:, j]) for j in range(p.shape[1])])


def _lorenz(y: np.ndarray, by: np.ndarray) -> float:
    order = np.argsort(-by, kind="stable")
    v, s = by[order], y[order]
    opens = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    size, part = np.diff(np.r_[opens, len(v)]), np.add.reduceat(s, opens)
    if not s.sum():
        return np.nan
    return float((size * (np.cumsum(part) - part / 2)).sum() / (len(v) * s.sum()) - 0.5)


def _ngini(y: np.ndarray, p: np.ndarray) -> np.ndarray:
    best = _lorenz(y, y)
    if np.isnan(y).any() or not best:
        return np.full(p.shape[1], np.nan)
    return np.array([np.nan if np.isnan(c).any() else _lorenz(y, c) / best for c in p.T])


def _rmse(y: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(((y[:, None] - p) ** 2).mean(axis=0))


def _r2(y: np.ndarray, p: np.ndarray) -> np.ndarray:
    spread = y.var()
    return 1 - ((y[:, None] - p) ** 2).mean(axis=0) / spread if spread else np.full(p.shape[1], np.nan)


SCORES: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "rmse": _rmse,
    "r2": _r2,
    **{n: _mean(n) for n in MEANS},
    "medae": _medae,
    "auc": _auc,
    "gini": lambda y, p: 2 * _auc(y, p) - 1,
    "ngini": _ngini,
}


def mixed(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The average of the members so far with each candidate added."""
    have = counts > 0
    return ((p[:, have] @ counts[have])[:, None] + p) / (counts.sum() + 1)


def of_targets(name: str, y: np.ndarray, p: np.ndarray, target: np.ndarray | None) -> np.ndarray:
    """The score per column, the mean over the targets if rows have one."""
    if target is None:
        return SCORES[name](y, p)
    return np.mean([SCORES[name](y[target == t], p[target == t]) for t in np.unique(target)], axis=0)


def greedy(
    name: str, lower: bool, y: np.ndarray, p: np.ndarray, steps: int | None, min_gain: float, target: np.ndarray | None = None
) -> list[int]:
    """Columns chosen with replacement while the best next one betters the score."""
    sign, best = (1.0 if lower else -1.0), np.inf
    counts = np.zeros(p.shape[1])
    picks: list[int] = []
    while len(counts) and (steps is None or len(picks) < steps):
        values = sign * of_targets(name, y, mixed(p, counts), target)
        k = int(np.argmin(np.where(np.isnan(values), np.inf, values)))
        if not values[k] < best - min_gain * abs(best if np.isfinite(best) else 0.0):
            break
        best = float(values[k])
        counts[k] += 1
        picks.append(k)
    return picks
