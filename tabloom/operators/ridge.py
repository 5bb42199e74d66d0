"""Least squares with an L2 penalty, on all folds from one pass.

Normal equations are sums over rows, so those of a fold's training part are the
sums over all rows minus those of the part it holds out. One pass adds up, for
each part of each repeat, the products of the features, the target and one;
every fold is then a small system that the driver solves. The objective is that
of MLlib's ``LinearRegression`` (features and target standardised).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce as fold_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.folds import PARTS, fold_of
from tabloom.operators.scale import spline_exprs

#: sums of all folds that come to the driver at once, in bytes; more repeats take a pass each
MAX_SUMS = 128 << 20


@dataclass(frozen=True)
class Basis:
    """Feature expressions and the columns they build on."""

    exprs: list[Column]
    place: dict[str, Column] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` with the array ``_fa`` of the features."""
        out = df.withColumns(self.place) if self.place else df
        return out.withColumn("_fa", F.array(*[e.cast("double") for e in self.exprs])).drop(*self.place)


def basis_of(train: DataFrame, features: list[str], kind: str, knots: int = 5) -> Basis:
    """Spline basis over the range of ``train`` for ``spline``, the columns themselves for ``ridge``."""
    if kind == "ridge":
        return Basis([F.col(f"`{c}`") for c in features])
    place, groups = spline_exprs(train, features, knots)
    return Basis([e for g in groups.values() for e in g], place)


@dataclass(frozen=True)
class Fit:
    intercept: float
    weights: np.ndarray

    def predict(self, features: Column) -> Column:
        terms = [F.get(features, F.lit(i)) * F.lit(float(w)) for i, w in enumerate(self.weights)]
        return fold_left(lambda a, b: a + b, terms, F.lit(self.intercept))


def solve(sums: np.ndarray, reg: float) -> Fit:
    """From the sums of products of (1, features, target)."""
    n = sums[0, 0]
    if n <= 0:
        raise ValueError("no rows to fit on")
    mean = sums[0, 1:] / n
    cov = sums[1:, 1:] / n - np.outer(mean, mean)
    dev = np.sqrt(np.maximum(np.diag(cov), 0.0))
    # rounding leaves a little variance in a constant column
    live = dev[:-1] > 1e-9 * np.sqrt(np.maximum(np.diag(sums)[1:-1] / n, 1e-300))
    weights = np.zeros(len(mean) - 1)
    if live.any() and dev[-1] > 1e-9 * np.sqrt(max(sums[-1, -1] / n, 1e-300)):
        d, y = dev[:-1][live], dev[-1]
        r = cov[:-1, :-1][np.ix_(live, live)] / np.outer(d, d) + np.eye(int(live.sum())) * (reg / y)
        weights[live] = np.linalg.lstsq(r, cov[:-1, -1][live] / (d * y), rcond=None)[0] * y / d
    return Fit(float(mean[-1] - weights @ mean[:-1]), weights)


def part_sums(rows: DataFrame, target: str, parts: list[Column]) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """(sums of products by part, shift) in one pass; a row is in one part of each of ``parts``.

    ``rows`` has the array ``_fa``. Rows without a target, or with a gap in the
    features, are left out. Features and target are shifted by those of one row,
    so that a large mean costs no digits.
    """
    rows = rows.where(F.col(target).isNotNull()).select(
        *[c.cast("int").alias(f"_r{i}") for i, c in enumerate(parts)],
        F.array_append("_fa", F.col(target).cast("double")).alias("_z"),
    )
    gap = F.exists(F.slice("_z", F.lit(1), F.size("_z") - 1), lambda x: x.isNull() | F.isnan(x))
    first = rows.where(~gap).select("_z").first()
    if first is None:
        raise ValueError("no rows to fit on")
    shift = np.array(first["_z"], float)
    size = len(shift) + 1
    columns = [f"_r{i}" for i in range(len(parts))]

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z = np.asarray(batch.column(batch.schema.get_field_index("_z")).flatten(), float).reshape(batch.num_rows, -1)
            sound = ~np.isnan(z[:, :-1]).any(axis=1)
            z = np.concatenate([np.ones((int(sound.sum()), 1)), z[sound] - shift], axis=1)
            for c in columns:
                fold = np.asarray(batch.column(batch.schema.get_field_index(c)))[sound]
                for f in np.unique(fold):
                    mine = z[fold == f]
                    sums[int(f)] = sums.get(int(f), 0.0) + mine.T @ mine
        for f, s in sums.items():
            yield pa.record_batch(
                [pa.array([f] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array(s.tolist(), pa.list_(pa.float64()))],
                names=["fold", "i", "v"],
            )

    def add(table: pa.Table) -> pa.Table:
        v = np.array(table.column("v").to_pylist()).sum(axis=0)
        return pa.table([table.column("fold")[:1], table.column("i")[:1], pa.array([v.tolist()], pa.list_(pa.float64()))], names=["fold", "i", "v"])

    schema = "fold int, i int, v array<double>"
    # a row of each part's matrix per task, added up by Spark
    found = rows.mapInArrow(reduce, schema).groupBy("fold", "i").applyInArrow(add, schema).collect()
    out: dict[int, np.ndarray] = {}
    for row in found:
        out.setdefault(row["fold"], np.zeros((size, size)))[row["i"]] = row["v"]
    return out, shift


def _unshifted(fit: Fit, shift: np.ndarray) -> Fit:
    return Fit(float(fit.intercept + shift[-1] - fit.weights @ shift[:-1]), fit.weights)


def fit_folds(
    train: DataFrame, basis: Basis, id_col: str, target: str, folds: list[int], reg: float, n_parts: int = PARTS
) -> dict[int, Fit]:
    """A fit per fold index, each on the rows that the fold does not hold out."""
    rows = basis.apply(train)
    repeats = sorted({f // n_parts for f in folds})
    at_once = max(1, MAX_SUMS // (8 * n_parts * (len(basis.exprs) + 2) ** 2))
    out: dict[int, Fit] = {}
    for k in range(0, len(repeats), at_once):
        some = repeats[k : k + at_once]
        part = lambda r: fold_of(F.col(f"`{id_col}`"), r, n_parts) + r * n_parts
        sums, shift = part_sums(rows, target, [part(r) for r in some])
        for r in some:
            total = sum(sums[p] for p in range(r * n_parts, (r + 1) * n_parts) if p in sums)
            for f in folds:
                if f // n_parts == r:
                    out[f] = _unshifted(solve(total - sums.get(f, 0.0), reg), shift)
    return out


def fit_all(train: DataFrame, basis: Basis, target: str, reg: float) -> Fit:
    """One fit on every row."""
    sums, shift = part_sums(basis.apply(train), target, [F.lit(0)])
    return _unshifted(solve(sums[0], reg), shift)
