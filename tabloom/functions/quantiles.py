"""Exact quantiles of whole columns without sorting or shuffling rows.

Each pass is one aggregate over all columns. An approximate quantile brackets
the wanted rank; the next pass counts what lies below the bracket and narrows
it. When few enough distinct values remain inside, the exact order statistics
are read from them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXACT_DISTINCT = 20_000
ACCURACY = 10_000


@dataclass
class _Bracket:
    col: str
    prob: float
    n: int
    lo: float
    hi: float
    below: int = 0
    inside: int = 0
    done: bool = False

    @property
    def rank(self) -> int:
        return math.floor(self.prob * (self.n - 1))

    @property
    def weight(self) -> float:
        return self.prob * (self.n - 1) - self.rank


def exact_quantiles(
    df: DataFrame,
    cols: list[str],
    probs: list[float],
    exact_distinct: int = EXACT_DISTINCT,
    accuracy: int = ACCURACY,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles (nulls ignored) of every column."""
    df = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    head = df.agg(
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)],
        *[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(cols)],
        *[F.min(c).alias(f"lo{i}") for i, c in enumerate(cols)],
        *[F.max(c).alias(f"hi{i}") for i, c in enumerate(cols)],
    ).first()
    result: dict[str, list[float | None]] = {}
    few = [c for i, c in enumerate(cols) if head[f"d{i}"] <= exact_distinct]
    if few:
        row = df.agg(*[F.percentile(c, probs).alias(f"q{i}") for i, c in enumerate(few)]).first()
        for i, c in enumerate(few):
            result[c] = list(row[i]) if row[i] is not None else [None] * len(probs)
    brackets = [
        _Bracket(c, p, head[f"n{i}"], head[f"lo{i}"], head[f"hi{i}"], inside=head[f"n{i}"])
        for i, c in enumerate(cols)
        if c not in result
        for p in probs
    ]
    _narrow(df, brackets, exact_distinct, accuracy)
    values = _read(df, brackets)
    for b in brackets:
        result.setdefault(b.col, []).append(values[(b.col, b.prob)])
    return result


def _inside(b: _Bracket):
    return F.when(F.col(b.col).between(F.lit(b.lo), F.lit(b.hi)), F.col(b.col))


def _narrow(df: DataFrame, brackets: list[_Bracket], exact_distinct: int, accuracy: int) -> None:
    todo = list(brackets)
    while todo:
        aggs = []
        for i, b in enumerate(todo):
            step = max(1, math.ceil(2 * b.inside / accuracy))
            want = b.rank - b.below
            grid = [
                max(0.0, (want - step) / b.inside),
                min(1.0, (want + 2 + step) / b.inside),
            ]
            aggs.append(F.percentile_approx(_inside(b), grid, F.lit(accuracy)).alias(f"g{i}"))
        row = df.agg(*aggs).first()
        tried = []
        for i, b in enumerate(todo):
            lo, hi = row[f"g{i}"]
            tried.append(_Bracket(b.col, b.prob, b.n, lo, hi))
        counts = []
        for i, t in enumerate(tried):
            counts += [
                F.count_if(F.col(t.col) < F.lit(t.lo)).alias(f"b{i}"),
                F.count(_inside(t)).alias(f"m{i}"),
                F.approx_count_distinct(_inside(t)).alias(f"d{i}"),
            ]
        row = df.agg(*counts).first()
        left = []
        for i, (b, t) in enumerate(zip(todo, tried)):
            below, inside, distinct = row[f"b{i}"], row[f"m{i}"], row[f"d{i}"]
            top = min(b.rank + 1, b.n - 1)
            holds = below <= b.rank and top < below + inside
            if holds and (inside < b.inside or t.lo == t.hi or distinct <= exact_distinct):
                b.lo, b.hi, b.below, b.inside = t.lo, t.hi, below, inside
            elif not holds:
                accuracy = min(accuracy * 4, 1_000_000)
            if not (holds and (distinct <= exact_distinct or t.lo == t.hi)):
                left.append(b)
        todo = left


def _read(df: DataFrame, brackets: list[_Bracket]) -> dict[tuple[str, float], float]:
    if not brackets:
        return {}
    aggs = []
    for i, b in enumerate(brackets):
        span = max(b.inside - 1, 1)
        k = b.rank - b.below
        aggs.append(
            F.percentile(_inside(b), [k / span, min((k + 1) / span, 1.0)]).alias(f"q{i}")
        )
    row = df.agg(*aggs).first()
    return {
        (b.col, b.prob): row[i][0] + b.weight * (row[i][1] - row[i][0])
        for i, b in enumerate(brackets)
    }
