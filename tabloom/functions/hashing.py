"""Deterministic pseudo-random columns.

Everything here is a function of row keys, so a recomputed task yields the same
folds, draws and noise as the first attempt.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_int(*parts: Column | str | int, digits: int = 8) -> Column:
    """The first ``digits`` hex digits of the md5 of the joined parts, as a long."""
    cols = [F.lit(str(p)) if isinstance(p, (int, str)) else p.cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("_", *cols)), 1, digits), 16, 10).cast("long")


def md5_mod(n: int, *parts: Column | str | int) -> Column:
    return F.pmod(md5_int(*parts), F.lit(n)).cast("int")


def md5_unit(*parts: Column | str | int) -> Column:
    """A draw from (0, 1) with 52 random bits."""
    return (md5_int(*parts, digits=13).cast("double") + F.lit(0.5)) / F.lit(float(16**13))


def md5_normal(*parts: Column | str | int) -> Column:
    """A standard normal draw (Box-Muller on two hash streams)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(md5_unit(*parts, "r")))
    return radius * F.cos(F.lit(2 * math.pi) * md5_unit(*parts, "a"))


def pick_by_share(u: Column, shares: list[tuple[object, float]]) -> Column:
    """Inverse-CDF draw: the value whose cumulative share first exceeds ``u``."""
    if not shares:
        raise ValueError("nothing to draw from")
    total = sum(s for _, s in shares)
    expr, acc = None, 0.0
    for value, share in shares[:-1]:
        acc += share / total
        cond = u < F.lit(acc)
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    last = F.lit(shares[-1][0])
    return last if expr is None else expr.otherwise(last)
