"""Joining a large table with a fitted table whose size is checked first."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.session import settle

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class Fitted:
    """A table computed once, with its row count and about its bytes."""

    table: DataFrame
    rows: int
    bytes: int = 0


def fitted(df: DataFrame) -> Fitted:
    """Compute, count and measure a table that is joined more than once."""
    table = settle(df)
    wide = [
        F.octet_length(F.col(f"`{n}`")) if t in ("string", "binary") else F.octet_length(F.to_json(F.struct(F.col(f"`{n}`"))))
        for n, t in table.dtypes
        if t in ("string", "binary") or t.startswith(("array", "map", "struct"))
    ]
    size = reduce(lambda a, b: a + F.coalesce(b, F.lit(0)), wide, F.lit(16 + 16 * len(table.columns)))
    row = table.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).first()
    return Fitted(table, row["n"], row["b"] or 0)


def attach(
    big: DataFrame,
    small: DataFrame | Fitted,
    on: list[str],
    how: str = "left",
    weight: str | None = None,
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join ``big`` with the fitted table ``small`` (unique on ``on``).

    ``small`` is computed once and measured. Up to ``max_rows`` rows and
    ``max_bytes`` bytes it is broadcast, so ``big`` is not shuffled. Above that
    the join shuffles: keys holding more than a thousandth of ``weight`` (at
    most 1000 keys, whatever the data) are broadcast, the others are hash
    joined, and null keys take no part in the shuffle. Without a weight column
    the rows of ``big`` per key are counted first.
    """
    known = small if isinstance(small, Fitted) else fitted(small)
    small = known.table
    if known.rows <= max_rows and known.bytes <= max_bytes:
        return big.join(F.broadcast(small), on, how)
    drop = weight is None
    if weight is None:
        weight = "_weight"
        small = small.join(big.groupBy(*on).agg(F.count(F.lit(1)).alias(weight)), on, "left").withColumn(
            weight, F.coalesce(weight, F.lit(0))
        )
        small = settle(small)
    total = small.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * 1000 > F.lit(total)
    hot, cold = small.where(is_hot), small.where(~is_hot)
    no_null = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in on])
    keyed = big.where(no_null)
    parts = [
        keyed.join(F.broadcast(hot), on, "inner"),
        keyed.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how),
    ]
    if how == "left":
        parts.append(big.where(~no_null))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.drop(weight) if drop else out
