"""Running aggregates in key order that do not need a whole key in one task."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.session import settle, stored

BLOCK_ROWS = 2_000_000
MAX_PIECES = 20_000

_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Sizes:
    """Rows per key: a settled table ``(keys, _rows)``, the largest and the total."""

    table: DataFrame
    largest: int
    total: int
    keys: int


def key_sizes(df: DataFrame, keys: list[str]) -> Sizes:
    """One pass with map-side counts."""
    table = settle(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")))
    row = table.agg(F.max("_rows").alias("m"), F.sum("_rows").alias("t"), F.count(F.lit(1)).alias("k")).first()
    return Sizes(table, row["m"] or 0, row["t"] or 0, row["k"])


def running(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    out: dict[str, tuple[str, str | Column]],
    sizes: Sizes | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``out[name] = (fn, column)`` accumulated per key in ``order``.

    ``order`` must be total within a key; ``sizes`` may bound ``df`` from above. While the largest key has at most
    ``block_rows`` rows a plain window does it. Otherwise rows are range
    partitioned on (keys, order) and frozen, each piece is accumulated by its
    own task, and the totals of earlier pieces are added. Every partition but
    the first opens with at most one key begun earlier, so the table of carried
    totals has fewer rows than there are partitions and is safe to broadcast.
    """
    sizes = sizes or key_sizes(df, keys)
    src = {f"_src_{n}": (c if isinstance(c, Column) else F.col(c)) for n, (_, c) in out.items()}
    df = df.withColumns(src)
    frame = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if sizes.largest <= block_rows:
        w = frame(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumns(
            {n: _AGG[f](f"_src_{n}").over(w) for n, (f, _) in out.items()}
        ).drop(*src)

    pieces = min(MAX_PIECES, max(2, math.ceil(sizes.total / block_rows)))
    by = [F.col(k) for k in keys] + list(order)
    ranged = stored(
        df.repartitionByRange(pieces, *by).withColumn("_piece", F.spark_partition_id()), "pieces"
    )
    w = frame(Window.partitionBy(*keys, "_piece").orderBy(*order))
    local = ranged.withColumns({n: _AGG[f](f"_src_{n}").over(w) for n, (f, _) in out.items()})
    totals = ranged.groupBy(*keys, "_piece").agg(
        *[_AGG[f](f"_src_{n}").alias(f"_tot_{n}") for n, (f, _) in out.items()]
    )
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("_piece"))
    carried = (
        totals.withColumns(
            {f"_car_{n}": _AGG[f](f"_tot_{n}").over(before) for n, (f, _) in out.items()}
        )
        .withColumn("_at", first)
        .where("_at > 1")
        .select(*keys, "_piece", *[f"_car_{n}" for n in out])
    )
    joined = local.join(F.broadcast(carried), [*keys, "_piece"], "left")
    combine = {
        "sum": lambda a, b: F.coalesce(a + b, a, b),
        "min": lambda a, b: F.least(a, b),
        "max": lambda a, b: F.greatest(a, b),
    }
    return joined.withColumns(
        {n: combine[f](F.col(n), F.col(f"_car_{n}")) for n, (f, _) in out.items()}
    ).drop(*src, "_piece", *[f"_car_{n}" for n in out])
