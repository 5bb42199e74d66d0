"""Cross-validation folds as hash expressions of the row id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.hashing import md5_mod

PARTS = 10
REPEATS = 3


def fold_of(row_id: Column, repeat: int | Column, parts: int = PARTS) -> Column:
    """Part 0..parts-1 in which the row is held out in a repeat."""
    return md5_mod(parts, row_id, repeat)


def fold_index(row_id: Column, repeat: int, parts: int = PARTS) -> Column:
    return F.lit(repeat * parts) + fold_of(row_id, repeat, parts)


def repeated_kfold(df: DataFrame, id_col: str, repeats: int = REPEATS, parts: int = PARTS) -> DataFrame:
    """One row per (row, repeat) with the fold index it is held out in.

    A projection and an explode of a three-element array: no shuffle.
    """
    folds = F.array(*[fold_index(F.col(id_col), r, parts) for r in range(repeats)])
    return df.withColumn("fold", F.explode(folds))


def held_out(id_col: str, fold: int, parts: int = PARTS) -> Column:
    """Whether the row belongs to the validation side of the fold."""
    return fold_of(F.col(id_col), fold // parts, parts) == F.lit(fold % parts)


def fold_sizes(df: DataFrame, id_col: str, first: int = 0, n: int = PARTS * REPEATS) -> DataFrame:
    """``(fold, n_train, n_valid)`` for a contiguous range of folds.

    Every repeat holds out each row once, so a repeat's folds add up to the
    table; the window runs over one row per fold.
    """
    per = (
        repeated_kfold(df.select(id_col), id_col)
        .groupBy("fold")
        .agg(F.count(F.lit(1)).alias("n_valid"))
    )
    total = F.sum("n_valid").over(Window.partitionBy(F.floor(F.col("fold") / PARTS)))
    return per.select("fold", (total - F.col("n_valid")).alias("n_train"), "n_valid").where(
        F.col("fold").between(first, first + n - 1)
    )


def holdout(row_id: Column, seed: int = 57, share: int = 10) -> Column:
    """True for one row in ``share``: the early-stopping rows of a fit."""
    return md5_mod(share, "holdout", seed, row_id) == 0
