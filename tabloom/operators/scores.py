"""Scores over a long predictions table, grouped by submission and fold.

Numeric scores read columns ``y`` and ``p``; probability scores read ``y`` in
{0, 1} and ``p`` = P(y = 1); label scores read true label ``y`` and predicted
label ``p``. Predictions with a ``class`` column have one row per class code and
its probability; label scores then compare the most probable class.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.joins import Fitted, attach
from tabloom.functions.running import BLOCK_ROWS, MAX_PIECES, key_sizes, running
from tabloom.session import settle, stored

KEYS = ("submission", "fold")
EPS = 1e-15
#: ranges of a curve per block of rows that one window may take: even work for the cores
PIECES_PER_BLOCK = 4


def _rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def _relative(y: Column, p: Column) -> Column:
    return F.avg(F.try_divide(F.abs(y - p), F.abs(y)))


def _smape(y: Column, p: Column) -> Column:
    both = F.abs(y) + F.abs(p)
    return F.avg(F.when(both == 0, F.lit(0.0)).otherwise(F.try_divide(2 * F.abs(y - p), both)))


def _r2(y: Column, p: Column) -> Column:
    return 1 - F.try_divide(F.avg((y - p) * (y - p)), F.var_pop(y))


def _log_likelihood(y: Column, p: Column) -> Column:
    of_true = F.when(y == 1, p).otherwise(1 - p)
    return F.avg(F.log(F.least(F.greatest(of_true, F.lit(EPS)), F.lit(1 - EPS))))


def _hits(y: Column, p: Column) -> Column:
    return F.avg(y.eqNullSafe(p).cast("double"))


SIMPLE: dict[str, Callable[[Column, Column], Column]] = {
    "rmse": _rmse,
    "mae": lambda y, p: F.avg(F.abs(y - p)),
    "mare": _relative,
    "mape": _relative,
    # a prediction below zero counts as zero, where the logarithm still holds
    "rmsle": lambda y, p: _rmse(F.log1p(y), F.log1p(F.greatest(p, F.lit(0.0)))),
    "smape": _smape,
    "r2": _r2,
    "nll": lambda y, p: -_log_likelihood(y, p),
    "loglik": _log_likelihood,
    "kappa": _log_likelihood,
    "accuracy": _hits,
    # Every row has one true and one predicted label, so the pooled counts of
    # false positives and false negatives agree and F1 is the share of hits.
    "f1-micro": _hits,
}
LABEL_SCORES = ("accuracy", "f1-micro", "mcc")
RANK_SCORES = ("auc", "gini", "ngini")
LOWER_IS_BETTER = {"rmse", "mae", "mare", "mape", "rmsle", "medae", "smape", "nll"}


def lower_is_better(name: str) -> bool:
    return name in LOWER_IS_BETTER


def whole(value: Column, name: str) -> Column:
    """``value``, or null if a row of the group lacks a usable pair.

    Averages skip nulls, so a missing prediction, or a target that the score is
    not defined for, would better a score. Label scores count a missing label as
    a miss instead.
    """
    if name in LABEL_SCORES:
        return value
    y = F.log1p("y") if name == "rmsle" else F.col("y")
    both = y.isNotNull() & F.col("p").isNotNull()
    return F.when(F.count_if(both) == F.count(F.lit(1)), value)


def simple(name: str) -> Column:
    """The aggregate of one of the ``SIMPLE`` scores over columns y and p."""
    return whole(SIMPLE[name](F.col("y"), F.col("p")), name)


def score(
    preds: DataFrame, name: str, keys: tuple[str, ...] = KEYS, digits: int | None = None, kept: bool = False
) -> DataFrame:
    """``(keys, score)``; null where a prediction or target is missing. ``kept`` as in ``ngini``."""
    if "class" in preds.columns:
        out = _score_blocks(preds, name, keys)
    elif name in SIMPLE:
        out = preds.groupBy(*keys).agg(simple(name).alias("score"))
    elif name == "ngini":
        out = ngini(preds, keys, kept)
    else:
        out = {"mcc": mcc, "medae": medae, "auc": auc, "gini": gini}[name](preds, keys)
    return out.withColumn("score", F.round("score", digits)) if digits is not None else out


def top_class(preds: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``(keys, row_id, y, p)`` with ``p`` the most probable class, the lowest code on ties."""
    order = F.struct(F.col("p").alias("a"), (-F.col("class")).alias("b"))
    return preds.groupBy(*keys, "row_id").agg(
        F.first("y").alias("y"), F.max_by("class", order).cast("double").alias("p")
    )


def _score_blocks(preds: DataFrame, name: str, keys: tuple[str, ...]) -> DataFrame:
    if name in ("nll", "loglik", "kappa"):
        out = multiclass_nll(preds, keys)
        return out if name == "nll" else out.withColumn("score", -F.col("score"))
    if name not in LABEL_SCORES:
        raise ValueError(f"{name} does not read class blocks")
    return score(top_class(preds, keys), name, keys)


def mcc(preds: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Matthews correlation over any number of classes, from confusion counts.

    With s rows, c hits, and t and p the rows per true and predicted class:
    (c s - sum t p) / sqrt((s^2 - sum p^2) (s^2 - sum t^2)); 0 if undefined. A
    missing label is a class of its own.
    """
    cells = preds.groupBy(*keys, "y", "p").agg(F.count(F.lit(1)).cast("double").alias("_n"))
    sides = F.array(
        F.struct(F.col("y").alias("k"), F.col("_n").alias("t"), F.lit(0.0).alias("g"), F.when(F.col("y").eqNullSafe(F.col("p")), F.col("_n")).otherwise(0.0).alias("c")),
        F.struct(F.col("p").alias("k"), F.lit(0.0).alias("t"), F.col("_n").alias("g"), F.lit(0.0).alias("c")),
    )
    per = cells.select(*keys, F.explode(sides).alias("e")).groupBy(*keys, "e.k").agg(
        F.sum("e.t").alias("t"), F.sum("e.g").alias("g"), F.sum("e.c").alias("c")
    )
    s, sq = F.sum("t"), lambda x: F.sum(F.col(x) * F.col(x))
    norm = F.sqrt(s * s - sq("g")) * F.sqrt(s * s - sq("t"))
    value = F.try_divide(F.sum("c") * s - F.sum(F.col("t") * F.col("g")), norm)
    return per.groupBy(*keys).agg(F.coalesce(value, F.lit(0.0)).alias("score"))


def multiclass_nll(preds: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Mean negative log probability of the true class.

    ``preds(keys, row_id, y, class, p)`` has one row per row and class; only the
    true one counts. Null if a row has no probability of its true class.
    """
    true = F.max(F.when(F.col("y") == F.col("class"), F.col("p"))).alias("p")
    hit = preds.groupBy(*keys, "row_id").agg(true)
    value = -F.avg(F.log(F.least(F.greatest("p", F.lit(EPS)), F.lit(1.0))))
    return hit.groupBy(*keys).agg(F.when(F.count("p") == F.count(F.lit(1)), value).alias("score"))


def _histogram(preds: DataFrame, keys: tuple[str, ...], value: Column, aggs: dict[str, Column]) -> DataFrame:
    """Rows combined per distinct value, partly before the shuffle."""
    return preds.groupBy(*keys, value.alias("_v")).agg(*[e.alias(n) for n, e in aggs.items()])


def _stored_histogram(preds: DataFrame, keys: tuple[str, ...], value: Column, aggs: dict[str, Column]) -> DataFrame:
    """A histogram computed once, so that sizes and sums read it and not the predictions."""
    return stored(_histogram(preds, keys, value, aggs), "histogram")


def medae(preds: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Median absolute error; null where a prediction or target is missing."""
    gaps = stored(preds.select(*keys, F.abs(F.col("y") - F.col("p")).alias("_gap")), "gaps")
    holes = gaps.groupBy(*keys).agg(F.count_if(F.col("_gap").isNull()).alias("_holes"))
    out = grouped_median(gaps, keys, F.col("_gap"), "score")
    return attach(holes, out, list(keys)).select(*keys, F.when(F.col("_holes") == 0, F.col("score")).alias("score"))


def grouped_median(
    df: DataFrame, keys: tuple[str, ...], value: Column, out: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Exact median per key.

    While keys fit a task, one shuffle and sort find the middle rows. Beyond
    that, ranks run over the histogram of values in range-partitioned pieces.
    """
    rows = df.where(value.isNotNull()).select(*keys, value.alias("_v"))
    sizes = key_sizes(rows, list(keys))
    lo, hi = F.floor((F.col("_rows") - 1) / 2), F.ceil((F.col("_rows") - 1) / 2)
    if sizes.largest <= block_rows:
        w = Window.partitionBy(*keys)
        placed = rows.withColumns(
            {"_at": F.row_number().over(w.orderBy("_v")) - 1, "_rows": F.count(F.lit(1)).over(w)}
        )
        return placed.where(F.col("_at").isin(lo, hi)).groupBy(*keys).agg(F.avg("_v").alias(out))
    hist = _histogram(rows, keys, F.col("_v"), {"_n": F.count(F.lit(1))})
    run = running(
        hist, list(keys), [F.col("_v")], {"_upto": ("sum", "_n")}, key_sizes(hist, list(keys)), block_rows
    )
    known = Fitted(sizes.table, sizes.keys)
    holds = lambda r: (F.col("_upto") - F.col("_n") <= r) & (r < F.col("_upto"))
    middle = (F.max(F.when(holds(lo), F.col("_v"))) + F.max(F.when(holds(hi), F.col("_v")))) / 2
    return attach(run, known, list(keys), "inner", weight="_rows").groupBy(*keys).agg(middle.alias(out))


def auc(preds: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Area under the ROC curve; a positive and a negative with equal score count half."""
    pos, neg = F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)
    hist = _stored_histogram(preds, keys, F.col("p"), {"_pos": pos, "_neg": neg, "_n": F.count(F.lit(1))})
    run = running(hist, list(keys), [F.col("_v")], {"_below": ("sum", "_neg")}, key_sizes(hist, list(keys)))
    wins = F.sum(F.col("_pos") * (F.col("_below") - F.col("_neg") / 2.0))
    area = F.try_divide(wins, F.sum("_pos").cast("double") * F.sum("_neg"))
    sound = (F.count_if(F.col("_v").isNull()) == 0) & (F.sum("_n") == F.sum("_pos") + F.sum("_neg"))
    return run.groupBy(*keys).agg(F.when(sound, area).alias("score"))


def gini(preds: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return auc(preds, keys).withColumn("score", 2 * F.col("score") - 1)


def _lorenz(rows: DataFrame, keys: tuple[str, ...], by: str) -> DataFrame:
    """``(keys, _area)``: area between the curve of captured ``y`` and the diagonal.

    Rows are taken from the highest ``by`` down; equal values form one straight
    segment. Large keys are cut into ranges of ``by``: each gives the strips below
    its own part of the curve, and its rows then stand on what the ranges before
    it captured. One row per range remains, so no row is read again.
    """
    aggs = {"_n": F.count(F.lit(1)), "_s": F.sum(F.col("y").cast("double"))}
    part = _stored_histogram(rows, keys, F.col(by), aggs)
    sizes = key_sizes(part, list(keys))
    fall = F.col("_v").desc()
    if sizes.largest > BLOCK_ROWS:
        n = min(MAX_PIECES, math.ceil(PIECES_PER_BLOCK * sizes.total / BLOCK_ROWS))
        part = part.repartitionByRange(n, *keys, fall).withColumn("_piece", F.spark_partition_id())
    else:
        part = part.withColumn("_piece", F.lit(0))
    down = Window.partitionBy(*keys, "_piece").orderBy(fall).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    strip = F.col("_n") * (F.col("_cum") - F.col("_s") / 2.0)
    pieces = part.withColumn("_cum", F.sum("_s").over(down)).groupBy(*keys, "_piece").agg(
        F.sum(strip).alias("_strip"),
        F.sum(F.when(F.col("_s").isNotNull(), F.col("_n"))).alias("_known"),
        F.sum("_n").alias("_n"),
        F.sum("_s").alias("_s"),
        F.count_if(F.col("_v").isNull()).alias("_holes"),
    )
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_strip") + F.col("_known") * F.coalesce(F.sum("_s").over(before), F.lit(0.0))
    area = F.try_divide(F.sum("_below"), F.sum("_n") * F.sum("_s")) - 0.5
    return pieces.withColumn("_below", below).groupBy(*keys).agg(F.when(F.sum("_holes") == 0, area).alias("_area"))


def _same_targets(pairs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``(keys, _as)``: the first of the keys that hold the same targets, as a struct.

    Targets are the same if their number and four sums of 28 bits of two hashes
    agree, which do not depend on the order of rows. Keys with a null are left out.
    """
    hashes = [F.xxhash64("y"), F.xxhash64("y", F.lit("again"))]
    bits = [F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << 28) - 1)) for h in hashes for at in (0, 32)]
    marks = {"_n": F.count(F.lit(1)), **{f"_m{i}": F.sum(b) for i, b in enumerate(bits)}}
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    marked = pairs.where(known).groupBy(*keys).agg(*[m.alias(n) for n, m in marks.items()])
    first = F.min(F.struct(*keys)).over(Window.partitionBy(*marks))
    return settle(marked.select(*keys, first.alias("_as")))


def ngini(preds: DataFrame, keys: tuple[str, ...] = KEYS, kept: bool = False) -> DataFrame:
    """Gini of the predicted order over gini of the perfect order.

    Both curves read the stored pairs (prediction, target); each combines equal
    values once. Submissions with the same targets share one perfect order. With
    ``kept``, the predictions are formulas over a stored table, which takes fewer
    rows than their pairs would, and are read from there.
    """
    pairs = preds.select(*keys, "p", "y")
    pairs = pairs if kept else stored(pairs, "pairs")
    same = _same_targets(pairs, keys)
    firsts = same.where(F.struct(*keys) == F.col("_as")).select(*keys)
    got = _lorenz(pairs, keys, "p")
    best = _lorenz(attach(pairs, firsts, list(keys), "inner"), keys, "y")
    best = best.select(F.struct(*keys).alias("_as"), F.col("_area").alias("_best"))
    return got.join(same, list(keys)).join(best, "_as").select(
        *keys, F.try_divide(F.col("_area"), F.col("_best")).alias("score")
    )


def combined(preds: DataFrame, name: str, keys: tuple[str, ...] = KEYS, target: str = "target") -> DataFrame:
    """Mean over targets of one score, equal weights."""
    per = score(preds, name, (*keys, target))
    return per.groupBy(*keys).agg(F.avg("score").alias("score"))


def score_table(preds: DataFrame, names: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``(keys, score_name, score)``; all plain scores share one aggregate."""
    plain = [n for n in names if n in SIMPLE]
    out = None
    if plain:
        wide = preds.groupBy(*keys).agg(
            *[simple(n).alias(n) for n in plain]
        )
        out = wide.unpivot(list(keys), plain, "score_name", "score")
    for n in names:
        if n not in SIMPLE:
            one = score(preds, n, keys).withColumn("score_name", F.lit(n))
            out = one if out is None else out.unionByName(one)
    return out


def rank_rows(preds: DataFrame, keys: tuple[str, ...] = KEYS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``preds`` with ``p`` replaced by its average rank within the key, as a share.

    Rank r of n becomes (r - 1/2) / n, so that keys of other sizes count alike.
    The predictions are computed once; their sizes and ranks read that file.
    While keys fit a task one window does it. Beyond that, ranks come from the
    distinct predictions; a value shared by very many rows is joined back by
    broadcast, so it does not pile up in one task.
    """
    cols, ks = preds.columns, list(keys)
    preds = stored(preds, "ranked")
    sizes = key_sizes(preds, ks)
    if sizes.largest <= block_rows:
        w = Window.partitionBy(*ks)
        by = w.orderBy("p")
        peers = F.count(F.lit(1)).over(by.rangeBetween(Window.currentRow, Window.currentRow))
        share = (F.rank().over(by) + peers / 2.0 - 1) / F.count(F.lit(1)).over(w)
        return preds.withColumn("p", share).select(*cols)
    hist = _histogram(preds, keys, F.col("p"), {"_n": F.count(F.lit(1))})
    run = running(hist, ks, [F.col("_v")], {"_upto": ("sum", "_n")}, key_sizes(hist, ks), block_rows)
    run = attach(run, Fitted(sizes.table, sizes.keys), ks, "inner", weight="_rows")
    ranks = run.select(*keys, F.col("_v").alias("p"), "_n", ((F.col("_upto") - F.col("_n") / 2.0) / F.col("_rows")).alias("rank"))
    return attach(preds, ranks, [*keys, "p"], weight="_n").withColumn("p", F.col("rank")).select(*cols)
