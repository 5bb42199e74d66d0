"""Relational work over the trials table.

``trials`` has one row per (submission, fold): a score column per step, times,
fold sizes, and hyperparameter columns prefixed ``hyper_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.running import running
from tabloom.session import settle

KEY = "submission"


def trial_summary(scores: DataFrame, hypers: DataFrame, sizes: DataFrame, score: str) -> DataFrame:
    """Scores by step side by side, with hyperparameters and fold sizes.

    ``scores(submission, fold, step, score_name, value, seconds)``. Steps are
    known, so the pivot needs no pass to find them.
    """
    at = lambda s, c: F.max(F.when(F.col("step") == s, F.col(c)))
    wide = (
        scores.where(F.col("score_name") == score)
        .groupBy(KEY, "fold")
        .agg(
            *[at(s, "value").alias(f"{s}_{score}") for s in ("train", "valid")],
            *[at(s, "seconds").alias(f"{s}_time") for s in ("train", "valid")],
        )
    )
    return wide.join(hypers, KEY, "left").join(F.broadcast(sizes), "fold", "left")  # a row per fold


def full_folds(trials: DataFrame, folds: list[int]) -> DataFrame:
    """Rows of the wanted folds, of trials that have every one of them."""
    n = F.count("fold").over(Window.partitionBy(KEY))  # a trial's rows: one per fold
    wanted = trials.where(F.col("fold").isin(folds))
    return wanted.withColumn("_n", n).where(F.col("_n") == len(folds)).drop("_n")


def _per_trial(trials: DataFrame, agg, folds: list[int] | None) -> DataFrame:
    rows = trials if folds is None else full_folds(trials, folds)
    hypers = [c for c in rows.columns if c.startswith("hyper_")]
    values = [c for c in rows.columns if c not in (KEY, *hypers)]
    return rows.groupBy(KEY).agg(
        *[agg(c).alias(c) for c in values],
        *[F.first(c, ignorenulls=True).alias(c) for c in hypers],
    )


def trial_means(trials: DataFrame, folds: list[int] | None = None) -> DataFrame:
    return _per_trial(trials, F.avg, folds)


def trial_stds(trials: DataFrame, folds: list[int] | None = None) -> DataFrame:
    return _per_trial(trials, F.stddev_samp, folds)


def trial_counts(trials: DataFrame, folds: list[int] | None = None) -> DataFrame:
    return _per_trial(trials, F.count, folds)


def fold_bias(trials: DataFrame, score: str) -> DataFrame:
    """``(fold, bias)``: a fold's mean score minus the mean of the fold means."""
    means = trials.groupBy("fold").agg(F.avg(score).alias("_m")).collect()  # a row per fold
    if not means:
        return trials.limit(0).select("fold", F.lit(0.0).alias("bias"))
    centre = sum(r["_m"] for r in means) / len(means)
    return trials.sparkSession.createDataFrame(
        [(r["fold"], r["_m"] - centre) for r in means], "fold int, bias double"
    )


def unbiased(trials: DataFrame, score: str) -> DataFrame:
    """Adds ``<score>_unbiased``: the score with its fold's bias removed."""
    bias = fold_bias(trials, score)
    return (
        trials.join(F.broadcast(bias), "fold", "left")  # a row per fold
        .withColumn(f"{score}_unbiased", F.col(score) - F.col("bias"))
        .drop("bias")
    )


def _order(score: str, lower: bool) -> list[Column]:
    return [F.col(score).asc() if lower else F.col(score).desc(), F.col(KEY).asc()]


def select_top_n(means: DataFrame, score: str, n: int, lower: bool) -> DataFrame:
    """Best ``n`` trials, with the worst selected score beside each."""
    top = means.orderBy(*_order(score, lower)).limit(n).select(KEY, score)
    worst = F.max(score) if lower else F.min(score)
    return top.withColumn("cutoff", worst.over(Window.partitionBy(F.lit(0))))  # n rows


def select_by_cutoff(means: DataFrame, score: str, cutoff: float, lower: bool) -> DataFrame:
    good = F.col(score) <= F.lit(cutoff) if lower else F.col(score) >= F.lit(cutoff)
    return means.where(good)


def trial_errors(trials: DataFrame, score: str, folds: list[int]) -> DataFrame:
    """``(submission, score, mean_std)``: mean, and standard error of unbiased scores."""
    rows = unbiased(full_folds(trials, folds), score)
    return rows.groupBy(KEY).agg(
        F.avg(score).alias(score),
        (F.stddev_samp(f"{score}_unbiased") / F.sqrt(F.count("fold"))).alias("mean_std"),
    )


def sigma_cutoff(errors: DataFrame, score: str, top_n: int | None, n_sigma: float, lower: bool) -> float | None:
    top = errors if top_n is None else errors.orderBy(*_order(score, lower)).limit(top_n)
    m, s = top.agg(F.avg(score), F.avg("mean_std")).first()
    if m is None:
        return None
    return m + n_sigma * (s or 0.0) * (1 if lower else -1)


def select_within_sigma(
    trials: DataFrame, score: str, folds: list[int], top_n: int | None, n_sigma: float, lower: bool
) -> DataFrame:
    """Trials within ``n_sigma`` standard errors of the mean of the best ones."""
    errors = settle(trial_errors(trials, score, folds))  # a row per trial, read twice
    cutoff = sigma_cutoff(errors, score, top_n, n_sigma, lower)
    if cutoff is None:
        return errors.limit(0).select(KEY, score)
    return select_by_cutoff(errors, score, cutoff, lower).select(KEY, score)


def dedupe_trials(means: DataFrame, score: str) -> DataFrame:
    """One trial per distinct mean score, the first by name."""
    return means.groupBy(score).agg(F.min(KEY).alias(KEY))


def rank_best_trials(
    means: DataFrame, totals: DataFrame, base: str, score: str, lower: bool, top_n: int | None = None
) -> DataFrame:
    """Rank trials by score from 0 and name the kept ones by rank and contributivity.

    Kept: rank below ``top_n``, or a positive contributivity. The rank runs
    over all trials; ``running`` cuts it into range-partitioned pieces.
    """
    both = totals.join(means.select(KEY, score), KEY, "inner").withColumn("_all", F.lit(0))
    ranked = running(both, ["_all"], _order(score, lower), {"_at": ("sum", F.lit(1).cast("long"))})
    rank = F.col("_at") - 1
    kept = ranked if top_n is None else ranked.where((rank < top_n) | (F.col("contributivity") > 0))
    return kept.select(
        KEY,
        score,
        "contributivity",
        rank.alias("rank"),
        F.concat(F.lit(f"{base}_best_"), rank.cast("string"), F.lit("_"), F.col("contributivity").cast("string")).alias("new_name"),
    )
