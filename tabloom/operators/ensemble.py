"""Bagging over folds and forward-greedy blending of submissions.

Predictions are long: ``(submission, fold, row_id, y, p)``. A held-out row
occurs once per fold that held it out, a test row once per fold. With a ``class``
column a row has one prediction per class, and classes are averaged separately.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.joins import attach
from tabloom.functions.spread import spread
from tabloom.operators import greedy as G
from tabloom.operators import scores as S
from tabloom.session import stored

#: a step must better the score by this share of it
MIN_GAIN = 1e-9
#: predictions of one fold that a task may hold at once, beside the copies and orders its scores make of them
FOLD_CELLS = 1_000_000


def _cell(preds: DataFrame) -> list[str]:
    """What a single number is predicted for: a row, a row and class, or a row and target."""
    return ["row_id", *[c for c in ("class", "target") if c in preds.columns]]


def bag(preds: DataFrame, keys: tuple[str, ...] = ("submission",)) -> DataFrame:
    """Average of a row's predictions over the folds that have one."""
    keys = (*keys, *_cell(preds))
    aggs = [F.avg("p").alias("p")]
    if "y" in preds.columns and "y" not in keys:
        aggs.insert(0, F.first("y", ignorenulls=True).alias("y"))
    return preds.groupBy(*keys).agg(*aggs)


def bag_ranks(preds: DataFrame) -> DataFrame:
    """Bag of the ranks within submission and fold, for rank-based scores."""
    return bag(S.rank_rows(preds, _ranked_by(preds, ("submission", "fold"))))


def _ranked_by(preds: DataFrame, keys: tuple[str, ...]) -> tuple[str, ...]:
    """Ranks are those of one target."""
    return (*keys, "target") if "target" in preds.columns else keys


def score_of(preds: DataFrame, name: str, keys: tuple[str, ...]) -> DataFrame:
    """The score per key; with several targets the mean of theirs."""
    return (S.combined if "target" in preds.columns else S.score)(preds, name, keys)


def bagged_scores(preds: DataFrame, name: str, folds: list[int]) -> DataFrame:
    """``(submission, n_folds, score)``: the bag after each added fold.

    The predictions of a cell are brought together once, in the order of the
    fold list. Its bag changes only where a fold has one, so it is a number per
    such step; a step is repeated for the prefixes it holds for behind the
    shuffle, on its way into the scores.
    """
    cell = _cell(preds)
    place = F.array_position(F.array(*[F.lit(f) for f in folds]), F.col("fold")).cast("int")
    mine = F.collect_list(F.struct(place.alias("at"), F.col("p").cast("double").alias("p")))
    cells = preds.where(F.col("fold").isin(folds)).groupBy("submission", *cell).agg(
        F.first("y").alias("y"), F.sort_array(mine).alias("_mine")
    )

    def step(x: Column, i: Column) -> Column:
        known = F.filter(F.transform(F.slice("_mine", F.lit(1), i + 1), lambda e: e["p"]), lambda p: p.isNotNull())
        mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, p: a + p), F.size(known))
        after = F.coalesce(F.get("_mine", i + 1)["at"], F.lit(len(folds) + 1))
        return F.struct(x["at"].alias("first"), (after - 1).alias("last"), mean.alias("p"))

    steps = F.filter(F.transform("_mine", step), lambda s: s["first"] <= s["last"])
    rows = cells.select("submission", *cell, "y", F.explode(steps).alias("_step")).select(
        "submission", *cell, "y", "_step.p", F.explode(F.sequence("_step.first", "_step.last")).alias("n_folds")
    )
    return score_of(rows, name, ("submission", "n_folds"))


# --- one greedy step -------------------------------------------------------


def blend_step(
    preds: DataFrame,
    chosen: list[str],
    name: str,
    keys: tuple[str, ...] = ("fold",),
) -> DataFrame:
    """``(keys, submission, score)``: every candidate added to the chosen sum.

    The chosen members' sum per row is a window over the row's submissions, so
    candidates meet it without a self-join. ``chosen`` may repeat names.
    """
    times = F.lit(0)
    for c in sorted(set(chosen)):
        times = F.when(F.col("submission") == c, F.lit(chosen.count(c))).otherwise(times)
    row = Window.partitionBy(*keys, *_cell(preds))
    base = F.sum(F.col("p") * times).over(row)
    mixed = preds.withColumn("p", (base + F.col("p")) / F.lit(len(chosen) + 1.0))
    return score_of(mixed, name, (*keys, "submission"))


def best_candidate(step: DataFrame, name: str, keys: tuple[str, ...] = ("fold",)) -> DataFrame:
    """The best scored submission per key, the first name on ties."""
    sign = F.lit(1.0 if S.lower_is_better(name) else -1.0)
    order = F.struct((sign * F.col("score")).alias("s"), F.col("submission").alias("n"))
    return step.groupBy(*keys).agg(
        F.min_by("submission", order).alias("submission"), F.min_by("score", order).alias("score")
    )


# --- greedy selection ------------------------------------------------------


def wide_predictions(preds: DataFrame, names: list[str]) -> DataFrame:
    """``(fold, row_id, y, ps)`` with one array entry per submission."""
    cell = _cell(preds)
    return (
        preds.groupBy("fold", *cell)
        .agg(
            F.first("y", ignorenulls=True).alias("y"),
            *[F.max(F.when(F.col("submission") == n, F.col("p"))).alias(f"_{i}") for i, n in enumerate(names)],
        )
        .select("fold", *cell, "y", F.array(*[f"_{i}" for i in range(len(names))]).alias("ps"))
    )


def complete_members(wide: DataFrame, names: list[str]) -> tuple[dict[int, list[int]], dict[int, int]]:
    """Per fold, the places of the submissions that predict every cell of it, and its cells.

    A submission that lacks a prediction, or whose prediction is null or NaN,
    is no candidate in that fold: an average over other rows than those of its
    rivals could not be compared.
    """
    has = [F.count_if(F.col("ps")[i].isNotNull() & ~F.isnan(F.col("ps")[i])).alias(f"_{i}") for i in range(len(names))]
    rows = wide.groupBy("fold").agg(F.count(F.lit(1)).alias("_n"), *has).collect()  # a row per fold
    members = {r["fold"]: [i for i in range(len(names)) if r[f"_{i}"] == r["_n"]] for r in rows}
    return members, {r["fold"]: r["_n"] for r in rows}


def residual_table(wide: DataFrame, m: int) -> DataFrame:
    """``(fold, i, j, v)``: inner products of the residuals ``p - y`` of m members.

    Each Arrow batch is reduced to one matrix per fold, so the shuffle carries
    matrices and not rows or pairs of rows.
    """

    def reduce_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for fold, part in pdf.groupby("fold"):
                x = np.stack(part["ps"].to_numpy()).astype(float) - part["y"].to_numpy(dtype=float)[:, None]
                sums[fold] = sums.get(fold, 0.0) + x.T @ x
        for fold, g in sums.items():
            i, j = np.triu_indices(m)
            yield pd.DataFrame({"fold": fold, "i": i, "j": j, "v": g[i, j]})

    part = wide.select("fold", F.col("y").cast("double").alias("y"), "ps").mapInPandas(
        reduce_batches, "fold int, i int, j int, v double"
    )
    return part.groupBy("fold", "i", "j").agg(F.sum("v").alias("v"))


def _greedy_on_residuals(r: np.ndarray, members: list[int], steps: int | None) -> list[int]:
    """Indices chosen to minimise the squared error of the running average.

    The error of an average of t members is s'Rs / t^2 with s their counts, so
    nothing is subtracted and a large target costs no digits.
    """
    r = r[np.ix_(members, members)]
    picks: list[int] = []
    s_dot = np.zeros(len(members))
    s_sq, best = 0.0, np.inf
    while members and (steps is None or len(picks) < steps):
        sq = s_sq + 2 * s_dot + np.diag(r)
        err = sq / (len(picks) + 1) ** 2
        k = int(np.argmin(err))
        if not err[k] < best - MIN_GAIN * abs(best if np.isfinite(best) else 0.0):
            break
        best, s_sq = err[k], sq[k]
        picks.append(members[k])
        s_dot = s_dot + r[:, k]
    return picks


def _shares(fold: int, names: list[str], picks: list[str], n_folds: int) -> list[tuple]:
    return [
        (fold, n, picks.count(n) / len(picks), picks.count(n) / len(picks) / n_folds)
        for n in names
        if n in picks
    ]


WEIGHTS = "fold int, submission string, weight double, contributivity double"


def blend(preds: DataFrame, name: str, max_steps: int | None = None) -> DataFrame:
    """``(fold, submission, weight, contributivity)`` by greedy selection per fold.

    Selection is with replacement and goes on until no candidate betters the
    score; ``max_steps`` may end it earlier. Candidates of a fold are the
    submissions that predict all of it. For squared error one pass builds the
    residual matrices and the choice is made on them. For other scores, folds of
    at most ``FOLD_CELLS`` predictions are walked through by a task each. Beyond
    that each step is a job over the rows: means add up one number per fold and
    candidate, and rank scores are first bounded by histograms, so that only
    candidates which can still be best are sorted.
    """
    spark = preds.sparkSession
    pairs = preds.select("submission", "fold").distinct().collect()  # a row per submission and fold
    names, folds = sorted({r[0] for r in pairs}), sorted({r[1] for r in pairs})
    wide = stored(wide_predictions(preds, names), "wide")
    members, sizes = complete_members(wide, names)
    rows: list[tuple] = []
    several = "target" in wide.columns
    if name in ("rmse", "r2") and not several:
        m = len(names)
        known = [F.when(F.col("fold").isin([f for f in folds if i in members[f]]), F.col("ps")[i]) for i in range(m)]
        filled = wide.withColumn("ps", F.array(*[F.coalesce(k, F.col("y").cast("double")) for k in known]))
        grams = {f: np.zeros((m, m)) for f in folds}
        for c in residual_table(filled, m).collect():  # members squared per fold
            grams[c["fold"]][c["i"], c["j"]] = grams[c["fold"]][c["j"], c["i"]] = c["v"]
        picked = {f: [names[k] for k in _greedy_on_residuals(grams[f], members[f], max_steps)] for f in folds}
    elif name in G.SCORES and "class" not in wide.columns and max(sizes.values(), default=0) * len(names) <= FOLD_CELLS:
        picked = _greedy_in_tasks(wide, name, names, members, max_steps)
    else:
        picked = _greedy_by_jobs(wide, name, names, members, max_steps)
    for f in folds:
        rows += _shares(f, names, picked[f], len(folds)) if picked[f] else []
    return spark.createDataFrame(rows, WEIGHTS)


def _greedy_in_tasks(
    wide: DataFrame, name: str, names: list[str], members: dict[int, list[int]], max_steps: int | None
) -> dict[int, list[str]]:
    """A fold's matrix of predictions, of bounded size, is walked through by one task."""
    lower = S.lower_is_better(name)

    several = "target" in wide.columns

    def walk(table: pa.Table) -> pa.Table:
        fold = table.column("fold")[0].as_py()
        target = np.asarray(table.column("target").combine_chunks().dictionary_encode().indices) if several else None
        y = np.asarray(table.column("y"), float)
        ps = np.asarray(table.column("ps").combine_chunks().flatten(), float).reshape(len(y), -1)
        mine = members[fold]
        picks = G.greedy(name, lower, y, ps[:, mine], max_steps, MIN_GAIN, target)
        return pa.table({"fold": pa.array([fold], pa.int32()), "picks": pa.array([[mine[k] for k in picks]], pa.list_(pa.int32()))})

    rows = wide.select("fold", F.col("y").cast("double").alias("y"), "ps", *["target"] * several).groupBy("fold")
    found = rows.applyInArrow(walk, "fold int, picks array<int>").collect()  # a row per fold
    return {f: [] for f in members} | {r["fold"]: [names[i] for i in r["picks"]] for r in found}


def _step_sums(wide: DataFrame, name: str, picks: dict[int, list[int]], m: int) -> dict[int, np.ndarray]:
    """Scores of all candidates per open fold for a score that is a mean over rows."""
    counts = {f: np.bincount(p, minlength=m).astype(float) for f, p in picks.items()}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for fold, y, ps in _by_fold(batch):
                mixed = G.mixed(ps, counts[fold])
                sums[fold] = sums.get(fold, 0.0) + G.sums(name, y, mixed)
        for fold, s in sums.items():
            yield pa.record_batch(
                [pa.array([fold] * m, pa.int32()), pa.array(range(m), pa.int32()), pa.array(s[0]), pa.array(s[1])],
                names=["fold", "i", "s", "n"],
            )

    rows = wide.where(F.col("fold").isin(list(picks))).select("fold", F.col("y").cast("double").alias("y"), "ps")
    found = rows.mapInArrow(add, "fold int, i int, s double, n double").groupBy("fold", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = {f: np.full(m, np.nan) for f in picks}
    for r in found.collect():  # folds times members
        out[r["fold"]][r["i"]] = G.finish(name, r["s"], r["n"])
    return out


def _by_fold(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    if not batch.num_rows:
        return
    folds = np.asarray(batch.column(0))
    y = np.asarray(batch.column(1), float)
    ps = np.asarray(batch.column(2).flatten(), float).reshape(len(y), -1)
    for f in np.unique(folds):
        mine = folds == f
        yield int(f), y[mine], ps[mine]


def rank_edges(wide: DataFrame, m: int, bins: int = 512) -> dict[int, np.ndarray]:
    """Per fold, edges between bins that hold about as many mean predictions each."""
    mean = F.aggregate(F.filter("ps", lambda p: p.isNotNull() & ~F.isnan(p)), F.lit(0.0), lambda a, p: a + p) / m
    probs = [i / bins for i in range(1, bins)]
    rows = wide.groupBy("fold").agg(F.percentile_approx(mean, probs, 10 * bins).alias("q")).collect()  # a row per fold
    return {r["fold"]: np.unique(np.array(r["q"] or [], float)) for r in rows}


def _rank_survivors(
    wide: DataFrame, picks: dict[int, list[int]], members: dict[int, list[int]], m: int, edges: dict[int, np.ndarray]
) -> dict[int, list[int]]:
    """Per open fold the candidates whose area under the curve may be the greatest.

    Pairs in different bins are counted, pairs in one bin leave an interval; the
    histograms add up over tasks, whatever the number of rows.
    """
    counts = {f: np.bincount(p, minlength=m).astype(float) for f, p in picks.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist: dict[int, np.ndarray] = {}
        for batch in batches:
            for fold, y, ps in _by_fold(batch):
                mixed, size = G.mixed(ps, counts[fold]), len(edges[fold]) + 1
                place = np.searchsorted(edges[fold], mixed, "right") + size * np.arange(m)
                both = [np.bincount(place[y == k].ravel(), minlength=m * size).reshape(m, size) for k in (1, 0)]
                hist[fold] = hist.get(fold, 0) + np.stack(both)
        for fold, h in hist.items():
            lists = [pa.array(x.tolist(), pa.list_(pa.int64())) for x in h]
            yield pa.record_batch([pa.array([fold] * m, pa.int32()), pa.array(range(m), pa.int32()), *lists], names=["fold", "i", "pos", "neg"])

    def add(table: pa.Table) -> pa.Table:
        lists = [pa.array([np.array(table.column(c).to_pylist()).sum(axis=0).tolist()], pa.list_(pa.int64())) for c in ("pos", "neg")]
        return pa.table([table.column("fold")[:1], table.column("i")[:1], *lists], names=["fold", "i", "pos", "neg"])

    schema = "fold int, i int, pos array<bigint>, neg array<bigint>"
    rows = wide.where(F.col("fold").isin(list(picks))).select("fold", F.col("y").cast("double").alias("y"), "ps")
    found = rows.mapInArrow(count, schema).groupBy("fold", "i").applyInArrow(add, schema).collect()  # folds times members
    low, high = ({f: np.full(m, -np.inf) for f in picks} for _ in range(2))
    for r in found:
        pos, neg = np.array(r["pos"], float), np.array(r["neg"], float)
        sure = float((pos * (np.cumsum(neg) - neg)).sum())
        low[r["fold"]][r["i"]], high[r["fold"]][r["i"]] = sure, sure + float((pos * neg).sum())
    return {f: [i for i in members[f] if high[f][i] >= low[f][members[f]].max()] for f in picks}


def _greedy_by_jobs(
    wide: DataFrame, name: str, names: list[str], members: dict[int, list[int]], max_steps: int | None
) -> dict[int, list[str]]:
    """A job or two per step over all folds still open."""
    sign = 1.0 if S.lower_is_better(name) else -1.0
    picks: dict[int, list[str]] = {f: [] for f in members}
    best = {f: float("inf") for f in members}
    open_folds = {f for f, ms in members.items() if ms}
    cell = _cell(wide)
    blocks, m, t = len(cell) > 1, len(names), 0
    edges = rank_edges(wide, m) if name in ("auc", "gini") and not blocks else {}
    while open_folds and (max_steps is None or t < max_steps):
        t += 1
        chosen = {f: [names.index(n) for n in picks[f]] for f in sorted(open_folds)}
        if name in G.MEANS and not blocks:
            for f, values in _step_sums(wide, name, chosen, m).items():
                values = sign * values[members[f]]
                k = int(np.argmin(np.where(np.isnan(values), np.inf, values)))
                if not values[k] < best[f] - MIN_GAIN * abs(best[f] if best[f] != float("inf") else 0.0):
                    open_folds.discard(f)
                else:
                    best[f] = float(values[k])
                    picks[f].append(names[members[f][k]])
            continue
        able = _rank_survivors(wide, chosen, members, m, edges) if edges else members
        by_fold = lambda value: F.coalesce(*[F.when(F.col("fold") == f, value(f)) for f in sorted(open_folds)])
        times = by_fold(lambda f: F.array(*[F.lit(float(picks[f].count(n))) for n in names]))
        slots = by_fold(lambda f: F.array(*[F.lit(i) for i in able[f]]))
        base = F.aggregate(
            F.zip_with("ps", times, lambda p, c: F.when(c > 0, p * c).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b
        )
        mixed = (
            wide.where(F.col("fold").isin(sorted(open_folds)))
            .select("fold", *cell, "y", "ps", base.alias("_base"), F.explode(slots).alias("_i"))
            .select(
                "fold", *cell, "y",
                F.array(*[F.lit(n) for n in names])[F.col("_i")].alias("submission"),
                ((F.col("_base") + F.col("ps")[F.col("_i")]) / F.lit(float(t))).alias("p"),
            )
        )
        scored = score_of(mixed, name, ("fold", "submission")).where("score is not null")
        found = {r["fold"]: r for r in best_candidate(scored, name).collect()}  # a row per fold
        for f in sorted(open_folds):
            value = sign * found[f]["score"] if f in found else float("inf")
            if not value < best[f] - MIN_GAIN * abs(best[f] if best[f] != float("inf") else 0.0):
                open_folds.discard(f)
            else:
                best[f] = value
                picks[f].append(found[f]["submission"])
    return picks


# --- using weights ---------------------------------------------------------


def apply_blend(preds: DataFrame, weights: DataFrame) -> DataFrame:
    """``(fold, row_id, y, p)``: weighted mean of the chosen submissions per fold.

    The weight table has at most a row per submission and fold; its size is
    checked before it is broadcast.
    """
    on = [c for c in ("fold", "submission") if c in weights.columns and c in preds.columns]
    hit = attach(preds, weights.select(*on, "weight"), on, "inner")
    aggs = [F.try_divide(F.sum(F.col("weight") * F.col("p")), F.sum("weight")).alias("p")]
    if "y" in preds.columns:
        aggs.insert(0, F.first("y").alias("y"))
    return hit.groupBy("fold", *_cell(preds)).agg(*aggs)


def blend_then_bag(preds: DataFrame, weights: DataFrame, name: str | None = None) -> DataFrame:
    """``(row_id, y, p)``: blended in every fold, then averaged over folds.

    For a score that reads ranks only, the ranks within each fold are averaged:
    folds whose predictions lie on other scales then count alike.
    """
    blended = apply_blend(preds, weights)
    return bag(S.rank_rows(blended, _ranked_by(blended, ("fold",))) if name in S.RANK_SCORES else blended, ())


def bag_for(preds: DataFrame, name: str) -> DataFrame:
    """Bag of a submission's folds, of ranks if the score reads ranks only."""
    return bag_ranks(preds) if name in S.RANK_SCORES else bag(preds)


def bag_then_blend(preds: DataFrame, name: str, max_steps: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Bag each submission, then one greedy blend of the bags: (weights, output)."""
    bags = stored(bag_for(preds, name).withColumn("fold", F.lit(0)), "bags")
    bags = spread(bags, bags.count(), "row_id")
    weights = blend(bags, name, max_steps)
    return weights, apply_blend(bags, weights).drop("fold")


def contributivity_totals(contrib: DataFrame) -> DataFrame:
    """``(submission, contributivity)``: fold weights added, in integer thousandths."""
    total = F.round(F.sum("contributivity"), 3) * 1000
    return contrib.groupBy("submission").agg(F.round(total).cast("int").alias("contributivity"))


def blended_set(totals: DataFrame) -> DataFrame:
    return totals.where(F.col("contributivity") > 0)


def base_contributivity(
    totals: DataFrame, bases: list[str], floor: int = 100, base: Column | None = None
) -> DataFrame:
    """``(base, contributivity)``: a base's trials added up, plus a floor.

    The base is the name up to ``_hyperopt_``, so one base's name being a
    prefix of another's does no harm. Bases without trials get the floor.
    """
    of = F.split(F.col("submission"), "_hyperopt_")[0] if base is None else base
    sums = totals.groupBy(of.alias("base")).agg(F.sum("contributivity").alias("_c"))
    every = totals.sparkSession.createDataFrame([(b,) for b in bases], "base string")
    return every.join(sums, "base", "left").select(
        "base", (F.coalesce("_c", F.lit(0)) + floor).cast("long").alias("contributivity")
    )


def best_single(preds: DataFrame, means: DataFrame, name: str) -> DataFrame:
    """Bagged predictions of the best trial of every base, ranks for rank scores.

    ``means(base, submission, score)``; ties go to the first name.
    """
    sign = F.lit(1.0 if S.lower_is_better(name) else -1.0)
    order = F.struct((sign * F.col("score")).alias("s"), F.col("submission").alias("n"))
    best = means.groupBy("base").agg(F.min_by("submission", order).alias("submission"))
    return attach(bag_for(preds, name), best, ["submission"], "inner")
