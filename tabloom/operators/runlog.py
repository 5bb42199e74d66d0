"""Queries over the run log.

``log(run, action_id, name, base, fold_lo, fold_hi, start_ts, stop_ts, score,
contributivities)``; ``fold_lo``/``fold_hi`` give a half-open fold range.
Queries that need the order of a run use ``running``, which splits a run too
long for one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.hashing import md5_unit
from tabloom.functions.joins import attach
from tabloom.functions.running import running

ORDER = ("start_ts", "action_id")


def _order() -> list[Column]:
    return [F.col(c) for c in ORDER]


def seconds() -> Column:
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return (micros("stop_ts") - micros("start_ts")) / F.lit(1e6)


def last_action(log: DataFrame, name: str, folds: tuple[int, int] | None = None, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """The latest record of a name per run, optionally of one fold range."""
    rows = log.where(F.col("name") == name)
    if folds is not None:
        rows = rows.where((F.col("fold_lo") == folds[0]) & (F.col("fold_hi") == folds[1]))
    rest = [c for c in log.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*ORDER)).alias("r"))
        .select(*keys, "r.*")
    )


def list_actions(log: DataFrame) -> DataFrame:
    return log.orderBy(*ORDER)


def truncate_after_last_blend(log: DataFrame, name: str = "blend") -> DataFrame:
    """Drop what started after the run's last blend stopped; runs without one stay."""
    last = log.where(F.col("name") == name).groupBy("run").agg(F.max("stop_ts").alias("_last"))
    rows = log.groupBy("run").agg(F.count(F.lit(1)).alias("_w"))
    hit = attach(log, last.join(rows, "run"), ["run"], weight="_w")
    return hit.where(F.col("_last").isNull() | (F.col("start_ts") <= F.col("_last"))).select(*log.columns)


def numbered(log: DataFrame, out: str) -> DataFrame:
    """Place 1, 2, ... of each record in its run."""
    return running(log, ["run"], _order(), {out: ("sum", F.lit(1).cast("long"))})


def pair_search_with_blend(log: DataFrame, search: str = "search", blend: str = "blend") -> DataFrame:
    """``(run, round_idx, ...)``: the i-th search that scored with the i-th blend.

    (run, round_idx) is unique on both sides, so the join has no hot key.
    """
    s = numbered(log.where((F.col("name") == search) & F.col("score").isNotNull()), "round_idx").select(
        "run", "round_idx", F.col("action_id").alias("search_id"), F.col("base"),
        seconds().alias("search_seconds"),
    )
    b = numbered(log.where(F.col("name") == blend), "round_idx").select(
        "run", "round_idx", F.col("action_id").alias("blend_id"), F.col("score"),
        seconds().alias("blend_seconds"), F.col("start_ts").alias("blend_ts"),
    )
    return s.join(b, ["run", "round_idx"])


def elapsed_hours(log: DataFrame, names: tuple[str, ...] = ("search", "blend")) -> DataFrame:
    """Running total of the time spent on the given actions, per run."""
    rows = log.where(F.col("name").isin(*names)).select("run", "action_id", "name", "start_ts", seconds().alias("_s"))
    out = running(rows, ["run"], _order(), {"elapsed": ("sum", "_s")})
    return out.select("run", "action_id", "name", (F.col("elapsed") / 3600).alias("elapsed_hours"))


def runtime_by_action(log: DataFrame, race_blend: str, search_folds: tuple[int, int]) -> DataFrame:
    """Seconds per action name; blends are told apart by their fold range."""
    on_search = (F.col("fold_lo") == search_folds[0]) & (F.col("fold_hi") == search_folds[1])
    label = (
        F.when((F.col("name") == race_blend) & on_search, F.lit("search_blend"))
        .when((F.col("name") == "blend") & ~on_search, F.lit("blend_then_bag"))
        .otherwise(F.col("name"))
    )
    return log.groupBy(label.alias("name")).agg(F.sum(seconds()).alias("seconds"))


def results_by_round(log: DataFrame, rounds: list[int], blend: str = "blend", final: str = "final") -> DataFrame:
    """Final-blend results of the scheduled rounds, the last record of each.

    The i-th final action belongs to the i-th blend on the final folds.
    ``round_idx`` is read from the final action.
    """
    b = numbered(log.where(F.col("name") == blend), "_i").select(
        "run", "_i", F.col("score").alias("valid_score"), seconds().alias("runtime")
    )
    f = numbered(log.where(F.col("name") == final), "_i").select(
        "run", "_i", "round_idx", F.col("start_ts").alias("round_ts"), F.col("action_id").alias("final_id")
    )
    both = b.join(f, ["run", "_i"]).where((F.col("round_idx") > 0) & F.col("round_idx").isin(rounds))
    return (
        both.groupBy("run", "round_idx")
        .agg(F.max_by(F.struct("valid_score", "runtime"), F.struct("round_ts", "final_id")).alias("r"))
        .select("run", "round_idx", "r.valid_score", "r.runtime")
    )


def round_state(log: DataFrame, n: int, blend: str = "blend") -> DataFrame:
    """``(run, submission, contributivity)``: the blend's members at its n-th round."""
    at = numbered(log.where(F.col("name") == blend), "_i").where(F.col("_i") == n)
    return at.select("run", F.explode("contributivities").alias("submission", "contributivity")).where(
        F.col("contributivity") > 0
    )


def round_contributivity(pairs: DataFrame, log: DataFrame) -> DataFrame:
    """Adds the searched base's contributivity in the round's own blend.

    Blend ids are unique, so the join has no hot key; the base is the member's
    name up to ``_hyperopt_``.
    """
    maps = log.select("run", F.col("action_id").alias("blend_id"), F.col("contributivities").alias("_m"))
    own = F.map_filter("_m", lambda k, v: F.split(k, "_hyperopt_")[0] == F.col("base"))
    total = F.aggregate(F.map_values(own), F.lit(0), lambda a, b: a + b)
    return pairs.join(maps, ["run", "blend_id"]).withColumn("contributivity", total).drop("_m")


def improvement_speed(pairs: DataFrame, floor: int = 100) -> DataFrame:
    """``(run, base, n, speed)``: contributivity now per second of search so far.

    ``pairs(run, base, round_idx, search_seconds, contributivity)``. A base
    with fewer than two rounds has the largest double as its speed.
    """
    top = F.lit(1.7976931348623157e308)  # largest double
    return (
        pairs.groupBy("run", "base")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max_by("contributivity", "round_idx").alias("_c"),
            F.sum("search_seconds").alias("_s"),
        )
        .select(
            "run", "base", "n",
            F.when(F.col("n") < 2, top)
            .otherwise(F.coalesce(F.try_divide((F.col("_c") + floor).cast("double"), F.col("_s")), top))
            .alias("speed"),
        )
    )


def choose_base(speeds: DataFrame, seed: int, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """The fastest base per run; ties are settled by a seeded draw."""
    draw = md5_unit(seed, F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("base").cast("string")))
    order = F.struct(F.col("speed").alias("s"), draw.alias("d"))
    return speeds.groupBy(*keys).agg(F.max_by("base", order).alias("base"))


def patience_stop(rounds: DataFrame, patience: int, lower: bool) -> DataFrame:
    """``(run, stop_round)``: the first round that ends ``patience`` rounds without gain.

    The running best of a round is compared with the one ``patience`` rounds
    earlier by an equi-join on (run, round), unique on both sides.
    ``rounds(run, start_ts, action_id, score)``.
    """
    if patience < 1:
        raise ValueError("patience must be at least 1")
    best = running(
        rounds, ["run"], _order(),
        {"round_idx": ("sum", F.lit(1).cast("long")), "best": ("min" if lower else "max", "score")},
    ).select("run", "round_idx", "best")
    early = best.select("run", (F.col("round_idx") + patience).alias("round_idx"), F.col("best").alias("_early"))
    stale = F.col("_early") <= F.col("best") if lower else F.col("_early") >= F.col("best")
    return (
        best.join(early, ["run", "round_idx"])
        .where(stale)
        .groupBy("run")
        .agg(F.min("round_idx").alias("stop_round"))
    )


def final_blend_cost(
    members: DataFrame,
    fold_seconds: DataFrame,
    elapsed: Column | float,
    blend_seconds: Column | float,
    n_search: int,
    n_final: int,
    max_hours: float,
) -> DataFrame:
    """``(train_hours, blend_hours, over_budget)`` of finishing now.

    Training: the members' first-fold seconds for each further fold. Blending:
    twice the last blend, scaled by the fold ratio.
    """
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    train = fold_seconds.join(members.select("submission"), "submission", "left_semi").agg(
        (F.coalesce(F.sum("seconds"), F.lit(0.0)) * (n_final - n_search) / 3600).alias("train_hours")
    )
    blend_hours = 2 * lit(blend_seconds) * n_final / n_search / 3600
    return train.withColumn("blend_hours", blend_hours).withColumn(
        "over_budget", lit(elapsed) + F.col("train_hours") + F.col("blend_hours") > max_hours
    )
