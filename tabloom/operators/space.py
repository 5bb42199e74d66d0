"""Search spaces, trial settings and their hashes.

A setting is an array of value indices, one per dimension in declared order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.hashing import md5_unit, pick_by_share
from tabloom.session import settle

HASH_DIGITS = 10


@dataclass(frozen=True)
class Dim:
    """A hyperparameter: finite values, a default and optional priors."""

    name: str
    values: tuple
    default: object
    priors: tuple[float, ...] = ()
    element: str = "predictor"

    @property
    def default_index(self) -> int:
        return self.values.index(self.default)

    @property
    def shares(self) -> list[tuple[int, float]]:
        priors = self.priors or (1.0,) * len(self.values)
        return list(enumerate(float(p) for p in priors))


@dataclass
class Space:
    dims: list[Dim] = field(default_factory=list)

    def names(self) -> list[str]:
        return [d.name for d in self.dims]

    def decode(self, indices: list[int]) -> dict[str, object]:
        return {d.name: d.values[i] for d, i in zip(self.dims, indices)}

    def defaults(self) -> list[int]:
        return [d.default_index for d in self.dims]


def index_array(cols: list[Column]) -> Column:
    return F.array(*[c.cast("int") for c in cols])


def trial_hash(indices: Column) -> Column:
    """First ten hex digits of the SHA-256 of the comma-joined indices."""
    return F.substring(F.sha2(F.array_join(indices.cast("array<string>"), ","), 256), 1, HASH_DIGITS)


def trial_name(base: Column | str, indices: Column) -> Column:
    b = F.lit(base) if isinstance(base, str) else base
    return F.concat(b, F.lit("_hyperopt_"), trial_hash(indices))


def drop_column_dims(priors: list[tuple[str, float | None]]) -> list[Dim]:
    """A drop flag per feature; a known drop probability becomes its prior."""
    return [
        Dim(f"{name}_to_drop", (False, True), False, (1 - p, p) if p is not None else (1.0, 1.0), "drop_columns")
        for name, p in priors
    ]


def _replace_at(array: Column, i: int, value: Column) -> Column:
    return F.transform(array, lambda x, j: F.when(j == i, value).otherwise(x))


def grid_space(start: DataFrame, space: Space, free: list[str], index: str = "indices") -> DataFrame:
    """All settings of the free dimensions, the others as in ``start``.

    Every free dimension is one explode of its declared index range; the full
    product over all dimensions is never built.
    """
    out = start
    for i, d in enumerate(space.dims):
        if d.name not in free:
            continue
        out = out.withColumn("_v", F.explode(F.sequence(F.lit(0), F.lit(len(d.values) - 1))))
        out = out.withColumn(index, _replace_at(F.col(index), i, F.col("_v"))).drop("_v")
    return out


def draw_settings(
    draws: DataFrame, space: Space, draw_id: str, seed: int, free: list[str] | None = None
) -> DataFrame:
    """One setting per draw: each free dimension by its priors, others default.

    A draw depends on its id, the dimension and the seed only.
    """
    picks = []
    for d in space.dims:
        if free is not None and d.name not in free:
            picks.append(F.lit(d.default_index))
        else:
            picks.append(pick_by_share(md5_unit(seed, d.name, F.col(draw_id)), d.shares))
    return draws.withColumn("indices", index_array(picks)).withColumn("hash", trial_hash(F.col("indices")))


def new_settings(settings: DataFrame, done: DataFrame) -> DataFrame:
    """Distinct settings whose hash has not been trained."""
    return settings.select("hash", "indices").dropDuplicates(["hash"]).join(
        done.select("hash").distinct(), "hash", "left_anti"
    )


def slice_size(space: Space, free: list[str] | None = None) -> int:
    """Settings that draws can reach: values without a share are never drawn."""
    size = 1
    for d in space.dims:
        if free is None or d.name in free:
            size *= sum(share > 0 for _, share in d.shares)
    return size


def random_trials(
    spark: SparkSession, space: Space, n: int, seed: int, done: DataFrame | None = None, free: list[str] | None = None
) -> DataFrame:
    """The first ``n`` distinct new settings among seeded draws: ``(hash, indices)``.

    Draws that were trained already do not use up the number. Draws are doubled
    until there are ``n`` new settings; once doubling brings none, the settings
    left have hardly any share, and the rest is taken from the grid of the free
    dimensions by hash. Fewer than ``n`` come back only if no more are left.
    """
    trained = None if done is None else settle(done.select("hash").distinct())
    new = lambda df: df if trained is None else df.join(trained, "hash", "left_anti")
    size, draws, before = slice_size(space, free), 2 * n, -1
    while True:
        drawn = draw_settings(spark.range(draws), space, "id", seed, free)
        firsts = drawn.groupBy("hash").agg(F.min("id").alias("id"), F.first("indices").alias("indices"))
        found = settle(new(firsts).orderBy("id").limit(n))
        have = found.count()
        if have >= min(n, size) or (have == before and draws >= 64 * n):
            break
        before, draws = have, draws * 2
    out = found.select("hash", "indices")
    if have >= min(n, size):
        return out
    varied = [d for d in space.dims if free is None or d.name in free]
    reached = [F.array(*[F.lit(i) for i, share in d.shares if share > 0]) for d in varied]
    grid = spark.range(1).select(index_array([F.lit(i) for i in space.defaults()]).alias("indices"))
    for d, values in zip(varied, reached):
        at = space.names().index(d.name)
        grid = grid.withColumn("_v", F.explode(values)).withColumn("indices", _replace_at(F.col("indices"), at, F.col("_v"))).drop("_v")
    rest = new(grid.withColumn("hash", trial_hash(F.col("indices")))).join(found.select("hash"), "hash", "left_anti")
    by_hash = rest.orderBy(F.xxhash64(F.lit(seed), "hash"), "hash").limit(n - have)
    return out.unionByName(by_hash.select("hash", "indices"))


def remaining_trials(wanted: DataFrame, done: DataFrame, n_trials: int, subtract: bool) -> DataFrame:
    """``(existing, remaining)``: trials still to run with or without discounting."""
    have = wanted.select("hash").distinct().join(done.select("hash").distinct(), "hash", "left_semi")
    n = have.agg(F.count(F.lit(1)).alias("existing"))
    left = F.greatest(F.lit(n_trials) - F.col("existing"), F.lit(0)) if subtract else F.lit(n_trials)
    return n.select("existing", left.cast("long").alias("remaining"))


def hybrid_trials(
    selected: DataFrame, parent: list[int], space: Space, element: str, new_base: str, done: DataFrame
) -> DataFrame:
    """Take ``element``'s indices from each selected setting, the rest from a parent.

    ``selected(submission, indices)``; trials whose name exists are left out.
    """
    mixed = index_array(
        [
            F.col("indices")[i] if d.element == element else F.lit(parent[i])
            for i, d in enumerate(space.dims)
        ]
    )
    out = selected.select(F.col("submission").alias("parent"), mixed.alias("indices"))
    out = out.withColumn("submission", trial_name(new_base, F.col("indices")))
    fresh = out.groupBy("submission").agg(F.min("parent").alias("parent"), F.first("indices").alias("indices"))
    return fresh.join(done.select("submission").distinct(), "submission", "left_anti")


def arm_settings(arms: DataFrame, space: Space, base: str) -> DataFrame:
    """Known-good settings as trials; absent dimensions take their default.

    ``arms`` has an index column ``<name>_i`` for each dimension it knows.
    """
    cols = [
        F.coalesce(F.col(f"{d.name}_i"), F.lit(d.default_index)) if f"{d.name}_i" in arms.columns else F.lit(d.default_index)
        for d in space.dims
    ]
    idx = index_array(cols)
    return (
        arms.where(F.col("contributivity").isNotNull())
        .select(trial_name(base, idx).alias("submission"), trial_hash(idx).alias("hash"), idx.alias("indices"))
        .dropDuplicates(["submission"])
    )
