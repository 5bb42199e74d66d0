"""Numeric feature and target transforms, and Gaussian mixture columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.hashing import md5_normal, md5_unit
from tabloom.functions.joins import attach
from tabloom.functions.quantiles import exact_quantiles
from tabloom.functions.running import running
from tabloom.meta import as_role
from tabloom.session import stored


def _replace(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    return df.select(
        *[as_role(exprs[c], c) if c in exprs else F.col(f"`{c}`") for c in df.columns]
    )


def standard_exprs(train: DataFrame, cols: list[str]) -> dict[str, Column]:
    """(x - mean) / population deviation; a constant column is only centred."""
    row = train.agg(
        *[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(f"`{c}`").alias(f"s{i}") for i, c in enumerate(cols)],
    ).first()
    return {
        c: (F.col(f"`{c}`") - F.lit(float(row[f"m{i}"] or 0.0))) / F.lit(float(row[f"s{i}"] or 1.0))
        for i, c in enumerate(cols)
    }


def scale_standard(train: DataFrame, other: DataFrame, cols: list[str]) -> DataFrame:
    """``other`` scaled by statistics of ``train``."""
    return _replace(other, standard_exprs(train, cols))


def scale_minmax(train: DataFrame, other: DataFrame, cols: list[str]) -> DataFrame:
    """(x - min) / (max - min); a constant column becomes x - min."""
    row = train.agg(
        *[F.min(f"`{c}`").alias(f"l{i}") for i, c in enumerate(cols)],
        *[F.max(f"`{c}`").alias(f"h{i}") for i, c in enumerate(cols)],
    ).first()
    exprs = {}
    for i, c in enumerate(cols):
        lo = float(row[f"l{i}"] or 0.0)
        width = float(row[f"h{i}"] or 0.0) - lo
        exprs[c] = (F.col(f"`{c}`") - F.lit(lo)) / F.lit(width or 1.0)
    return _replace(other, exprs)


def binary_columns(train: DataFrame, cols: list[str]) -> list[str]:
    """Columns holding no value but 0 and 1."""
    row = train.agg(
        *[F.max((~F.col(f"`{c}`").isin(0, 1)).cast("int")).alias(c) for c in cols]
    ).first()
    return [c for c in cols if not row[c]]


def quantile_grid(train: DataFrame, cols: list[str], n: int = 1000) -> dict[str, list[float]]:
    """``n`` evenly spaced exact quantiles per column, with linear interpolation.

    All ranks of all columns are found together: equal values are combined before
    the shuffle, running counts give the ranks that each distinct value covers,
    and only the values at wanted ranks come to the driver. Gaps are left out; a
    column of gaps has an empty grid.
    """
    doubles = [F.col(f"`{c}`").cast("double").alias(c) for c in cols]
    long = train.select(*doubles).unpivot([], cols, "feature", "v").where(F.col("v").isNotNull() & ~F.isnan("v"))
    hist = stored(long.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("_n")), "histogram")
    size = hist.groupBy("feature").agg(F.sum("_n").alias("_size"))
    run = running(hist, ["feature"], [F.col("v")], {"_upto": ("sum", "_n")})
    run = run.join(F.broadcast(size), "feature")  # a row per column
    # grid place i needs the ranks below and above i (size - 1) / (n - 1)
    last, step = F.col("_size") - 1, F.lit(n - 1)
    start = F.col("_upto") - F.col("_n")
    near = lambda rank: F.floor(rank * step / F.greatest(last, F.lit(1)))
    places = F.sequence(F.greatest(near(start - 1) - 1, F.lit(0)), F.least(near(F.col("_upto")) + 1, step).cast("bigint"))
    low = lambda i: F.floor(i * last / step)
    inside = lambda rank: (rank >= start) & (rank < F.col("_upto"))
    up = lambda i: F.ceil(i * last / step)
    hits = F.filter(places, lambda i: inside(low(i)) | inside(up(i)))
    rows = run.select("feature", "v", "_n", "_upto", "_size", F.explode(hits).alias("i"))
    i = F.col("i")
    grid = rows.groupBy("feature", "i").agg(
        F.max(F.when(inside(low(i)), F.col("v"))).alias("lo"), F.max(F.when(inside(up(i)), F.col("v"))).alias("hi"),
        F.first(i * last / step - F.floor(i * last / step)).alias("part"),
    )
    out: dict[str, list[float]] = {c: [] for c in cols}
    for r in grid.orderBy("feature", "i").collect():  # n rows per column
        out[r["feature"]].append(r["lo"] + (r["hi"] - r["lo"]) * r["part"])
    return out


def scale_quantile(train: DataFrame, other: DataFrame, cols: list[str], n: int = 1000) -> DataFrame:
    """Map to uniform [0, 1] by train's empirical quantiles; 0/1 columns pass.

    Interpolates from both ends and averages, so ties land in the middle of
    their range. A vectorised UDF does the search in the grid.
    """
    n = min(n, max(2, train.count()))
    passed = set(binary_columns(train, cols))
    todo = [c for c in cols if c not in passed]
    if not todo:
        return other
    grids = quantile_grid(train, todo, n)

    def mapper(grid: list[float]):
        q = np.asarray(grid) if grid else np.zeros(1)
        ref = np.linspace(0.0, 1.0, len(q))

        @F.pandas_udf("double")
        def place(x: pd.Series) -> pd.Series:
            v = x.to_numpy(dtype=float)
            up = np.interp(v, q, ref)
            down = -np.interp(-v, -q[::-1], -ref[::-1])
            return pd.Series(np.where(np.isnan(v), np.nan, 0.5 * (up + down))).where(~np.isnan(v), None)

        return place

    return _replace(other, {c: mapper(grids[c])(F.col(f"`{c}`").cast("double")) for c in todo})


def _bumps(n: int):
    """The cardinal cubic B-splines on [0, 4], shifted to start at knots -3, -2, ...: ``n`` values of a position.

    Made in Arrow batches: column expressions for so many pieces become one
    method that is too long for the JVM to compile, and is interpreted per row.
    """

    def bump(t: np.ndarray, j: int) -> np.ndarray:
        at = [t - float(j - 3 + k) for k in range(5)]
        u, v, w, z = at[0], at[1], at[2], 0.0 - at[4]
        pieces = [
            np.zeros(len(t)),
            u * u * u / 6.0,
            (-3.0 * v * v * v + 3.0 * v * v + 3.0 * v + 1.0) / 6.0,
            (3.0 * w * w * w - 6.0 * w * w + 4.0) / 6.0,
        ]
        outside = (u < 0.0) | (at[4] > 0.0) | np.isnan(t)
        return np.select([outside, at[1] < 0.0, at[2] < 0.0, at[3] < 0.0], pieces, z * z * z / 6.0)

    @F.arrow_udf("array<double>")
    def values(t: pa.Array) -> pa.Array:
        x = t.to_numpy(zero_copy_only=False).astype(float)
        flat = np.stack([bump(x, j) for j in range(n)], axis=1).ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n, dtype=np.int32)), pa.array(flat))

    return values


def spline_exprs(
    train: DataFrame, cols: list[str], knots: int = 5
) -> tuple[dict[str, Column], dict[str, list[Column]]]:
    """Cubic B-spline basis (knots + 2 columns) over train's range per column.

    Returns an array of each column's basis values, to be added first, and the
    expressions that read it.

    Knots are evenly spaced, so every basis function is one shifted bump. Values outside the range are clamped.
    Columns with at most two distinct values pass through.
    """
    row = train.agg(
        *[F.min(f"`{c}`").alias(f"l{i}") for i, c in enumerate(cols)],
        *[F.max(f"`{c}`").alias(f"h{i}") for i, c in enumerate(cols)],
    ).first()
    ends = {c: (row[f"l{i}"], row[f"h{i}"]) for i, c in enumerate(cols)}
    more = train.agg(
        *[
            F.max(
                ((F.col(f"`{c}`") != F.lit(ends[c][0])) & (F.col(f"`{c}`") != F.lit(ends[c][1]))).cast("int")
            ).alias(c)
            for c in cols
        ]
    ).first()
    place, out = {}, {}
    for i, c in enumerate(cols):
        if not more[c]:
            out[c] = [F.col(f"`{c}`")]
            continue
        lo, hi = (float(v) for v in ends[c])
        step = (hi - lo) / (knots - 1)
        x = f"least(greatest(cast(`{c}` as double), {lo!r}D), {hi!r}D)"
        place[f"_t_{i}"] = _bumps(knots + 2)(F.expr(f"({x} - {lo!r}D) / {step!r}D"))
        out[c] = [F.get(F.col(f"_t_{i}"), F.lit(j)) for j in range(knots + 2)]
    return place, out


def spline_basis(train: DataFrame, other: DataFrame, cols: list[str], knots: int = 5) -> DataFrame:
    place, exprs = spline_exprs(train, cols, knots)
    new = []
    for c in other.columns:
        if c not in exprs or len(exprs[c]) == 1:
            new.append(F.col(f"`{c}`"))
        else:
            new += [as_role(e, f"{c}_sp_{j}") for j, e in enumerate(exprs[c])]
    return (other.withColumns(place) if place else other).select(*new)


# --- targets ---------------------------------------------------------------


def log_target(y: Column) -> Column:
    return F.log1p(y)


def unlog_target(p: Column) -> Column:
    return F.expm1(p)


def target_stats(train: DataFrame, y: str) -> tuple[float, float]:
    row = train.agg(F.avg(y), F.stddev_pop(y)).first()
    return float(row[0]), float(row[1] or 1.0)


def standardize_target(y: Column, stats: tuple[float, float], scale: float = 1.0) -> Column:
    return (y - F.lit(stats[0])) / F.lit(stats[1]) * F.lit(float(scale))


def restore_target(p: Column, stats: tuple[float, float], scale: float = 1.0) -> Column:
    return p / F.lit(float(scale)) * F.lit(stats[1]) + F.lit(stats[0])


def bin_edges(train: DataFrame, y: str, bins: int = 10, how: str = "quantile", seed: int = 7) -> list[float]:
    """``bins + 1`` edges: ``uniform``, ``quantile`` or ``kmeans``; repeats merged."""
    lo, hi = (float(v) for v in train.agg(F.min(y), F.max(y)).first())
    if how == "uniform":
        edges = [lo + (hi - lo) * i / bins for i in range(bins)] + [hi]
    elif how == "quantile":
        edges = exact_quantiles(train, [y], [i / bins for i in range(bins + 1)])[y]
    elif how == "kmeans":
        points = VectorAssembler(inputCols=[y], outputCol="_x").transform(train.select(y))
        model = KMeans(k=bins, featuresCol="_x", seed=seed, maxIter=20).fit(points)
        centers = sorted(float(c[0]) for c in model.clusterCenters())
        edges = [lo] + [(a + b) / 2 for a, b in zip(centers, centers[1:])] + [hi]
    else:
        raise ValueError(f"unknown binning {how}")
    return sorted(set(edges))


def bin_code(y: Column, edges: list[float]) -> Column:
    """Code 0..k-1; bins are closed on the left, the last on both sides."""
    code = F.lit(0)
    for e in edges[1:-1]:
        code = code + (y >= F.lit(e)).cast("int")
    return F.when(y.isNotNull(), code)


def unbin_middle(code: Column, edges: list[float]) -> Column:
    mids = F.array(*[F.lit((a + b) / 2) for a, b in zip(edges, edges[1:])])
    return F.element_at(mids, code + 1)


def unbin_uniform(code: Column, edges: list[float], seed: int, row_id: Column) -> Column:
    """A uniform draw inside the bin, fixed by the row id."""
    lo = F.array(*[F.lit(a) for a in edges[:-1]])
    hi = F.array(*[F.lit(b) for b in edges[1:]])
    left, right = F.element_at(lo, code + 1), F.element_at(hi, code + 1)
    return left + md5_unit(seed, row_id) * (right - left)


# --- Gaussian mixtures -----------------------------------------------------


def mixture_mean(weights: Column, means: Column) -> Column:
    """Sum of weight times component mean, weights normalised."""
    add = lambda a, b: a + b
    dot = F.aggregate(F.zip_with(weights, means, lambda w, m: w * m), F.lit(0.0), add)
    return dot / F.aggregate(weights, F.lit(0.0), add)


def mixture_sample(weights: Column, means: Column, sigmas: Column, seed: int, row_id: Column) -> Column:
    """One draw per row: a component by cumulative weight, then its normal."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, b: a + b)
    u = md5_unit(seed, row_id) * total
    start = F.struct(F.lit(0.0).alias("acc"), F.lit(0).alias("pick"))
    walked = F.aggregate(
        weights,
        start,
        lambda s, w: F.struct(
            (s["acc"] + w).alias("acc"), (s["pick"] + (s["acc"] + w <= u).cast("int")).alias("pick")
        ),
    )
    k = F.least(walked["pick"] + 1, F.size(weights))
    return F.element_at(means, k) + F.element_at(sigmas, k) * md5_normal(seed + 1, row_id)


def silverman_bandwidth(draws: DataFrame, keys: list[str], value: str, dims: int = 1) -> DataFrame:
    """``(keys, n, bandwidth)``: Silverman's rule per group of draws."""
    shape = F.pow(F.col("n") * (dims + 2) / 4.0, F.lit(-1.0 / (dims + 4)))
    return (
        draws.groupBy(*keys)
        .agg(F.count(value).alias("n"), F.stddev_samp(value).alias("_s"))
        .select(*keys, "n", (F.col("_s") * shape).alias("bandwidth"))
    )


def kernel_mixture(draws: DataFrame, keys: list[str], value: str) -> DataFrame:
    """An equal-weight component per draw: ``(keys, w, mu, sigma)`` in long form."""
    bw = silverman_bandwidth(draws, keys, value)
    return attach(draws, bw, keys, "inner", weight="n").select(
        *keys, (1.0 / F.col("n")).alias("w"), F.col(value).alias("mu"), F.col("bandwidth").alias("sigma")
    )
