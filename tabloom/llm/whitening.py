"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

With A the centred rows, A v and A'u are taken in turn. One pass over the rows
makes p = A y and A'p, summed over tasks by Spark; the driver holds vectors of
the dimension of the rows only. A left vector has a number per row and is never
stored: it is A z for a z that the driver knows, so its products with p are z
times A'p, and full reorthogonalisation of both sides needs no further pass. A
pass is repeated where the correction is large. The singular value
decomposition of the small matrix yields components and deviations.

Lanczos vectors that end early are restarted by a random direction orthogonal
to all before, and so is a run whose leading components have converged, once
for each time they change: repeated eigenvalues are not lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import table
from tabloom.llm.registry import query
from tabloom.session import stored


@dataclass(frozen=True)
class WhitenSettings:
    components: int = 32  # at most
    scale: int = 64
    shift: int = 1_000_000
    tolerance: float = 1e-14  # of a residual, against the largest singular value
    rank_tolerance: float = 1e-10  # directions below this part of the largest have no component
    probe_steps: int = 8  # taken from a random direction after convergence
    seed: int = 11


@dataclass(frozen=True)
class Centre:
    """Row count and exact sums. A mean is an integer and a remainder, so that
    subtracting it loses nothing."""

    n: int
    sums: np.ndarray

    @property
    def whole(self) -> np.ndarray:
        return self.sums // self.n

    @property
    def part(self) -> np.ndarray:
        return (self.sums % self.n) / self.n

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.part


def coded(rows: DataFrame, id_col: str, vector_col: str, settings: WhitenSettings = WhitenSettings()) -> DataFrame:
    """(id, x array<long>) of the rows with a usable vector, x = floor(scale * c) + shift.

    Left out are null vectors, empty ones, those with a null or non-finite entry
    or one whose x is no long, and those whose length is not the commonest (of
    equally common ones the longest).
    """
    v = F.col(f"`{vector_col}`")
    fits = lambda c: F.coalesce(F.abs(c.cast("double")) < 2.0**62 / settings.scale, F.lit(False)) & ~F.isnan(c.cast("double"))
    code = lambda c: F.floor(c.cast("double") * settings.scale) + F.lit(settings.shift).cast("long")
    clean = stored(
        rows.select(F.col(f"`{id_col}`").alias("id"), v.alias("v"))
        .where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", fits))
        .select("id", F.transform("v", code).alias("x")),
        "coded",
    )
    sizes = clean.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    d = sizes.agg(F.max(F.struct("n", "d")).alias("m")).first()["m"]
    return clean.where(F.size("x") == (d["d"] if d else 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column(batch.schema.get_field_index("x"))
    return np.asarray(lists.flatten(), np.int64).reshape(len(lists), -1)


def _summed(xs: DataFrame, size: int, partial: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """Sum over all rows of ``partial(matrix)``: each task sends ``size`` numbers,
    Spark adds them by their place, the driver gets ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = partial(_matrix(batch))
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(size)), pa.array(total)], names=["at", "value"])

    rows = xs.select("x").mapInArrow(run, f"at long, value {kind}").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(size, np.int64 if kind == "long" else np.float64)
    for r in rows:
        out[r["at"]] = r["value"]
    return out


def centre(xs: DataFrame) -> Centre | None:
    """Count and sums of the rows, or None without rows."""
    first = xs.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    sums = _summed(xs, first["d"] + 1, lambda m: np.append(m.sum(axis=0), len(m)), "long")
    return Centre(int(sums[-1]), sums[:-1])


def products(xs: DataFrame, c: Centre) -> Callable[[np.ndarray], tuple[float, np.ndarray, float]]:
    """y -> (|A y|^2, A'A y, |A|^2) by one pass over the rows."""
    d = len(c.sums)

    def product(y: np.ndarray) -> tuple[float, np.ndarray, float]:
        def partial(m: np.ndarray) -> np.ndarray:
            a = c.centred(m)
            p = a @ y
            return np.concatenate([a.T @ p, [p @ p, np.einsum("ij,ij->", a, a)]])

        total = _summed(xs, d + 2, partial, "double")
        return float(total[d]), total[:d], float(total[d + 1])

    return product


@dataclass(frozen=True)
class Spectrum:
    vectors: np.ndarray  # a column per component
    singular: np.ndarray  # of A, falling
    square: float  # |A|^2
    passes: int


def bidiagonalise(product, d: int, settings: WhitenSettings = WhitenSettings()) -> Spectrum:
    """Leading components from ``product`` (see ``products``)."""
    rng = np.random.default_rng(settings.seed)
    k = min(settings.components, d)
    v = np.zeros((d, 0))
    z, w = np.zeros((d, 0)), np.zeros((d, 0))  # u = A z and A'u
    b = np.zeros((0, 0))
    cut: list[tuple[int, float]] = []  # couplings that a restart dropped
    square, passes, top, before, since = 0.0, 0, 0.0, None, 0

    def across(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - v @ (v.T @ x)
        return x

    def fresh() -> np.ndarray:
        x = across(rng.standard_normal(d))
        return across(x / np.linalg.norm(x))

    nxt, beta = fresh(), 0.0
    while True:
        step = v.shape[1]
        new = nxt / np.linalg.norm(nxt)
        y = new - beta * z[:, -1] if step and beta else new
        size, q, square = product(y)
        passes += 1
        column = np.zeros(step)
        if step and beta:
            column[-1] = beta
        for _ in range(3):
            c = z.T @ q
            y, left = y - z @ c, size - c @ c
            column += c
            if left > 0.5 * size or size <= (settings.rank_tolerance * top) ** 2:
                q, size = q - w @ c, max(left, 0.0)
                break
            # much was taken away: the rest is made anew from the rows
            size, q, _ = product(y)
            passes += 1
        alpha = np.sqrt(size)
        v = np.c_[v, new]
        if alpha <= max(top, np.sqrt(square / d)) * 1e-13 or square == 0:
            alpha, z, w = 0.0, np.c_[z, np.zeros(d)], np.c_[w, np.zeros(d)]
        else:
            z, w = np.c_[z, y / alpha], np.c_[w, q / alpha]
        b = np.block([[b, column[:, None]], [np.zeros((1, step)), np.array([[alpha]])]])
        left_vectors, singular, right_t = np.linalg.svd(b)
        top = singular[0]
        nxt = across(w[:, -1] - alpha * new)
        beta = float(np.linalg.norm(nxt))
        if v.shape[1] == d or square == 0:
            break
        ended = beta <= max(top, 1e-300) * 1e-13
        rest = np.abs(left_vectors[-1, :k]) * beta + sum(np.abs(left_vectors[i, :k]) * s for i, s in cut)
        since += 1
        if len(singular) >= k and (rest <= settings.tolerance * top).all() and since > settings.probe_steps:
            if before is not None and np.allclose(before, singular[:k], rtol=1e-12, atol=1e-12 * top):
                break
            before, since = singular[:k], 0
            cut.append((step, beta))
            ended = True
        if ended:
            nxt, beta = fresh(), 0.0
    found = singular[:k] > settings.rank_tolerance * max(top, 1e-300)
    return Spectrum(v @ right_t[:k][found].T, singular[:k][found], square, passes)


def whiten(rows: DataFrame, id_col: str = "id", vector_col: str = "vector", settings: WhitenSettings = WhitenSettings()) -> DataFrame:
    """A row per usable vector and component: (id, component, n, deviation,
    whitened, explained, identity_error). See ``coded`` for the vectors left out.

    Directions without variance have no component, so one row alone, or rows
    all equal, give no result row; neither does an empty table. Repeated rows
    are rows of their own, repeated and null ids are kept. Other columns are
    ignored. A deviation beyond a long raises.
    """
    kind = dict(rows.dtypes)[id_col]
    schema = (
        f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    spark = rows.sparkSession
    xs = coded(rows, id_col, vector_col, settings)
    c = centre(xs)
    if c is None:
        return spark.createDataFrame([], schema)
    spectrum = bidiagonalise(products(xs, c), len(c.sums), settings)
    k = len(spectrum.singular)
    if k == 0:
        return spark.createDataFrame([], schema)
    eigenvalues = spectrum.singular**2 / c.n
    explained = eigenvalues * c.n / spectrum.square
    project = spectrum.vectors / np.sqrt(eigenvalues)

    def moments(m: np.ndarray) -> np.ndarray:
        y = c.centred(m) @ project
        return np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])

    total = _summed(xs, k * k + k, moments, "double") / c.n
    mean = total[k * k :]
    identity_error = float(np.abs(total[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                m = _matrix(piece)
                y = c.centred(m) @ project
                far = c.n * (m - c.whole) - c.sums % c.n
                if c.n * (float(np.abs(m - c.whole).max()) + 1) * np.sqrt(m.shape[1]) >= 2.0**31.5:
                    if float((far.astype(float) ** 2).sum(axis=1).max()) >= 2.0**62.99:
                        raise OverflowError("a deviation does not fit a long")
                deviation = (far * far).sum(axis=1)
                rows_ = len(m)
                ids = piece.column(0).take(pa.array(np.repeat(np.arange(rows_), k)))
                columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_))]
                columns += [pa.array(np.full(rows_ * k, c.n)), pa.array(np.repeat(deviation, k)), pa.array(y.ravel())]
                columns += [pa.array(np.tile(explained, rows_)), pa.array(np.full(rows_ * k, identity_error))]
                yield pa.record_batch(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return xs.select("id", "x").mapInArrow(run, schema)


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``embeddings`` whitened on up to 32 components."""
    return whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumnRenamed("id", "vec_id")
