"""Exact nearest neighbours in two rounds over a metric tree.

Pivots, as many as the table needs for leaves of about ``leaf_rows`` rows, are
grouped below fewer tops; a row goes to its nearest top and there to its nearest
pivot. In the first round a query meets its own leaf only, which gives the true
distance of a k-th neighbour. In the second it meets those leaves that the ball
of that radius cuts, by the triangle inequality.

Leaves are packed into parts of bounded size. A query is sent once to a part,
with the numbers of the leaves it has to see there, and not once to a leaf; the
tables of visits that are planned and counted hold numbers and no vectors. A
leaf larger than a part is dealt over several tasks, and each task returns the
k best of what it has seen.

Within a task a cheap lower bound of the distance (``Screen``) rules out most
rows of a leaf: those beyond the query's k-th distance so far, which begins at
the radius of the first round. Only the others' distances are computed in full.
The result is exact for any metric used here.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.hashing import md5_int
from tabloom.session import stored

LEAF_ROWS = 2_000
#: most rows of a part; smaller tables have smaller parts, so that there is a task for every core
PART_ROWS = 60_000
TASKS_PER_CORE = 4
#: pivots are sent to every task; beyond this size leaves grow instead
PIVOT_BYTES = 32 << 20
#: bounds of a block that are held at once
CELLS = 1 << 19
#: differences of a block, which stay in a core's cache while they are summed
CACHE_CELLS = 1 << 17
#: fewer queries of a leaf are not worth a screen
SCREEN_QUERIES = 64
METRICS = {"l1": 1.0, "l2": 2.0, "chebyshev": math.inf}


def distances(q: np.ndarray, points: np.ndarray, order: float) -> np.ndarray:
    """A row per query and a column per point, by blocks of queries."""
    out = np.empty((len(q), len(points)))
    step = max(1, CACHE_CELLS // max(1, points.size))
    for at in range(0, len(q), step):
        gap = np.abs(q[at : at + step, None, :] - points[None, :, :])
        if order == 1.0:
            out[at : at + step] = gap.sum(axis=2)
        elif order == 2.0:
            out[at : at + step] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
        else:
            out[at : at + step] = gap.max(axis=2) if gap.shape[2] else 0.0
    return out


def between(q: np.ndarray, points: np.ndarray, order: float) -> np.ndarray:
    """Distances of pairs: row by row."""
    out = np.empty(len(q))
    step = max(1, CACHE_CELLS // max(1, q.shape[1]))
    for at in range(0, len(q), step):
        gap = np.abs(q[at : at + step] - points[at : at + step])
        if order == 1.0:
            out[at : at + step] = gap.sum(axis=1)
        elif order == 2.0:
            out[at : at + step] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        else:
            out[at : at + step] = gap.max(axis=1) if gap.shape[1] else 0.0
    return out


class Screen:
    """Scores of points against queries and, per query, the score that no point within ``limit`` exceeds.

    Here the scores are the distances themselves.
    """

    def __init__(self, points: np.ndarray, order: float):
        self.points, self.order = points, order

    def scores(self, q: np.ndarray) -> np.ndarray:
        return distances(q, self.points, self.order)

    def reach(self, q: np.ndarray, limit: np.ndarray) -> np.ndarray:
        return limit * (1 + 1e-9)  # sums in another order may differ by a rounding


class SquareScreen(Screen):
    """Squared distances less the query's square, by one product in single precision; ``reach`` covers its rounding."""

    def __init__(self, points: np.ndarray):
        self.centre = points.mean(axis=0)
        p = points - self.centre
        self.square = np.einsum("ij,ij->i", p, p)
        self.points = np.concatenate([p, self.square[:, None]], axis=1).astype(np.float32)

    def scores(self, q: np.ndarray) -> np.ndarray:
        return np.concatenate([-2 * (q - self.centre), np.ones((len(q), 1))], axis=1).astype(np.float32) @ self.points.T

    def reach(self, q: np.ndarray, limit: np.ndarray) -> np.ndarray:
        square, most = ((q - self.centre) ** 2).sum(axis=1), self.square.max()
        # each of the d + 1 products and sums may be off by a rounding of the largest value there
        slack = (q.shape[1] + 8) * 2.0**-22 * (square + 2 * np.sqrt(square * most) + most) + 1e-30
        return (limit * limit - square + slack).astype(np.float32)


class CellScreen(Screen):
    """City-block distances in whole cells of one width, as sums of short integers.

    |a - b| is twice the larger less both. A gap counts at most one cell too
    many, and values beyond the range, which are moved to its ends, only come
    closer: what lies within ``limit`` also does so in cells, with one for each
    dimension.
    """

    def __init__(self, points: np.ndarray, levels: int):
        low, high = np.quantile(points[:: -(-len(points) // 10_000)], [0.001, 0.999], axis=0)
        self.low, self.levels = low, levels
        self.width = float((high - low).max()) / levels or 1.0
        cells = self.cells(points)
        half = cells.sum(axis=1, dtype=np.int64) // 2
        self.base = half.max()
        self.start = (self.base - half).astype(np.uint16)
        # blocks of points whose columns stay in a core's cache
        step = max(1, CACHE_CELLS // cells.shape[1])
        self.columns = [np.ascontiguousarray(cells[at : at + step].T) for at in range(0, len(cells), step)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((x - self.low) / self.width), 0, self.levels).astype(np.uint16)

    def scores(self, q: np.ndarray) -> np.ndarray:
        out, cells, at = np.empty((len(q), len(self.start)), np.uint16), self.cells(q), 0
        for columns in self.columns:
            larger, end = np.empty_like(columns), at + columns.shape[1]
            for total, x in zip(out, cells):
                np.maximum(columns, x[:, None], out=larger)
                np.add.reduce(larger, axis=0, dtype=np.uint16, out=total[at:end])
            at = end
        out += self.start
        return out

    def reach(self, q: np.ndarray, limit: np.ndarray) -> np.ndarray:
        own = self.cells(q).sum(axis=1, dtype=np.int64)
        # two cells for the rounding of limits and of halves
        most = (limit * (1 + 1e-9) / self.width + q.shape[1] + own) / 2 + self.base + 2
        return np.clip(np.floor(most), 0, np.iinfo(np.uint16).max).astype(np.uint16)


def screen(points: np.ndarray, order: float) -> Screen:
    """The cheapest that fits: squares need some room in single precision, cells in short integers."""
    with np.errstate(over="ignore"):
        spread = float(np.ptp(points, axis=0).max()) if points.size else 0.0
    if not 0 < spread < 1e15:
        return Screen(points, order)
    if order == 2.0:
        return SquareScreen(points)
    levels = np.iinfo(np.uint16).max * 2 // 3 // points.shape[1]
    if order == 1.0 and levels >= 16:
        return CellScreen(points, levels)
    return Screen(points, order)


def vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


@dataclass(frozen=True)
class Tree:
    """Pivots sorted by the top they hang under: those of top t are first[t] to first[t+1]."""

    tops: np.ndarray
    pivots: np.ndarray
    first: np.ndarray
    order: float

    @staticmethod
    def grow(sample: np.ndarray, order: float) -> Tree:
        tops = sample[: max(1, math.isqrt(len(sample)))]
        under = np.concatenate([distances(sample[i : i + 1024], tops, order).argmin(axis=1) for i in range(0, len(sample), 1024)])
        by = np.argsort(under, kind="stable")
        return Tree(tops, sample[by], np.searchsorted(under[by], np.arange(len(tops) + 1)), order)

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each row and the distance to its pivot."""
        top = distances(x, self.tops, self.order).argmin(axis=1)
        leaf, reach = np.zeros(len(x), np.int32), np.zeros(len(x))
        for t in np.unique(top):
            mine = np.flatnonzero(top == t)
            d = distances(x[mine], self.pivots[self.first[t] : self.first[t + 1]], self.order)
            leaf[mine] = self.first[t] + d.argmin(axis=1)
            reach[mine] = d.min(axis=1)
        return leaf, reach

    def cut(self, x: np.ndarray, r: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for all leaves that the ball of radius ``r`` around a row cuts; NaN cuts all.

        ``radius`` is that of the leaves. Tops out of reach rule out all below.
        """
        # slack for rounding; it can only add leaves
        limit = np.where(np.isnan(r), np.inf, r * (1 + 1e-9) + 1e-9)
        to_top = distances(x, self.tops, self.order)
        rows, leaves = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for t in range(len(self.tops)):
            below = np.arange(self.first[t], self.first[t + 1])
            below = below[np.isfinite(radius[below])]
            if not len(below):
                continue
            reach = (distances(self.tops[t : t + 1], self.pivots[below], self.order)[0] + radius[below]).max()
            near = np.flatnonzero(to_top[:, t] - reach * (1 + 1e-9) <= limit)
            a, b = np.nonzero(distances(x[near], self.pivots[below], self.order) - radius[below] <= limit[near][:, None])
            rows.append(near[a])
            leaves.append(below[b])
        return np.concatenate(rows), np.concatenate(leaves)


def standardize_vectors(train: DataFrame, df: DataFrame, col: str) -> DataFrame:
    """Each dimension minus train's mean over its population deviation."""
    rows = (
        train.select(F.posexplode(col).alias("j", "v"))
        .groupBy("j")
        .agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
        .orderBy("j")
        .collect()  # one row per dimension
    )
    mean = F.array(*[F.lit(float(r["m"])) for r in rows])
    dev = F.array(*[F.lit(float(r["s"]) or 1.0) for r in rows])
    centred = F.zip_with(F.col(col), mean, lambda v, m: v - m)
    return df.withColumn(col, F.zip_with(centred, dev, lambda v, s: v / s))


def _with_leaf(df: DataFrame, tree: Tree) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf, reach = tree.leaves(vectors(batch.column(batch.schema.get_field_index("vec"))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(reach)], names=[*batch.schema.names, "leaf", "reach"])

    fields = ", ".join(f"{n} {t}" for n, t in df.dtypes)
    return df.mapInArrow(run, f"{fields}, leaf int, reach double")


def _best(rows: np.ndarray, cols: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k least d per row, row by row, and their ranks; ``cols`` orders equal ones."""
    by = np.lexsort((cols, d, rows))
    r = rows[by]
    opens = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, np.int64)
    rank = np.arange(len(r)) - np.repeat(opens, np.diff(np.r_[opens, len(r)]))
    return by[rank < k], rank[rank < k]


class Nearest:
    """The k nearest points of each query so far: place in the table and distance."""

    def __init__(self, q: np.ndarray, grp: np.ndarray, limit: np.ndarray, k: int, order: float):
        self.q, self.grp, self.limit, self.k, self.order = q, grp, limit, k, order
        self.place = np.full((len(q), k), -1, np.int64)
        self.dist = np.full((len(q), k), np.inf)

    def _add(self, rows: np.ndarray, cols: np.ndarray, d: np.ndarray) -> None:
        good = d <= self.limit[rows]
        good &= np.isfinite(d)
        rows, cols, d = rows[good], cols[good], d[good]
        if not len(rows):
            return
        known = np.unique(rows)
        old = np.nonzero(self.place[known] >= 0)
        rows = np.r_[known[old[0]], rows]
        cols = np.r_[self.place[known][old], cols]
        d = np.r_[self.dist[known][old], d]
        best, rank = _best(rows, cols, d, self.k)
        self.place[rows[best], rank], self.dist[rows[best], rank] = cols[best], d[best]
        self.limit[known] = np.minimum(self.limit[known], self.dist[known, -1])

    def meet(self, rows: np.ndarray, points: np.ndarray, grp: np.ndarray, places: np.ndarray) -> None:
        """Queries ``rows`` against the points of a leaf, which lie at ``places`` of the table."""
        seen = screen(points, self.order) if len(rows) >= SCREEN_QUERIES else Screen(points, self.order)
        # a block of bounds is reduced to the points near enough before the next is made
        step = max(1, CELLS // max(1, len(points)))
        for at in range(0, len(rows), step):
            mine = rows[at : at + step]
            q = self.q[mine]
            far = 1e15 if type(seen) is SquareScreen else np.inf
            kind = seen if np.abs(q).max(initial=0.0) < far else Screen(points, self.order)
            with np.errstate(over="ignore", invalid="ignore"):
                scores = kind.scores(q)
                unknown = np.flatnonzero(np.isinf(self.limit[mine]))
                if len(unknown) and len(points) > self.k:
                    self._bound(mine[unknown], scores[unknown], points, grp)
                a, b = np.divmod(np.flatnonzero(scores <= kind.reach(q, self.limit[mine])[:, None]), len(points))
                other = self.grp[mine[a]] != grp[b]
                a, b = a[other], b[other]
                self._add(mine[a], places[b], between(self.q[mine[a]], points[b], self.order))

    def _bound(self, rows: np.ndarray, scores: np.ndarray, points: np.ndarray, grp: np.ndarray) -> None:
        """Any k points that may be chosen bound the k-th distance: those of the least scores."""
        banned = self.grp[rows][:, None] == grp[None, :]
        scores[banned] = np.iinfo(scores.dtype).max if scores.dtype.kind == "u" else np.inf
        some = np.argpartition(scores, self.k - 1, axis=1)[:, : self.k]
        d = between(np.repeat(self.q[rows], self.k, axis=0), points[some.ravel()], self.order).reshape(some.shape)
        d[np.take_along_axis(banned, some, axis=1)] = np.inf
        bound = d.max(axis=1)
        self.limit[rows] = np.where(np.isnan(bound), np.inf, bound)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, rank = np.nonzero(self.place >= 0)
        return rows, self.place[rows, rank], self.dist[rows, rank]


def _meet(k: int, order: float, schema: pa.Schema):
    """Queries of a part against the leaves each has to see there."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return schema.empty_table()
        right = right.take(pc.sort_indices(right, sort_keys=[("row_id", "ascending")]))
        points, leaf, grp = vectors(right.column("vec").combine_chunks()), np.asarray(right.column("leaf")), np.asarray(right.column("grp"))
        whole = np.isfinite(points).all(axis=1)  # others have no distance
        q, q_grp = vectors(left.column("vec").combine_chunks()), np.asarray(left.column("grp"))
        wants = left.column("leaves").combine_chunks()
        owner = np.repeat(np.arange(len(q)), np.asarray(pc.list_value_length(wants)))
        wanted = np.asarray(wants.flatten())
        by = np.argsort(wanted, kind="stable")
        owner, wanted = owner[by], wanted[by]
        limit = np.asarray(left.column("r"), float) * (1 + 1e-9) + 1e-9
        best = Nearest(q, q_grp, np.where(np.isnan(limit), np.inf, limit), k, order)
        for leaf_no in np.unique(leaf):
            a, b = np.searchsorted(wanted, [leaf_no, leaf_no + 1])
            mine = np.flatnonzero((leaf == leaf_no) & whole)
            if a < b and len(mine):
                rows = owner[a:b]
                best.meet(rows[np.isfinite(q[rows]).all(axis=1)], points[mine], grp[mine], mine)
        rows, cols, d = best.found()
        rows, cols = pa.array(rows), pa.array(cols)
        return pa.table(
            [left.column("row_id").take(rows), right.column("row_id").take(cols), pa.array(d), right.column("y").take(cols)],
            schema=schema,
        )

    return run


@dataclass(frozen=True)
class Index:
    """Training rows with their leaves, and per leaf its pivot, size, radius and part."""

    rows: DataFrame
    tree: Tree
    radius: np.ndarray
    part: np.ndarray  # -1: nothing in the leaf
    blocks: np.ndarray  # tasks that a part's rows are dealt over
    kind: str
    part_rows: int

    @property
    def n_parts(self) -> int:
        return len(self.blocks)


def build_index(base: DataFrame, order: float, leaf_rows: int = LEAF_ROWS, part_rows: int | None = None) -> Index | None:
    """Over ``base(row_id, vec, grp, y)``; None without rows."""
    first = base.agg(F.count(F.lit(1)).alias("n"), F.first(F.size("vec")).alias("d")).first()
    if not first["n"]:
        return None
    if part_rows is None:
        # queries are dealt in as many blocks as there are parts
        parts = math.ceil(math.sqrt(TASKS_PER_CORE * base.sparkSession.sparkContext.defaultParallelism))
        part_rows = min(PART_ROWS, max(leaf_rows, math.ceil(first["n"] / parts)))
    n_pivots = max(1, min(math.ceil(first["n"] / leaf_rows), PIVOT_BYTES // (8 * max(1, first["d"]))))
    picked = base.orderBy(md5_int("pivot", F.col("row_id").cast("string")), "row_id").limit(n_pivots).select("vec").toArrow()
    tree = Tree.grow(vectors(picked.column(0).combine_chunks()), order)
    rows = stored(_with_leaf(base, tree), "leaves")
    sizes = np.zeros(len(tree.pivots), np.int64)
    radius = np.full(len(sizes), -np.inf)
    for r in rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("r")).collect():  # a row per pivot
        sizes[r["leaf"]], radius[r["leaf"]] = r["n"], r["r"]
    # neighbouring leaves hang under one top and lie side by side: they share parts
    part, at, filled = np.full(len(sizes), -1, np.int32), -1, part_rows
    totals: list[int] = []
    for i in np.flatnonzero(sizes):
        if filled + sizes[i] > part_rows:
            at, filled = at + 1, 0
            totals.append(0)
        part[i], filled = at, filled + sizes[i]
        totals[at] += int(sizes[i])
    blocks = np.maximum(1, np.ceil(np.array(totals) / part_rows)).astype(np.int64)
    return Index(rows, tree, radius, part, blocks, dict(base.dtypes)["row_id"], part_rows)


def _visits(query: DataFrame, index: Index, own: bool) -> DataFrame:
    """(row_id, grp, vec, r, part, leaves): own leaf only, or the others that the ball ``r`` cuts."""
    tree, radius, part, n_parts = index.tree, index.radius, index.part, index.n_parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = lambda n: batch.column(batch.schema.get_field_index(n))
            x = vectors(col("vec"))
            seen = np.asarray(col("leaf"))
            r = pa.nulls(len(x), pa.float64()) if own else col("r")
            if own:
                rows, leaf = np.arange(len(x)), seen
            else:
                rows, leaf = tree.cut(x, np.asarray(r, float), radius)
                other = leaf != seen[rows]
                rows, leaf = rows[other], leaf[other]
            key = rows * (n_parts + 1) + part[leaf]
            by = np.argsort(key, kind="stable")
            rows, leaf, key = rows[by], leaf[by].astype(np.int32), key[by]
            opens = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            take = pa.array(rows[opens])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[opens, len(key)].astype(np.int32)), pa.array(leaf))
            yield pa.record_batch(
                [*(c.take(take) for c in (col("row_id"), col("grp"), col("vec"), r)), pa.array(part[leaf[opens]].astype(np.int32)), lists],
                names=["row_id", "grp", "vec", "r", "part", "leaves"],
            )

    kind = dict(query.dtypes)["row_id"]
    return query.mapInArrow(run, f"row_id {kind}, grp int, vec array<double>, r double, part int, leaves array<int>")


def _round(query: DataFrame, index: Index, own: bool, k: int) -> DataFrame:
    """The k best per query, part and task."""
    visits = stored(_visits(query, index, own), "visits")
    q_blocks = np.ones(index.n_parts, np.int64)
    for r in visits.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect():  # a row per part
        q_blocks[r["part"]] = math.ceil(r["n"] / index.part_rows)
    spark = query.sparkSession
    rows = [(i, int(a), int(b)) for i, (a, b) in enumerate(zip(index.blocks, q_blocks))]
    cut = F.broadcast(spark.createDataFrame(rows, "part int, _t int, _q int"))  # a row per part
    leaf_part = F.broadcast(spark.createDataFrame([(i, int(p)) for i, p in enumerate(index.part)], "leaf int, part int"))
    salt = lambda name, n: F.pmod(md5_int(name, F.col("row_id").cast("string")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    t = index.rows.join(leaf_part, "leaf").join(cut, "part")
    t = t.select("part", salt("t", "_t").alias("tb"), every("_q").alias("qb"), "row_id", "vec", "grp", "y", "leaf")
    q = visits.join(cut, "part")
    q = q.select("part", every("_t").alias("tb"), salt("q", "_q").alias("qb"), "row_id", "vec", "r", "grp", "leaves")
    q_kind = dict(query.dtypes)["row_id"]
    out = f"row_id {q_kind}, neighbour {index.kind}, dist double, y double"
    arrow = spark.createDataFrame([], out).toArrow().schema
    by = ["part", "tb", "qb"]
    return q.groupBy(*by).cogroup(t.groupBy(*by)).applyInArrow(_meet(k, index.tree.order, arrow), out)


def nearest_neighbours(
    train: DataFrame,
    query: DataFrame,
    k: int,
    id_col: str = "row_id",
    vector: str = "vec",
    metric: str = "l2",
    group: str | None = None,
    label: str | None = None,
    leaf_rows: int = LEAF_ROWS,
    part_rows: int | None = None,
) -> DataFrame:
    """``(row_id, neighbour, dist, y, rank)``: the k nearest training rows per query.

    Ties are settled by the neighbour's id. With ``group`` a query skips
    training rows of its own group (its own fold, say). ``label`` travels with
    the training rows as ``y``, so votes need no join. Ids keep their type.
    """
    order = METRICS[metric]

    def shape(df: DataFrame) -> DataFrame:
        kind = dict(df.dtypes)[id_col]
        whole = "bigint" if kind in ("tinyint", "smallint", "int") else kind
        return df.select(
            F.col(id_col).cast(whole).alias("row_id"),
            F.col(vector).cast("array<double>").alias("vec"),
            (F.col(group).cast("int") if group else F.lit(-1)).alias("grp"),
            (F.col(label).cast("double") if label and label in df.columns else F.lit(None).cast("double")).alias("y"),
        )

    base = shape(train)
    if not group:
        base = base.withColumn("grp", F.lit(-2))
    index = build_index(base, order, leaf_rows, part_rows)
    asked = shape(query).drop("y")
    if index is None:
        return asked.limit(0).selectExpr("row_id", "row_id AS neighbour", "0D AS dist", "0D AS y", "0 AS rank")
    placed = stored(_with_leaf(asked, index.tree), "queries")
    best = Window.partitionBy("row_id").orderBy("dist", "neighbour")

    def top(df: DataFrame) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    # a query's own leaf may lie in several tasks
    near = stored(top(_round(placed, index, True, k)), "first_round")
    if len(index.tree.pivots) == 1:
        return near
    kth = near.where(F.col("rank") == k).select("row_id", F.col("dist").alias("r"))
    rest = _round(placed.join(kth, "row_id", "left"), index, False, k)
    return top(near.drop("rank").unionByName(rest))


def _weights(neighbours: DataFrame, weights: str) -> DataFrame:
    """Uniform, or 1/distance with exact hits taking all the weight."""
    if weights == "uniform":
        return neighbours.withColumn("w", F.lit(1.0))
    hit = F.max((F.col("dist") == 0).cast("int")).over(Window.partitionBy("row_id")) == 1  # k rows each
    return neighbours.withColumn(
        "w",
        F.when(hit, (F.col("dist") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("dist"))),
    )


def knn_classifier(neighbours: DataFrame, weights: str = "uniform") -> DataFrame:
    """``(row_id, class, p)``: weighted share of each class code among the neighbours."""
    voted = _weights(neighbours, weights)
    per = voted.groupBy("row_id", F.col("y").cast("int").alias("class")).agg(F.sum("w").alias("_w"))
    total = F.sum("_w").over(Window.partitionBy("row_id"))
    return per.select("row_id", "class", (F.col("_w") / total).alias("p"))


def knn_regressor(neighbours: DataFrame, weights: str = "uniform") -> DataFrame:
    """``(row_id, p)``: weighted mean of the neighbours' targets."""
    voted = _weights(neighbours, weights)
    return voted.groupBy("row_id").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("p"))


