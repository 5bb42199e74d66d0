"""The paths taken on large data must agree with the plain ones."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabloom.functions.joins import attach
from tabloom.functions.quantiles import exact_quantiles
from tabloom.functions.running import key_sizes, running
from tabloom.operators import knn as K
from tabloom.operators import scores as S
from tabloom.operators.encode import minhash, text_signature


def keyed(spark, n=3000):
    """One key holds half of the rows; values have many ties."""
    return spark.range(n).select(
        "id",
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 7).cast("int").alias("k"),
        (F.col("id") * 7919 % 101).cast("double").alias("v"),
    )


def as_set(df):
    return sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())


@pytest.mark.parametrize("fn", ["sum", "min", "max"])
def test_running_in_pieces_equals_window(spark, fn):
    df = keyed(spark)
    order = [F.col("v"), F.col("id")]
    w = Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    plain = df.withColumn("r", getattr(F, fn)("id").over(w))
    cut = running(df, ["k"], order, {"r": (fn, "id")}, block_rows=100)
    assert as_set(cut) == as_set(plain)


def test_running_descending_over_one_key(spark):
    df = keyed(spark).withColumn("k", F.lit(1))
    order = [F.col("v").desc(), F.col("id")]
    got = running(df, ["k"], order, {"r": ("sum", F.lit(1).cast("long"))}, block_rows=64)
    assert sorted(r["r"] for r in got.collect()) == list(range(1, 3001))
    ranked = [(-r["v"], r["id"]) for r in got.orderBy("r").collect()]
    assert ranked == sorted(ranked)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_attach_beyond_the_broadcast_bound(spark, how):
    big = keyed(spark).withColumn("k", F.when(F.col("id") % 11 != 0, F.col("k")))
    small = big.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k <> 3")
    want = as_set(big.join(small, ["k"], how))
    assert as_set(attach(big, small, ["k"], how, weight="n", max_rows=2)) == want
    assert as_set(attach(big, small, ["k"], how, max_rows=2)) == want
    assert as_set(attach(big, small, ["k"], how)) == want


@pytest.mark.parametrize("limit", [10, 100_000])
def test_exact_quantiles_by_brackets(spark, limit):
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.normal(size=4000), np.full(3000, 0.25), rng.exponential(size=3001)])
    other = np.where(rng.random(len(data)) < 0.5, 1.0, rng.normal(size=len(data)))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(data, other)], "a double, b double")
    probs = [0.0, 0.1, 0.37, 0.5, 0.99, 1.0]
    got = exact_quantiles(df, ["a", "b"], probs, exact_distinct=limit, accuracy=200)
    assert np.allclose(got["a"], np.quantile(data, probs), atol=1e-12)
    assert np.allclose(got["b"], np.quantile(other, probs), atol=1e-12)


def test_quantiles_of_an_empty_column(spark):
    df = spark.createDataFrame([(None,)], "a double")
    assert exact_quantiles(df, ["a"], [0.5]) == {"a": [None]}


def test_grouped_median_in_pieces(spark):
    df = keyed(spark)
    want = as_set(S.grouped_median(df, ("k",), F.col("v"), "m"))
    assert as_set(S.grouped_median(df, ("k",), F.col("v"), "m", block_rows=50)) == want
    exact = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert {k: m for k, m in want} == exact


def test_ranks_in_pieces(spark):
    preds = keyed(spark).select(F.lit("s").alias("submission"), F.col("k").alias("fold"), "id", F.col("v").alias("p"))
    assert as_set(S.rank_rows(preds, block_rows=50)) == as_set(S.rank_rows(preds))


def test_auc_in_pieces(spark, monkeypatch):
    preds = keyed(spark).select(
        F.lit("s").alias("submission"), F.lit(0).alias("fold"), (F.col("id") % 3 == 0).cast("int").alias("y"), F.col("v").alias("p")
    )
    want = S.auc(preds).collect()[0]["score"]
    monkeypatch.setattr("tabloom.operators.scores.BLOCK_ROWS", 10)
    monkeypatch.setattr("tabloom.functions.running.running.__defaults__", (None, 10))
    assert S.auc(preds).collect()[0]["score"] == pytest.approx(want)


def test_key_sizes(spark):
    s = key_sizes(keyed(spark), ["k"])
    assert (s.total, s.keys) == (3000, 7) and s.largest >= 1500


@pytest.mark.parametrize("metric", ["l1", "l2", "chebyshev"])
@pytest.mark.parametrize("grouped", [False, True])
@pytest.mark.parametrize("leaf_rows", [3, 25, 1000])
def test_neighbours_equal_brute_force(spark, metric, grouped, leaf_rows):
    rng = np.random.default_rng(11)
    # one dense cluster holds most rows, with exact copies
    pts = np.round(np.concatenate([rng.normal(0, 0.05, (120, 3)), rng.normal(0, 3, (60, 3))]), 2)
    pts[100:110] = pts[0]
    grp = np.arange(180) % 4
    df = spark.createDataFrame(
        [(i, [float(x) for x in p], int(g)) for i, (p, g) in enumerate(zip(pts, grp))], "row_id long, vec array<double>, g int"
    )
    order = {"l1": 1, "l2": 2, "chebyshev": np.inf}[metric]
    got = K.nearest_neighbours(df, df, 5, metric=metric, group="g" if grouped else None, leaf_rows=leaf_rows, part_rows=20)
    found = {(r["row_id"], r["rank"]): (r["neighbour"], r["dist"]) for r in got.collect()}
    for i in range(180):
        d = np.linalg.norm(pts - pts[i], ord=order, axis=1)
        ok = np.flatnonzero(grp != grp[i]) if grouped else np.arange(180)
        best = ok[np.lexsort((ok, np.round(d[ok], 9)))[:5]]
        near = [found[(i, r + 1)] for r in range(5)]
        assert np.allclose([x[1] for x in near], d[best])
        assert len({x[0] for x in near}) == 5


SHAPES = {
    "even": lambda rng: rng.normal(size=(600, 16)),
    "copies": lambda rng: np.round(3 * rng.normal(size=(600, 2))),
    "outliers": lambda rng: rng.standard_cauchy((600, 5)) ** 3,
    "far from zero": lambda rng: 1e9 + rng.normal(size=(600, 4)),
    "tiny": lambda rng: 1e-25 * rng.normal(size=(600, 4)),
    "huge": lambda rng: 1e200 * rng.normal(size=(600, 4)),
    "one value": lambda rng: np.full((600, 3), 0.7),
    "one column moves": lambda rng: np.c_[np.zeros((600, 3)), np.where(rng.random(600) < 0.002, 5.0, 0.0)],
    "long": lambda rng: rng.normal(size=(600, 5000)).round(1),
}


@pytest.mark.parametrize("metric", ["l1", "l2", "chebyshev"])
@pytest.mark.parametrize("shape", SHAPES)
def test_screens_lose_no_neighbour(metric, shape):
    order, k = K.METRICS[metric], 4
    pts = SHAPES[shape](np.random.default_rng(2))
    q, p = pts[:100], pts[100:]
    q_grp, grp = np.arange(100) % 3, np.arange(500) % 3
    limits = {"open": np.full(100, np.inf)}
    with np.errstate(over="ignore"):
        full = K.distances(q, p, order)
    full[q_grp[:, None] == grp[None, :]] = np.inf
    limits["known"] = np.sort(full, axis=1)[:, k + 10]
    for limit in limits.values():
        near = K.Nearest(q, q_grp, limit.copy(), k, order)
        for at in range(0, 500, 125):
            near.meet(np.arange(100), p[at : at + 125], grp[at : at + 125], np.arange(at, at + 125))
        rows, cols, d = near.found()
        for i in range(100):
            want = np.sort(full[i][np.isfinite(full[i])])[:k]
            mine = cols[rows == i]
            assert np.allclose(np.sort(d[rows == i]), want, rtol=1e-9, atol=0) and len(set(mine)) == len(mine)
            assert (grp[mine] != q_grp[i]).all()
            if shape in ("copies", "one value"):  # ties go to the earlier place
                assert mine.tolist() == np.argsort(full[i], kind="stable")[:k].tolist()


@pytest.mark.parametrize("metric", ["l1", "l2"])
def test_few_distances_are_computed_in_full(monkeypatch, metric):
    pts, order = np.random.default_rng(4).normal(size=(4200, 64)), K.METRICS[metric]
    seen = []
    monkeypatch.setattr(K, "between", lambda q, p, o, run=K.between: seen.append(len(q)) or run(q, p, o))
    monkeypatch.setattr(K, "distances", None)
    near = K.Nearest(pts[:200], np.zeros(200, int), np.full(200, np.inf), 5, order)
    for at in (200, 2200):
        near.meet(np.arange(200), pts[at : at + 2000], np.ones(2000, int), np.arange(at, at + 2000))
    assert sum(seen) < 0.03 * 200 * 4000 and len(near.found()[0]) == 1000


def test_vectors_with_gaps_have_no_neighbours(spark):
    gap = float("nan")
    rows = [(i, [float(i), 1.0]) for i in range(200)] + [(200, [gap, 1.0]), (201, [float("inf"), 1.0]), (202, [3.0, None])]
    df = spark.createDataFrame(rows, "row_id long, vec array<double>")
    got = K.nearest_neighbours(df, df, 2, metric="l1").collect()
    assert {r["row_id"] for r in got} == set(range(200)) == {r["neighbour"] for r in got}
    assert len(got) == 400


def test_parts_give_each_core_tasks(spark):
    base = spark.range(3000).selectExpr("id AS row_id", "array(cast(id % 97 AS double)) AS vec", "-2 AS grp", "0D AS y")
    index = K.build_index(base, 1.0, leaf_rows=20)
    cores = spark.sparkContext.defaultParallelism
    assert index.n_parts * -(-3000 // index.part_rows) >= K.TASKS_PER_CORE * cores
    assert K.build_index(base, 1.0, leaf_rows=20, part_rows=500).part_rows == 500


def test_few_leaves_are_visited(spark):
    """Clustered rows: about as many parts per query in a table ten times as large."""
    per_query = []
    for n in (2000, 20_000):
        rng = np.random.default_rng(5)
        pts = rng.normal(0, 1, (n, 2)) + 40 * rng.integers(0, 30, (n, 2))
        df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "row_id long, vec array<double>").repartition(8)
        base = df.selectExpr("row_id", "vec", "-2 AS grp", "CAST(null AS double) AS y")
        index = K.build_index(base, 2.0, 50, 200)
        asked = K._with_leaf(base.withColumn("grp", F.lit(-1)).drop("y"), index.tree).withColumn("r", F.lit(1.0))
        seen = K._visits(asked, index, False)
        per_query.append(seen.agg(F.sum(F.size("leaves"))).first()[0] / n)
    assert per_query[1] < 1.5 * per_query[0] + 1 and per_query[1] < 20


def test_neighbours_of_text_ids(spark):
    rows = [(f"ID_{i}", [float(i), 0.0], float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "name string, vec array<double>, t double")
    got = K.nearest_neighbours(df, df, 2, id_col="name", label="t", leaf_rows=5, part_rows=10).collect()
    near = {(r["row_id"], r["rank"]): (r["neighbour"], r["y"]) for r in got}
    assert len(got) == 100 and near["ID_7", 1] == ("ID_7", 7.0) and near["ID_0", 2][0] == "ID_1"


def test_neighbours_with_too_few_rows(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "row_id long, vec array<double>")
    assert K.nearest_neighbours(df, df, 5).count() == 4


def brute_minhash(text, n, lo, hi, minmax):
    """Gram by gram in plain integers."""
    word = 2**64
    family, x = [], 1
    k = (n + 1) // 2 if minmax else n
    for _ in range(k):
        x = (x * 0xD1342543DE82EF95 + 12345) % word
        a = x | 1
        x = (x * 0xD1342543DE82EF95 + 12345) % word
        family.append((a, x))
    hashes = []
    for size in range(lo, hi + 1):
        for i in range(len(text) - size + 1):
            h = 0
            for ch in text[i : i + size]:
                h = (h + ord(ch) + 1) * 0x9E3779B97F4A7C15 % word
                h ^= h >> 29
            hashes.append(h)
    if not hashes:
        return [0.0] * n
    low = [min((h * a + b) % word for h in hashes) for a, b in family]
    high = [max((h * a + b) % word for h in hashes) for a, b in family][: n - k] if minmax else []
    return [(v >> 11) / 2**53 for v in low + high]


@pytest.mark.parametrize("text", ["", "a", "ab", "hello wörld, ça va?", "日本語テキスト " * 30])
@pytest.mark.parametrize("minmax", [False, True])
def test_minhash_equals_brute_force(text, minmax):
    assert minhash(text, 11, 2, 4, minmax) == brute_minhash(text, 11, 2, 4, minmax)


def test_minhash_reads_whole_texts(spark):
    long = "x" * 200_000
    df = spark.createDataFrame([(1, long), (2, long + "zq"), (3, None)], "id int, t string")
    rows = {r["id"]: r["s"] for r in df.select("id", text_signature(F.col("t"), 40).alias("s")).collect()}
    assert rows[1] != rows[2] and len(rows[3]) == 40
