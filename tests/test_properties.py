"""Properties the operators must keep whatever the data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.catalog.views import order_kit, price_preds, repeated_preds, share_preds
from tabloom.meta import Kit, Meta, roles_of, with_roles
from tabloom.operators import columns as C
from tabloom.operators import encode as E
from tabloom.operators import ensemble as B
from tabloom.operators import folds as D
from tabloom.operators import impute as I
from tabloom.operators import scale as N
from tabloom.operators import scores as S


@pytest.fixture(scope="module")
def kit(spark, sf):
    k = order_kit(spark, sf)
    return k.replace(k.train.cache(), k.test.cache())


STEPS = {
    "median": lambda k: I.impute_median(k, ["balance"]),
    "mode": lambda k: I.impute_mode(k, ["priority"]),
    "onehot": lambda k: E.encode_onehot(k, "priority"),
    "count": lambda k: E.encode_count(k, "priority"),
    "target": lambda k: E.encode_target(k, "priority", F.col("price")),
    "added": lambda k: E.add_target_encoding(k, ["place"], F.col("price")),
    "binary": lambda k: E.encode_binary(k, "priority"),
    "hashing": lambda k: E.encode_hashing(k, "place"),
    "auto": lambda k: E.encode_category(k.replace(*[d.withColumn("c", F.col("place")) for d in (k.train, k.test)]), "c"),
    "text": lambda k: E.encode_text_minhash(k, "segment", n=6),
    "date": lambda k: E.encode_date(k, "ordered", "cyclical-ohe"),
    "num_model": lambda k: I.impute_num_model(k, "balance", ["balance", "nationkey"], ["segment"], trees=2, depth=2),
    "cat_model": lambda k: I.impute_cat_model(k, "priority", ["nationkey"], ["priority", "segment"], trees=2, depth=2),
}


@pytest.mark.parametrize("name", sorted(STEPS))
def test_rows_are_kept(kit, name):
    out = STEPS[name](kit)
    assert out.train.count() == kit.train.count() and out.test.count() == kit.test.count()
    ids = out.train.select("id").distinct().count()
    assert ids == kit.train.select("id").distinct().count()
    assert roles_of(out.train)["id"] == "id"


@pytest.mark.parametrize("name,col", [("median", "balance"), ("mode", "priority"), ("num_model", "balance"), ("cat_model", "priority")])
def test_imputers_leave_no_gap_and_touch_only_gaps(kit, name, col):
    out = STEPS[name](kit)
    for before, after in ((kit.train, out.train), (kit.test, out.test)):
        assert after.where(F.col(col).isNull()).count() == 0
        old = before.where(F.col(col).isNotNull()).select("id", F.col(col).alias("old"))
        assert after.join(old, "id").where(F.col(col) != F.col("old")).count() == 0


def test_single_label_is_filled_with_missing(spark):
    df = with_roles(spark.createDataFrame([(1, "a"), (2, None)], "id long, c string"), {"id": "id", "c": "cat"})
    out = I.impute_cat_model(Kit(df, df, None), "c", [], ["c"])
    assert sorted(r["c"] for r in out.train.collect()) == ["a", "missing"]


def test_train_fitted_steps_ignore_test(kit):
    """Target codes, scalers and splines must not move when test changes."""
    other = kit.replace(kit.train, kit.test.limit(5))
    for step in ("target", "added"):
        col = "priority" if step == "target" else "place_target_encode"
        a, b = (STEPS[step](k).train.select("id", col).collect() for k in (kit, other))
        assert sorted(a) == sorted(b)


def test_unseen_category_gets_the_prior(spark):
    train = spark.createDataFrame([(1, "a", 1.0), (2, "b", 3.0)], "id long, c string, y double")
    test = spark.createDataFrame([(3, "z", 0.0), (4, None, 0.0)], "id long, c string, y double")
    out = E.encode_target(Kit(train, test, None), "c", F.col("y")).test
    assert [r["c"] for r in out.collect()] == [2.0, 2.0]


def test_out_of_fold_codes_do_not_see_own_fold(spark):
    rows = [(i, "ab"[i % 2], float(i), i % 5) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, c string, y double, fold int")
    out = {r["id"]: r["c_target_encode"] for r in E.encode_target_out_of_fold(df, "c", "y", "fold").collect()}
    bumped = df.withColumn("y", F.when(F.col("fold") == 2, F.col("y") + 1e6).otherwise(F.col("y")))
    again = {r["id"]: r["c_target_encode"] for r in E.encode_target_out_of_fold(bumped, "c", "y", "fold").collect()}
    assert all(math.isclose(out[i], again[i]) for i in range(50) if i % 5 == 2)


def test_onehot_names_and_null_category(spark):
    df = spark.createDataFrame([(1, "x y"), (2, "x/y"), (3, None)], "id long, c string")
    out = E.encode_onehot(Kit(df, df, None), "c").train
    assert out.columns == ["id", "c_nan", "c_x_y", "c_x_y_1"]
    assert all(sum(r[c] for c in out.columns[1:]) == 1 for r in out.collect())


def test_category_values_splits_narrow_and_wide(kit):
    got = E.category_values(kit, ["priority", "place"])
    assert got["priority"][0] is None and len(got["priority"]) == 5
    assert got["place"] is None  # 25 nations


def test_each_row_is_held_out_once_per_repeat(spark):
    df = spark.range(500)
    out = D.repeated_kfold(df, "id").withColumn("r", F.floor(F.col("fold") / 10))
    assert out.groupBy("id", "r").count().where("count <> 1").count() == 0
    held = [df.where(D.held_out("id", f)).count() for f in range(10, 20)]
    assert sum(held) == 500 and min(held) > 20
    sizes = D.fold_sizes(df, "id").collect()
    assert len(sizes) == 30 and all(r["n_train"] + r["n_valid"] == 500 for r in sizes)


def test_repeats_are_independent(spark):
    pairs = spark.range(5000).select(*[D.fold_of(F.col("id"), r).alias(f"f{r}") for r in (0, 1)])
    cells = [r["count"] for r in pairs.groupBy("f0", "f1").count().collect()]
    assert len(cells) == 100 and max(cells) < 100


@pytest.mark.parametrize("metric", ["rmse", "mae"])
def test_blend_is_never_worse_than_the_best_single(spark, sf, metric):
    preds = price_preds(spark, sf).cache()
    weights = B.blend(preds, metric, max_steps=6)
    out = B.apply_blend(preds, weights).withColumn("submission", F.lit("blend"))
    blended = {r["fold"]: r["score"] for r in S.score(out, metric).collect()}
    single = S.score(preds, metric).groupBy("fold").agg(F.min("score").alias("best")).collect()
    assert all(blended[r["fold"]] <= r["best"] + 1e-9 for r in single)
    sums = weights.groupBy("fold").agg(F.sum("weight").alias("w")).collect()
    assert all(math.isclose(r["w"], 1.0) for r in sums)
    assert math.isclose(weights.agg(F.sum("contributivity")).first()[0], 1.0)


def test_gram_and_job_selection_agree(spark, sf):
    preds = price_preds(spark, sf).cache()
    names = sorted(r[0] for r in preds.select("submission").distinct().collect())
    folds = sorted(r[0] for r in preds.select("fold").distinct().collect())
    members = {f: list(range(len(names))) for f in folds}
    by_jobs = B._greedy_by_jobs(B.wide_predictions(preds, names), "rmse", names, members, 4)
    by_gram = B.blend(preds, "rmse", max_steps=4).collect()
    for r in by_gram:
        picks = by_jobs[r["fold"]]
        assert math.isclose(r["weight"], picks.count(r["submission"]) / len(picks))


def test_blend_for_a_higher_is_better_score(spark, sf):
    preds = share_preds(spark, sf)
    weights = B.blend(preds, "auc", max_steps=3)
    out = B.apply_blend(preds, weights).withColumn("submission", F.lit("b"))
    got = {r["fold"]: r["score"] for r in S.score(out, "auc").collect()}
    best = S.score(preds, "auc").groupBy("fold").agg(F.max("score").alias("m")).collect()
    assert all(got[r["fold"]] >= r["m"] - 1e-9 for r in best)


def test_bag_of_one_fold_is_the_identity(spark, sf):
    one = price_preds(spark, sf)
    bagged = B.bag(one).withColumnRenamed("p", "q")
    assert one.join(bagged, ["submission", "row_id"]).where("abs(p - q) > 1e-9").count() == 0


def test_last_bagged_score_is_the_bag_score(spark, sf):
    preds = repeated_preds(spark, sf)
    folds = list(range(30))
    last = {r["submission"]: r["score"] for r in B.bagged_scores(preds, "rmse", folds).where("n_folds = 30").collect()}
    whole = {r["submission"]: r["score"] for r in S.score(B.bag(preds), "rmse", ("submission",)).collect()}
    assert all(math.isclose(last[k], whole[k]) for k in whole)


def test_quantile_scaling_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.exponential(size=400), 1)
    df = spark.createDataFrame([(i, float(v), float(i % 2)) for i, v in enumerate(x)], "id int, x double, b double")
    out = {r["id"]: r for r in N.scale_quantile(df, df, ["x", "b"], n=400).collect()}
    q, ref = np.sort(x), np.linspace(0, 1, 400)
    want = 0.5 * (np.interp(x, q, ref) - np.interp(-x, -q[::-1], -ref[::-1]))
    assert np.allclose([out[i]["x"] for i in range(400)], want, atol=0.01)
    assert all(out[i]["b"] == float(i % 2) for i in range(400))


def test_splines_sum_to_one_and_clamp(spark):
    train = spark.createDataFrame([(float(i), float(i % 2)) for i in range(50)], "x double, b double")
    far = spark.createDataFrame([(-10.0, 1.0), (99.0, 0.0), (20.3, 1.0)], "x double, b double")
    out = N.spline_basis(train, far, ["x", "b"], knots=10)
    assert len(out.columns) == 13
    for r in out.collect():
        assert math.isclose(sum(r[c] for c in out.columns if c.startswith("x_sp")), 1.0)


def test_bins_round_trip_into_their_range(spark):
    df = spark.range(1000).select(F.col("id").alias("row"), (F.col("id") * 1.5).alias("y"))
    for how in ("uniform", "quantile", "kmeans"):
        edges = N.bin_edges(df, "y", 5, how)
        code = N.bin_code(F.col("y"), edges)
        drawn = df.select("y", code.alias("c"), N.bin_code(N.unbin_uniform(code, edges, 3, F.col("row")), edges).alias("d"))
        assert drawn.where("c <> d").count() == 0
        assert drawn.select("c").distinct().count() == 5


def test_mixture_samples_follow_the_weights(spark):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    df = spark.range(4000).select(
        N.mixture_sample(arr(1, 3), arr(-100, 100), arr(1, 1), 5, F.col("id")).alias("s")
    )
    high = df.where("s > 0").count() / 4000
    assert abs(high - 0.75) < 0.03
    sd = df.where("s > 0").agg(F.stddev("s")).first()[0]
    assert abs(sd - 1.0) < 0.06


def test_kernel_mixture_weights(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", 5.0), ("b", 9.0)], "g string, v double")
    sums = N.kernel_mixture(df, ["g"], "v").groupBy("g").agg(F.sum("w").alias("w")).collect()
    assert all(math.isclose(r["w"], 1.0) for r in sums)


def test_constant_columns_need_both_tables_to_agree(spark):
    a = spark.createDataFrame([(1, 5, None, 7)], "x int, y int, z int, w int").union(
        spark.createDataFrame([(2, 5, None, 7)], "x int, y int, z int, w int"))
    b = spark.createDataFrame([(1, 5, 1, 8)], "x int, y int, z int, w int")
    assert C.constant_columns(a, b, ["x", "y", "z", "w"]) == ["y"]


def test_invalid_names_collision_is_an_error(spark):
    df = spark.createDataFrame([(1, 2)], ["a b", "ab"])
    with pytest.raises(ValueError):
        C.invalid_col_names(df)


def test_one_sided_columns_keep_targets(spark):
    a = spark.createDataFrame([(1, 2, 3)], ["id", "x", "y"])
    b = spark.createDataFrame([(1, 4)], ["id", "z"])
    tr, te = C.col_in_train_only(a, b, ["id", "y"])
    assert tr.columns == ["id", "y"] and te.columns == ["id"]


def test_scores_on_known_values(spark):
    df = spark.createDataFrame(
        [("s", 0, 1, 0.9), ("s", 0, 0, 0.1), ("s", 0, 1, 0.1), ("s", 0, 0, 0.05)], "submission string, fold int, y int, p double"
    )
    one = lambda n: S.score(df, n).collect()[0]["score"]
    assert one("auc") == pytest.approx(0.875)
    assert one("gini") == pytest.approx(0.75)
    assert one("ngini") == pytest.approx(0.75)
    assert one("nll") == pytest.approx(-np.mean(np.log([0.9, 0.9, 0.1, 0.95])))
    hard = df.withColumn("p", F.when(F.col("p") > 0.5, 1).otherwise(0))
    assert S.score(hard, "accuracy").collect()[0]["score"] == 0.75
    assert S.score(hard, "mcc").collect()[0]["score"] == pytest.approx(1 / math.sqrt(3))


def test_meta_round_trip():
    m = Meta("t", "id", ["y"], "regression", "rmse", {"id": "num", "a": "cat"}, {"a": "string"}, {}, {}, {"unique_value_count": {"a": 2}})
    assert Meta.from_json(m.to_json()) == m
