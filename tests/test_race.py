"""A small race, stopped and resumed."""

import pytest
from pyspark.sql import functions as F

from tabloom.catalog.learned import _forest, _spec, _task
from tabloom.operators import ensemble as B
from tabloom.operators import runlog as L
from tabloom.operators import space as H
from tabloom.operators import training as T
from tabloom.operators.models import Spec, fit
from tabloom.plans.race import Base, Race, RaceSettings
from tabloom.session import work_dir


@pytest.fixture(scope="module")
def task(spark, sf):
    return _task(spark, sf)


def bases():
    return {
        "rf": Base("rf", H.Space([H.Dim("maxDepth", (1, 2, 3, 4, 5), 2)]), _forest),
        "gbt": Base("gbt", H.Space([H.Dim("maxDepth", (1, 2, 3), 2), H.Dim("maxIter", (1, 2), 1)]), _spec),
    }


def test_race_resumes_where_it_stopped(spark, task):
    store = T.Store(spark, work_dir(spark, "race"))
    make = lambda n: Race(
        store, task, bases(), RaceSettings(n_rounds=n, n_trials=2, n_search_folds=2, n_final_folds=3, blend_steps=4)
    )
    first = make(1)
    first.go(finish=False)
    assert first.n_done() == 1 and first.blended()
    before = store.scores().count()

    # a search that died before its blend must not count
    first._note("search", "rf", [0, 1], __import__("datetime").datetime.now(__import__("datetime").timezone.utc), 1.0, None)
    again = make(2)
    assert again.n_done() == 1
    out = again.go()
    assert again.n_done() == 2 and store.scores().count() > before
    n_test = task.test.count()
    assert out["blend_then_bag"].count() == n_test and out["bag_then_blend"].count() == n_test
    assert out["best_single"].select("row_id").distinct().count() == n_test
    assert again.members_at(1) == sorted(first.members_at(1)) and again.members_at(2) == sorted(again.blended())
    names = {r["name"] for r in store.read("log", "run string, name string").collect()}
    assert {"search", "blend", "final_blend_then_bag", "final_bag_then_blend"} <= names


def test_trained_pairs_are_skipped(spark, task):
    store = T.Store(spark, work_dir(spark, "skip"))
    specs = {"a": Spec("rf", {"numTrees": 2, "maxDepth": 2})}
    T.train_folds(store, task, specs, [0])
    assert T.pending(store, [("a", 0), ("a", 1)]) == [("a", 1)]
    held = store.predictions(task, "valid").select("row_id").distinct().count()
    assert 0 < held < task.train.count() / 5


def test_patience(spark):
    rows = [(1, i, s) for i, s in enumerate([5.0, 4.0, 4.5, 4.2, 4.1, 3.0])]
    df = spark.createDataFrame(rows, "run long, action_id long, score double").withColumn(
        "start_ts", F.timestamp_seconds("action_id")
    )
    assert L.patience_stop(df, 3, lower=True).collect()[0]["stop_round"] == 5
    assert L.patience_stop(df, 5, lower=True).count() == 0
    flipped = df.withColumn("score", -F.col("score"))
    assert L.patience_stop(flipped, 3, lower=False).collect()[0]["stop_round"] == 5


def test_grid_and_draws_stay_in_the_space(spark):
    space = H.Space([H.Dim("a", (1, 2, 3), 2, (0.0, 1.0, 3.0)), H.Dim("b", ("x", "y"), "x", (), "other")])
    start = spark.createDataFrame([([1, 0],)], "indices array<int>")
    grid = H.grid_space(start, space, ["a"])
    assert sorted(tuple(r["indices"]) for r in grid.collect()) == [(0, 0), (1, 0), (2, 0)]
    drawn = H.draw_settings(spark.range(2000), space, "id", 1)
    n = {r["i"]: r["count"] for r in drawn.groupBy(F.col("indices")[0].alias("i")).count().collect()}
    assert 0 not in n and 2.4 < n[2] / n[1] < 3.8
    again = H.draw_settings(spark.range(2000).repartition(5), space, "id", 1)
    assert sorted(r["hash"] for r in drawn.collect()) == sorted(r["hash"] for r in again.collect())
    assert space.decode([2, 1]) == {"a": 3, "b": "y"}


def test_random_trials_skip_what_is_done(spark):
    space = H.Space([H.Dim("a", (1, 2, 3), 2), H.Dim("b", ("x", "y"), "x")])
    first = H.random_trials(spark, space, 4, seed=1)
    assert first.count() == 4 and first.select("hash").distinct().count() == 4
    rest = H.random_trials(spark, space, 4, seed=2, done=first)
    assert rest.count() == 2 and rest.join(first, "hash").count() == 0
    assert H.random_trials(spark, space, 4, seed=3, done=first.unionByName(rest)).count() == 0


def test_drop_flags_use_priors():
    dims = H.drop_column_dims([("x", 0.3), ("y", None)])
    assert dims[0].shares == [(0, 0.7), (1, 0.3)] and dims[1].shares == [(0, 1.0), (1, 1.0)]


@pytest.mark.parametrize("kind,params", [
    ("gbt", {"maxIter": 3, "maxDepth": 2}),
    ("rf", {"numTrees": 5, "maxDepth": 4}),
    ("kernel_svm", {"components": 24, "gamma": 0.5, "maxIter": 20, "C": 10.0}),
    ("spline", {"knots": 5, "hidden": (6,), "maxIter": 60}),
    ("knn", {"n_neighbors": 3, "weights": "distance", "metric": "manhattan"}),
])
def test_classifiers_learn_and_probabilities_sum_to_one(spark, kind, params):
    df = spark.range(400).select("id", (F.col("id") % 20 / 10.0).alias("x"), (F.col("id") % 7 * 1.0).alias("z")).withColumn(
        "y", (F.col("x") > 1.0).cast("int")
    )
    for classes, y in ((2, F.col("y")), (3, F.col("y") + (F.col("x") > 1.5).cast("int"))):
        rows = df.withColumn("t", y)
        out = fit(Spec(kind, params), rows, ["x", "z"], "t", classes, "id").predict(rows)
        assert out.where(F.abs(F.aggregate("probs", F.lit(0.0), lambda a, b: a + b) - 1) > 1e-9).count() == 0
        hits = out.where((F.array_position("probs", F.array_max("probs")) - 1) == F.col("t")).count()
        assert hits > 300


@pytest.mark.parametrize("kind,params", [
    ("gbt", {"maxIter": 10, "maxDepth": 3}),
    ("rf", {"numTrees": 10, "maxDepth": 5}),
    ("kernel_svm", {"components": 48, "gamma": 0.5, "maxIter": 60, "C": 100.0}),
    ("spline", {"knots": 5, "regParam": 0.0001}),
    ("knn", {"n_neighbors": 3, "metric": "minkowski", "p": 1}),
])
@pytest.mark.parametrize("score", ["rmse", "mae", "rmsle"])
def test_regressors_beat_the_mean(spark, kind, params, score):
    df = spark.range(400).select("id", (F.col("id") % 40 / 10.0).alias("x"), (F.col("id") % 7 * 1.0).alias("z")).withColumn(
        "y", F.col("x") * F.col("x") + 1
    )
    out = fit(Spec(kind, params, score), df, ["x", "z"], "y", 0, "id").predict(df)
    err, base = out.agg(F.avg((F.col("y") - F.col("p")) ** 2), F.var_pop("y")).first()
    assert err < base * 0.6


@pytest.mark.parametrize("classes,score", [(3, "accuracy"), (3, "nll"), (2, "accuracy"), (2, "auc")])
def test_class_blends(spark, classes, score):
    """Probabilities are averaged per class and scored after averaging."""
    df = spark.range(600).select(
        "id", (F.col("id") % 20 / 10.0).alias("x"), (F.col("id") % 7 * 1.0).alias("z"),
    )
    y = (F.col("x") > 0.7).cast("int") + ((F.col("x") > 1.3).cast("int") if classes == 3 else F.lit(0))
    rows = df.withColumn("y", y.cast("double"))
    task = T.Task(rows.where("id < 500"), rows.where("id >= 500").drop("y"), "id", "y", ["x", "z"], score, classes)
    store = T.Store(spark, work_dir(spark, "classes"))
    specs = {"deep": Spec("rf", {"numTrees": 3, "maxDepth": 4}, score), "flat": Spec("rf", {"numTrees": 1, "maxDepth": 1}, score)}
    means = {r["submission"]: r["mean_valid"] for r in T.train_folds(store, task, specs, [0, 1]).collect()}
    assert set(means) == {"deep", "flat"}
    race = Race(store, task, {}, RaceSettings(blend_steps=3))
    for kind in ("blend", "bag_then_blend"):
        totals, got, weights = race.blend_now(["deep", "flat"], [0, 1], kind)
        assert totals["deep"] > 0 and (got < 0.6 if score == "nll" else got > 0.85)
    test = store.predictions(task, "test")
    out = B.apply_blend(B.bag(test).withColumn("fold", F.lit(0)), weights)
    per_row = out.groupBy("row_id").agg(F.sum("p").alias("s"), F.count("p").alias("n")).collect()
    assert len(per_row) == 100
    if task.blocks:
        assert all(r["n"] == classes and abs(r["s"] - 1) < 1e-9 for r in per_row)
