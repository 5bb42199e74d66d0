"""Fold-additive least squares against single fits."""

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tabloom.operators import models as M
from tabloom.operators import ridge
from tabloom.operators import training as T
from tabloom.operators.folds import held_out
from tabloom.session import work_dir


@pytest.fixture(scope="module")
def task(spark):
    rows = spark.range(3000).select(
        "id", (F.col("id") * 7919 % 101 / 10.0).alias("x"), (F.col("id") * 104729 % 997 / 50.0).alias("z"),
        (F.col("id") % 2).cast("double").alias("b"), F.lit(3.0).alias("still"),
    ).withColumn("y", F.sin("x") * 5 + F.col("z") * 2 + F.col("b") + 1000 + F.col("id") % 13 / 10.0)
    train, test = rows.where("id < 2500"), rows.where("id >= 2500").drop("y")
    return T.Task(train, test, "id", "y", ["x", "z", "b", "still"], "rmse")


@pytest.mark.parametrize("kind", ["ridge", "spline"])
def test_fits_equal_mllib(spark, task, kind):
    basis = ridge.basis_of(task.train, task.features, kind)
    fits = ridge.fit_folds(task.train, basis, "id", "y", [0, 7, 12, 29], 0.5)
    for f, mine in fits.items():
        part = basis.apply(task.train.where(~held_out("id", f)))
        data = M.assembled(part, [F.col("_fa")[i] for i in range(len(basis.exprs))], F.col("y"))
        one = LinearRegression(featuresCol="_x", labelCol="_y", regParam=0.5).fit(data)
        x = np.array([r["_fa"] for r in part.select("_fa").limit(200).collect()])
        want = x @ one.coefficients.toArray() + one.intercept
        assert np.allclose(x @ mine.weights + mine.intercept, want, rtol=1e-9, atol=0)


def test_all_folds_from_one_pass_equal_single_fits(spark, task):
    spec = M.Spec("spline", {"knots": 5, "regParam": 0.1})
    store = T.Store(spark, work_dir(spark, "ridge"))
    T.train_folds(store, task, {"s": spec}, [0, 3, 25])
    basis = ridge.basis_of(task.train, task.features, "spline", 5)
    saved = store.read("predictions", T.predictions_schema())
    assert {r["fold"] for r in saved.select("fold").distinct().collect()} == {0, 3, 25}
    for f in (0, 3, 25):
        one = ridge.fit_all(task.train.where(~held_out("id", f)), basis, "y", 0.1)
        rows = basis.apply(task.train.where(held_out("id", f)).select(*task.train.columns))
        want = {r["id"]: r["p"] for r in rows.select("id", one.predict(F.col("_fa")).alias("p")).collect()}
        got = {r["row_id"]: r["p"] for r in saved.where((F.col("fold") == f) & (F.col("split") == "valid")).collect()}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=1e-9) for i in want)
        assert saved.where((F.col("fold") == f) & (F.col("split") == "test")).count() == 500
    scores = {(r["fold"], r["step"]): r for r in store.scores().collect()}
    assert len(scores) == 6 and scores[3, "valid"]["n_rows"] + scores[3, "train"]["n_rows"] == 2500
    # only what is missing is trained
    T.train_folds(store, task, {"s": spec}, [0, 1, 3], train_score=False)
    scores = {(r["fold"], r["step"]): r["value"] for r in store.scores().collect()}
    assert len(scores) == 7 and (1, "train") not in scores and (25, "train") in scores


def test_gaps_constants_and_nothing(spark):
    rows = [(i, float(i % 5), None if i == 3 else float(i % 3), None if i == 4 else 2.0 * (i % 5) + 1) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    basis = ridge.basis_of(df, ["a", "b"], "ridge")
    fit = ridge.fit_all(df, basis, "y", 0.0)
    assert fit.weights == pytest.approx([2.0, 0.0], abs=1e-9) and fit.intercept == pytest.approx(1.0)
    flat = ridge.fit_all(df.withColumn("y", F.lit(7.0)), basis, "y", 0.1)
    assert flat.intercept == pytest.approx(7.0) and not flat.weights.any()
    with pytest.raises(ValueError):
        ridge.fit_all(df.limit(0), basis, "y", 0.1)


def test_a_large_mean_costs_no_digits(spark, task):
    far = task.train.withColumns({"z": F.col("z") + 1e7, "y": F.col("y") + 1e7})
    names = ["x", "z", "b"]
    near = ridge.fit_all(task.train, ridge.basis_of(task.train, names, "ridge"), "y", 0.1)
    moved = ridge.fit_all(far, ridge.basis_of(far, names, "ridge"), "y", 0.1)
    assert moved.weights == pytest.approx(near.weights, rel=1e-6)
