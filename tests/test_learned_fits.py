"""Early stopping, calibration and code words."""

import math
from types import SimpleNamespace

import numpy as np
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tabloom.meta import Kit, Meta, with_roles
from tabloom.operators import impute as I
from tabloom.operators import models as M


def noisy(spark, n, seed):
    """Two classes that overlap, and columns of noise."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6))
    y = (rng.random(n) < 1 / (1 + np.exp(-1.5 * x[:, 0]))).astype(float)
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"x{k} double" for k in range(6)) + ", y double")


FEATURES = [f"x{k}" for k in range(6)]


def log_loss(out):
    p = F.least(F.greatest(F.when(F.col("y") == 1, F.col("probs")[1]).otherwise(F.col("probs")[0]), F.lit(1e-15)), F.lit(1.0))
    return out.agg(-F.avg(F.log(p))).first()[0]


def test_network_stops_before_its_most_iterations(spark):
    train, test = noisy(spark, 400, 1), noisy(spark, 400, 2)
    params = {"knots": 5, "hidden": (16,), "maxIter": 300}
    early = M.fit(M.Spec("spline", params), train, FEATURES, "y", 2, "id")
    assert early.iterations < 300
    whole = M.fit(M.Spec("spline", {**params, "early_stop": False}), train, FEATURES, "y", 2, "id")
    assert whole.iterations is None
    assert log_loss(early.predict(test)) < log_loss(whole.predict(test))


class Stage:
    """A fitted network whose probability of the second class is given."""

    def __init__(self, p):
        self.weights, self.p = [p], p

    def transform(self, df):
        return df.withColumn("_probabilityCol0", array_to_vector(F.array(F.lit(1 - self.p), F.lit(self.p))))


def staged(spark, monkeypatch, shares, most):
    """Iterations, the chosen stage's share, and (iterations, starting weights) of each stage, all rows kept aside being of class 1."""
    asked, left = [], list(shares)

    def make(maxIter, initialWeights=None):
        asked.append((maxIter, initialWeights))
        return SimpleNamespace(hasParam=lambda p: False, fit=lambda df: Stage(left.pop(0)))

    monkeypatch.setattr(M, "PipelineModel", lambda stages: stages)
    y = F.when(M.holdout(F.col("id")), 1.0).otherwise(F.col("id") % 2)
    rows = spark.range(100).select("id", F.lit(0.5).alias("x"), y.cast("double").alias("y"))
    out = M._staged_network(make, rows, [F.col("x")], F.col("y"), 2, "id", most)
    return out.iterations, out.stages[0][0].p, asked


def test_short_network_can_stop(spark, monkeypatch):
    done, chosen, asked = staged(spark, monkeypatch, [0.6, 0.5, 0.4, 0.9], 15)
    assert (done, chosen) == (12, 0.6)
    assert asked == [(6, None), (3, [0.6]), (3, [0.5])]


def test_the_best_stage_is_kept_however_small_its_gain(spark, monkeypatch):
    done, chosen, asked = staged(spark, monkeypatch, [0.6, 0.600001, 0.59, 0.9], 15)
    assert (done, chosen) == (12, 0.600001)
    done, chosen, asked = staged(spark, monkeypatch, [0.6, 0.5, 0.7, 0.71], 15)
    assert (done, chosen) == (15, 0.71)
    assert [n for n, _ in asked] == [6, 3, 3, 3]


def test_stages_of_any_length_make_up_the_most(spark, monkeypatch):
    for most in (1, 2, 3, 4, 7, 50):
        done, _, asked = staged(spark, monkeypatch, [0.1 + 0.01 * k for k in range(60)], most)
        assert done == most == sum(n for n, _ in asked)


def test_margins_of_unseen_rows_calibrate_better(spark):
    train, test = noisy(spark, 220, 3), noisy(spark, 500, 4)
    spec = M.Spec("kernel_svm", {"components": 96, "gamma": 0.3, "C": 100.0, "maxIter": 60})
    mine = log_loss(M.fit(spec, train, FEATURES, "y", 2, "id").predict(test))
    # calibrated on the margins of the rows it was fitted on
    exprs, rest = M._fourier(spec, train, FEATURES)
    data = M.assembled(train, exprs, F.col("y"))
    svm = LinearSVC(featuresCol="_x", labelCol="_y", **rest).fit(data)
    seen = svm.transform(data).drop("prediction")
    calib = LogisticRegression(featuresCol="rawPrediction", labelCol="_y", regParam=1e-3, rawPredictionCol="_r").fit(seen)
    rows = M.assembled(test, exprs, F.col("y"), [F.col("y")])
    out = calib.transform(svm.transform(rows).drop("prediction")).withColumn("probs", vector_to_array("probability"))
    assert mine < log_loss(out)


def test_one_class_in_a_part(spark):
    few = noisy(spark, 12, 5).withColumn("y", F.when(F.col("id") == 0, 1.0).otherwise(0.0))
    out = M.fit(M.Spec("kernel_svm", {"components": 4, "maxIter": 5}), few, FEATURES, "y", 2, "id").predict(few)
    assert out.where("probs[0] + probs[1] BETWEEN 0.999 AND 1.001").count() == 12


def labels_kit(spark, labels, per):
    rows = [(i, float(i % labels), f"label {i % labels}" if i % 9 else None) for i in range(labels * per)]
    df = with_roles(spark.createDataFrame(rows, "id long, x double, c string"), {"id": "id", "x": "num", "c": "cat"})
    meta = Meta("t", "id", ["y"], "regression", "rmse", {"x": "num", "c": "cat"})
    return Kit(df, df.where("id % 2 = 0"), meta)


def test_many_labels_by_code_words(spark):
    kit = labels_kit(spark, 40, 20)
    out = I.impute_cat_model(kit, "c", ["x"], [], trees=8, depth=9, max_classes=16)
    for df, source in ((out.train, kit.train), (out.test, kit.test)):
        rows = {r["id"]: r for r in df.collect()}
        assert len(rows) == source.count() and df.columns == source.columns
        assert all(rows[r["id"]]["c"] == r["c"] for r in source.where("c is not null").collect())
        gaps = [rows[r["id"]] for r in source.where("c is null").collect()]
        assert all(g["c"].startswith("label ") for g in gaps)
        assert sum(g["c"] == f"label {int(g['x'])}" for g in gaps) > 0.6 * len(gaps)
    assert out.train.schema["c"].metadata == {"role": "cat"}


def test_code_words_tell_labels_apart():
    bits = I.code_bits(10_000)
    words = I.code_words(np.arange(10_000), bits, 61)
    assert bits <= 32 and len({w.tobytes() for w in words}) > 9_990
    assert 0.45 < words.mean() < 0.55 and math.ceil(math.log2(10_000)) < bits
    assert (I.code_words(np.array([7]), bits, 61) == words[7]).all()
