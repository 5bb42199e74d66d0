"""Kits from files, stand-in targets, the preparation chain over all roles."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.meta import Kit, Meta, features_of, roles_of, with_roles
from tabloom.operators import profile as P
from tabloom.operators.models import Spec
from tabloom.operators.stages import ClipToRange, ColumnStage
from tabloom.operators.training import Store
from tabloom.plans import prepare as R
from tabloom.plans.start import setup_and_start
from tabloom.session import work_dir
from tabloom.sources import kits as K
from tabloom.sources import outputs as O


@pytest.fixture()
def frame(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(rng.normal()), float(rng.normal()), ("y1", "y2", "y3")[i % 3]) for i in range(100)]
    return spark.createDataFrame(rows, "id long, a double, b double, y string")


def test_regression_stand_in_targets(spark, frame):
    train = frame.withColumn("y", F.col("a") * 2 + 5)
    out = P.dummy_targets(train, frame.drop("y"), "y", "id", classification=False)
    assert out.count() == 100 and out.columns == ["id", "a", "b", "y"]
    again = P.dummy_targets(train, frame.drop("y").repartition(7), "y", "id", classification=False)
    assert sorted(out.select("id", "y").collect()) == sorted(again.select("id", "y").collect())
    mean = out.agg(F.avg("y")).first()[0]
    assert abs(mean - train.agg(F.avg("y")).first()[0]) < 1.0


def test_class_stand_in_targets(frame):
    out = P.dummy_targets(frame, frame.drop("y"), "y", "id", classification=True)
    assert {r["y"] for r in out.collect()} == {"y1", "y2", "y3"}


def test_given_targets_are_left_alone(frame):
    assert P.dummy_targets(frame, frame, "y", "id", classification=True) is frame


def test_label_codes_follow_first_appearance(spark):
    df = spark.createDataFrame([(3, "b"), (1, "c"), (2, "a"), (4, "c")], "id long, y string")
    codes = {r["y"]: r["code"] for r in P.label_codes(df, "y", "id").collect()}
    assert codes == {"c": 0, "a": 1, "b": 2}


def write_kit(path, target_in_test=False, n=120):
    """All roles, gaps, odd names, two targets absent from test, a constant and a one-sided column."""
    rng = np.random.default_rng(1)
    os.makedirs(path)
    head = ["id", "size [m]", "kind", "flag", "note", "day", "where", "wide cat", "const", "score", "label"]
    roles = ["num", "num", "cat", "bin", "text", "date", "location", "cat", "num"]
    for name, drop in (("train", []), ("test", ["score", "label"])):
        rows = []
        for i in range(n):
            j = i + (1000 if name == "test" else 0)
            rows.append(
                {
                    "id": j,
                    "size [m]": "" if i % 9 == 0 else f"{rng.normal():.4f}",
                    "kind": "" if i % 7 == 0 else " red " if i % 3 else "blue",
                    "flag": "yes" if i % 2 else "no",
                    "note": f"text {i % 13} of row",
                    "day": f"2024-{1 + i % 12:02d}-{1 + i % 28:02d} {i % 24:02d}:00:00",
                    "where": "FR" if i % 2 else "DE",
                    "wide cat": f"v{i % 30}",
                    "const": 4,
                    "score": "" if i == 5 else f"{i * 0.5:.2f}",
                    "label": ("lo", "mid", "hi")[i % 3],
                }
            )
        cols = [h for h in head if h not in drop]
        with open(f"{path}/{name}.csv", "w") as f:
            f.write(",".join(cols) + "\n")
            for r in rows:
                f.write(",".join(str(r[c]) for c in cols) + "\n")
    return dict(zip(head, roles))


def write_meta(path, roles, target, prediction, score):
    with open(f"{path}/metadata.json", "w") as f:
        json.dump(
            {
                "title": "made for tests",
                "id_col": "id",
                "prediction_type": prediction,
                "score_name": score,
                "data_description": {
                    "target_cols": [target],
                    "feature_types": roles,
                    "feature_types_to_cast": {"const": "double"},
                },
            },
            f,
        )


@pytest.mark.parametrize("target,prediction,score", [("score", "regression", "rmse"), ("label", "classification", "accuracy")])
def test_setup_and_start(spark, tmp_path, target, prediction, score):
    path = str(tmp_path / "kit")
    roles = write_kit(path)
    write_meta(path, roles, target, prediction, score)
    kit = K.read_kit(spark, path)
    assert dict(kit.train.dtypes)["const"] == "double"
    ready = R.setup(kit)
    assert ready.train.count() == (119 if target == "score" else 120)
    assert "_size__m__1" in ready.train.columns
    prof = ready.meta.profile
    assert prof["missing_data_count"]["_size__m__1"] > 0
    assert prof["unique_value_count"]["_kind_2"] == 3
    assert prof["feature_values"]["_kind_2"] == ["", "blue", "red"]
    assert target in ready.test.columns
    if prediction == "classification":
        assert ready.meta.target_values["label"] == ["lo", "mid", "hi"]

    days = spark.createDataFrame([("FR", "2024-01-01"), ("FR", "2024-01-01"), ("DE", "2024-05-01")], "location string, day string")
    store = Store(spark, work_dir(spark, "t"))
    spec = Spec("rf", {"numTrees": 3, "maxDepth": 3}, score)
    task, means = setup_and_start(kit, store, R.ChainSettings(calendar=days, text={"_note_4": {"n": 4}}), spec, (0, 1))
    assert "is_holiday" in task.features and "_const_8" not in task.features
    assert "_where_6_FR" in task.features and "_flag_3_yes" in task.features
    assert sum(c.startswith("_wide_cat_7_col_") for c in task.features) > 10
    got = means.collect()
    assert len(got) == 1 and got[0]["mean_valid"] is not None
    sizes = store.scores().where("step = 'valid' and fold = 0").select("n_rows").collect()
    assert sizes[0][0] < 60


def test_model_imputers_in_the_chain(spark, tmp_path):
    path = str(tmp_path / "kit")
    roles = write_kit(path)
    write_meta(path, roles, "score", "regression", "rmse")
    kit = R.setup(K.read_kit(spark, path))
    s = R.ChainSettings(imputer="model", imputer_settings={"trees": 2, "depth": 2}, text={"_note_4": {"n": 2}})
    out = R.preprocess_chain(kit, s)
    cols = R.numeric_features(out)
    assert out.train.count() == kit.train.count()
    assert all(r == 0 for r in out.train.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first())


def test_output_keeps_sample_order(spark, tmp_path):
    ids = spark.createDataFrame([(3, 0), (1, 1), (2, 2)], "id long, at int")
    preds = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3)], "id long, p double")
    out = O.regression_output(ids, preds, "id", "y")
    O.write_predictions(out.coalesce(1), str(tmp_path / "o"), order="at")
    back = spark.read.option("header", True).csv(str(tmp_path / "o"))
    assert [r["id"] for r in back.collect()] == ["3", "1", "2"]


def test_arg_max_ties_go_to_the_first_class(spark):
    ids = spark.createDataFrame([(1,)], "id long")
    preds = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5)], "id long, class string, p double")
    out = O.class_output(ids, preds, "id", "y", ["b", "a"], "accuracy")
    assert out.collect()[0]["y"] == "b"


def test_stages_keep_roles_and_join_pipelines(spark):
    class Square(ColumnStage):
        def apply(self, df, cols):
            return df.withColumns({f"{c}_sq": F.col(c) * F.col(c) for c in cols})

    df = with_roles(spark.createDataFrame([(1, 2.0), (2, 3.0)], "id long, x double"), {"id": "id", "x": "num"})
    out = Square(cols=["x"]).transform(df)
    assert roles_of(out) == {"id": "id", "x": "num", "x_sq": "num"}
    from pyspark.ml import Pipeline

    fitted = Pipeline(stages=[Square(cols=["x"]), ClipToRange(cols=["x_sq"])]).fit(df)
    far = with_roles(spark.createDataFrame([(9, 10.0)], "id long, x double"), {"id": "id", "x": "num"})
    got = fitted.transform(far)
    assert got.collect()[0]["x_sq"] == 9.0 and features_of(got) == ["x", "x_sq"]


def test_kit_both_uses_shared_columns(spark):
    a = spark.createDataFrame([(1, 2)], ["id", "y"])
    b = spark.createDataFrame([(3,)], ["id"])
    assert Kit(a, b, Meta("", "id", ["y"], "regression", "rmse", {})).both().columns == ["id"]


def test_priors_skip_the_baseline(spark):
    t = spark.createDataFrame([(0, 9.0, 9.0), (1, 0.25, 0.5)], "step int, a double, `b c` double")
    got = {r["feature"]: r["prior"] for r in K.drop_priors(t, ["id", "a", "b c"], "id", "step").collect()}
    assert got == {"_a_1": 0.25, "_b_c_2": 0.5}
    assert K.drop_priors(t.limit(1), ["id", "a", "b c"], "id", "step").count() == 0
