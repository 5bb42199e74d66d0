"""Coded predictions to labels, shapes and order."""

import pytest

import os

from tabloom.meta import Kit, Meta
from tabloom.operators.models import Spec
from tabloom.operators.training import Store, Task, retrain_full, train_folds
from tabloom.plans.outputs import write_outputs
from tabloom.plans.prepare import make_task, preprocess_chain, setup
from tabloom.session import work_dir
from tabloom.sources.kits import in_file_order, read_kit


def kit_of(spark, kind, score, labels=(), positive=None, sample=None):
    test = spark.createDataFrame([(i, float(i)) for i in (1, 2, 3)], "id long, x double")
    meta = Meta("t", "id", ["y"], kind, score, {"x": "num"}, {}, {"y": positive} if positive else {}, {"y": list(labels)})
    task = Task(test, test, "id", "y", ["x"], score, len(labels))
    return Kit(test, test, meta, sample), task


def rows(spark, path):
    return [tuple(r) for r in spark.read.option("header", True).option("inferSchema", True).csv(path).collect()]


def test_regression_in_sample_order(spark):
    sample = spark.createDataFrame([(3, 0.0), (1, 0.0), (2, 0.0)], "id long, y double").coalesce(1)
    kit, task = kit_of(spark, "regression", "rmse", sample=sample)
    preds = spark.createDataFrame([(1, 10.0), (3, 30.0)], "row_id long, p double")
    (path,) = write_outputs(kit, task, {"blend_then_bag": preds}, work_dir(spark, "out"))
    assert rows(spark, path) == [(3, 30.0), (1, 10.0), (2, None)]


@pytest.mark.parametrize("positive, want", [("yes", {1: 0.9, 2: 0.2}), ("no", {1: 0.1, 2: 0.8})])
def test_two_classes_give_the_positive_one(spark, positive, want):
    kit, task = kit_of(spark, "classification", "auc", ("no", "yes"), positive)
    preds = spark.createDataFrame([(1, 0.9), (2, 0.2)], "row_id long, p double")
    (path,) = write_outputs(kit, task, {"x": preds}, work_dir(spark, "out"))
    got = {i: p for i, p in rows(spark, path)}
    assert got[3] is None and all(got[i] == pytest.approx(p) for i, p in want.items())


def test_three_labels_and_a_file_per_base(spark):
    kit, task = kit_of(spark, "classification", "f1-micro", ("died", "lived", "other"))
    preds = spark.createDataFrame(
        [(b, i, c, 0.8 if (i + (b == "rf")) % 3 == c else 0.1) for b in ("gbt", "rf") for i in (1, 2, 3) for c in range(3)],
        "base string, row_id long, class int, p double",
    )
    paths = write_outputs(kit, task, {"best_single": preds}, work_dir(spark, "out"))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["best_single_gbt", "best_single_rf"]
    assert rows(spark, paths[0]) == [(1, "lived"), (2, "other"), (3, "died")]
    assert rows(spark, paths[1]) == [(1, "other"), (2, "died"), (3, "lived")]


def test_probabilities_per_class(spark):
    kit, task = kit_of(spark, "classification", "nll", ("a", "b", "c"))
    preds = spark.createDataFrame([(1, c, p) for c, p in enumerate((0.2, 0.3, 0.5))], "row_id long, class int, p double")
    (path,) = write_outputs(kit, task, {"x": preds}, work_dir(spark, "out"))
    assert rows(spark, path)[0] == (1, 0.2, 0.3, 0.5)


def test_text_ids_from_kit_to_file(spark, tmp_path):
    """Ids such as ID_07 stay text; rows come in the order of the sample's files."""
    folder = f"{tmp_path}/kit"
    os.makedirs(f"{folder}/sample_submission.csv")
    ids = [f"ID_{i:03d}" for i in range(300)]
    row = lambda i, y: f"{ids[i]},{i % 7},{y}\n"
    with open(f"{folder}/train.csv", "w") as f:
        f.write("id,x,y\n" + "".join(row(i, 10 * (i % 7 > 3)) for i in range(200)))
    with open(f"{folder}/test.csv", "w") as f:
        f.write("id,x\n" + "".join(f"{ids[i]},{i % 7}\n" for i in range(200, 300)))
    order = [200 + (37 * k) % 100 for k in range(100)]
    for part, wanted in (("a.csv", order[:10]), ("b.csv", order[10:])):  # the second is larger, so it is dealt first
        with open(f"{folder}/sample_submission.csv/{part}", "w") as f:
            f.write("id,y\n" + "".join(f"{ids[i]},0\n" for i in wanted))
    meta = Meta("t", "id", ["y"], "regression", "rmse", {"id": "num", "x": "num"})
    with open(f"{folder}/metadata.json", "w") as f:
        f.write(meta.to_json())
    kit = setup(read_kit(spark, folder, has_sample=True))
    task = make_task(preprocess_chain(kit))
    store = Store(spark, work_dir(spark, "results"))
    train_folds(store, task, {"s": Spec("rf", {"numTrees": 1, "maxDepth": 3, "bootstrap": False})}, [0, 1])
    valid = store.predictions(task).collect()
    assert valid and {r["row_id"] for r in valid} <= set(ids[:200])
    out = retrain_full(task, Spec("rf", {"numTrees": 1, "maxDepth": 3, "bootstrap": False}))
    (path,) = write_outputs(kit, task, {"x": out}, f"{tmp_path}/out")
    got = spark.read.option("header", True).schema("id string, y double").csv(path)
    got = [tuple(r) for r in in_file_order(got).orderBy("_order").select("id", "y").collect()]
    assert got == [(ids[i], 10.0 * (i % 7 > 3)) for i in order]


def test_two_targets_from_kit_to_files(spark, tmp_path):
    """A race on two targets: one blend for both, a column each in the files."""
    from tabloom.operators import space as H
    from tabloom.plans.race import Base, Race, RaceSettings

    folder = f"{tmp_path}/kit"
    os.makedirs(folder)
    with open(f"{folder}/train.csv", "w") as f:
        f.write("id,x,a,b\n" + "".join(f"{i},{i % 7},{10 * (i % 7 > 3) + i % 3},{-1000 * (i % 7 > 1) - 300 * (i % 7 > 4) - i % 5}\n" for i in range(400)))
    with open(f"{folder}/test.csv", "w") as f:
        f.write("id,x\n" + "".join(f"{i},{i % 7}\n" for i in range(400, 450)))
    meta = Meta("t", "id", ["a", "b"], "regression", "rmse", {"id": "num", "x": "num"})
    with open(f"{folder}/metadata.json", "w") as f:
        f.write(meta.to_json())
    kit = setup(read_kit(spark, folder))
    task = make_task(preprocess_chain(kit))
    assert task.several and task.cell == ["row_id", "target"]
    build = lambda v: Spec("rf", {"numTrees": 1, "bootstrap": False, **v})
    bases = {"rf": Base("rf", H.Space([H.Dim("maxDepth", (0, 1, 3), 1)]), build)}
    store = Store(spark, work_dir(spark, "results"))
    race = Race(store, task, bases, RaceSettings(n_rounds=1, n_trials=3, n_search_folds=2, n_final_folds=2))
    outputs = race.go()
    # the mean of the two errors is what is compared: the deepest tree is best on both
    means = {r["submission"]: r["value"] for r in store.scores().where("step = 'valid' AND fold = 0").collect()}
    best = min(means, key=means.get)
    assert race._values_of([best])[best][1] == {"maxDepth": 3} and race.blended().get(best, 0) > 0
    paths = write_outputs(kit, task, outputs, f"{tmp_path}/out")
    for path in paths:
        got = spark.read.option("header", True).schema("id long, a double, b double").csv(path).collect()
        assert [r["id"] for r in sorted(got, key=lambda r: r["id"])] == list(range(400, 450))
        for r in got:
            x = r["id"] % 7
            assert abs(r["a"] - (10 * (x > 3) + 1)) < 1 and abs(r["b"] + 1000 * (x > 1) + 300 * (x > 4) + 2) < 3
