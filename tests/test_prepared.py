"""Prepared tables kept by settings and inputs, and a race that tunes them."""

import pytest
from pyspark.sql import functions as F

from tabloom.catalog.views import order_kit
from tabloom.meta import Kit, Meta, with_roles
from tabloom.operators import space as H
from tabloom.operators import training as T
from tabloom.operators.models import Spec
from tabloom.plans import prepare as R
from tabloom.plans.prepared import Preparation, chain_settings, preparation_dims
from tabloom.plans.race import Base, Race, RaceSettings, with_preparation
from tabloom.session import work_dir


@pytest.fixture(scope="module")
def kit(spark, sf):
    k = order_kit(spark, sf)
    drop = [c for c in ("status", "place") if c in k.train.columns]
    meta = Meta(k.meta.title, k.meta.id_col, k.meta.target_cols, k.meta.prediction_type, k.meta.score_name,
                {c: r for c, r in k.meta.roles.items() if c not in drop})
    return R.stored_kit(Kit(k.train.drop(*drop), k.test.drop(*drop), meta))


def as_rows(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=str)


def test_moving_one_element_refits_only_what_follows(spark, kit):
    store = T.Store(spark, work_dir(spark, "prep"))
    prep = Preparation(kit, store)
    _, first = prep.task({})
    assert "encode_cat" in prep.fitted and "rm_constant_col" in prep.fitted
    want = R.make_task(R.preprocess_chain(kit))
    assert first.features == want.features and as_rows(first.train) == as_rows(want.train)

    prep.fitted.clear()
    key, again = prep.task({})
    assert prep.fitted == [] and again.features == first.features

    # another encoder: nothing before it is fitted again
    _, coded = prep.task({"priority_encoder": "count"})
    assert prep.fitted == ["encode_cat", "rm_constant_col"] and coded.features != first.features
    want = R.make_task(R.preprocess_chain(kit, R.ChainSettings(category={"priority": "count"})))
    assert as_rows(coded.test) == as_rows(want.test)

    # a dropped column changes the features
    prep.fitted.clear()
    _, less = prep.task({"balance_to_drop": True, "segment_to_drop": True})
    assert not any(f.startswith(("balance", "segment")) for f in less.features) and prep.fitted

    # another process finds everything
    other = Preparation(kit, store)
    assert other.task({"priority_encoder": "count"})[1].features == coded.features and other.fitted == []
    # other rows are another input
    changed = Preparation(kit.replace(kit.train.limit(50), kit.test), store)
    assert changed.input_key != other.input_key


def test_a_step_broken_off_is_made_anew(spark, kit):
    store = T.Store(spark, work_dir(spark, "prep"))
    prep = Preparation(kit, store)
    finish, prep._finish = prep._finish, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        prep.task({})
    prep._finish = finish
    assert prep.task({})[1].train.count() == kit.train.count()


def test_dims_and_settings(kit):
    dims = preparation_dims(kit, {"balance": 0.4})
    by = {d.name: d for d in dims}
    assert by["balance_to_drop"].priors == (0.6, 0.4) and by["priority_encoder"].element == "encode_cat"
    s = chain_settings({"balance_to_drop": True, "priority_encoder": "binary", "imputer": "model", "maxDepth": 3}, R.ChainSettings())
    assert s.dropped == {"balance": True} and s.category == {"priority": "binary"} and s.imputer == "model"


@pytest.mark.parametrize("name, params", [("variance_threshold", {"threshold": 0.2}), ("select_kbest", {"removed": -2}), ("l1_selector", {"c": 0.02}), ("rf_selector", {"removed": 2, "trees": 5})])
def test_selectors_in_the_chain(spark, name, params):
    rows = spark.range(400).select(
        "id", (F.col("id") % 2).cast("double").alias("good"), ((F.col("id") * 7919 % 101) / 100.0).alias("noise"),
        ((F.col("id") * 104729 % 97) / 1000.0).alias("faint"), (F.col("id") % 2).cast("double").alias("y"),
    )
    roles = {"good": "num", "noise": "num", "faint": "num"}
    train = with_roles(rows, roles | {"id": "id", "y": "target"})
    meta = Meta("t", "id", ["y"], "classification", "auc", roles, {}, {"y": "1"}, {"y": ["0", "1"]})
    s = R.ChainSettings(chain=(*R.DEFAULT_CHAIN, name), selectors={name: params})
    kept = R.numeric_features(R.preprocess_chain(Kit(train, train, meta), s))
    assert "good" in kept and len(kept) < 3
    prep = Preparation(Kit(train, train, meta), T.Store(spark, work_dir(spark, "prep")), s)
    assert prep.task({})[1].features == kept


def forest(values):
    return Spec("rf", {"numTrees": 2, **values}, "rmse")


def test_race_tunes_the_preparation(spark, kit):
    store = T.Store(spark, work_dir(spark, "race"))
    prep = Preparation(kit, store)
    dims = preparation_dims(kit, steps=("drop_columns", "encode_cat"))
    base = with_preparation(Base("rf", H.Space([H.Dim("maxDepth", (1, 2, 3), 2)]), forest), dims)
    _, task = prep.task({})
    settings = RaceSettings(n_rounds=2, n_trials=2, n_search_folds=2, n_final_folds=2, elements=("drop_columns",))
    race = Race(store, task, {"rf": base}, settings, preparation=prep)
    out = race.go()
    assert out["blend_then_bag"].count() == kit.test.count()
    # the trials moved drop flags only, so their features differ
    values = race._values_of([r["submission"] for r in race.known().collect()])
    assert len(values) == 4 and {v["maxDepth"] for _, v in values.values()} == {2}
    features = {tuple(prep.task(v)[1].features) for _, v in values.values()}
    assert len(features) > 1
    # the encoders of one submission with the predictor of another
    name = sorted(values)[0]
    race.store.append([("rf_hyperopt_x", "rf", "x", [0, *[0] * sum(d.element == "drop_columns" for d in dims), 1, 1])], "settings",
                      "submission string, base string, hash string, indices array<int>")
    mixed = race.hybrids("rf", name, "encode_cat", ["rf_hyperopt_x"])
    got = race._values_of(mixed)[mixed[0]][1]
    assert got["priority_encoder"] == "count" and got["maxDepth"] == 2


def test_failed_trials_are_topped_up(spark, kit):
    store = T.Store(spark, work_dir(spark, "race"))
    task = R.make_task(R.preprocess_chain(kit))

    def build(values):
        # four of six settings cannot be fitted
        return forest({"maxDepth": values["maxDepth"] if values["maxDepth"] in (2, 5) else -1})

    base = Base("rf", H.Space([H.Dim("maxDepth", (1, 2, 3, 4, 5, 6), 2)]), build)
    race = Race(store, task, {"rf": base}, RaceSettings(n_rounds=1, n_trials=2, n_search_folds=1))
    race.store.append([("seed", 0, "valid", "rmse", 1.0, 1.0, 1)], "scores", T.SCORES)
    race.go(finish=False)
    trained = {r["submission"] for r in store.scores().where("submission <> 'seed'").collect()}
    assert len(trained) == 2 and store.read("failures", T.FAILURES).count() >= 1
