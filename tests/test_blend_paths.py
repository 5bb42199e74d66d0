"""All ways of walking through a blend choose the same members."""

import numpy as np
import pytest

from tabloom.operators import ensemble as B
from tabloom.operators import greedy as G
from tabloom.operators import scores as S


def preds(spark, name, seed=3, n=400):
    rng = np.random.default_rng(seed)
    rows = []
    for fold in range(3):
        x = rng.normal(size=n + 50 * fold)
        if name in ("auc", "gini", "nll", "loglik"):
            y = (rng.random(len(x)) < 1 / (1 + np.exp(-2 * x))).astype(float)
            make = lambda a, s: 1 / (1 + np.exp(-(a * x + s * rng.normal(size=len(x)))))
        else:
            y = np.exp(x)
            make = lambda a, s: np.round(np.exp(a * x + s * rng.normal(size=len(x))), 2)
        for k, (a, s) in enumerate([(2.0, 1.0), (1.0, 0.4), (0.5, 0.3), (1.5, 1.5)]):
            p = make(a, s)
            rows += [(f"m{k}", fold, i, float(y[i]), float(p[i])) for i in range(len(x)) if not (k == 3 and fold == 1 and i == 0)]
    return spark.createDataFrame(rows, "submission string, fold int, row_id long, y double, p double")


def picks(df, name):
    return sorted((r["fold"], r["submission"], round(r["weight"], 9)) for r in B.blend(df, name).collect())


@pytest.mark.parametrize("name", ["mae", "mare", "smape", "rmsle", "medae", "nll", "loglik", "auc", "gini", "ngini"])
def test_all_ways_choose_alike(spark, monkeypatch, name):
    df = preds(spark, name).cache()
    in_tasks = picks(df, name)
    assert not any(f == 1 and s == "m3" for f, s, _ in in_tasks)  # it lacks a row there
    monkeypatch.setattr(B, "FOLD_CELLS", 0)
    assert picks(df, name) == in_tasks
    # without the sums and the bounds: a row per candidate
    monkeypatch.setattr(B.G, "MEANS", ())
    monkeypatch.setattr(B, "rank_edges", lambda *a: {})
    assert picks(df, name) == in_tasks


def test_bounds_keep_the_best_and_drop_others(spark):
    df = preds(spark, "auc", n=3000)
    names = ["m0", "m1", "m2", "m3"]
    wide = B.wide_predictions(df, names)
    members, sizes = B.complete_members(wide, names)
    assert members[1] == [0, 1, 2] and sizes[0] == 3000
    chosen = {f: [0, 1] for f in members}
    able = B._rank_survivors(wide, chosen, members, 4, B.rank_edges(wide, 4))
    step = B.blend_step(df, ["m0", "m1"], "auc")
    best = {r["fold"]: r["submission"] for r in B.best_candidate(step.where("fold <> 1 OR submission <> 'm3'"), "auc").collect()}
    for f, left in able.items():
        assert best[f] in [names[i] for i in left] and len(left) < len(members[f])


@pytest.mark.parametrize("name", sorted(G.SCORES))
def test_scores_of_columns_equal_the_queries(spark, name):
    df = preds(spark, name if name in ("auc", "gini", "nll", "loglik") else "auc" if name == "kappa" else "mae", n=100)
    got = {(r["submission"], r["fold"]): r["score"] for r in S.score(df, name).collect()}
    rows = df.where("fold = 0").orderBy("row_id").collect()
    for m in ("m0", "m1"):
        y = np.array([r["y"] for r in rows if r["submission"] == m])
        p = np.array([r["p"] for r in rows if r["submission"] == m])
        assert G.SCORES[name](y, p[:, None])[0] == pytest.approx(got[m, 0], rel=1e-9)
