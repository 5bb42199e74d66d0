"""What a task holds does not grow with the table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.catalog import views
from tabloom.functions import spread as P
from tabloom.operators import ensemble as B
from tabloom.operators import models as M


def test_prefixes_are_not_multiplied_before_the_bags(spark):
    rows = [("a", 2, 1, 5.0, 4.0), ("a", 0, 1, 5.0, 8.0), ("a", 2, 1, 5.0, 3.0), ("a", 1, 2, 1.0, 2.0), ("b", 1, 1, 5.0, None), ("b", 2, 1, 5.0, 6.0)]
    df = spark.createDataFrame(rows, "submission string, fold int, row_id long, y double, p double")
    folds = [2, 1, 0]
    out = B.bagged_scores(df, "mae", folds)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.rindex("Aggregate")
    got = {(r["submission"], r["n_folds"]): r["score"] for r in out.collect()}
    want = {}
    for s in ("a", "b"):
        for n in range(1, len(folds) + 1):
            cells = {}
            for _, f, i, y, p in [r for r in rows if r[0] == s and r[1] in folds[:n]]:
                cells.setdefault((i, y), []).append(p)
            bags = [(y, [p for p in ps if p is not None]) for (_, y), ps in cells.items()]
            if bags:
                want[s, n] = np.mean([abs(y - np.mean(ps)) for y, ps in bags]) if all(ps for _, ps in bags) else None
    assert got == pytest.approx(want)


def test_line_items_are_dealt_over_tasks_by_their_number(spark, sf, monkeypatch):
    want = sorted(map(tuple, views.items(spark, sf).collect()))
    monkeypatch.setattr(P, "TASK_ROWS", 100)
    rows = views.items(spark, sf)
    n = views.table(spark, sf, "lineitem").count()
    assert rows.rdd.getNumPartitions() >= n / 100
    assert sorted(map(tuple, rows.collect())) == want
    # what is made of a row stays in its task: no second shuffle
    assert B.bag(views.repeated_preds(spark, sf))._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_bags_are_blended_in_tasks_of_bounded_size(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(s, f, i, float(i), float(i + rng.normal())) for s in "abc" for f in range(2) for i in range(500)]
    df = spark.createDataFrame(rows, "submission string, fold int, row_id long, y double, p double")
    _, want = B.bag_then_blend(df, "rmse")
    monkeypatch.setattr(P, "TASK_ROWS", 50)
    _, got = B.bag_then_blend(df, "rmse")
    assert got.rdd.getNumPartitions() >= 30
    assert {r["row_id"]: pytest.approx(r["p"]) for r in got.collect()} == {r["row_id"]: r["p"] for r in want.collect()}


def test_trees_are_fitted_in_tasks_of_bounded_size(spark, monkeypatch):
    df = spark.range(2000).selectExpr("id", "id % 7 AS x", "double(id % 7 > 3) AS y").coalesce(1)
    parts = []
    whole = M.assembled
    monkeypatch.setattr(M, "assembled", lambda rows, *a: parts.append(rows.rdd.getNumPartitions()) or whole(rows, *a))
    monkeypatch.setattr(P, "TASK_ROWS", 100)
    for kind, classes in (("gbt", 0), ("rf", 0), ("gbt", 2), ("rf", 2)):
        params = {"maxDepth": 1, **({"maxIter": 1} if kind == "gbt" else {"numTrees": 1})}
        model = M.fit(M.Spec(kind, params), df, ["x"], "y", classes, "id")
        assert model.predict(df).count() == 2000
    assert min(parts) >= 20


def test_a_fold_of_millions_is_not_walked_by_one_task():
    # three candidates on the line items at sixty times sf0.1: 3.6 million rows a fold
    assert B.FOLD_CELLS < 3 * 3_600_000


def test_gaps_are_left_out_of_the_sums_in_batches(spark):
    from tabloom.operators import ridge

    rows = [(float(i), float(i * i % 7), 2.0 * i + 1) for i in range(40)] + [(None, 1.0, 9.0), (float("nan"), 1.0, 9.0), (1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, y double").coalesce(1)
    fit = ridge.fit_all(df, ridge.basis_of(df, ["a", "b"], "ridge"), "y", 0.0)
    assert fit.intercept == pytest.approx(1.0) and list(fit.weights) == pytest.approx([2.0, 0.0], abs=1e-9)
    row = df.withColumn("_fa", fit_array()).withColumn("p", fit.predict(F.col("_fa")))
    assert [r["p"] for r in row.limit(3).collect()] == pytest.approx([1.0, 3.0, 5.0])
    # a sum of columns, not a lambda per row
    assert "lambda" not in row._jdf.queryExecution().optimizedPlan().toString()


def fit_array():
    return F.array(F.col("a"), F.col("b"))


def test_the_parts_of_training_rows_are_hashed_once(spark, tmp_path, monkeypatch):
    from tabloom.operators import training as T

    rows = spark.range(3000).selectExpr("id", "double(id % 2) AS x", "double(id % 7 + 3 * (id % 2)) AS y")
    specs = {d: M.Spec("rf", {"numTrees": 1, "bootstrap": False, "maxDepth": int(d)}) for d in "01"}
    task = T.Task(rows.where("id % 4 > 0"), rows.where("id % 4 = 0"), "id", "y", ["x"], "rmse")

    def scores(name):
        store = T.Store(spark, str(tmp_path / name))
        T.train_folds(store, task, specs, [0, 11])
        return {(r["submission"], r["fold"], r["step"]): (pytest.approx(r["value"]), r["n_rows"]) for r in store.scores().collect()}

    want, hashed = scores("whole"), []
    plain = T.held_out
    monkeypatch.setattr(T, "held_out", lambda *a: hashed.append(a) or plain(*a))
    monkeypatch.setattr(P, "TASK_ROWS", 100)
    assert scores("parts") == want and len(want) == 12
    assert not hashed


def test_a_spline_basis_is_no_long_expression_per_row(spark):
    from tabloom.operators import scale as N

    rows = [(float(i) / 7, i) for i in range(50)] + [(None, 50), (float("-inf"), 51)]
    df = spark.createDataFrame(rows, "x double, id int")
    train = df.where("id < 50")
    place, exprs = N.spline_exprs(train, ["x"], 5)
    out = df.withColumns(place).select("id", *[e.alias(f"b{j}") for j, e in enumerate(exprs["x"])])
    assert "CASE" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["id"]: np.array(r[1:]) for r in out.collect()}
    assert all(v.sum() == pytest.approx(1.0) and (v >= 0).all() for v in got.values())
    # ends, and the row in the middle: a knot
    assert got[0] == pytest.approx([1 / 6, 4 / 6, 1 / 6, 0, 0, 0, 0]) and got[49] == pytest.approx([0, 0, 0, 0, 1 / 6, 4 / 6, 1 / 6])
    # a gap and what lies below the range count as its lower end
    assert (got[50] == got[0]).all() and (got[51] == got[0]).all()


def test_curves_combine_equal_values_once(spark, monkeypatch):
    from tabloom.operators import scores as S

    rows = [("a", f, i, float(i % 5), float(i * 7 % 11)) for f in range(2) for i in range(60)] + [("b", 0, 1, 2.0, None), ("b", 0, 2, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "submission string, fold int, row_id long, y double, p double")
    made, sized = [], []
    whole, sizes = S.stored, S.key_sizes
    monkeypatch.setattr(S, "stored", lambda t, *a: made.append(whole(t, *a)) or made[-1])
    monkeypatch.setattr(S, "key_sizes", lambda t, *a: sized.append(t) or sizes(t, *a))
    got = {(r["submission"], r["fold"]): r["score"] for r in S.ngini(df).collect()}

    def area(pairs):
        cum = strip = 0.0
        for v in sorted({v for v, _ in pairs}, reverse=True):
            ys = [y for u, y in pairs if u == v]
            strip += len(ys) * (cum + sum(ys) / 2)
            cum += sum(ys)
        return strip / (len(pairs) * cum) - 0.5

    want = {("b", 0): None}
    for f in range(2):
        mine = [(p, y) for s, g, _, y, p in rows if (s, g) == ("a", f)]
        want["a", f] = area(mine) / area([(y, y) for _, y in mine])
    assert {k: v if v is None else pytest.approx(v) for k, v in want.items()} == got
    # sizes and running sums read a file, not the shuffle of the predictions again
    assert len(sized) == 2 and all(any(t is m for m in made) for t in sized)


def test_submissions_with_the_same_targets_share_a_perfect_order(spark, monkeypatch):
    from tabloom.operators import scores as S

    y = [float(i * i % 17) for i in range(40)]
    mine = {
        ("a", 0): list(zip(y, y[1:] + y[:1])),
        ("b", 0): list(zip(y[::-1], y)),  # the same targets in another order of rows
        ("c", 0): list(zip(y[:-1], y)),  # one row less
        ("d", 0): list(zip(y[:-1] + [99.0], y)),  # one target differs
        ("e", 0): list(zip(y[:-1] + [None], y)),
        ("f", 0): list(zip(y, y[:-1] + [None])),
        ("a", 1): list(zip([2 * v for v in y], y)),
        ("b", None): list(zip(y, y)),
    }
    rows = [(s, f, i, a, b) for (s, f), pairs in mine.items() for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "submission string, fold int, row_id long, y double, p double")

    def area(pairs):
        pairs = sorted(pairs, key=lambda q: -q[0])
        cum = strip = 0.0
        for v in dict.fromkeys(q[0] for q in pairs):
            ys = [t for u, t in pairs if u == v]
            strip += len(ys) * (cum + sum(ys) / 2)
            cum += sum(ys)
        return strip / (len(pairs) * cum) - 0.5

    want = {}
    for key, pairs in mine.items():
        if key[1] is not None:
            gap = any(None in q for q in pairs)
            want[key] = None if gap else pytest.approx(area([(p, t) for t, p in pairs]) / area([(t, t) for t, _ in pairs]))
    sized = []
    sizes = S.key_sizes
    monkeypatch.setattr(S, "key_sizes", lambda t, *a: sized.append(t) or sizes(t, *a))
    got = S.ngini(df)
    assert {(r["submission"], r["fold"]): r["score"] for r in got.collect()} == want and got.count() == len(want)
    best = {tuple(r) for r in sized[1].select("submission", "fold").distinct().collect()}
    assert best == {("a", 0), ("c", 0), ("d", 0), ("e", 0), ("a", 1)}


def test_a_fold_is_hashed_once_per_row_and_not_per_submission(spark, tmp_path):
    rows = [(k, n, float(k % 50), 100.0 * k + n, n / 100, 0.0, "ANR"[k % 3]) for k in range(1, 30) for n in range(1, 4)]
    names = "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "lineitem.parquet"))
    for preds in (views.price_preds, views.share_preds):
        df = preds(spark, str(tmp_path))
        assert df.columns == ["submission", "fold", "row_id", "y", "p"] and df.count() == 3 * len(rows)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("md5(") == 1 and plan.index("Generate") < plan.index("md5(")
    # folds of its own: this one needs none
    assert "md5(" not in views._long(views.items(spark, str(tmp_path)), F.col("price"), views.PRICE_FORMULAS)._jdf.queryExecution().optimizedPlan().toString()


def test_normalised_gini_stores_line_items_once_and_not_each_submission(spark, tmp_path, monkeypatch):
    from tabloom import catalog
    from tabloom import session
    from tabloom.operators import scores as S

    rows = [(k, n, float(k % 50), 100.0 * (k % 9) + n, n / 100, 0.0, "ANR"[k % 3]) for k in range(1, 90) for n in (1, 2, 3, 3)]
    names = "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "lineitem.parquet"))
    want = {tuple(r) for r in S.score(views.price_preds(spark, str(tmp_path)), "ngini", digits=4).collect()}
    made = {}

    def keep(df, label="table"):
        made.setdefault(label, []).append(session.stored(df, label))
        return made[label][-1]

    monkeypatch.setattr(S, "stored", keep)
    monkeypatch.setattr(views, "stored", keep, raising=False)
    got = {tuple(r) for r in catalog.QUERIES["score_ngini"](spark, str(tmp_path)).collect()}
    assert got == want and len(got) == 30
    assert {k: len(v) for k, v in made.items()} == {"items": 1, "histogram": 2}
    assert made["items"][0].count() == len(rows) * 3 // 4


def test_curves_of_large_keys_add_up_ranges_without_a_table_of_pieces(spark, monkeypatch):
    from tabloom.functions import running as R
    from tabloom.operators import scores as S

    rows = [("a", f, float(i * i % (40 + f)), float(i * 7 % 31)) for f in range(3) for i in range(200)]
    rows += [("b", 0, float(i % 3), None if i % 5 else 2.0 * i) for i in range(60)] + [("c", 0, None if i == 7 else 1.0 * i, 3.0) for i in range(50)]
    rows += [("d", 0, 1.0 * i, float("nan") if i % 9 == 0 else -1.0 * i) for i in range(90)] + [("e", 0, 0.0, 1.0 * i) for i in range(40)]
    rows += [("f", 0, -2.0, 1.0), ("f", 1, 5.0, 5.0), ("g", None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "submission string, fold int, y double, p double")
    curve = lambda by: {(r["submission"], r["fold"]): r["_area"] for r in S._lorenz(df, S.KEYS, by).collect()}
    want = {by: curve(by) for by in "py"}
    scores = {(r["submission"], r["fold"]): r["score"] for r in S.ngini(df).collect()}
    labels = []
    for module in (S, R):
        whole = module.stored
        monkeypatch.setattr(module, "stored", lambda t, label="table", whole=whole: labels.append(label) or whole(t, label))
    monkeypatch.setattr(S, "BLOCK_ROWS", 10)
    monkeypatch.setattr(R.running, "__defaults__", (None, 10))
    for by in "py":
        got = curve(by)
        assert got.keys() == want[by].keys()
        assert all(v is None and got[k] is None or got[k] == pytest.approx(v, nan_ok=True) for k, v in want[by].items())
    assert want["p"]["a", 0] is not None and want["p"]["b", 0] is None and want["y"]["c", 0] is None
    got = {(r["submission"], r["fold"]): r["score"] for r in S.ngini(df).collect()}
    assert got.keys() == scores.keys()
    assert all(v is None and got[k] is None or got[k] == pytest.approx(v, nan_ok=True) for k, v in scores.items())
    # ranges are summed where they are made
    assert "histogram" in labels and "pieces" not in labels
