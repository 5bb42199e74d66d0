"""Learned operators: neighbours, MLlib fits, model imputers, the race."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.catalog.registry import query
from tabloom.catalog.views import ITEMS_SQL, items, order_kit, sql_mod, table
from tabloom.meta import Kit
from tabloom.operators import impute as I
from tabloom.operators import knn as K
from tabloom.operators import models as M
from tabloom.operators import space as H
from tabloom.operators import training as T
from tabloom.operators.folds import fold_of
from tabloom.plans import prepare as R
from tabloom.plans.race import Base, Race, RaceSettings, grow_folds, run_arms, select_and_train
from tabloom.plans.start import setup_and_start
from tabloom.session import stored, work_dir

# --- neighbours: every vector is predicted from the other folds -----------------------------

VEC_SQL = f"""v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, {sql_mod(10, "vec_id || '_0'")} AS fold FROM embeddings),
  x AS (SELECT vec_id, label, fold, unnest(e) AS c, generate_subscripts(e, 1) AS j FROM v),
  z AS (SELECT vec_id, label, fold, list((c - m) / s ORDER BY j) AS e FROM x JOIN
        (SELECT j, avg(c) AS m, stddev_pop(c) AS s FROM x GROUP BY j) USING (j) GROUP BY 1, 2, 3),"""
L2 = "list_distance(a.e, b.e)"
L1 = "list_sum(list_transform(list_zip(a.e, b.e), lambda t: abs(t[1] - t[2])))"


def _near_sql(k: int, dist: str) -> str:
    return f"""{VEC_SQL}
  n AS (SELECT a.vec_id AS row_id, b.vec_id AS neighbour, b.label, {dist} AS dist FROM z a JOIN z b ON a.fold <> b.fold),
  r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY dist, neighbour) AS rank FROM n),
  near AS (SELECT * FROM r WHERE rank <= {k})"""


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("vec"), "label",
        fold_of(F.col("vec_id"), 0).alias("fold"),
    )
    return K.standardize_vectors(v, v, "vec")


@query(
    "knn_classifier",
    f"""WITH {_near_sql(7, L2)}, w AS (SELECT row_id, label AS class, sum(1 / dist) AS w FROM near GROUP BY 1, 2)
        SELECT row_id, class, round(w / sum(w) OVER (PARTITION BY row_id), 6) AS p FROM w""",
)
def knn_classifier(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    near = K.nearest_neighbours(v, v, 7, metric="l2", group="fold", label="label")
    return K.knn_classifier(near, "distance").withColumn("p", F.round("p", 6))


@query("knn_regressor", f"WITH {_near_sql(5, L1)} SELECT row_id, round(avg(label), 6) AS p FROM near GROUP BY 1")
def knn_regressor(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    near = K.nearest_neighbours(v, v, 5, metric="l1", group="fold", label="label")
    return K.knn_regressor(near, "uniform").withColumn("p", F.round("p", 6))


# --- fits on line items ---------------------------------------------------------------------

NUM = ["q", "d", "tax"]


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with numeric features, a price and coded return flags."""
    code = F.when(F.col("flag") == "R", 1.0).otherwise(0.0)
    three = F.array_position(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("flag")) - 1
    return stored(items(spark, sf).withColumns({"is_r": code, "flag3": three.cast("double")}), "items")


def _holdout_predictions(spark, sf, spec: M.Spec, target: str, classes: int = 0) -> DataFrame:
    """Fit on nine folds of the first repeat, predict all rows; ``held`` marks those of the tenth."""
    rows = _rows(spark, sf).withColumn("held", fold_of(F.col("row_id"), 0) == 0)
    model = M.fit(spec, rows.where("not held"), NUM, target, classes, "row_id")
    out = model.predict(rows)
    return out.select("row_id", "held", F.col(target).alias("y"), "p" if classes == 0 else "probs")


def _fit_query(name: str, kind: str, params: dict, target: str, classes: int = 0, score: str = "rmse") -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _holdout_predictions(spark, sf, M.Spec(kind, params, score), target, classes)

    query(name)(run)


_fit_query("gbt_classifier", "gbt", {"maxIter": 5, "maxDepth": 3, "early_stop": True}, "is_r", 2)
_fit_query("gbt_classifier_multiclass", "gbt", {"maxIter": 3, "maxDepth": 3}, "flag3", 3)
_fit_query("gbt_regressor", "gbt", {"maxIter": 8, "maxDepth": 3, "stepSize": 0.3}, "price")
_fit_query("gbt_regressor_absolute", "gbt", {"maxIter": 4, "maxDepth": 3}, "price", score="mae")
_fit_query("gbt_regressor_log", "gbt", {"maxIter": 4, "maxDepth": 3}, "price", score="rmsle")
_fit_query("rf_classifier", "rf", {"numTrees": 8, "maxDepth": 4}, "flag3", 3)
_fit_query("rf_regressor", "rf", {"numTrees": 8, "maxDepth": 5}, "price")
_fit_query("kernel_svm_classifier", "kernel_svm", {"components": 16, "gamma": 0.2, "maxIter": 10}, "is_r", 2)
_fit_query("kernel_svm_regressor", "kernel_svm", {"components": 16, "gamma": 0.2, "maxIter": 20}, "price")
_fit_query("spline_mlp_classifier", "spline", {"knots": 5, "hidden": (8,), "maxIter": 15}, "flag3", 3)

# --- the spline fit in SQL: basis, correlations, and Gauss-Jordan elimination row by row ---------

KNOTS = 5


def _bump_sql(t: str, j: int) -> str:
    u = f"({t} - {float(j - 3)})"
    v, w, z = f"({u} - 1)", f"({u} - 2)", f"(4 - {u})"
    cube = lambda e: f"{e} * {e} * {e}"
    return f"""CAST(CASE WHEN {u} < 0 OR {u} > 4 THEN 0 WHEN {u} < 1 THEN {cube(u)} / 6
      WHEN {u} < 2 THEN (-3 * {cube(v)} + 3 * {v} * {v} + 3 * {v} + 1) / 6
      WHEN {u} < 3 THEN (3 * {cube(w)} - 6 * {w} * {w} + 4) / 6 ELSE {cube(z)} / 6 END AS DOUBLE)"""


def _spline_sql() -> str:
    places = [(c, j) for c in NUM for j in range(KNOTS + 2)]
    names = [f"x{i + 1}" for i in range(len(places))]
    n = len(names)
    ends = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}, (max({c}) - min({c})) / {KNOTS - 1}.0::DOUBLE AS step_{c}" for c in NUM)
    at = ", ".join(f"(least(greatest({c}, lo_{c}), hi_{c}) - lo_{c}) / step_{c} AS t_{c}" for c in NUM)
    basis = ", ".join(f"{_bump_sql('t_' + c, j)} AS {x}" for x, (c, j) in zip(names, places))
    means = ", ".join(f"avg({x}) AS m_{x}" for x in [*names, "price"])
    devs = ", ".join(f"sqrt(avg(({x} - m_{x}) * ({x} - m_{x}))) AS s_{x}" for x in [*names, "price"])

    def cell(a: str, b: str) -> str:
        r = f"avg(({a} - m_{a}) * ({b} - m_{b})) / (any_value(s_{a}) * any_value(s_{b}))"
        return r + (" + 0.01 / any_value(s_price)" if a == b else "")

    rows = ", ".join("[" + ", ".join(cell(a, b) for b in [*names, "price"]) + "]" for a in names)
    fit = " + ".join(f"w[{i + 1}] * ({x} - m_{x}) / s_{x}" for i, x in enumerate(names))
    return f"""WITH RECURSIVE {ITEMS_SQL}, r AS (SELECT row_id, price, q, d, tax, {sql_mod(10, "row_id || '_0'")} = 0 AS held FROM items),
      ends AS (SELECT {ends} FROM r WHERE NOT held), t AS (SELECT row_id, held, price, {at} FROM r, ends),
      x AS (SELECT row_id, held, price, {basis} FROM t),
      m AS (SELECT {means} FROM x WHERE NOT held), s AS (SELECT {devs} FROM x, m WHERE NOT held),
      a AS (SELECT [{rows}] AS a FROM x, m, s WHERE NOT held),
      g AS (SELECT 0 AS k, unnest(range(1, {n + 1})) AS i, unnest(a) AS row FROM a
        UNION ALL SELECT k + 1, i, CASE WHEN i = k + 1 THEN p ELSE list_transform(list_zip(row, p), lambda e: e[1] - row[k + 1] * e[2]) END
        FROM (SELECT k, i, row, list_transform(p, lambda e: e / p[k + 1]) AS p FROM
          (SELECT k, i, row, max(CASE WHEN i = k + 1 THEN row END) OVER () AS p FROM g) WHERE k < {n})),
      w AS (SELECT list(row[{n + 1}] ORDER BY i) AS w FROM g WHERE k = {n})
      SELECT row_id, held, price AS y, round(m_price + s_price * ({fit}), 2) AS p FROM x, m, s, w"""


@query("spline_regressor", _spline_sql())
def spline_regressor(spark: SparkSession, sf: str) -> DataFrame:
    out = _holdout_predictions(spark, sf, M.Spec("spline", {"knots": KNOTS}, "rmse"), "price")
    return out.withColumn("p", F.round("p", 2))


@query("multi_target_regressor")
def multi_target_regressor(spark: SparkSession, sf: str) -> DataFrame:
    """Quality and toxicity of the labelled documents from their length and language."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", (F.col("lang") == "en").cast("double").alias("en"))
    rows = table(spark, sf, "labels").join(docs, "doc_id")
    models = M.fit_targets(M.Spec("gbt", {"maxIter": 4, "maxDepth": 3}), rows, ["n_chars", "en"], ["quality", "toxic"])
    return M.predict_targets(models, rows).select("doc_id", "p_quality", "p_toxic")


def _kept(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "feature string")


@query("l1_selector")
def l1_selector(spark: SparkSession, sf: str) -> DataFrame:
    return _kept(spark, M.l1_selector(_rows(spark, sf), NUM, "is_r", c=0.01))


@query("rf_selector")
def rf_selector(spark: SparkSession, sf: str) -> DataFrame:
    return _kept(spark, M.rf_selector(_rows(spark, sf), NUM + ["price"], "is_r", removed=2, trees=5, depth=4))


# --- model imputers -------------------------------------------------------------------------


@query("impute_num_model")
def impute_num_model(spark: SparkSession, sf: str) -> DataFrame:
    kit = order_kit(spark, sf)
    out = I.impute_num_model(kit, "balance", ["balance", "nationkey"], ["priority", "segment"], trees=5, depth=3)
    return out.both().select("id", "balance")


@query("impute_cat_model")
def impute_cat_model(spark: SparkSession, sf: str) -> DataFrame:
    kit = order_kit(spark, sf)
    out = I.impute_cat_model(kit, "priority", ["balance", "nationkey"], ["priority", "segment"], trees=5, depth=4)
    return out.both().select("id", "priority")


# --- training, search and race ---------------------------------------------------------------

SPACE = H.Space(
    [H.Dim("maxDepth", (2, 3, 4), 3), H.Dim("maxIter", (2, 3), 2), H.Dim("stepSize", (0.1, 0.3, 0.5), 0.3)]
)


def _spec(v: dict) -> M.Spec:
    return M.Spec("gbt", dict(v), "rmse")


def _forest(v: dict) -> M.Spec:
    return M.Spec("rf", {"numTrees": 3, **v}, "rmse")


def _task(spark: SparkSession, sf: str) -> T.Task:
    """Order prices from customer attributes, prepared by the chain."""
    kit = order_kit(spark, sf)
    kit = kit.replace(kit.train.drop("status", "ordered"), kit.test.drop("status", "ordered"))
    return R.make_task(R.preprocess_chain(kit))


def _store(spark: SparkSession) -> T.Store:
    return T.Store(spark, work_dir(spark, "results"))


def _predictions(store: T.Store) -> DataFrame:
    """Everything the store holds, a row per submission, fold, split and row."""
    return store.read("predictions", T.predictions_schema()).drop("class", "target")


@query("train_folds")
def train_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out and test predictions of two submissions on two folds."""
    store = _store(spark)
    specs = {"a": _spec({"maxIter": 2, "maxDepth": 2}), "b": M.Spec("spline", {"knots": 3}, "rmse")}
    T.train_folds(store, _task(spark, sf), specs, [0, 1])
    return _predictions(store)


@query("retrain_full")
def retrain_full(spark: SparkSession, sf: str) -> DataFrame:
    return T.retrain_full(_task(spark, sf), _spec({"maxIter": 3, "maxDepth": 3}))


@query("search")
def search(spark: SparkSession, sf: str) -> DataFrame:
    drawn = H.random_trials(spark, SPACE, 3, seed=5).collect()
    specs = {f"gbt_hyperopt_{r['hash']}": _spec(SPACE.decode(r["indices"])) for r in drawn}
    store = _store(spark)
    _, best = T.search(store, _task(spark, sf), specs, [0, 1])
    return _predictions(store).withColumn("best", F.col("submission") == best)


@query("select_and_train")
def select_and_train_query(spark: SparkSession, sf: str) -> DataFrame:
    """Two settings on one fold; the better one goes on to a second."""
    store, task = _store(spark), _task(spark, sf)
    specs = {"deep": _forest({"maxDepth": 5}), "flat": _forest({"maxDepth": 1})}
    T.train_folds(store, task, specs, [0])
    select_and_train(store, task, specs, [0], [0, 1], top_n=1)
    return _predictions(store)


@query("growing_folds")
def growing_folds(spark: SparkSession, sf: str) -> DataFrame:
    store, task = _store(spark), _task(spark, sf)
    specs = {"deep": _forest({"maxDepth": 5}), "flat": _forest({"maxDepth": 1})}
    names = grow_folds(store, task, specs, first=0, start=2, stop=3, top_n=1, n_sigma=1.0)
    return _predictions(store).withColumn("kept", F.col("submission").isin(names))


def _race(spark: SparkSession, sf: str) -> Race:
    bases = {
        "gbt": Base("gbt", SPACE, _spec),
        "rf": Base("rf", H.Space([H.Dim("maxDepth", (2, 4, 6), 4)]), _forest),
    }
    settings = RaceSettings(n_rounds=2, n_trials=2, n_search_folds=2, n_final_folds=3)
    return Race(_store(spark), _task(spark, sf), bases, settings)


@query("race")
def race(spark: SparkSession, sf: str) -> DataFrame:
    out = _race(spark, sf).go()
    parts = [df.select(F.lit(n).alias("output"), "row_id", "p") for n, df in sorted(out.items())]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


@query("arm_race")
def arm_race(spark: SparkSession, sf: str) -> DataFrame:
    """Known-good settings trained on the final folds, blended and bagged."""
    arms = table(spark, sf, "part").groupBy((F.col("p_size") % 2).alias("maxDepth_i")).agg(
        F.count(F.lit(1)).alias("contributivity")
    )
    _, out = run_arms(_race(spark, sf), arms, "rf")
    return out.select("row_id", "p")


@query("setup_and_start")
def setup_and_start_query(spark: SparkSession, sf: str) -> DataFrame:
    """Raw kit to a first boosted model on three folds."""
    kit = order_kit(spark, sf)
    kit = Kit(kit.train.drop("status"), kit.test.drop("status", "price"), kit.meta)
    kit.meta.roles.pop("place")
    kit = Kit(kit.train.drop("place"), kit.test.drop("place"), kit.meta)
    spec = M.Spec("gbt", {"maxIter": 2, "maxDepth": 3}, "rmse")
    store = _store(spark)
    setup_and_start(kit, store, spec=spec)
    return _predictions(store)


