"""Tree fits and training plans in settings whose result SQL can state.

One tree of depth one on a single 0/1 feature predicts the mean, or the class
shares, of the training rows with the same feature value; depth zero predicts
those of all training rows. Every fold is held out once and predicted. The same
operators in their real settings are in ``catalog.learned``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.catalog.registry import query
from tabloom.catalog.views import ITEMS_SQL, items, sql_mod, table
from tabloom.operators import models as M
from tabloom.operators import space as H
from tabloom.operators import training as T
from tabloom.operators.folds import fold_of
from tabloom.plans.race import grow_folds, select_and_train
from tabloom.session import stored, work_dir

FOLDS = 10
FOLD = sql_mod(FOLDS, "row_id || '_0'")
ROWS_SQL = f"""{ITEMS_SQL}, r AS (
  SELECT row_id, price, CAST(q > 25 AS INTEGER) AS big, CASE WHEN flag = 'R' THEN 1 ELSE 0 END AS is_r,
         list_position(['A', 'N', 'R'], flag) - 1 AS flag3, {FOLD} AS fold FROM items)"""


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    three = F.array_position(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("flag")) - 1
    return stored(
        items(spark, sf).select(
            "row_id", "price", (F.col("q") > 25).cast("double").alias("big"),
            (F.col("flag") == "R").cast("double").alias("is_r"), three.cast("double").alias("flag3"),
            fold_of(F.col("row_id"), 0).alias("fold"),
        ),
        "rows",
    )


def _all_folds(spark: SparkSession, sf: str, spec: M.Spec, target: str, classes: int = 0) -> DataFrame:
    """Every fold predicted by a fit on the other nine."""
    rows = _rows(spark, sf)
    parts = []
    for f in range(FOLDS):
        model = M.fit(spec, rows.where(F.col("fold") != f), ["big"], target, classes, "row_id")
        parts.append(model.predict(rows.where(F.col("fold") == f)))
    return reduce(DataFrame.unionByName, parts)


def _others_sql(value: str) -> str:
    """``s(big, fold, v, n)``: sums of a value over the rows of the other folds."""
    return f"""c AS (SELECT big, fold, sum({value}) AS v, count(*) AS n FROM r GROUP BY 1, 2),
        s AS (SELECT a.big, f.fold, sum(a.v) AS v, sum(a.n) AS n FROM c a JOIN (SELECT DISTINCT fold FROM r) f ON a.fold <> f.fold GROUP BY 1, 2)"""


TREE = {"numTrees": 1, "maxDepth": 1, "bootstrap": False}
STUMP = {"maxIter": 1, "maxDepth": 1}
MEAN_SQL = f"""WITH {ROWS_SQL}, {_others_sql('price')}
        SELECT row_id, round(v / n, 4) AS p FROM r JOIN s USING (big, fold)"""


@query("rf_regressor_exact", MEAN_SQL)
def rf_regressor(spark: SparkSession, sf: str) -> DataFrame:
    out = _all_folds(spark, sf, M.Spec("rf", TREE), "price")
    return out.select("row_id", F.round("p", 4).alias("p"))


@query("gbt_regressor_exact", MEAN_SQL)
def gbt_regressor(spark: SparkSession, sf: str) -> DataFrame:
    out = _all_folds(spark, sf, M.Spec("gbt", STUMP), "price")
    return out.select("row_id", F.round("p", 4).alias("p"))


@query(
    "rf_classifier_exact",
    f"""WITH {ROWS_SQL}, c AS (SELECT big, fold, flag3, count(*) AS n FROM r GROUP BY 1, 2, 3),
        s AS (SELECT a.big, f.fold, flag3, sum(a.n) AS n FROM c a JOIN (SELECT DISTINCT fold FROM r) f ON a.fold <> f.fold GROUP BY 1, 2, 3),
        top AS (SELECT fold, count(DISTINCT c) AS tops FROM (SELECT big, fold, arg_max(flag3, n) AS c FROM s GROUP BY 1, 2) GROUP BY 1),
        p AS (SELECT big, fold, flag3, CASE WHEN tops > 1 THEN n / sum(n) OVER (PARTITION BY big, fold)
                ELSE sum(n) OVER (PARTITION BY flag3, fold) / sum(n) OVER (PARTITION BY fold) END AS p FROM s JOIN top USING (fold))
        SELECT row_id, CAST(p.flag3 AS INTEGER) AS class, round(p, 6) AS p FROM r JOIN p USING (big, fold)""",
)
def rf_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves with one most frequent class are joined into their parent."""
    out = _all_folds(spark, sf, M.Spec("rf", TREE), "flag3", 3)
    return out.select("row_id", F.posexplode("probs").alias("class", "p")).withColumn("p", F.round("p", 6))


@query(
    "gbt_classifier_exact",
    f"""WITH {ROWS_SQL}, {_others_sql('2 * is_r - 1')}
        SELECT row_id, round(1 / (1 + exp(-2 * CAST(v AS DOUBLE) / n)), 6) AS p FROM r JOIN s USING (big, fold)""",
)
def gbt_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """One boosting step: the leaf mean of the labels -1 and 1 on the logistic scale."""
    out = _all_folds(spark, sf, M.Spec("gbt", STUMP), "is_r", 2)
    return out.select("row_id", F.round(F.col("probs")[1], 6).alias("p"))


@query(
    "multi_target_regressor_exact",
    """WITH t AS (SELECT doc_id, lang = 'en' AS en, quality, toxic FROM labels JOIN documents USING (doc_id))
        SELECT doc_id, round(avg(quality) OVER (PARTITION BY en), 6) AS p_quality, round(avg(toxic) OVER (PARTITION BY en), 6) AS p_toxic FROM t""",
)
def multi_target_regressor(spark: SparkSession, sf: str) -> DataFrame:
    """Quality and toxicity of the labelled documents from whether they are English."""
    docs = table(spark, sf, "documents").select("doc_id", (F.col("lang") == "en").cast("double").alias("en"))
    rows = table(spark, sf, "labels").join(docs, "doc_id")
    models = M.fit_targets(M.Spec("gbt", STUMP), rows, ["en"], ["quality", "toxic"])
    out = M.predict_targets(models, rows)
    return out.select("doc_id", F.round("p_quality", 6).alias("p_quality"), F.round("p_toxic", 6).alias("p_toxic"))


# --- training plans ---------------------------------------------------------------------

# held-out errors of the mean of all and of the mean by feature, and test rows apart
PLAN_SQL = f"""{ROWS_SQL}, t AS (SELECT * FROM r WHERE row_id % 4 <> 0), test AS (SELECT * FROM r WHERE row_id % 4 = 0),
  c AS (SELECT big, fold, sum(price) AS v, count(*) AS n FROM t GROUP BY 1, 2),
  one AS (SELECT a.big, f.fold, sum(a.v) / sum(a.n) AS p FROM c a JOIN (SELECT DISTINCT fold FROM t) f ON a.fold <> f.fold GROUP BY 1, 2),
  zero AS (SELECT f.fold, sum(a.v) / sum(a.n) AS p FROM c a JOIN (SELECT DISTINCT fold FROM t) f ON a.fold <> f.fold GROUP BY 1),
  e AS (SELECT 1 AS depth, fold, sqrt(avg(power(price - p, 2))) AS value, count(*) AS n_rows FROM t JOIN one USING (big, fold) GROUP BY 2
        UNION ALL SELECT 0, fold, sqrt(avg(power(price - p, 2))), count(*) FROM t JOIN zero USING (fold) GROUP BY 2)"""


def _tree(v: dict) -> M.Spec:
    return M.Spec("rf", {"numTrees": 1, "bootstrap": False, **v})


def _task(spark: SparkSession, sf: str) -> T.Task:
    rows = _rows(spark, sf).select("row_id", "price", "big")
    return T.Task(rows.where("row_id % 4 <> 0"), rows.where("row_id % 4 = 0"), "row_id", "price", ["big"], "rmse")


def _store(spark: SparkSession) -> T.Store:
    return T.Store(spark, work_dir(spark, "results"))


DEPTHS = {"flat": 0, "deep": 1}


def _specs() -> dict[str, M.Spec]:
    return {n: _tree({"maxDepth": d}) for n, d in DEPTHS.items()}


def _valid(store: T.Store) -> DataFrame:
    rows = store.scores().where("step = 'valid'")
    return rows.select("submission", "fold", F.round("value", 4).alias("value"), "n_rows")


@query(
    "train_folds_exact",
    f"""WITH {PLAN_SQL} SELECT CASE depth WHEN 0 THEN 'flat' ELSE 'deep' END AS submission, CAST(fold AS INTEGER) AS fold, round(value, 4) AS value, n_rows
        FROM e WHERE fold < 3""",
)
def train_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of two submissions on three folds."""
    store = _store(spark)
    T.train_folds(store, _task(spark, sf), _specs(), [0, 1, 2])
    return _valid(store)


@query(
    "train_folds_predictions_exact",
    f"""WITH {PLAN_SQL} SELECT 'valid' AS split, row_id, round(p, 4) AS p FROM t JOIN one USING (big, fold) WHERE fold = 1
        UNION ALL SELECT 'test', row_id, round(p, 4) FROM test JOIN one USING (big) WHERE one.fold = 1""",
)
def train_folds_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Stored predictions of one submission and fold."""
    store = _store(spark)
    T.train_folds(store, _task(spark, sf), {"deep": _tree({"maxDepth": 1})}, [1])
    rows = store.read("predictions", T.predictions_schema()).where("split <> 'train'")
    return rows.select("split", "row_id", F.round("p", 4).alias("p"))


@query(
    "retrain_full_exact",
    f"""WITH {PLAN_SQL}, m AS (SELECT big, avg(price) AS p FROM t GROUP BY 1) SELECT row_id, round(p, 4) AS p FROM test JOIN m USING (big)""",
)
def retrain_full(spark: SparkSession, sf: str) -> DataFrame:
    return T.retrain_full(_task(spark, sf), _tree({"maxDepth": 1})).withColumn("p", F.round("p", 4))


SPACE = H.Space([H.Dim("maxDepth", (0, 1), 0)])


@query(
    "search_exact",
    f"""WITH {PLAN_SQL}, m AS (SELECT 'tree_hyperopt_' || substr(sha256(CAST(depth AS VARCHAR)), 1, 10) AS submission, avg(value) AS value FROM e WHERE fold < 2 GROUP BY 1)
        SELECT submission, round(value, 4) AS mean_valid, value = min(value) OVER () AS best FROM m""",
)
def search(spark: SparkSession, sf: str) -> DataFrame:
    """Both settings of a one-dimensional space, and which is best."""
    drawn = H.random_trials(spark, SPACE, 2, seed=5).collect()
    specs = {f"tree_hyperopt_{r['hash']}": _tree(SPACE.decode(r["indices"])) for r in drawn}
    means, best = T.search(_store(spark), _task(spark, sf), specs, [0, 1])
    return means.select("submission", F.round("mean_valid", 4).alias("mean_valid"), (F.col("submission") == best).alias("best"))


@query(
    "select_and_train_exact",
    f"""WITH {PLAN_SQL}, b AS (SELECT arg_min(depth, value) AS depth FROM e WHERE fold = 0)
        SELECT CASE depth WHEN 0 THEN 'flat' ELSE 'deep' END AS submission, round(avg(value), 4) AS mean_valid FROM e JOIN b USING (depth) WHERE fold < 3 GROUP BY 1""",
)
def select_and_train_query(spark: SparkSession, sf: str) -> DataFrame:
    """Two submissions on one fold; the better one goes on to three."""
    store, task = _store(spark), _task(spark, sf)
    T.train_folds(store, task, _specs(), [0])
    out = select_and_train(store, task, _specs(), [0], [0, 1, 2], top_n=1)
    return out.withColumn("mean_valid", F.round("mean_valid", 4))


@query(
    "growing_folds_exact",
    f"""WITH {PLAN_SQL}, b AS (SELECT arg_min(depth, m) AS depth FROM (SELECT depth, avg(value) AS m FROM e WHERE fold < 2 GROUP BY 1))
        SELECT CASE depth WHEN 0 THEN 'flat' ELSE 'deep' END AS submission, CAST(fold AS INTEGER) AS fold, round(value, 4) AS value, n_rows
        FROM e LEFT JOIN b USING (depth) WHERE fold < 2 OR (fold = 2 AND depth IN (SELECT depth FROM b))""",
)
def growing_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Both submissions on two folds, the better one on a third."""
    store = _store(spark)
    grow_folds(store, _task(spark, sf), _specs(), first=0, start=2, stop=3, top_n=1, n_sigma=0.1)
    return _valid(store)
