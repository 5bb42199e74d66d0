"""Scores by submission and fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.catalog.registry import query
from tabloom.catalog.views import (
    ITEMS_SQL,
    KIT_SQL,
    LABEL_SQL,
    PRED_SQL,
    SHARE_SQL,
    items,
    kept_price_preds,
    label_preds,
    order_kit,
    price_preds,
    share_preds,
    sql_mod,
    table,
)
from tabloom.functions.joins import attach
from tabloom.operators import impute as I
from tabloom.operators import scores as S
from tabloom.operators.folds import fold_of, repeated_kfold
from tabloom.plans.prepare import stored_kit

EPS = "1e-15::DOUBLE"
LL = f"avg(ln(least(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, {EPS}), 1 - {EPS})))"

PRICE_SCORES = {
    "rmse": "sqrt(avg((y - p) * (y - p)))",
    "mae": "avg(abs(y - p))",
    "mare": "avg(abs(y - p) / abs(y))",
    "rmsle": "sqrt(avg(power(ln(1 + y) - ln(1 + p), 2)))",
    "medae": "median(abs(y - p))",
    "smape": "avg(2 * abs(y - p) / (abs(y) + abs(p)))",
    "r2": "1 - avg((y - p) * (y - p)) / var_pop(y)",
}


def _register(name: str, metric: str, preds, sql: str, kept: bool = False) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return S.score(preds(spark, sf), metric, digits=4, kept=kept)

    query(name, sql)(run)


for _name, _expr in PRICE_SCORES.items():
    _register(
        f"score_{_name}", _name, price_preds,
        f"WITH {PRED_SQL} SELECT submission, fold, round({_expr}, 4) AS score FROM preds GROUP BY 1, 2",
    )
_register("score_nll", "nll", share_preds, f"WITH {SHARE_SQL} SELECT submission, fold, round(-{LL}, 4) AS score FROM preds GROUP BY 1, 2")
_register("score_loglik", "loglik", share_preds, f"WITH {SHARE_SQL} SELECT submission, fold, round({LL}, 4) AS score FROM preds GROUP BY 1, 2")

AUC_SQL = f"""WITH {SHARE_SQL},
  h AS (SELECT submission, fold, p, sum(y) AS pos, count(*) - sum(y) AS neg FROM preds GROUP BY 1, 2, 3),
  c AS (SELECT *, sum(neg) OVER (PARTITION BY submission, fold ORDER BY p) - neg / 2.0::DOUBLE AS below FROM h),
  auc AS (SELECT submission, fold, sum(pos * below) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS a FROM c GROUP BY 1, 2)"""
_register("score_auc", "auc", share_preds, f"{AUC_SQL} SELECT submission, fold, round(a, 4) AS score FROM auc")
_register("score_gini", "gini", share_preds, f"{AUC_SQL} SELECT submission, fold, round(2 * a - 1, 4) AS score FROM auc")


def _area_sql(name: str, by: str) -> str:
    return f"""{name}_h AS (SELECT submission, fold, {by} AS v, count(*) AS n, sum(y) AS s FROM preds GROUP BY 1, 2, 3),
    {name}_c AS (SELECT *, sum(s) OVER (PARTITION BY submission, fold ORDER BY v DESC) AS cum FROM {name}_h),
    {name} AS (SELECT submission, fold, sum(n * (cum - s / 2)) / (sum(n) * sum(s)) - 0.5::DOUBLE AS area FROM {name}_c GROUP BY 1, 2)"""


_register(
    "score_ngini", "ngini", kept_price_preds,
    f"WITH {PRED_SQL}, {_area_sql('got', 'p')}, {_area_sql('best', 'y')} SELECT submission, fold, round(got.area / best.area, 4) AS score FROM got JOIN best USING (submission, fold)",
    kept=True,
)
HITS = f"WITH {LABEL_SQL} SELECT submission, fold, round(avg(CASE WHEN y = p THEN 1.0::DOUBLE ELSE 0 END), 4) AS score FROM preds GROUP BY 1, 2"
_register("score_accuracy", "accuracy", label_preds, HITS)
_register(
    "score_f1_micro", "f1-micro", label_preds,
    f"""WITH {LABEL_SQL}, c AS (SELECT unnest(['A', 'N', 'R']) AS c),
      n AS (SELECT submission, fold, c, count(*) FILTER (y = c AND p = c) AS tp, count(*) FILTER (y <> c AND p = c) AS fp,
                   count(*) FILTER (y = c AND p <> c) AS fn FROM preds, c GROUP BY 1, 2, 3)
      SELECT submission, fold, round(2.0::DOUBLE * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 4) AS score FROM n GROUP BY 1, 2""",
)


@query(
    "score_mcc",
    f"""WITH {LABEL_SQL}, n AS (SELECT submission, fold,
          CAST(count(*) FILTER (y = 'R' AND p = 'R') AS DOUBLE) AS tp, CAST(count(*) FILTER (y <> 'R' AND p <> 'R') AS DOUBLE) AS tn,
          CAST(count(*) FILTER (y <> 'R' AND p = 'R') AS DOUBLE) AS fp, CAST(count(*) FILTER (y = 'R' AND p <> 'R') AS DOUBLE) AS fn
          FROM preds GROUP BY 1, 2)
        SELECT submission, fold, round(coalesce((tp * tn - fp * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0), 4) AS score FROM n""",
)
def score_mcc(spark: SparkSession, sf: str) -> DataFrame:
    is_r = lambda c: (F.col(c) == "R").cast("int")
    binary = label_preds(spark, sf).withColumns({"y": is_r("y"), "p": is_r("p")})
    return S.score(binary, "mcc", digits=4)


@query(
    "score_mcc_classes",
    f"""WITH {LABEL_SQL}, n AS (SELECT submission, fold, count(*) AS s, count(*) FILTER (y = p) AS c FROM preds GROUP BY 1, 2),
        k AS (SELECT submission, fold, l, count(*) FILTER (y = l) AS t, count(*) FILTER (p = l) AS g
              FROM preds, (SELECT unnest(['A', 'N', 'R']) AS l) GROUP BY 1, 2, 3),
        x AS (SELECT submission, fold, sum(t * g) AS tg, sum(t * t) AS tt, sum(g * g) AS gg FROM k GROUP BY 1, 2)
        SELECT submission, fold, round(CAST(c * s - tg AS DOUBLE) / (sqrt(CAST(s * s - gg AS DOUBLE)) * sqrt(CAST(s * s - tt AS DOUBLE))), 4) AS score
        FROM n JOIN x USING (submission, fold)""",
)
def score_mcc_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Three labels at once."""
    return S.score(label_preds(spark, sf), "mcc", digits=4)


@query(
    "score_rmsle_holes",
    f"""WITH {PRED_SQL}, bad AS (SELECT submission, fold, y, CASE WHEN row_id % 7 = 0 THEN -5 ELSE p END AS p,
          (fold = 3 AND row_id % 5 = 0) OR (fold = 5 AND row_id % 11 = 0) AS hole FROM preds)
        SELECT submission, fold, CASE WHEN count(*) FILTER (hole) = 0 THEN round(sqrt(avg(power(ln(1 + y) - ln(1 + greatest(p, 0)), 2))), 4) END AS score
        FROM bad GROUP BY 1, 2""",
)
def score_rmsle_holes(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions below zero count as zero; a fold that lacks some, or has a target below -1, has no score."""
    hole = (F.col("fold") == 3) & (F.col("row_id") % 5 == 0)
    low = (F.col("fold") == 5) & (F.col("row_id") % 11 == 0)
    p = F.when(F.col("row_id") % 7 == 0, F.lit(-5.0)).otherwise(F.col("p"))
    preds = price_preds(spark, sf).withColumns({"p": F.when(~hole, p), "y": F.when(low, F.lit(-2.0)).otherwise(F.col("y"))})
    return S.score(preds, "rmsle", digits=4)


@query(
    "score_nll_multiclass",
    f"""WITH {ITEMS_SQL} SELECT 'q' AS submission, {sql_mod(10, "row_id || '_0'")} AS fold,
        CASE WHEN {sql_mod(10, "row_id || '_0'")} <> 4 OR count(*) FILTER (row_id % 9 = 0) = 0 THEN
          round(-avg(ln(CASE flag WHEN 'A' THEN 0.1 + q / 100 WHEN 'N' THEN 0.3 ELSE 0.6 - q / 100 END)), 4) END AS score FROM items GROUP BY 2""",
)
def score_nll_multiclass(spark: SparkSession, sf: str) -> DataFrame:
    """In fold 4 some rows lack their true class, so it has no score."""
    probs = F.create_map(
        F.lit("A"), 0.1 + F.col("q") / 100, F.lit("N"), F.lit(0.3), F.lit("R"), F.lit(0.6) - F.col("q") / 100
    )
    long = items(spark, sf).select(
        F.lit("q").alias("submission"), fold_of(F.col("row_id"), 0).alias("fold"), "row_id", F.col("flag").alias("y"),
        F.explode(probs).alias("class", "p"),
    )
    long = long.where((F.col("fold") != 4) | (F.col("row_id") % 9 != 0) | (F.col("y") != F.col("class")))
    return S.multiclass_nll(long).withColumn("score", F.round("score", 4))


@query(
    "score_combined",
    f"""WITH t AS (SELECT doc_id, {sql_mod(10, "doc_id || '_0'")} AS fold, quality, toxic, least(n_chars / 4000.0::DOUBLE, 0.95::DOUBLE) + 0.02::DOUBLE AS p FROM labels JOIN documents USING (doc_id)),
        e AS (SELECT fold, sqrt(avg((quality - p) * (quality - p))) AS a, sqrt(avg((toxic - p) * (toxic - p))) AS b FROM t GROUP BY 1)
        SELECT 'length' AS submission, fold, round((a + b) / 2, 4) AS score FROM e""",
)
def score_combined(spark: SparkSession, sf: str) -> DataFrame:
    """Two targets of the labelled documents, one prediction."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    rows = table(spark, sf, "labels").join(docs, "doc_id")
    p = F.least(F.col("n_chars") / 4000.0, F.lit(0.95)) + 0.02
    long = rows.withColumn("p", p).withColumn("fold", fold_of(F.col("doc_id"), 0)).unpivot(
        ["fold", "p"], ["quality", "toxic"], "target", "y"
    )
    return S.combined(long.withColumn("submission", F.lit("length")), "rmse").withColumn("score", F.round("score", 4))


@query(
    "score_table",
    f"WITH {PRED_SQL}, w AS (SELECT submission, fold, {', '.join(f'{e} AS {n}' for n, e in PRICE_SCORES.items())} FROM preds GROUP BY 1, 2) "
    + " UNION ALL ".join(f"SELECT submission, fold, '{n}' AS score_name, round({n}, 4) AS score FROM w" for n in PRICE_SCORES),
)
def score_table(spark: SparkSession, sf: str) -> DataFrame:
    out = S.score_table(price_preds(spark, sf), list(PRICE_SCORES))
    return out.withColumn("score", F.round("score", 4))


# --- the flagship: fold scores of a group-mean predictor ---------------------------------


@query(
    "group_mean_cv",
    f"""WITH {KIT_SQL},
        mode AS (SELECT priority FROM kit WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, priority LIMIT 1),
        rows AS (SELECT id, price, coalesce(train.priority, (SELECT priority FROM mode)) AS priority, segment FROM train),
        f AS (SELECT rows.*, CAST(r * 10 + {sql_mod(10, "id || '_' || r")} AS INTEGER) AS fold, r FROM rows, (SELECT unnest([0, 1, 2]) AS r)),
        own AS (SELECT priority, segment, r, fold, sum(price) AS s, count(*) AS n FROM f GROUP BY 1, 2, 3, 4),
        tot AS (SELECT priority, segment, r, sum(s) AS st, sum(n) AS nt FROM own GROUP BY 1, 2, 3),
        code AS (SELECT own.priority, own.segment, fold, (st - s) / (nt - n) AS p FROM own JOIN tot USING (priority, segment, r))
        SELECT fold, count(*) AS n_valid, round(sqrt(avg((price - p) * (price - p))), 4) AS score
        FROM f JOIN code USING (priority, segment, fold) GROUP BY 1""",
)
def group_mean_cv(spark: SparkSession, sf: str) -> DataFrame:
    """Impute, fold three times, predict by the group mean of the other folds, score.

    A fold's training mean is the group's total minus its own fold's, so one
    small table serves all thirty folds.
    """
    cut = ["id", "price", "priority", "segment"]
    kit = order_kit(spark, sf)
    kit = stored_kit(kit.replace(kit.train.select(*cut), kit.test.select(*cut)))
    rows = I.impute_mode(kit, ["priority"]).train
    folded = repeated_kfold(rows, "id").withColumn("r", F.floor(F.col("fold") / 10))
    own = folded.groupBy("priority", "segment", "r", "fold").agg(F.sum("price").alias("s"), F.count(F.lit(1)).alias("n"))
    tot = own.groupBy("priority", "segment", "r").agg(F.sum("s").alias("st"), F.sum("n").alias("nt"))
    code = own.join(tot, ["priority", "segment", "r"]).select(
        "priority", "segment", "fold", F.try_divide(F.col("st") - F.col("s"), F.col("nt") - F.col("n")).alias("p"), "n"
    )
    scored = attach(folded, code, ["priority", "segment", "fold"], "inner", weight="n")
    return scored.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_valid"),
        F.round(F.sqrt(F.avg((F.col("price") - F.col("p")) * (F.col("price") - F.col("p")))), 4).alias("score"),
    )
