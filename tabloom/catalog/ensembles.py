"""Bagging and blending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.catalog.registry import query
from tabloom.catalog.views import (
    PRED_SQL,
    PRICE_FORMULAS,
    REPEAT_SQL,
    SHARE_FORMULAS,
    SHARE_SQL,
    TRIALS_SQL,
    price_preds,
    repeated_preds,
    share_preds,
    trials,
)
from tabloom.operators import ensemble as B
from tabloom.operators import scores as S

WEIGHTS_SQL = """weights AS (
  SELECT submission, fold, CASE submission WHEN 'flat' THEN 0.2::DOUBLE WHEN 'slope' THEN 0.5::DOUBLE ELSE 0.1::DOUBLE * (fold % 3) END AS weight
  FROM (SELECT DISTINCT submission, fold FROM preds) WHERE submission <> 'flat' OR fold % 2 = 0)"""


def _weights(preds: DataFrame) -> DataFrame:
    """A fixed weight table over the submissions and folds present."""
    pairs = preds.select("submission", "fold").distinct()
    w = (
        F.when(F.col("submission") == "flat", 0.2)
        .when(F.col("submission") == "slope", 0.5)
        .otherwise(0.1 * (F.col("fold") % 3))
    )
    return pairs.withColumn("weight", w).where((F.col("submission") != "flat") | (F.col("fold") % 2 == 0))


@query("bag", f"WITH {REPEAT_SQL} SELECT submission, row_id, any_value(y) AS y, round(avg(p), 4) AS p FROM preds GROUP BY 1, 2")
def bag(spark: SparkSession, sf: str) -> DataFrame:
    return B.bag(repeated_preds(spark, sf)).withColumn("p", F.round("p", 4))


@query(
    "bag_ranks",
    f"""WITH {REPEAT_SQL}, r AS (SELECT submission, fold, row_id, y, rank() OVER (PARTITION BY submission, fold ORDER BY p) AS lo,
          count(*) OVER (PARTITION BY submission, fold, p) AS n, count(*) OVER (PARTITION BY submission, fold) AS size FROM preds)
        SELECT submission, row_id, any_value(y) AS y, round(avg((lo + n / 2.0::DOUBLE - 1) / size), 6) AS p FROM r GROUP BY 1, 2""",
)
def bag_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Folds differ in size, so ranks are shares of them."""
    return B.bag_ranks(repeated_preds(spark, sf)).withColumn("p", F.round("p", 6))


@query(
    "bagged_score",
    f"""WITH {REPEAT_SQL}, n AS (SELECT unnest(range(1, 31)) AS n_folds),
        b AS (SELECT submission, n_folds, row_id, any_value(y) AS y, avg(p) AS p FROM preds, n
              WHERE fold < n_folds GROUP BY 1, 2, 3)
        SELECT submission, n_folds, round(sqrt(avg((y - p) * (y - p))), 4) AS score FROM b GROUP BY 1, 2""",
)
def bagged_score(spark: SparkSession, sf: str) -> DataFrame:
    """The bag after each of thirty added folds."""
    out = B.bagged_scores(repeated_preds(spark, sf), "rmse", list(range(30)))
    return out.withColumns({"score": F.round("score", 4), "n_folds": F.col("n_folds").cast("long")})


@query(
    "blend_step",
    f"""WITH {PRED_SQL},
        base AS (SELECT fold, row_id, sum(CASE submission WHEN 'slope' THEN 2 * p WHEN 'steep' THEN p ELSE 0 END) AS s FROM preds GROUP BY 1, 2)
        SELECT fold, submission, round(sqrt(avg(power(y - (s + p) / 4, 2))), 4) AS score FROM preds JOIN base USING (fold, row_id) GROUP BY 1, 2""",
)
def blend_step(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the three candidates after three picks."""
    step = B.blend_step(price_preds(spark, sf), ["slope", "slope", "steep"], "rmse")
    return step.withColumn("score", F.round("score", 4))


@query(
    "blend_step_best",
    f"""WITH {PRED_SQL}, base AS (SELECT fold, row_id, sum(CASE submission WHEN 'slope' THEN p ELSE 0 END) AS s FROM preds GROUP BY 1, 2),
        sc AS (SELECT fold, submission, avg(abs(y - (s + p) / 2)) AS score FROM preds JOIN base USING (fold, row_id) GROUP BY 1, 2)
        SELECT fold, arg_min(submission, score) AS submission, round(min(score), 4) AS score FROM sc GROUP BY 1""",
)
def blend_step_best(spark: SparkSession, sf: str) -> DataFrame:
    step = B.blend_step(price_preds(spark, sf), ["slope"], "mae")
    return B.best_candidate(step, "mae").withColumn("score", F.round("score", 4))


def _walk_sql(err: str, n_folds: str) -> str:
    """Greedy selection as a recursive query over folds.

    ``err`` scores the counts (a, b, c) of three members in name order; a step
    is taken while the best candidate lowers it.
    """
    return f"""walk AS (
          SELECT fold, 0 AS t, 0 AS a, 0 AS b, 0 AS c, 'infinity'::DOUBLE AS err FROM folds
          UNION ALL
          SELECT fold, t, a, b, c, err FROM (
            SELECT *, row_number() OVER (PARTITION BY fold ORDER BY err, k) AS place FROM (
              SELECT w.fold, w.t + 1 AS t, w.a + m.a AS a, w.b + m.b AS b, w.c + m.c AS c, w.err AS old, m.k, {err} AS err
              FROM walk w JOIN g USING (fold), (VALUES (0, 1, 0, 0), (1, 0, 1, 0), (2, 0, 0, 1)) AS m(k, a, b, c)))
          WHERE place = 1 AND err < old - CASE WHEN isinf(old) THEN 0 ELSE 1e-9 * abs(old) END),
        last AS (SELECT fold, max(t) AS t, arg_max(a, t) AS a, arg_max(b, t) AS b, arg_max(c, t) AS c FROM walk GROUP BY fold),
        shares AS (SELECT fold, unnest([struct_pack(k := 0, n := a), struct_pack(k := 1, n := b), struct_pack(k := 2, n := c)], recursive := true), t FROM last),
        chosen AS (SELECT fold, k, n / CAST(t AS DOUBLE) AS weight, n / CAST(t AS DOUBLE) / {n_folds} AS contributivity FROM shares WHERE n > 0)"""


def _residual_sql(names: list[str], source: str) -> str:
    """Folds, and inner products of the residuals of three members."""
    part = ", ".join(f"max(p - y) FILTER (submission = '{n}') AS e{i}" for i, n in enumerate(names))
    cells = ", ".join(f"sum(e{i} * e{j}) AS r{i}{j}" for i in range(3) for j in range(i, 3))
    return f"""folds AS (SELECT DISTINCT fold FROM {source}),
        g AS (SELECT fold, {cells} FROM (SELECT fold, row_id, {part} FROM {source} GROUP BY 1, 2) GROUP BY fold)"""


_SQUARE = (
    "(r00 * (w.a + m.a) ** 2 + r11 * (w.b + m.b) ** 2 + r22 * (w.c + m.c) ** 2 + 2 * r01 * (w.a + m.a) * (w.b + m.b)"
    " + 2 * r02 * (w.a + m.a) * (w.c + m.c) + 2 * r12 * (w.b + m.b) * (w.c + m.c)) / (w.t + 1) ** 2"
)
_PRICE = sorted(PRICE_FORMULAS)
_SHARE = sorted(SHARE_FORMULAS)
_MIXES = 8  # steps that the query for the rank score can follow; its walks are shorter


def _named(names: list[str]) -> str:
    return f"[{', '.join(repr(n) for n in names)}][k + 1]"


@query(
    "blend",
    f"""WITH RECURSIVE {PRED_SQL}, {_residual_sql(_PRICE, 'preds')}, {_walk_sql(_SQUARE, '10')}
        SELECT CAST(fold AS INTEGER) AS fold, {_named(_PRICE)} AS submission, weight, contributivity FROM chosen""",
)
def blend(spark: SparkSession, sf: str) -> DataFrame:
    """Squared error: greedy choice on the Gram matrices of the folds."""
    return B.blend(price_preds(spark, sf), "rmse")


@query(
    "blend_by_jobs",
    f"""WITH RECURSIVE {SHARE_SQL}, folds AS (SELECT DISTINCT fold FROM preds),
        wide AS (SELECT fold, row_id, any_value(y) AS y, {', '.join(f"max(p) FILTER (submission = '{n}') AS p{i}" for i, n in enumerate(_SHARE))} FROM preds GROUP BY 1, 2),
        mixes AS (SELECT a, b, c FROM range({_MIXES + 1}) x(a), range({_MIXES + 1}) y(b), range({_MIXES + 1}) z(c) WHERE a + b + c BETWEEN 1 AND {_MIXES}),
        h AS (SELECT fold, a, b, c, (a * p0 + b * p1 + c * p2) / (a + b + c) AS v, sum(y) AS pos, count(*) - sum(y) AS neg FROM wide, mixes GROUP BY 1, 2, 3, 4, 5),
        u AS (SELECT *, sum(neg) OVER (PARTITION BY fold, a, b, c ORDER BY v) - neg / 2.0::DOUBLE AS below FROM h),
        auc AS (SELECT fold, a, b, c, -sum(pos * below) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS e FROM u GROUP BY 1, 2, 3, 4),
        g AS (SELECT fold, map_from_entries(list(struct_pack(k := a * 10000 + b * 100 + c, v := e))) AS es FROM auc GROUP BY fold),
        {_walk_sql("es[(w.a + m.a) * 10000 + (w.b + m.b) * 100 + w.c + m.c]", '10')}
        SELECT CAST(fold AS INTEGER) AS fold, {_named(_SHARE)} AS submission, weight, contributivity FROM chosen""",
)
def blend_by_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """A rank score: one scoring job per greedy step."""
    return B.blend(share_preds(spark, sf), "auc")


@query(
    "apply_blend",
    f"""WITH {PRED_SQL}, {WEIGHTS_SQL}
        SELECT fold, row_id, any_value(y) AS y, round(sum(weight * p) / sum(weight), 4) AS p FROM preds JOIN weights USING (submission, fold) GROUP BY 1, 2""",
)
def apply_blend(spark: SparkSession, sf: str) -> DataFrame:
    preds = price_preds(spark, sf)
    return B.apply_blend(preds, _weights(preds)).withColumn("p", F.round("p", 4))


@query(
    "blend_then_bag",
    f"""WITH {REPEAT_SQL}, {WEIGHTS_SQL},
        b AS (SELECT fold, row_id, any_value(y) AS y, sum(weight * p) / sum(weight) AS p FROM preds JOIN weights USING (submission, fold) GROUP BY 1, 2)
        SELECT row_id, any_value(y) AS y, round(avg(p), 4) AS p FROM b GROUP BY 1""",
)
def blend_then_bag(spark: SparkSession, sf: str) -> DataFrame:
    preds = repeated_preds(spark, sf)
    return B.blend_then_bag(preds, _weights(preds)).withColumn("p", F.round("p", 4))


@query(
    "bag_then_blend",
    f"""WITH RECURSIVE {REPEAT_SQL}, bags AS (SELECT 0 AS fold, submission, row_id, any_value(y) AS y, avg(p) AS p FROM preds GROUP BY 2, 3),
        {_residual_sql(_PRICE, 'bags')}, {_walk_sql(_SQUARE, '1')}
        SELECT row_id, any_value(y) AS y, round(sum(weight * p), 4) AS p FROM bags JOIN chosen ON submission = {_named(_PRICE)} GROUP BY 1""",
)
def bag_then_blend(spark: SparkSession, sf: str) -> DataFrame:
    _, out = B.bag_then_blend(repeated_preds(spark, sf), "rmse")
    return out.withColumn("p", F.round("p", 4))


CONTRIB_SQL = f"""{TRIALS_SQL}, totals AS (SELECT submission, CAST(round(round(sum(valid / 7), 3) * 1000) AS INTEGER) AS contributivity FROM trials GROUP BY 1)"""


def _totals(spark: SparkSession, sf: str) -> DataFrame:
    contrib = trials(spark, sf).select("submission", (F.col("valid") / 7).alias("contributivity"))
    return B.contributivity_totals(contrib)


@query("contributivity_totals", f"WITH {CONTRIB_SQL} SELECT * FROM totals")
def contributivity_totals(spark: SparkSession, sf: str) -> DataFrame:
    return _totals(spark, sf)


@query("blended_set", f"WITH {CONTRIB_SQL} SELECT * FROM totals WHERE contributivity > 0")
def blended_set(spark: SparkSession, sf: str) -> DataFrame:
    return B.blended_set(_totals(spark, sf))


@query(
    "base_contributivity",
    f"""WITH {CONTRIB_SQL}, b AS (SELECT unnest(['base0', 'base1', 'base2', 'base']) AS base)
        SELECT b.base, CAST(coalesce(sum(contributivity), 0) + 100 AS BIGINT) AS contributivity
        FROM b LEFT JOIN totals ON split_part(submission, '_hyperopt_', 1) = b.base GROUP BY 1""",
)
def base_contributivity(spark: SparkSession, sf: str) -> DataFrame:
    return B.base_contributivity(_totals(spark, sf), ["base0", "base1", "base2", "base"])


@query(
    "best_single",
    f"""WITH {REPEAT_SQL}, e AS (SELECT submission, CASE submission WHEN 'flat' THEN 'constant' ELSE 'linear' END AS base, sqrt(avg((y - p) * (y - p))) AS s FROM preds GROUP BY 1),
        best AS (SELECT base, arg_min(submission, s) AS submission FROM e GROUP BY 1)
        SELECT base, submission, row_id, any_value(y) AS y, round(avg(p), 4) AS p FROM preds JOIN best USING (submission) GROUP BY 1, 2, 3""",
)
def best_single(spark: SparkSession, sf: str) -> DataFrame:
    preds = repeated_preds(spark, sf)
    base = F.when(F.col("submission") == "flat", "constant").otherwise("linear").alias("base")
    means = S.score(preds, "rmse", ("submission",)).select("submission", "score", base)
    return B.best_single(preds, means, "rmse").withColumn("p", F.round("p", 4))


