"""Trial analytics, search spaces and the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.catalog.registry import query
from tabloom.catalog.views import FOLDS, FULL_SQL, LOG_SQL, TRIALS_SQL, run_log, sql_unit, table, trials
from tabloom.operators import runlog as L
from tabloom.operators import space as H
from tabloom.operators import trials as T
from tabloom.operators.ensemble import contributivity_totals

VALUES = ["fold", "valid", "train", "seconds"]


def _r(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# --- trials ------------------------------------------------------------------------


@query(
    "trial_summary",
    f"""WITH {TRIALS_SQL}, sizes AS (SELECT l_linenumber AS fold, (SELECT count(*) FROM lineitem) - count(*) AS n_train, count(*) AS n_valid FROM lineitem GROUP BY 1)
        SELECT fold, submission, train AS train_disc, valid AS valid_disc, seconds * 2 AS train_time, seconds AS valid_time,
               hyper_size, hyper_brand, n_train, n_valid FROM trials JOIN sizes USING (fold)""",
)
def trial_summary(spark: SparkSession, sf: str) -> DataFrame:
    t = trials(spark, sf)
    steps = F.array(
        F.struct(F.lit("train").alias("step"), F.col("train").alias("value"), (F.col("seconds") * 2).alias("s")),
        F.struct(F.lit("valid").alias("step"), F.col("valid").alias("value"), F.col("seconds").alias("s")),
    )
    scores = t.select("submission", "fold", F.explode(steps).alias("e")).select(
        "submission", "fold", "e.step", F.lit("disc").alias("score_name"), "e.value", F.col("e.s").alias("seconds")
    )
    hypers = t.groupBy("submission").agg(F.first("hyper_size").alias("hyper_size"), F.first("hyper_brand").alias("hyper_brand"))
    n = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("fold")).agg(F.count(F.lit(1)).alias("n_valid"))
    rows = n.collect()  # one row per fold
    total = sum(r["n_valid"] for r in rows)
    sizes = n.select("fold", (F.lit(total) - F.col("n_valid")).alias("n_train"), "n_valid")
    return T.trial_summary(scores, hypers, sizes, "disc")


@query("full_folds", f"WITH {FULL_SQL} SELECT * FROM full_trials")
def full_folds(spark: SparkSession, sf: str) -> DataFrame:
    return T.full_folds(trials(spark, sf), FOLDS)


def _agg_sql(fn: str, extra: str = "", digits: int | None = 6) -> str:
    one = lambda c: f"{fn}({c})" if digits is None else f"round({fn}({c}), {digits})"
    cols = ", ".join(f"{one(c)} AS {c}" for c in VALUES)
    return f"WITH {FULL_SQL} SELECT submission, {cols}, any_value(hyper_size) AS hyper_size, any_value(hyper_brand) AS hyper_brand FROM full_trials GROUP BY 1"


@query("trial_means", _agg_sql("avg"))
def trial_means(spark: SparkSession, sf: str) -> DataFrame:
    return _r(T.trial_means(trials(spark, sf), FOLDS), *VALUES)


@query("trial_stds", _agg_sql("stddev_samp"))
def trial_stds(spark: SparkSession, sf: str) -> DataFrame:
    return _r(T.trial_stds(trials(spark, sf), FOLDS), *VALUES)


@query("trial_counts", _agg_sql("count", digits=None))
def trial_counts(spark: SparkSession, sf: str) -> DataFrame:
    return T.trial_counts(trials(spark, sf), FOLDS)


BIAS_SQL = """fm AS (SELECT fold, avg(valid) AS m FROM full_trials GROUP BY 1),
  bias AS (SELECT fold, m - (SELECT avg(m) FROM fm) AS bias FROM fm)"""


@query(
    "fold_bias",
    f"WITH {FULL_SQL}, {BIAS_SQL} SELECT fold, submission, round(valid, 6) AS valid, round(valid - bias, 6) + 0 AS valid_unbiased FROM full_trials JOIN bias USING (fold)",
)
def fold_bias(spark: SparkSession, sf: str) -> DataFrame:
    out = T.unbiased(T.full_folds(trials(spark, sf), FOLDS), "valid")
    return _r(out.select("fold", "submission", "valid", "valid_unbiased"), "valid", "valid_unbiased")


MEANS_SQL = f"{FULL_SQL}, means AS (SELECT submission, round(avg(valid), 3) AS valid FROM full_trials GROUP BY 1)"


def _means(spark: SparkSession, sf: str) -> DataFrame:
    return _r(T.trial_means(trials(spark, sf).select("submission", "fold", "valid"), FOLDS), "valid", digits=3).drop("fold")


@query(
    "select_top_n",
    f"WITH {MEANS_SQL}, top AS (SELECT * FROM means ORDER BY valid, submission LIMIT 50) SELECT submission, valid, (SELECT max(valid) FROM top) AS cutoff FROM top",
)
def select_top_n(spark: SparkSession, sf: str) -> DataFrame:
    return T.select_top_n(_means(spark, sf), "valid", 50, lower=True)


@query("select_by_cutoff", f"WITH {MEANS_SQL} SELECT submission, valid FROM means WHERE valid >= 0.055::DOUBLE")
def select_by_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    return T.select_by_cutoff(_means(spark, sf), "valid", 0.055, lower=False)


@query(
    "select_within_sigma",
    f"""WITH {FULL_SQL}, {BIAS_SQL},
        e AS (SELECT submission, avg(valid) AS m, stddev_samp(valid - bias) / sqrt(count(*)) AS se FROM full_trials JOIN bias USING (fold) GROUP BY 1),
        cut AS (SELECT avg(m) + 2 * avg(se) + 0.00000001::DOUBLE AS c FROM (SELECT * FROM e ORDER BY round(m, 9), submission LIMIT 20))
        SELECT submission, round(m, 6) AS valid FROM e, cut WHERE m <= c""",
)
def select_within_sigma(spark: SparkSession, sf: str) -> DataFrame:
    out = T.select_within_sigma(trials(spark, sf), "valid", FOLDS, top_n=20, n_sigma=2.0, lower=True)
    return _r(out, "valid")


@query("dedupe_trials", f"WITH {MEANS_SQL} SELECT valid, min(submission) AS submission FROM means GROUP BY 1")
def dedupe_trials(spark: SparkSession, sf: str) -> DataFrame:
    return T.dedupe_trials(_means(spark, sf), "valid")


@query(
    "rank_best_trials",
    f"""WITH {MEANS_SQL}, totals AS (SELECT submission, CAST(round(round(sum(greatest(train - 0.04, 0)), 3) * 1000) AS INTEGER) AS contributivity FROM trials GROUP BY 1),
        r AS (SELECT submission, valid, contributivity, row_number() OVER (ORDER BY valid, submission) - 1 AS rank FROM means JOIN totals USING (submission))
        SELECT *, 'base_best_' || rank || '_' || contributivity AS new_name FROM r WHERE rank < 100 OR contributivity > 0""",
)
def rank_best_trials(spark: SparkSession, sf: str) -> DataFrame:
    contrib = trials(spark, sf).select("submission", F.greatest(F.col("train") - 0.04, F.lit(0.0)).alias("contributivity"))
    return T.rank_best_trials(_means(spark, sf), contributivity_totals(contrib), "base", "valid", True, 100)


# --- search space -------------------------------------------------------------------

SPACE = H.Space(
    [
        H.Dim("flag", ("A", "N", "R"), "A", (0.5, 0.3, 0.2)),
        H.Dim("status", ("F", "O"), "F", (), "cat_encoder"),
        H.Dim("line", (1, 2, 3, 4, 5, 6, 7), 1),
    ]
)
SETTINGS_SQL = """settings AS (
  SELECT DISTINCT list_position(['A', 'N', 'R'], l_returnflag) - 1 AS f, list_position(['F', 'O'], l_linestatus) - 1 AS s, l_linenumber - 1 AS l, l_suppkey FROM lineitem),
hashed AS (SELECT *, substr(sha256(f || ',' || s || ',' || l), 1, 10) AS hash FROM settings)"""


def _settings(spark: SparkSession, sf: str) -> DataFrame:
    """Index vectors found in the line items, per supplier."""
    at = lambda values, c: F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c)) - 1
    idx = H.index_array(
        [at(SPACE.dims[0].values, "l_returnflag"), at(SPACE.dims[1].values, "l_linestatus"), F.col("l_linenumber") - 1]
    )
    return (
        table(spark, sf, "lineitem").select("l_suppkey", idx.alias("indices")).distinct()
        .withColumn("hash", H.trial_hash(F.col("indices")))
    )


def _flat(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols, *[F.col("indices")[i].alias(n) for i, n in enumerate("fsl")])


INT_FSL = "CAST(f AS INTEGER) AS f, CAST(s AS INTEGER) AS s, CAST(l AS INTEGER) AS l"


@query("trial_hash", f"WITH {SETTINGS_SQL} SELECT 's' || l_suppkey || '_hyperopt_' || hash AS submission, {INT_FSL} FROM hashed")
def trial_hash(spark: SparkSession, sf: str) -> DataFrame:
    base = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    return _flat(_settings(spark, sf).withColumn("submission", H.trial_name(base, F.col("indices"))), "submission")


@query(
    "grid_space",
    f"""WITH {SETTINGS_SQL}, start AS (SELECT l_suppkey, min(f * 100 + s * 10 + l) AS c FROM settings GROUP BY 1)
        SELECT l_suppkey, CAST(nf AS INTEGER) AS f, CAST((c // 10) % 10 AS INTEGER) AS s, CAST(nl AS INTEGER) AS l
        FROM start, (SELECT unnest([0, 1, 2]) AS nf), (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS nl)""",
)
def grid_space(spark: SparkSession, sf: str) -> DataFrame:
    """From each supplier's first setting: the predictor's slice, the encoder frozen."""
    start = _settings(spark, sf).groupBy("l_suppkey").agg(F.min("indices").alias("indices"))
    return _flat(H.grid_space(start, SPACE, ["flag", "line"]), "l_suppkey")


DRAWS_SQL = f"""u AS (SELECT o_orderkey, {sql_unit("'9_flag_' || o_orderkey")} AS uf, {sql_unit("'9_status_' || o_orderkey")} AS us, {sql_unit("'9_line_' || o_orderkey")} AS ul FROM orders),
  draws AS (SELECT o_orderkey, CASE WHEN uf < 0.5::DOUBLE THEN 0 WHEN uf < 0.8::DOUBLE THEN 1 ELSE 2 END AS f,
            CASE WHEN us < 0.5::DOUBLE THEN 0 ELSE 1 END AS s, CAST(floor(ul * 7) AS INTEGER) AS l FROM u)"""


@query("random_trials", f"WITH {DRAWS_SQL} SELECT o_orderkey, substr(sha256(f || ',' || s || ',' || l), 1, 10) AS hash, {INT_FSL} FROM draws")
def random_trials(spark: SparkSession, sf: str) -> DataFrame:
    """One seeded draw per order."""
    draws = table(spark, sf, "orders").select("o_orderkey")
    return _flat(H.draw_settings(draws, SPACE, "o_orderkey", seed=9), "o_orderkey", "hash")


@query(
    "random_trials_new",
    f"""WITH {DRAWS_SQL}, {SETTINGS_SQL}, d AS (SELECT DISTINCT substr(sha256(f || ',' || s || ',' || l), 1, 10) AS hash, f, s, l FROM draws)
        SELECT hash, {INT_FSL} FROM d WHERE hash NOT IN (SELECT hash FROM hashed WHERE s = 0)""",
)
def random_trials_new(spark: SparkSession, sf: str) -> DataFrame:
    """Draws whose setting is not among the trained ones, those with status F."""
    draws = H.draw_settings(table(spark, sf, "orders").select("o_orderkey"), SPACE, "o_orderkey", seed=9)
    done = _settings(spark, sf).where(F.col("indices")[1] == 0)
    return _flat(H.new_settings(draws, done), "hash")


@query(
    "remaining_trials",
    f"""WITH {DRAWS_SQL}, {SETTINGS_SQL}, w AS (SELECT DISTINCT substr(sha256(f || ',' || s || ',' || l), 1, 10) AS hash FROM draws)
        SELECT count(*) AS existing, CAST(greatest(100 - count(*), 0) AS BIGINT) AS remaining FROM w WHERE hash IN (SELECT hash FROM hashed)""",
)
def remaining_trials(spark: SparkSession, sf: str) -> DataFrame:
    draws = H.draw_settings(table(spark, sf, "orders").select("o_orderkey"), SPACE, "o_orderkey", seed=9)
    return H.remaining_trials(draws, _settings(spark, sf), 100, subtract=True)


@query(
    "hybrid_trials",
    f"""WITH {SETTINGS_SQL}, sel AS (SELECT 's' || l_suppkey || '_hyperopt_' || hash AS submission, f, s, l FROM hashed),
        mixed AS (SELECT submission AS parent, f, 1 AS s, l, 'hyb_hyperopt_' || substr(sha256(f || ',1,' || l), 1, 10) AS submission FROM sel)
        SELECT submission, min(parent) AS parent, CAST(any_value(f) AS INTEGER) AS f, CAST(any_value(s) AS INTEGER) AS s, CAST(any_value(l) AS INTEGER) AS l
        FROM mixed WHERE submission NOT IN (SELECT 'hyb_hyperopt_' || hash FROM hashed WHERE f = 0) GROUP BY 1""",
)
def hybrid_trials(spark: SparkSession, sf: str) -> DataFrame:
    """Predictor settings of every supplier's trials with one encoder setting."""
    rows = _settings(spark, sf)
    sel = rows.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit("_hyperopt_"), "hash").alias("submission"), "indices")
    done = rows.where(F.col("indices")[0] == 0).select(F.concat(F.lit("hyb_hyperopt_"), "hash").alias("submission"))
    return _flat(H.hybrid_trials(sel, [0, 1, 0], SPACE, "predictor", "hyb", done), "submission", "parent")


@query(
    "arm_trials",
    """WITH a AS (SELECT DISTINCT CAST(p_size % 3 AS INTEGER) AS f, CAST(p_size % 7 AS INTEGER) AS l FROM part WHERE p_size > 10)
       SELECT 'arm_hyperopt_' || substr(sha256(f || ',0,' || l), 1, 10) AS submission, f, 0 AS s, l FROM a""",
)
def arm_trials(spark: SparkSession, sf: str) -> DataFrame:
    """Known-good settings of the parts; the dimension they lack takes its default."""
    arms = table(spark, sf, "part").select(
        (F.col("p_size") % 3).alias("flag_i"),
        (F.col("p_size") % 7).alias("line_i"),
        F.when(F.col("p_size") > 10, F.col("p_size")).alias("contributivity"),
    )
    return _flat(H.arm_settings(arms, SPACE, "arm"), "submission")


# --- run log ------------------------------------------------------------------------

LOG_COLS = "run, action_id, name, base, start_us, stop_us, score"


def _out(df: DataFrame) -> DataFrame:
    return df.select(
        "run", "action_id", "name", "base",
        F.unix_micros("start_ts").alias("start_us"), F.unix_micros("stop_ts").alias("stop_us"), "score",
    )


@query(
    "last_action",
    f"""WITH {LOG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY start_us DESC, action_id DESC) AS i FROM log WHERE name = 'blend' AND fold_hi = 3)
        SELECT {LOG_COLS} FROM r WHERE i = 1""",
)
def last_action(spark: SparkSession, sf: str) -> DataFrame:
    return _out(L.last_action(run_log(spark, sf), "blend", (0, 3)))


@query("list_actions", f"WITH {LOG_SQL} SELECT {LOG_COLS} FROM log ORDER BY start_us, action_id")
def list_actions(spark: SparkSession, sf: str) -> DataFrame:
    return _out(L.list_actions(run_log(spark, sf)))


@query(
    "truncate_after_last_blend",
    f"""WITH {LOG_SQL}, last AS (SELECT run, max(stop_us) AS t FROM log WHERE name = 'blend' GROUP BY 1)
        SELECT {LOG_COLS} FROM log LEFT JOIN last USING (run) WHERE t IS NULL OR start_us <= t""",
)
def truncate_after_last_blend(spark: SparkSession, sf: str) -> DataFrame:
    return _out(L.truncate_after_last_blend(run_log(spark, sf)))


PAIR_SQL = f"""{LOG_SQL},
  s AS (SELECT run, action_id AS search_id, base, seconds AS search_seconds, row_number() OVER (PARTITION BY run ORDER BY start_us, action_id) AS round_idx FROM timed WHERE name = 'search'),
  b AS (SELECT run, action_id AS blend_id, score, k, seconds AS blend_seconds, start_us, row_number() OVER (PARTITION BY run ORDER BY start_us, action_id) AS round_idx FROM timed WHERE name = 'blend'),
  pairs AS (SELECT * FROM s JOIN b USING (run, round_idx))"""


@query(
    "pair_search_with_blend",
    f"WITH {PAIR_SQL} SELECT run, round_idx, search_id, base, round(search_seconds, 6) AS search_seconds, blend_id, score, round(blend_seconds, 6) AS blend_seconds, start_us AS blend_us FROM pairs",
)
def pair_search_with_blend(spark: SparkSession, sf: str) -> DataFrame:
    out = L.pair_search_with_blend(run_log(spark, sf))
    return _r(out.withColumn("blend_us", F.unix_micros("blend_ts")).drop("blend_ts"), "search_seconds", "blend_seconds")


@query(
    "elapsed_hours",
    f"""WITH {LOG_SQL} SELECT run, action_id, name, round(sum(seconds) OVER (PARTITION BY run ORDER BY start_us, action_id ROWS UNBOUNDED PRECEDING) / 3600, 6) AS elapsed_hours
        FROM timed WHERE name IN ('search', 'blend')""",
)
def elapsed_hours(spark: SparkSession, sf: str) -> DataFrame:
    return _r(L.elapsed_hours(run_log(spark, sf)), "elapsed_hours")


@query(
    "runtime_by_action",
    f"""WITH {LOG_SQL} SELECT CASE WHEN name = 'blend' AND fold_hi = 3 THEN 'search_blend' WHEN name = 'blend' THEN 'blend_then_bag' ELSE name END AS name,
        round(sum(seconds), 4) AS seconds FROM timed GROUP BY 1""",
)
def runtime_by_action(spark: SparkSession, sf: str) -> DataFrame:
    return _r(L.runtime_by_action(run_log(spark, sf), "blend", (0, 3)), "seconds", digits=4)


ROUNDS = [5, 10, 20, 30, 50, 70]


@query(
    "results_by_round",
    f"""WITH {LOG_SQL},
        b AS (SELECT run, score AS valid_score, seconds AS runtime, row_number() OVER (PARTITION BY run ORDER BY start_us, action_id) AS i FROM timed WHERE name = 'blend'),
        f AS (SELECT run, k AS round_idx, start_us, action_id, row_number() OVER (PARTITION BY run ORDER BY start_us, action_id) AS i FROM timed WHERE name = 'final'),
        j AS (SELECT *, row_number() OVER (PARTITION BY run, round_idx ORDER BY start_us DESC, action_id DESC) AS r FROM b JOIN f USING (run, i)
              WHERE round_idx > 0 AND round_idx IN (5, 10, 20, 30, 50, 70))
        SELECT run, round_idx, valid_score, round(runtime, 6) AS runtime FROM j WHERE r = 1""",
)
def results_by_round(spark: SparkSession, sf: str) -> DataFrame:
    return _r(L.results_by_round(run_log(spark, sf), ROUNDS), "runtime")


@query(
    "round_state",
    f"""WITH {LOG_SQL}, b AS (SELECT run, k, row_number() OVER (PARTITION BY run ORDER BY start_us, action_id) AS i FROM log WHERE name = 'blend'),
        m AS (SELECT run, 'base0_hyperopt_x' AS submission, k AS contributivity FROM b WHERE i = 3 UNION ALL SELECT run, 'base1_hyperopt_y', CAST(k % 7 AS INTEGER) FROM b WHERE i = 3)
        SELECT * FROM m WHERE contributivity > 0""",
)
def round_state(spark: SparkSession, sf: str) -> DataFrame:
    return L.round_state(run_log(spark, sf), 3)


SPEED_SQL = f"""{PAIR_SQL}, speeds AS (SELECT run, base, count(*) AS n,
  CASE WHEN count(*) < 2 THEN 1.7976931348623157e308::DOUBLE ELSE CAST(arg_max(CASE base WHEN 'base0' THEN k WHEN 'base1' THEN k % 7 ELSE 0 END, round_idx) + 100 AS DOUBLE) / sum(search_seconds) END AS speed FROM pairs GROUP BY 1, 2)"""


def _speeds(spark: SparkSession, sf: str) -> DataFrame:
    log = run_log(spark, sf)
    return L.improvement_speed(L.round_contributivity(L.pair_search_with_blend(log), log))


@query(
    "improvement_speed",
    f"WITH {SPEED_SQL} SELECT run, base, n, CASE WHEN speed < 1e300 THEN round(speed, 6) ELSE speed END AS speed FROM speeds",
)
def improvement_speed(spark: SparkSession, sf: str) -> DataFrame:
    fine = F.when(F.col("speed") < 1e300, F.round("speed", 6)).otherwise(F.col("speed"))
    return _speeds(spark, sf).withColumn("speed", fine)


@query(
    "choose_base",
    f"""WITH {SPEED_SQL}, r AS (SELECT run, base, row_number() OVER (PARTITION BY run ORDER BY speed DESC, {sql_unit("'3_' || run || '|' || base")} DESC) AS i FROM speeds)
        SELECT run, base FROM r WHERE i = 1""",
)
def choose_base(spark: SparkSession, sf: str) -> DataFrame:
    return L.choose_base(_speeds(spark, sf), seed=3)


@query(
    "patience_stop",
    f"""WITH {LOG_SQL},
        r AS (SELECT run, row_number() OVER w AS i, max(score) OVER w AS best FROM log WHERE name = 'blend' WINDOW w AS (PARTITION BY run ORDER BY start_us, action_id ROWS UNBOUNDED PRECEDING)),
        e AS (SELECT run, i, best, lag(best, 4) OVER (PARTITION BY run ORDER BY i) AS early FROM r)
        SELECT run, min(i) AS stop_round FROM e WHERE early >= best GROUP BY 1""",
)
def patience_stop(spark: SparkSession, sf: str) -> DataFrame:
    rounds = run_log(spark, sf).where("name = 'blend'")
    return L.patience_stop(rounds, 4, lower=False)


@query(
    "final_blend_cost",
    f"""WITH {TRIALS_SQL}, m AS (SELECT submission FROM trials GROUP BY 1 HAVING round(round(sum(valid / 7), 3) * 1000) > 0),
        c AS (SELECT coalesce(sum(seconds), 0) * 27 / 3600 AS t FROM trials WHERE fold = 1 AND submission IN (SELECT submission FROM m))
        SELECT round(t, 4) AS train_hours, round(2 * 90.0::DOUBLE * 30 / 3 / 3600, 4) AS blend_hours, 1.5::DOUBLE + t + 2 * 90.0::DOUBLE * 30 / 3 / 3600 > 10 AS over_budget FROM c""",
)
def final_blend_cost(spark: SparkSession, sf: str) -> DataFrame:
    t = trials(spark, sf)
    totals = contributivity_totals(t.select("submission", (F.col("valid") / 7).alias("contributivity")))
    out = L.final_blend_cost(
        totals.where("contributivity > 0"), t.where("fold = 1").select("submission", "seconds"), 1.5, 90.0, 3, 30, 10.0
    )
    return _r(out, "train_hours", "blend_hours", digits=4)
