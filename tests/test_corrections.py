"""Cases that were wrong once: blending, scores, search draws, encoders, reading."""

import math

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tabloom.meta import Kit
from tabloom.operators import columns as C
from tabloom.operators import encode as E
from tabloom.operators import ensemble as B
from tabloom.operators import scores as S
from tabloom.operators import space as H
from tabloom.operators import training as T
from tabloom.session import work_dir

PREDS = "submission string, fold int, row_id long, y double, p double"


def preds(spark, rows):
    return spark.createDataFrame(rows, PREDS)


def weights(df):
    return {(r["fold"], r["submission"]): r["weight"] for r in df.collect()}


def test_blend_keeps_its_digits_for_a_large_target(spark):
    rows = []
    for i in range(40):
        y = 1e9 + i
        rows += [("good", 0, i, y, y + 0.01 * (-1) ** i), ("bad", 0, i, y, y + 0.5 * (-1) ** (i // 2))]
    for metric in ("rmse", "mae"):
        w = weights(B.blend(preds(spark, rows), metric))
        assert w[(0, "good")] > 0.95


@pytest.mark.parametrize("metric", ["rmse", "mae"])
def test_a_member_that_lacks_rows_is_no_candidate(spark, metric):
    rows = [("perfect", 0, i, float(i), float(i)) for i in range(6)]
    rows += [("short", 0, i, float(i), float(i)) for i in range(5)]
    rows += [("hole", 0, i, float(i), None if i == 2 else float(i)) for i in range(6)]
    rows += [("nan", 0, i, float(i), math.nan if i == 2 else float(i)) for i in range(6)]
    rows += [("short", 1, i, float(i), float(i) + 1) for i in range(3)]
    assert weights(B.blend(preds(spark, rows), metric)) == {(0, "perfect"): 1.0, (1, "short"): 1.0}


def test_blend_goes_on_while_it_improves(spark):
    # errors that do not overlap: every further member betters the average
    n = 130
    assert B._greedy_on_residuals(np.eye(n), list(range(n)), None) == list(range(n))
    rows = [(f"m{k:03d}", 0, i, 0.0, float(i == k)) for k in range(n) for i in range(n)]
    w = weights(B.blend(preds(spark, rows), "rmse"))
    assert len(w) == n and set(w.values()) == {1 / n}


def test_rank_scores_bag_ranks(spark):
    rows = []
    for i in range(4):
        rows += [("s", 0, i, float(i > 1), i / 1000.0), ("s", 1, i, float(i > 1), 1000.0 * (3 - i))]
    df = preds(spark, rows)
    w = spark.createDataFrame([(0, "s", 1.0, 0.5), (1, "s", 1.0, 0.5)], B.WEIGHTS)
    ranked = {r["row_id"]: r["p"] for r in B.blend_then_bag(df, w, "auc").collect()}
    assert ranked == {0: 0.5, 1: 0.5, 2: 0.5, 3: 0.5}
    plain = {r["row_id"]: r["p"] for r in B.blend_then_bag(df, w, "rmse").collect()}
    assert plain[0] > plain[3]
    assert {r["row_id"]: r["p"] for r in B.bag_for(df, "gini").collect()} == ranked


@pytest.mark.parametrize("name", ["rmse", "mae", "mare", "rmsle", "medae", "smape", "r2", "nll", "loglik", "auc", "gini", "ngini"])
def test_a_missing_prediction_leaves_no_score(spark, name):
    full = [("s", 0, i, float(i % 2), 0.1 + 0.2 * i) for i in range(4)]
    hole = [("s", 1, i, float(i % 2), None if i == 3 else 0.1 + 0.2 * i) for i in range(4)]
    got = {r["fold"]: r["score"] for r in S.score(preds(spark, full + hole), name).collect()}
    assert got[0] is not None and got[1] is None


def test_rmsle_counts_predictions_below_zero_as_zero(spark):
    got = S.score(preds(spark, [("s", 0, 0, 1.0, -5.0), ("s", 0, 1, 3.0, 3.0)]), "rmsle").first()["score"]
    assert got == pytest.approx(math.log(2) / math.sqrt(2))


def test_ranks_of_folds_of_unequal_size(spark):
    rows = [("s", int(i >= 800), i, float(i % 5 == 0), float(i % 5 == 0) + i / 10_000) for i in range(1000)]
    df = preds(spark, rows)
    bagged = B.bag_ranks(df).withColumn("fold", F.lit(0))
    assert S.score(bagged, "auc").first()["score"] == 1.0
    ranked = {r["row_id"]: r["p"] for r in S.rank_rows(df).collect()}
    assert 0 < min(ranked.values()) and max(ranked.values()) < 1
    cut = {r["row_id"]: r["p"] for r in S.rank_rows(df, block_rows=50).collect()}
    assert cut == pytest.approx(ranked)


def test_a_row_without_its_true_class_leaves_no_score(spark):
    rows = [("s", 0, 0, 1.0, 0, 0.1), ("s", 0, 0, 1.0, 1, 0.9), ("s", 0, 1, 0.0, 0, 0.01), ("s", 0, 1, 0.0, 1, 0.99)]
    schema = "submission string, fold int, row_id long, y double, class int, p double"
    got = S.score(spark.createDataFrame(rows, schema), "nll").first()["score"]
    assert got == pytest.approx(-(math.log(0.9) + math.log(0.01)) / 2)
    assert S.score(spark.createDataFrame(rows[:2] + rows[3:], schema), "nll").first()["score"] is None


def test_rmsle_of_a_target_below_minus_one(spark):
    assert S.score(preds(spark, [("s", 0, 0, -2.0, 5.0), ("s", 0, 1, 3.0, 3.0)]), "rmsle").first()["score"] is None


def test_mcc_of_three_classes(spark):
    y = [0] * 5 + [1] * 5 + [2] * 5
    p = [0, 0, 0, 1, 2, 1, 1, 1, 1, 0, 2, 2, 2, 0, 1]
    rows = [("s", 0, i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))]
    c, s = sum(a == b for a, b in zip(y, p)), 15
    t, g = [5, 5, 5], [p.count(k) for k in range(3)]
    want = (c * s - sum(a * b for a, b in zip(t, g))) / math.sqrt((s * s - sum(x * x for x in g)) * (s * s - sum(x * x for x in t)))
    assert S.score(preds(spark, rows), "mcc").first()["score"] == pytest.approx(want)
    blocks = spark.createDataFrame(
        [("s", 0, i, float(a), k, 0.8 if k == b else 0.1) for i, (a, b) in enumerate(zip(y, p)) for k in range(3)],
        "submission string, fold int, row_id long, y double, class int, p double",
    )
    assert S.score(blocks, "mcc").first()["score"] == pytest.approx(want)
    same = [("s", 0, i, 1.0, 1.0) for i in range(3)]
    assert S.score(preds(spark, same), "mcc").first()["score"] == 0.0


def test_random_trials_find_all_that_are_left(spark):
    five = H.Space([H.Dim("a", tuple(range(10)), 0)])
    done = H.random_trials(spark, five, 5, seed=1)
    assert done.count() == 5
    rest = H.random_trials(spark, five, 5, seed=2, done=done)
    assert rest.count() == 5 and rest.join(done, "hash").count() == 0
    assert H.random_trials(spark, five, 5, seed=3, done=done.unionByName(rest)).count() == 0
    heavy = H.Space([H.Dim("a", tuple(range(40)), 0, (1e6,) + (1e-3,) * 39), H.Dim("b", (0, 1), 0, (1.0, 0.0))])
    got = H.random_trials(spark, heavy, 20, seed=4)
    assert got.count() == 20 == got.select("hash").distinct().count()
    assert got.where(F.col("indices")[1] != 0).count() == 0
    assert H.random_trials(spark, heavy, 100, seed=4).count() == 40


def test_few_train_values_keep_their_encoder(spark):
    train = spark.createDataFrame([(i, "abc"[i % 3], float(i)) for i in range(30)], "id long, c string, y double")
    test = spark.createDataFrame([(i, f"t{i}", 0.0) for i in range(2500)], "id long, c string, y double")
    kit = Kit(train, test, None)
    counted = E.encode_category(kit, "c", "count")
    assert counted.train.columns == ["id", "y", "c"]
    assert {r["c"] for r in counted.train.collect()} == {10} and {r["c"] for r in counted.test.collect()} == {1}
    bits = E.encode_category(kit, "c", "binary").test
    assert len(bits.columns) == 2 + 12
    codes = bits.select(F.concat(*[F.col(c).cast("string") for c in bits.columns if c.startswith("c_")])).distinct().count()
    assert codes == 2500
    assert E.category_values(kit, ["c"], spelled=[]) == {"c": []}
    assert E.category_values(kit, ["c"], limit=2) == {"c": None}


def test_out_of_fold_codes_of_missing_and_lone_categories(spark):
    rows = [(i, None if i % 7 == 0 else "ab"[i % 2], float(i), i % 3) for i in range(42)] + [(99, "lone", 5.0, 0)]
    df = spark.createDataFrame(rows, "id long, c string, y double, fold int")
    out = {r["id"]: r for r in E.encode_target_out_of_fold(df, "c", "y", "fold").collect()}
    assert len(out) == 43 and all(r["c_target_encode"] is not None for r in out.values())
    for fold in range(3):
        others = [r[2] for r in rows if r[3] != fold]
        prior = sum(others) / len(others)
        for i, c, _, f in rows:
            if f == fold and (c is None or c == "lone"):
                assert out[i]["c_target_encode"] == pytest.approx(prior)


def test_anova_counts_cells_and_keeps_digits(spark):
    rows = [(k, None if i == 0 else 1e9 + k + 0.1 * i) for k in range(3) for i in range(5)]
    got = C.anova_scores(spark.createDataFrame(rows, "y int, x double"), ["x"], "y").first()["f"]
    groups = [[k + 0.1 * i for i in range(1, 5)] for k in range(3)]
    means = [sum(g) / 4 for g in groups]
    mean = sum(means) / 3
    between = sum(4 * (m - mean) ** 2 for m in means) / 2
    within = sum((x - m) ** 2 for g, m in zip(groups, means) for x in g) / (12 - 3)
    assert got == pytest.approx(between / within, rel=1e-4)


def test_only_a_missing_table_reads_as_empty(spark):
    store = T.Store(spark, work_dir(spark, "store"))
    assert store.scores().count() == 0
    spark.range(3).write.parquet(f"{store.path}/broken/x=1")
    with pytest.raises(AnalysisException):
        store.read("broken", "nonsense type here").collect()


def test_signatures_of_a_batch_match_those_of_single_texts():
    texts = ["", "a", "abc", "some words and some more", "é\U0001f600" * 50, "x" * 300_000]
    for minmax in (False, True):
        got = E.minhash_batch(texts, 7, 2, 4, minmax)
        assert got.tolist() == [E.minhash(t, 7, 2, 4, minmax) for t in texts]
