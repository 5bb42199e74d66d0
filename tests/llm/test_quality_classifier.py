"""The model against a plain Kneser-Ney recursion; verdicts on planted junk."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm.quality_classifier import (
    EDGE,
    QualitySettings,
    _shards,
    classify_quality,
    count_grams,
    grams,
    kneser_ney,
    score_documents,
    symbols,
    training_sample,
)


def kn(texts, order):
    streams = [[EDGE] * (order - 1) + symbols(t).tolist() + [EDGE] for t in texts]
    seen = {order: Counter(tuple(s[i : i + order]) for s in streams for i in range(len(s) - order + 1))}
    for n in range(order - 1, 0, -1):
        seen[n] = Counter(g[1:] for g in seen[n + 1])
    cuts = {}
    for n, c in seen.items():
        n1, n2, n3, n4 = (sum(x == k for x in c.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        cuts[n] = [min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) if a else 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]

    def p(g):
        if not g:
            return 2.0**-12
        n, h = len(g), g[:-1]
        total = sum(c for x, c in seen[n].items() if x[:-1] == h)
        if not total:
            return p(g[1:])
        cut = lambda c: cuts[n][min(c, 3) - 1]
        weight = sum(cut(c) for x, c in seen[n].items() if x[:-1] == h) / total
        own = (seen[n][g] - cut(seen[n][g])) / total if g in seen[n] else 0.0
        return own + weight * p(g[1:])

    return p


def test_grams_of_a_text_stand_alone():
    one, n = grams(["ab", "", "\U0001f600x"], 3)
    parts = [grams([t], 3)[0] for t in ("ab", "", "\U0001f600x")]
    assert n.tolist() == [3, 1, 3] and np.array_equal(one, np.concatenate(parts))


def test_log_probabilities_match_the_recursion(spark):
    train = ["the cat sat on the mat", "the dog sat", "a cat", "", "the the the", "über \U0001f600"]
    probe = ["the cat", "zzz", "", None, "a dog sat on the mat", "x" * 500]
    s = QualitySettings(order=4, shard_rows=7, chunk_chars=10)
    table = spark.createDataFrame([(t,) for t in train], "text string")
    ps, ws = kneser_ney(count_grams(table, s), s.order)
    shards = ([_shards(t, "p", 7) for t in ps], [_shards(t, "weight", 7) for t in ws])
    rows = spark.createDataFrame([(i, "en", t) for i, t in enumerate(probe)], "doc_id long, lang string, text string")
    got = {r["doc_id"]: r for r in score_documents(rows, shards, s).collect()}
    p = kn(train, 4)
    for i, t in enumerate(probe):
        stream = [EDGE] * 3 + symbols(t or "").tolist() + [EDGE]
        want = sum(math.log(p(tuple(stream[k : k + 4]))) for k in range(len(stream) - 3))
        assert got[i]["n_symbols"] == len(t or "") + 1
        assert got[i]["log_p"] == pytest.approx(want, rel=1e-9)


def test_probabilities_sum_to_one(spark):
    s = QualitySettings(order=3)
    table = spark.createDataFrame([("abab aab",), ("ba",)], "text string")
    ps, _ = kneser_ney(count_grams(table, s), 3)
    first = ps[0].agg(F.sum("p")).first()[0]
    assert first <= 1.0


def test_junk_is_told_from_trusted_text(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    s = QualitySettings(max_training_docs=100)
    out = classify_quality(docs, labels, s).join(labels, "doc_id")
    rows = out.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    kept = {r["quality"]: r["k"] for r in rows}
    assert kept[1] >= 0.97 and kept[0] <= 0.35


def test_long_texts_do_not_keep_others_out(spark):
    s = QualitySettings(max_training_chars=1000)
    long = [(k, "long text " * 300, "en") for k in range(40)]
    short = [(100 + k, f"plain words number {k}", "en") for k in range(20)]
    schema = "doc_id long, text string, lang string"
    labels = spark.createDataFrame([(r[0], 1, 0) for r in long + short], "doc_id long, quality int, toxic int")
    sample = training_sample(spark.createDataFrame(long + short, schema), labels, s).collect()
    assert {r["doc_id"] for r in sample} >= {r[0] for r in short}
    assert sum(len(r["text"]) for r in sample) <= 1000
    # a model is fitted although no text fits
    out = classify_quality(spark.createDataFrame(long, schema), labels, s)
    assert out.where("perplexity is null").count() == 0


def test_odd_rows_and_missing_labels(spark):
    rows = [(1, "plain words here", "en", 9), (1, "plain words here", "en", 9), (2, None, None, 1), (None, "", "xx", 2), (3, "ÿ" * 4000, "en", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, threshold int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, None), (2, 0, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    out = classify_quality(docs, labels).collect()
    assert len(out) == 5 and all(r["threshold"] is not None for r in out)
    assert {r["kept"] for r in out if r["doc_id"] == 1} == {True}
    assert not next(r["kept"] for r in out if r["doc_id"] == 3)
    none = classify_quality(docs, labels.limit(0)).collect()
    assert len(none) == 5 and all(r["kept"] for r in none)
    assert classify_quality(docs.limit(0), labels).count() == 0


def test_a_long_text_gives_a_piece_drawn_by_hash(spark):
    from tabloom.llm.quality_classifier import _piece

    text = "".join(f"{k:04d}" for k in range(250))  # 1000 characters
    rows = spark.range(200).select(F.lit(text).alias("t"), F.xxhash64("id").alias("h"))
    pieces = {r["p"] for r in rows.select(_piece(F.col("t"), F.col("h"), 300).alias("p")).collect()}
    assert pieces == {text[k : k + 300] for k in range(0, 1000, 300)}
    odd = spark.createDataFrame([(None, 1), ("", -7), ("abc", -1)], "t string, h long")
    assert [r["p"] for r in odd.select(_piece(F.col("t"), F.col("h"), 3).alias("p")).collect()] == [None, "", "abc"]
