"""Targets against a plain reading of the rule, and what a mix must hold."""

import re

import pytest
from pyspark.sql import functions as F

from tabloom.llm.mixing import MixSettings, mix_sources, permuted, pieces, plan_mix


def targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed.update({s: most * sizes[s] for s in over})


def n_words(t):
    return len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w])


def check(rows, got, near):
    assert len(got) == len(rows)
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), n_words(t)) for i, t, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + n_words(t)
    want, taken = targets(sizes), {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= near * t + 40, (s, taken[s], t)


def test_documents_and_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs]
    rows += [(9001, "tiny source", "a"), (9002, None, "b"), (9003, "", None), (None, "word " * 9000, None),
             (9004, "same row", "src1"), (9004, "same row", "src1"), (9005, "z " * 400, "\U0001f600")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, size int")
    got = mix_sources(df).collect()
    check(rows, got, 0.03)
    # reruns and other partitionings agree
    again = mix_sources(df.repartition(13), MixSettings()).collect()
    key = lambda rs: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rs)
    assert key(got) == key(again)


def test_hot_source_many_shards_and_buckets(spark):
    rows = [(i, "w " * (i % 50), "hot" if i % 3 else f"s{i % 30}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(rows, mix_sources(df, MixSettings(block_words=8, shard_slots=64, bucket_docs=20)).collect(), 0.1)


def test_slots_are_permutations_and_blocks_cover_the_words(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    s = MixSettings(block_words=16, shard_slots=100)
    mix = plan_mix(df, s)
    passes = mix.slots.groupBy("rank", "pass").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("block").alias("d"), F.max("block").alias("m")
    ).join(mix.sources.select("rank", "n_blocks"), "rank").collect()
    assert passes and all(r["n"] == r["d"] and r["m"] < r["n_blocks"] for r in passes)
    # per shard and source, at most one block beyond the whole part that others got, plus draws
    words = pieces(mix, s).groupBy("rank", "block").agg(F.sum("words").alias("w"))
    full = words.join(mix.sources.select("rank", "n_blocks"), "rank")
    assert full.where("block < n_blocks - 1 and w <> 16").count() == 0
    assert words.count() == mix.sources.agg(F.sum("n_blocks")).first()[0]


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000])
def test_permuted_is_a_bijection(spark, n):
    df = spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(99).cast("long"), 16).alias("x"))
    assert sorted(r["x"] for r in df.collect()) == list(range(n))


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_sources(df).count() == 0
    only_empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r["size"], r["target"], r["taken"]) for r in mix_sources(only_empty).collect()] == [(0, 0.0, 0)] * 2
