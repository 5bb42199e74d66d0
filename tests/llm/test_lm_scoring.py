"""Scores against a plain model held in dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tabloom.llm.lm_scoring import LmSettings, score_texts

EDGES = [None, "", " \t\n", "One", "one two one two one two", "a b c d\x0be\x0cf " * 40, "é\xa0É b c", "x " * 3000]


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w] + ["</s>"]


def brute(rows, s):
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    texts = [words(t) for _, t in rows]
    counts = [Counter() for _ in range(s.order + 1)]
    for t, h in zip(texts, held):
        if not h:
            for n in range(1, s.order + 1):
                counts[n].update(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
    total, vocab = sum(counts[1].values()), len(counts[1])

    def state(g):
        return counts[len(g)][g] >= s.min_context[len(g) - 1]

    followers, cuts = defaultdict(int), [0.0, 0.0]
    for n in range(2, s.order + 1):
        kept = {g: c for g, c in counts[n].items() if state(g[:-1]) and all(state(g[k:-1]) for k in range(1, n - 1))}
        for g in kept:
            followers[g[:-1]] += 1
        n1, n2 = (sum(c == k for c in kept.values()) for k in (1, 2))
        cuts.append(n1 / max(n1 + 2 * n2, 1) or 0.5)

    def p(w, h):
        if not h:
            return (counts[1][(w,)] + 0.5) / (total + 0.5 * (vocab + 1))
        lower = p(w, h[1:])
        if not state(h):
            return lower
        c, d = counts[len(h)][h], cuts[len(h) + 1]
        return max(counts[len(h) + 1][(*h, w)] - d, 0) / c + d * followers[h] / c * lower

    out = []
    for (i, _), t, h in zip(rows, texts, held):
        base = sum(math.log10(p(w, ())) for w in t)
        score = sum(math.log10(p(w, tuple(t[max(0, k - s.order + 1) : k]))) for k, w in enumerate(t))
        known = sum(counts[1][(w,)] > 0 for w in t)
        out.append((i, h, len(t), known, total, base, score))
    return sorted(out, key=str)


def check(spark, rows, settings):
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(3)
    got = sorted((tuple(r) for r in score_texts(df, settings).collect()), key=str)
    want = brute(rows, settings)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


@pytest.mark.parametrize(
    "settings",
    [
        LmSettings(),
        LmSettings(order=3, min_context=(2, 8), block_bytes=3000, shard_keys=2000),
        LmSettings(order=4, min_context=(1, 1, 1), block_bytes=20_000, shard_keys=3000, hot_context=11),
        LmSettings(order=3, min_context=(1, 1), block_bytes=2000, shard_keys=500, hot_context=7),
        LmSettings(order=2, min_context=(3,), block_bytes=5000, shard_keys=10_000, hot_context=50),
    ],
)
def test_scores_match_brute_force(spark, sf, settings):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 4000").collect()
    rows = [(r["doc_id"], r["text"]) for r in docs]
    rows += [(None if k == 3 else 10_000 + k, t) for k, t in enumerate(EDGES)] + [(10_004, EDGES[4])] * 3
    check(spark, rows, settings)


def test_query_scores_by_three_words(spark, tmp_path):
    from tabloom.llm.lm_scoring import op5_lm_scoring

    # after "b" alone both words are as likely, after "a b" and "x b" only one is
    rows = [(i, "a b c x b d " * 3) for i in range(40)]
    schema = "doc_id long, text string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op5_lm_scoring(spark, str(tmp_path)).collect()), key=str)
    three, two = (brute(rows, LmSettings(order=k)) for k in (3, 2))
    for g, w, less in zip(got, three, two):
        assert g[6] == pytest.approx(w[6], rel=1e-9) and w[6] > less[6] + 1


def test_small_tables(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1]
    check(spark, [(i, "no training text at all") for i in held[:3]], LmSettings())
    check(spark, [(held[0] + 1 if held[0] + 1 not in held else 0, None)], LmSettings())
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert score_texts(empty).count() == 0
