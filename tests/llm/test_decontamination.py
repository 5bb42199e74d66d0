"""Retrieval and verdicts against all documents times all items by brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tabloom.llm import decontamination as D
from tabloom.llm.decontamination import LeakSettings, blocks, common_words, decontaminate_stage, find_leaks, tokens, verdict


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_subsequences_by_bits():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.randint(0, 5) for _ in range(rnd.randint(0, 70))] for _ in range(2))
        assert common_words(np.array(a, np.int32), np.array(b, np.int32)) == lcs(a, b)


def planted(spark, sf):
    """Documents with copies and paraphrases of items, at the start, middle and end."""
    rnd = random.Random(7)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = [t for _, t in docs if len(t.split()) > 50][:60]
    rows, leaked = [], {}
    for k, (i, text) in enumerate(items):
        words, host = text.split(), clean[k % len(clean)].split()
        shape = k % 3
        if shape == 1:  # other case and punctuation
            words = [w.upper().strip(".,") + "!" for w in words]
        if shape == 2:  # one word in eight replaced, the answer kept
            words = [w if j % 8 or j > 0.75 * len(words) else "zzz" + rnd.choice("abc") for j, w in enumerate(words)]
        at = rnd.choice([0, len(host) // 2, len(host)])
        rows.append((50_000 + k, " ".join(host[:at] + words + host[at:])))
        leaked[50_000 + k] = i
    return docs + rows, items, leaked


def exact(rows, items, s):
    split = lambda t: [w for w in tokens(pa.array([t], pa.string())).to_pylist()[0]]
    code = {}
    number = lambda ws: np.array([code.setdefault(w, len(code) + 1) for w in ws], np.int32)
    coded = [(i, number([w for w in split(t) if w])) for i, t in items]
    return {
        (d, i)
        for d, t in rows
        for text in [number(split(t))]
        for i, item in coded
        if np.isin(text, item).sum() >= s.paraphrased * len(item) and verdict(item, text, s)[0]
    }


def test_recall_and_precision_against_all_pairs(spark, sf):
    rows, items, leaked = planted(spark, sf)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    s = LeakSettings()
    got = {r["doc_id"]: r for r in find_leaks(docs, bench, s).collect()}
    assert len(got) == len(rows)
    want = {d for d, _ in exact(rows, items, s)}
    found = {d for d, r in got.items() if r["contaminated"]}
    assert set(leaked) <= want
    assert len(found & want) >= 0.99 * len(want)
    assert found <= want
    assert all(got[d]["item_id"] == i for d, i in leaked.items())
    # the same in several blocks of the benchmark
    few = LeakSettings(block_items=9)
    assert len(list(blocks(bench, few))) > 2
    again = {r["doc_id"] for r in find_leaks(docs, bench, few).collect() if r["contaminated"]}
    assert len(again & want) >= 0.99 * len(want) and again <= want
    left = decontaminate_stage(docs, bench)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in rows} - found


def test_odd_rows(spark):
    item = "which of the nine old bridges crosses the northern river near the market the third one"
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, " ... "), (None, "short one here")], "item_id long, text string")
    rows = [(1, item), (1, item), (2, None), (3, ""), (None, "so " * 30000 + item), (4, "the of near old which"), (5, "x short one here y"), (6, "short and one and here")]
    docs = spark.createDataFrame([(*r, 2.0) for r in rows], "doc_id long, text string, cosine double")
    out = find_leaks(docs, bench).collect()
    assert len(out) == len(rows)
    verdicts = {r["doc_id"]: r["contaminated"] for r in out}
    assert verdicts == {1: True, 2: False, 3: False, None: True, 4: False, 5: True, 6: False}
    assert find_leaks(docs.limit(0), bench).count() == 0
    assert not any(r["contaminated"] for r in find_leaks(docs, bench.limit(0)).collect())


def test_items_of_frequent_words_are_found(spark):
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(3000)]
    item = " ".join(rnd.sample(words, 30))
    # an item in a third of the rows, and one of words that all other rows hold
    plain, every = [" ".join(rnd.choices(words, k=400)) for _ in range(120)], [f"e{k}" for k in range(20)]
    often = " ".join(every)
    rows = []
    for k, text in enumerate(plain):
        host, mixed = text.split(), rnd.sample(every, len(every))
        host = " ".join(w for j, x in enumerate(host) for w in ([x, mixed[j // 20]] if j % 20 == 10 else [x]))
        rows.append((k, f"{host} {item}" if k % 3 == 0 else f"{host} {often}" if k == 1 else host))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rare = " ".join(f"r{k}" for k in range(30))
    bench = spark.createDataFrame([(1, item), (2, often), (3, rare)], "item_id long, text string")
    got = {r["doc_id"]: r["item_id"] for r in find_leaks(docs, bench).collect() if r["contaminated"]}
    assert got == {k: 1 if k % 3 == 0 else 2 for k in range(120) if k % 3 == 0 or k == 1}


@pytest.mark.parametrize("basis", [300, 60])
def test_recall_with_a_sampled_basis(spark, sf, basis):
    rows, items, leaked = planted(spark, sf)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in find_leaks(docs, bench, LeakSettings(basis_passages=basis)).collect()}
    found = {d for d, r in got.items() if r["contaminated"]}
    assert set(leaked) <= found
    assert found <= {d for d, _ in exact(rows, items, LeakSettings())}


def weighted_passages(seed, n_words=60, n=150):
    """Passages as code sequences, their triples, and the same as a dense matrix."""
    rnd = np.random.default_rng(seed)
    codes = [rnd.zipf(1.3, size=rnd.integers(0, 12)).clip(0, n_words).astype(np.int32) * (rnd.random() < 0.9) for _ in range(n)]
    counts = np.bincount(np.concatenate([np.unique(c) for c in codes]), minlength=n_words + 1)
    idf = np.log((n + 2) / (counts + 1.0))
    idf[0] = 0.0
    triples = D._weighted(*D._passages(codes, 64, n_words, idf > 0)[:3], idf)
    dense = np.zeros((n, n_words + 1))
    dense[triples[0], triples[1]] = triples[2]
    return codes, idf, triples, dense


@pytest.mark.parametrize("most, chunk", [(4096, 2048), (60, 7), (12, 1), (1, 50)])
def test_word_pairs_give_the_products_of_all_passages(most, chunk):
    for seed in range(5):
        _, idf, triples, dense = weighted_passages(seed)
        omega = D._random(60, 9, 1)
        pairs, got = D.PairSums(idf, most), np.zeros((61, 9), np.float32)
        rest = pairs.add(triples, chunk)
        D._gram_times(rest, omega, got)
        pairs.times(omega, got)
        assert np.allclose(got, dense.T @ (dense @ omega), atol=1e-3)
        assert set(rest[0][rest[3]]) == {p for p, c in zip(triples[0], triples[1]) if pairs.rank[c] < 0}
    pairs = D.PairSums(idf, most)
    empty = D._weighted(*D._passages([], 64, 60, idf > 0)[:3], idf)
    assert not len(pairs.add(empty)[0]) and not pairs.upper.any()
    one = tuple(x[: triples[3][1]] for x in triples[:3]) + (np.zeros(1, np.int64),)
    left = pairs.add(one)
    assert len(left[0]) == len(one[0]) or pairs.upper.any()


def test_the_basis_is_fitted_on_all_passages(spark):
    codes, idf, _, dense = weighted_passages(8)
    block = D.Block([1], [np.array([1, 2, 3], np.int32)], pa.array([f"w{k}" for k in range(60)]))
    rows = [(k, k * 977, bytearray(c.astype("<u2").tobytes())) for k, c in enumerate(codes)]
    coded = spark.createDataFrame(rows, "doc_id long, text_key long, codes binary").repartition(3)
    s = LeakSettings(item_weight=0.0, spare_rank=4, oversampling=55)  # as many columns as words: the fit is exact
    got = D.latent_basis(coded, block, idf, 1_000_000, s).astype(float)
    want = np.linalg.svd(dense.T, full_matrices=False)[0][:, :5]
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-2)
