"""Runs of words against a search over all periods."""

import hashlib
import zlib

import pyarrow as pa
from hypothesis import given, settings, strategies as st

from tabloom.llm import periodic_runs as module
from tabloom.llm.catalog import QUERIES
from tabloom.llm.periodic_runs import periodic_runs

WHITE = b" \t\n\x0b\x0c\r"


def brute(w, least):
    """All (start, length, period), the smallest period of each interval."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def collapsed(w, runs):
    drop = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in drop)


def words_of(text):
    return [x.decode() for x in (text or "").encode().split()]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


THUE = [bin(i).count("1") % 2 for i in range(300)]


@st.composite
def word_lists(draw):
    part = st.one_of(
        st.lists(st.integers(0, 2), max_size=60),
        st.tuples(st.lists(st.integers(0, 5), min_size=1, max_size=9), st.integers(1, 9)).map(lambda x: x[0] * x[1]),
        st.integers(0, 90).map(fibonacci),
        st.integers(0, 90).map(lambda n: THUE[:n]),
        st.lists(st.integers(0, 500), max_size=30),
    )
    return sum(draw(st.lists(part, max_size=4)), [])


@settings(max_examples=400, deadline=None)
@given(st.lists(word_lists(), min_size=1, max_size=4), st.sampled_from([2, 5, 12]), st.booleans())
def test_runs_of_any_words(docs, least, small):
    chunk, module.CHUNK = module.CHUNK, 7 if small else module.CHUNK
    try:
        texts = pa.array([" ".join(f"w{x}" for x in w) for w in docs], pa.string())
        _, runs, text = module._runs_of_texts(texts, least)
    finally:
        module.CHUNK = chunk
    for w, got, left in zip(docs, runs.to_pylist(), text.to_pylist()):
        want = brute(w, least)
        assert [(r["start"], r["length"], r["period"]) for r in got] == sorted(want, key=lambda r: (r[0], r[2]))
        assert left == collapsed([f"w{x}" for x in w], want)


TEXTS = [
    None, "", " \n ", "a", "a " * 11, "a " * 12, "a\x0ba\x0ca\ra\ta\na " * 3, "a b " * 20, "\x1c \x85 " * 9,
    "x y " * 40_000, " ".join(map(str, range(30_000))), ("é ü \U0001f600 " * 5 + "z ") * 3, "a " * 12,
]


def test_odd_texts_repeats_and_clashing_columns(spark):
    rows = [(None if i == 3 else i, t) for i, t in enumerate(TEXTS)] + [(12, TEXTS[12]), (12, "other")]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id int, text string, runs int, collapsed string").repartition(3)
    got = sorted(
        ((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs(docs).collect()), key=str
    )
    want = []
    for i, t in rows:
        w = words_of(t)
        runs = [(0, len(w), 2)] if i == 9 else brute(w, 12) if len(w) < 1000 else []
        want.append((i, len(w), sorted(runs, key=lambda r: (r[0], r[2])), collapsed(w, runs)))
    assert got == sorted(want, key=str)
    assert periodic_runs(docs.limit(0)).count() == 0


def test_query_against_all_periods(spark, sf):
    got = {r["doc_id"]: r for r in QUERIES["op12_periodic_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    with_runs = 0
    for d in docs:
        w = words_of(d["text"])
        n, h = len(w), zlib.crc32(str(d["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        runs = sorted(brute(w, 12), key=lambda r: (r[0], r[2]))
        r = got[d["doc_id"]]
        assert r["n_runs"] == len(runs)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        assert (r["start"], r["length"], r["period"]) == (top or (None,) * 3)
        assert r["exponent_milli"] == (top and 1000 * top[1] // top[2])
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        assert r["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
        with_runs += bool(runs)
    assert with_runs >= 10
