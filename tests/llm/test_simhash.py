"""Fingerprints, links and groups against brute force."""

import random

import xxhash

from tabloom.llm.components import components
from tabloom.llm.simhash import (
    SimHashSettings,
    dedup_stage,
    fingerprint,
    fingerprint_links,
    near_duplicates,
)


def brute_fingerprint(text, n=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        {c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, radius):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = list(root)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def want(rows, radius=3):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = groups(set(fps), radius)
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    return sorted(((i, f"{f:016x}", least.get(root[f])) for (i, _), f in zip(rows, fps)), key=str)


def got(df):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()), key=str)


EDGES = [(3, None), (1, ""), (None, " \n\t"), (7, "One"), (7, "one"), (9, "a b"), (8, "x" * 5000),
         (2, "é\xa0b c d É"), (11, "w " * 20000), (12, "A b c d e f"), (12, "A b c d e f")]


def test_fingerprints_of_odd_texts():
    for _, t in EDGES:
        assert fingerprint(t, 3, 42) == brute_fingerprint(t)


def test_groups_match_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in table.collect()] + EDGES
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    assert got(near_duplicates(df)) == want(rows)
    assert near_duplicates(df.limit(0)).count() == 0


def test_links_survive_dealing_large_shards_again(spark):
    rnd = random.Random(5)
    centers = [rnd.getrandbits(64) for _ in range(6)]
    fps = {c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for c in centers for _ in range(60)}
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    nodes = spark.createDataFrame(signed, "fp long")
    links = fingerprint_links(nodes, SimHashSettings(shard_rows=5))
    found = {(r["a"] % 2**64, r["b"] % 2**64) for r in links.collect()}
    assert all((a ^ b).bit_count() <= 3 for a, b in found)
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    expected = groups(fps, 3)
    parts = {}
    for f in fps:
        s = f - 2**64 if f >= 2**63 else f
        parts.setdefault(roots.get(s, s), set()).add(f)
    other = {}
    for f in fps:
        other.setdefault(expected[f], set()).add(f)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, other.values()))


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 700)]
    df = spark.createDataFrame(chain + star + [(9, 9)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components(df).collect()}
    assert roots == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 700)}}
    assert components(df.limit(0)).count() == 0


def test_stage_keeps_one_row_of_each_group(spark):
    rows = [(i, t, "en", "s", 1, f"r{k}") for k, (i, t) in enumerate(EDGES)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, root string")
    out = dedup_stage(df)
    assert out.columns == df.columns and dict(out.dtypes) == dict(df.dtypes)
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(kept) == len({w[2] for w in want(EDGES)})
    assert {i for i, _ in kept} == {w[2] for w in want(EDGES)}


def test_stage_keeps_rows_as_they_are(spark):
    """Repeated ids and texts: microseconds, decimals, maps and nulls of the kept row are not touched."""
    import datetime
    from decimal import Decimal

    at = datetime.datetime(2024, 1, 2, 3, 4, 5, 123456)
    rows = [(1, "same text here", at, Decimal("1.10"), {"a": None}, (None, 2)), (1, "same text here", at, Decimal("1.20"), {"a": None}, (None, 2))]
    kind = "doc_id long, text string, at timestamp, price decimal(38,18), m map<string,int>, s struct<x:int,y:int>"
    df = spark.createDataFrame(rows, kind)
    (kept,) = dedup_stage(df).collect()
    assert kept in df.collect()
