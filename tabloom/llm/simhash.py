"""Near-duplicates by SimHash fingerprints and BK-trees.

Fingerprints that differ in few bits are linked, and documents are grouped by
reachability over the links. Equal fingerprints are one node, whatever the
number of copies.

Two fingerprints within ``radius`` bits agree in at least one of ``radius + 1``
bands of their bits, so each band value is a shard of its own. A shard that is
still large is dealt again by bands of the bits that are left, which is exact as
well. In each shard a BK-tree is grown: the children of a node are keyed by
their Hamming distance to it, and a search follows only edges whose key is
within the radius of the distance at the node. A search that meets a group
already joined adds no link, so a shard gives fewer links than it has nodes.

Shard trees are not broadcast: together they hold the fingerprints of all
documents. The shuffle brings each shard's fingerprints to the task that grows
and searches its tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import table
from tabloom.llm.components import components
from tabloom.llm.registry import query
from tabloom.session import stored

BITS = 64


@dataclass(frozen=True)
class SimHashSettings:
    shingle_words: int = 3
    radius: int = 3
    seed: int = 42
    shard_rows: int = 4096  # a larger shard is dealt again by its remaining bits


def fingerprint(text: str | None, words: int, seed: int) -> int:
    """Bits set in over half of the XXH64 hashes of a text's shingles."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = [b" ".join(s) for s in zip(*[tokens[k:] for k in range(words)])]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in shingles), np.uint64, len(shingles))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for a very long text
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, settings: SimHashSettings, text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp) with the fingerprint as a signed 64-bit number."""
    words, seed = settings.shingle_words, settings.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            fps = np.array([fingerprint(t, words, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=["doc_id", "text_key", "fp"])

    rows = docs.select("doc_id", F.xxhash64(text_col).alias("text_key"), text_col)
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, fp long")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each number; two shards given one name are only searched together."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _deal(shards: DataFrame, ways: int) -> DataFrame:
    """Copy each row to one shard per band of the bits that its shard left open.

    ``open`` is the mask of bits that the shard does not fix; ``shard`` names
    the bands and values fixed so far.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, masks, names = (batch.column(i).to_numpy().view(np.uint64) for i in range(3))
            for mask in np.unique(masks):
                fp, name = fps[masks == mask], names[masks == mask]
                bits = np.array([b for b in range(BITS) if int(mask) >> b & 1], np.int64)
                for band in np.array_split(bits, ways):
                    cut = np.uint64(sum(1 << int(b) for b in band))
                    shard = _mixed(_mixed(name ^ cut) + (fp & cut))
                    left = np.full(len(fp), mask & ~cut, np.uint64)
                    yield pa.record_batch(
                        [pa.array(x.view(np.int64)) for x in (fp, left, shard)], names=["fp", "open", "shard"]
                    )

    return shards.mapInArrow(run, "fp long, open long, shard long")


class _Tree:
    """A BK-tree that joins what it finds within the radius."""

    def __init__(self, radius: int):
        self.radius, self.values, self.children, self.parent = radius, [], [], []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def add(self, value: int) -> list[int]:
        """Insert a value; return one value of each group that it joins."""
        radius, values, children = self.radius, self.values, self.children
        me, joined = len(values), []
        values.append(value)
        children.append({})
        self.parent.append(me)
        if me == 0:
            return joined
        stack = [0]
        while stack:
            at = stack.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                a, b = self.find(at), self.find(me)
                if a != b:
                    self.parent[b] = a
                    joined.append(values[at])
            kids = children[at]
            if kids:
                if len(kids) <= 2 * radius + 1:
                    stack += [i for k, i in kids.items() if d - radius <= k <= d + radius and i != me]
                else:
                    stack += [kids[k] for k in range(d - radius, d + radius + 1) if k in kids]
        at = 0
        while True:
            d = (values[at] ^ value).bit_count()
            if d not in children[at]:
                children[at][d] = me
                return joined
            at = children[at][d]


def _search(radius: int):
    """Links within the shards of a partition whose rows arrive sorted by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, last = None, None
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64).tolist()
            a, b = [], []
            for shard, value in zip(batch.column(1).to_pylist(), fps):
                if shard != last:
                    tree, last = _Tree(radius), shard
                for other in tree.add(value):
                    a.append(value)
                    b.append(other)
            pairs = [np.array(x, np.uint64).view(np.int64) for x in (a, b)]
            yield pa.record_batch([pa.array(x, pa.int64()) for x in pairs], names=["a", "b"])

    return run


def fingerprint_links(nodes: DataFrame, settings: SimHashSettings) -> DataFrame:
    """Links (a, b) that connect all of ``nodes`` (fp, distinct) within the radius."""
    ways = settings.radius + 1
    full = nodes.select("fp", F.lit(-1).cast("long").alias("open"), F.lit(0).cast("long").alias("shard"))
    links = []
    while True:
        shards = stored(_deal(full, ways), "shards")
        sizes = stored(shards.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
        fit = shards.join(sizes.where(F.col("n") <= settings.shard_rows).select("shard"), "shard")
        found = (
            fit.select("fp", "shard")
            .repartition("shard")
            .sortWithinPartitions("shard", "fp")
            .mapInArrow(_search(settings.radius), "a long, b long")
        )
        links.append(stored(found, "found"))
        # a shard with no bits left open holds one fingerprint, so this ends
        large = sizes.where(F.col("n") > settings.shard_rows).select("shard")
        if large.isEmpty():
            break
        full = shards.join(large, "shard").select("fp", "open", "shard")
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(
    docs: DataFrame, settings: SimHashSettings = SimHashSettings(), text_col: str = "text"
) -> DataFrame:
    """(doc_id, text_key, fingerprint, root, component_id) for every row of ``docs``.

    ``component_id`` is the least doc_id reachable over links of at most
    ``radius`` bits, and ``root`` the least fingerprint; the id is null only if no document of the group has an id. Texts
    without words, nulls among them, have fingerprint zero and are linked like
    any other. Repeated rows share a fingerprint. An empty table gives an empty
    table.
    """
    marked = stored(fingerprints(docs, settings, text_col), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    linked = components(fingerprint_links(nodes, settings))
    grouped = nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    ids = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = grouped.select("fp", "root").join(ids, "root")
    return marked.join(by_fp, "fp").select(
        "doc_id",
        "text_key",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "root",
        "component_id",
    )


def dedup_stage(docs: DataFrame, settings: SimHashSettings = SimHashSettings()) -> DataFrame:
    """One document of each group: the one with the least id; same columns as ``docs``.

    Among rows of that id, the one whose text hashes least; of repeated rows,
    one. A group without ids keeps the row whose text hashes least.
    """
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "doc_id", "text")
    groups = near_duplicates(work, settings)
    has_id = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    keep = (
        groups.groupBy("root")
        .agg(F.min(has_id).alias("k"))
        .select("k.doc_id", "k.text_key")
    )
    same = groups.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    chosen = stored(
        same.alias("s")
        .join(
            keep.alias("k"),
            F.col("s.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("s.text_key") == F.col("k.text_key")),
            "left_semi",
        ),
        "chosen",
    )
    keyed = work.withColumn("text_key", F.xxhash64("text")).alias("d")
    found = keyed.join(
        chosen.alias("c"),
        F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.text_key") == F.col("c.text_key")),
    )
    single = found.where("c.n = 1").select("d._doc")
    # rows that share id and text: the first by their other columns as text, kept as it is
    many = (
        found.where("c.n > 1")
        .groupBy("d.doc_id", "d.text_key")
        .agg(F.min_by("d._doc", F.col("d._doc").cast("string")).alias("_doc"))
        .select("_doc")
    )
    return single.unionByName(many).select("_doc.*")


@query("op3_simhash")
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every one of the whole ``documents``."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")
