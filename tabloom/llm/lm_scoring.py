"""Language-model scores by a weighted backoff automaton.

States are the contexts of a smoothed n-gram model, arcs its n-grams, and a
failure arc leads from a context to the one without its first word. A text is
read once from left to right: the state is carried, an arc that exists adds its
weight, a missing one adds the weight of the failure arc and is tried again
from the shorter context.

The model is counted over all training documents and no task holds it whole.
Documents are cut into blocks of bounded size, stored with their words as
numbers of the block. For each order, a block asks for the counts of its own
n-grams: the requests are shuffled to shards, which sum them over all blocks
and answer. A block's automaton then has all states and arcs that its texts
can reach. Only n-grams that another block can have are asked for: an answer
also tells whether a block was the only one to ask, and an n-gram whose context
or whose suffix only this block has is counted here, its context's shard being
told just how many such followers there are. A context becomes a state once it
has ``min_context`` occurrences in training.

An n-gram is dealt by its context, so that the shard also knows the context's
number of different followers; a context with more than ``hot_context``
occurrences is dealt over several shards by follower. Words are known by their
64-bit XXH64 and followers by 48 bits within their context.

Smoothing is interpolated absolute discounting,
p(w|h) = (c(hw) - D) / c(h) + D t(h) / c(h) p(w|h'), with t(h) the number of
followers, D = n1 / (n1 + 2 n2) per order from the counts of counts, and at the
root the base distribution (c + 0.5) / (N + 0.5 (V + 1)).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import table
from tabloom.llm.registry import query
from tabloom.session import stored

END = xxhash.xxh64_intdigest(b"the end", 0)  # no word holds a space
LOW48 = np.uint64((1 << 48) - 1)
BLOCKS = (
    "block long, doc_ids array<{id}>, held binary, lengths binary, codes binary, hashes binary, counts binary, "
    "n_train long, n_tokens long"
)
REQUESTS = "block long, shard long, contexts binary, followers binary, extra binary, keys binary, counts binary, n1 long, n2 long"
REPLIES = "block long, shard long, totals binary, kinds binary, n1 long, n2 long, distinct_keys long"


@dataclass(frozen=True)
class LmSettings:
    order: int = 3
    min_context: tuple[int, ...] = (1, 1)  # of the contexts of one word, two words, ...
    held_out: int = 1  # remainder of crc32(doc_id) by folds that is not trained on
    folds: int = 5
    block_bytes: int = 8 << 20
    shard_keys: int = 1 << 20  # n-grams of all blocks that a shard gets, about
    hot_context: int = 1 << 19


def packed(a: np.ndarray) -> bytes:
    """Compressed with equal bytes of all numbers side by side."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(b: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def in_training(doc_id: object, settings: LmSettings) -> bool:
    """Documents without an id have no remainder and are trained on."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % settings.folds != settings.held_out


# --- blocks -----------------------------------------------------------------


def _runs(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    at, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield slice(at, i)
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield slice(at, len(sizes))


def text_blocks(docs: DataFrame, settings: LmSettings) -> DataFrame:
    """One row per block: its documents, and their words as numbers of the block."""
    kind = dict(docs.dtypes)["doc_id"]

    def block(number: int, ids: pa.Array, texts: pa.Array) -> list:
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        flat = split.values
        full = pc.greater(pc.binary_length(flat), 0)
        before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        at = split.offsets.to_numpy()
        lengths = (before[at[1:]] - before[at[:-1]]).astype("<i4")
        coded = flat.filter(full).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype("<i4")
        hashes = np.array([xxhash.xxh64_intdigest(w.encode(), 0) for w in coded.dictionary.to_pylist()], "<u8")
        # frequent words first, then by hash: both the codes and the gaps of the hashes pack better
        order = np.lexsort((hashes, -np.bincount(codes, minlength=len(hashes))))
        number_of = np.empty(len(order), "<i4")
        number_of[order] = np.arange(len(order), dtype="<i4")
        codes, hashes = number_of[codes], np.append(hashes[order], np.uint64(END))
        held = np.array([not in_training(i, settings) for i in ids.to_pylist()], bool)
        counts = np.bincount(codes[np.repeat(~held, lengths)], minlength=len(hashes))
        counts[-1] = (~held).sum()
        return [
            number, ids, held.tobytes(), lengths.tobytes(), packed(codes), packed(np.diff(hashes, prepend=np.uint64(0))),
            packed(counts.astype("<i8")), int(counts.sum()), int(lengths.sum() + len(lengths)),
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for part in _runs(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), settings.block_bytes):
                size = part.stop - part.start
                row = block(number, ids.slice(part.start, size), texts.slice(part.start, size))
                number += 1
                kinds = [pa.int64(), None, *[pa.binary()] * 5, pa.int64(), pa.int64()]
                columns = [pa.array([x], k) if k else pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), x) for x, k in zip(row, kinds)]
                yield pa.record_batch(columns, names=names)

    names = ["block", "doc_ids", "held", "lengths", "codes", "hashes", "counts", "n_train", "n_tokens"]
    return docs.select("doc_id", "text").mapInArrow(run, BLOCKS.format(id=kind))


# --- requests of blocks, answers of shards -----------------------------------


def _deal(shard: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of entries by shard, and where each shard begins."""
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(n + 1))


@dataclass
class Level:
    """n-grams of a block: context number and word of each, and each position's (-1: none)."""

    contexts: np.ndarray
    words: np.ndarray
    at: np.ndarray
    suffix: np.ndarray | None  # the n-gram without its first word, at the level below
    counts: np.ndarray | None
    keys: np.ndarray | None  # of the n-grams, to name them as contexts of the next order
    asked: np.ndarray | None = None  # the n-grams that other blocks can have
    totals: np.ndarray | None = None
    alone: np.ndarray | None = None  # n-grams that no other block has
    kinds: np.ndarray | None = None  # different followers, per n-gram as a context


class Block:
    """A block read back, with the answers that came so far."""

    def __init__(self, row: dict, settings: LmSettings, n_shards: int):
        self.settings, self.n_shards, self.row = settings, n_shards, row
        self.hashes = np.cumsum(unpacked(row["hashes"], "<u8"), dtype=np.uint64)
        self.held = np.frombuffer(row["held"], bool)
        lengths = np.frombuffer(row["lengths"], "<i4").astype(np.int64)
        self.sizes = lengths + 1
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        ends = self.starts + lengths
        self.stream = np.full(int(self.sizes.sum()), len(self.hashes) - 1, np.int32)
        inside = np.ones(len(self.stream), bool)
        inside[ends] = False
        self.stream[inside] = unpacked(row["codes"], "<i4")
        self.train = np.repeat(~self.held, self.sizes)
        word = np.arange(len(self.hashes), dtype=np.int32)
        counts = unpacked(row["counts"], "<i8").astype(np.int32)
        self.levels = [Level(np.zeros(len(word), np.int32), word, self.stream, None, counts, self.hashes)]
        self.first = np.zeros(len(self.stream), bool)
        self.first[self.starts] = True

    def requests(self) -> Iterator[tuple]:
        """Per shard: context keys, how many followers of each are listed and how many
        more are known, hashes of those listed and their training counts. The first
        also has the counts of counts of what only this block has."""
        top = self.levels[-1]
        if len(self.levels) == 1:  # words: the only context is the empty one, split by hash
            order, cuts = _deal((mixed(top.keys) % np.uint64(self.n_shards)).astype(np.int64), self.n_shards)
            for k in np.flatnonzero(np.diff(cuts)):
                part = order[cuts[k] : cuts[k + 1]]
                yield int(k), b"", b"", b"", top.keys[part].astype("<u8").tobytes(), packed(top.counts[part].astype("<i4")), 0, 0
            return
        context, follower, row_keys, _, extra = self._rows()
        order, cuts = _deal((row_keys % np.uint64(self.n_shards)).astype(np.int64), self.n_shards)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        entry = np.argsort(rank[context], kind="stable")
        sizes = np.bincount(context, minlength=len(row_keys))[order]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        raw = follower[entry].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        counts = top.counts[top.asked][entry].astype("<i4")
        own = top.counts[~top.asked]
        news = [int((own == 1).sum()), int((own == 2).sum())]
        for k in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[k], cuts[k + 1]
            yield (
                int(k), row_keys[order[a:b]].astype("<u8").tobytes(), packed(sizes[a:b].astype("<i4")),
                packed(extra[order[a:b]].astype("<i4")), np.ascontiguousarray(raw[ends[a] : ends[b]]).tobytes(),
                packed(counts[ends[a] : ends[b]]), *news,
            )
            news = [0, 0]
        if any(news):  # nothing to ask, but something to tell
            yield 0, b"", packed(sizes[:0].astype("<i4")), packed(sizes[:0].astype("<i4")), b"", packed(counts[:0]), *news

    def _rows(self):
        """Rows (context, part of its followers) that are asked for, and the row and
        follower of each n-gram asked for: every part of a hot context is a row."""
        top, below = self.levels[-1], self.levels[-2]
        there = np.zeros(len(below.totals), bool)
        there[top.contexts] = True
        present = np.flatnonzero(there & ~below.alone)
        parts = -(-below.totals[present] // self.settings.hot_context)
        base = np.concatenate([[0], np.cumsum(parts)])
        local = np.zeros(len(below.totals), np.int32)
        local[present] = np.arange(len(present))
        mine = local[top.contexts[top.asked]]
        follower = mixed(self.hashes[top.words[top.asked]]) & LOW48
        row = base[mine] + (follower % parts[mine].astype(np.uint64)).astype(np.int64)
        row_context = np.repeat(present, parts)
        part = np.arange(base[-1]) - np.repeat(base[:-1], parts)
        keys = mixed(below.keys[row_context] + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        known = np.bincount(top.contexts[~top.asked & (top.counts > 0)], minlength=len(below.totals))
        extra = np.where(part == 0, known[row_context], 0)
        return row, follower, keys, row_context, extra

    def answer(self, replies: list[dict]) -> None:
        """Put the totals of the last level's n-grams in place."""
        top = self.levels[-1]
        replies = sorted(replies, key=lambda r: r["shard"])
        none = [np.zeros(0, np.int64)]
        told = np.concatenate(none + [unpacked(r["totals"], "<i8") for r in replies])
        if len(self.levels) == 1:
            order, _ = _deal((mixed(top.keys) % np.uint64(self.n_shards)).astype(np.int64), self.n_shards)
            top.totals, top.alone = np.zeros(len(top.keys), np.int64), np.zeros(len(top.keys), bool)
            top.totals[order], top.alone[order] = told >> 1, (told & 1).astype(bool)
            return
        below = self.levels[-2]
        context, _, row_keys, row_context, _ = self._rows()
        order, _ = _deal((row_keys % np.uint64(self.n_shards)).astype(np.int64), self.n_shards)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        place = np.flatnonzero(top.asked)[np.argsort(rank[context], kind="stable")]
        top.totals, top.alone = top.counts.astype(np.int64), ~top.asked
        top.totals[place], top.alone[place] = told >> 1, (told & 1).astype(bool)
        below.kinds = np.bincount(top.contexts[top.counts > 0], minlength=len(below.totals))
        below.kinds[row_context] = 0
        np.add.at(below.kinds, row_context[order], np.concatenate(none + [unpacked(r["kinds"], "<i8") for r in replies]))
        below.keys = below.counts = top.asked = None

    def state(self, n: int) -> np.ndarray:
        """Which n-grams of level n (from 1) are contexts."""
        level = self.levels[n - 1]
        return (level.totals >= self.settings.min_context[n - 1]) & (level.words != len(self.hashes) - 1)

    def grow(self) -> None:
        """The n-grams one word longer than those of the last level."""
        top, n_words = self.levels[-1], len(self.hashes)
        context = np.concatenate([[-1], top.at[:-1]]).astype(np.int32)
        context[self.first] = -1
        ok = context >= 0
        ok[ok] = self.state(len(self.levels))[context[ok]]
        grams, local = np.unique(context[ok].astype(np.int64) * n_words + self.stream[ok], return_inverse=True)
        local = local.astype(np.int32)
        at = np.full(len(self.stream), -1, np.int32)
        at[ok] = local
        contexts, words = (grams // n_words).astype(np.int32), (grams % n_words).astype(np.int32)
        counts = np.bincount(local[self.train[ok]], minlength=len(grams)).astype(np.int32)
        keys = mixed(mixed(top.keys[contexts]) + self.hashes[words])
        suffix = words
        if len(self.levels) > 1:
            suffix = np.zeros(len(grams), np.int32)
            suffix[local] = top.at[ok]
        asked = ~(top.alone[contexts] | top.alone[suffix])
        self.levels.append(Level(contexts, words, at, suffix, counts, keys, asked))


def requests_of(block: Block) -> Iterator[pa.RecordBatch]:
    names = ["block", "shard", "contexts", "followers", "extra", "keys", "counts", "n1", "n2"]
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 5, pa.int64(), pa.int64()]
    for r in block.requests():
        yield pa.record_batch([pa.array([x], t) for x, t in zip((block.row["block"], *r), kinds)], names=names)


def _sum_shard(requests: pa.Table) -> pa.Table:
    """Add up what all blocks counted of each key, and answer every block in its own order.

    A total is sent doubled, plus one where no other block asked for the key.
    """
    rows = requests.to_pylist()
    keys, counts, rows_of, contexts, extra = [], [], [], [], []
    words = not any(r["followers"] for r in rows)
    for r in rows:
        counts.append(unpacked(r["counts"], "<i4"))
        if words:
            keys.append(np.frombuffer(r["keys"], "<u8"))
            continue
        raw = np.zeros((len(counts[-1]), 8), np.uint8)
        raw[:, :6] = np.frombuffer(r["keys"], np.uint8).reshape(-1, 6)
        own = np.frombuffer(r["contexts"], "<u8")
        spread = np.repeat(np.arange(len(own)), unpacked(r["followers"], "<i4"))
        contexts.append(own)
        rows_of.append(spread)
        extra.append(unpacked(r["extra"], "<i4"))
        keys.append(mixed(own)[spread] + raw.view("<u8").ravel())
    every = np.concatenate(keys)
    distinct, first, back = np.unique(every, return_index=True, return_inverse=True)
    totals = np.bincount(back, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
    doubled = 2 * totals + (np.bincount(back, minlength=len(distinct)) == 1)
    if not words:
        names, where = np.unique(np.concatenate(contexts), return_inverse=True)
        shift = np.cumsum([0] + [len(c) for c in contexts])[:-1]
        of_entry = where[np.concatenate([s + r for s, r in zip(shift, rows_of)])] if len(every) else np.zeros(0, np.int64)
        kinds = np.bincount(of_entry[first][totals > 0], minlength=len(names))
        kinds = kinds + np.bincount(where, weights=np.concatenate(extra), minlength=len(names)).astype(np.int64)
    out, at, ctx = [], 0, 0
    for i, r in enumerate(rows):
        own = doubled[back[at : at + len(keys[i])]]
        at += len(keys[i])
        told = np.zeros(0, "<i8")
        if not words:
            told = kinds[where[ctx : ctx + len(contexts[i])]].astype("<i8")
            ctx += len(contexts[i])
        news = [int((totals == 1).sum()), int((totals == 2).sum()), int((totals > 0).sum())] if i == 0 else [0, 0, 0]
        out.append((r["block"], r["shard"], packed(own), packed(told), news[0] + r["n1"], news[1] + r["n2"], news[2]))
    kinds_ = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names_ = ["block", "shard", "totals", "kinds", "n1", "n2", "distinct_keys"]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds_)], names=names_)


# --- the automaton ------------------------------------------------------------


@dataclass(frozen=True)
class Figures:
    """Training tokens and words, and the discount of each order from two."""

    tokens: int
    words: int
    discounts: tuple[float, ...]


def automaton(block: Block, figures: Figures):
    """Weights of arcs per order, of failure arcs per context, and depth of the state after each position."""
    words = block.levels[0]
    root = (words.totals + 0.5) / (figures.tokens + 0.5 * (figures.words + 1))
    lower, arcs, fails = root, [np.log10(root)], []
    depth = np.zeros(len(block.stream), np.int64)
    for n, level in enumerate(block.levels[1:], 2):
        below, cut = block.levels[n - 2], figures.discounts[n - 2]
        state = block.state(n - 1)
        total = np.maximum(below.totals, 1)
        back = np.where(state, cut * below.kinds / total, 1.0)
        fails.append(np.log10(np.maximum(back, 1e-300)))
        # the shorter n-gram of each: the same word after the context without its first word
        shorter = level.suffix
        p = np.maximum(level.totals - cut, 0) / total[level.contexts] + back[level.contexts] * lower[shorter]
        seen = level.totals > 0
        arcs.append(np.where(seen, np.log10(np.maximum(p, 1e-300)), np.nan))
        lower = np.where(seen, p, back[level.contexts] * lower[shorter])
        there = below.at >= 0
        there[there] = state[below.at[there]]
        depth[there] = n - 1
    return arcs, fails, depth


def traverse(block: Block, arcs, fails, depth) -> np.ndarray:
    """Log10 probability of each text: all texts of the block are read in step, each with its state."""
    order = np.argsort(-block.sizes, kind="stable")
    starts, sizes = block.starts[order], block.sizes[order]
    score = np.zeros(len(order))
    state = np.zeros(len(order), np.int64)  # length of the context that each text stands in
    active = len(order)
    for step in range(int(sizes[0]) if len(sizes) else 0):
        while active and sizes[active - 1] <= step:
            active -= 1
        at = starts[:active] + step
        now = state[:active]
        open_ = np.arange(active)
        for n in range(len(arcs), 1, -1):
            mine = open_[now[open_] == n - 1]
            if not len(mine):
                continue
            where = at[mine]
            weight = arcs[n - 1][block.levels[n - 1].at[where]]
            hit = ~np.isnan(weight)
            score[mine[hit]] += weight[hit]
            lost = mine[~hit]
            score[lost] += fails[n - 2][block.levels[n - 2].at[at[lost] - 1]]
            now[lost] = n - 2
            done = np.zeros(active, bool)
            done[mine[hit]] = True
            open_ = open_[~done[open_]]
        score[open_] += arcs[0][block.stream[at[open_]]]
        state[:active] = depth[at]
    out = np.empty(len(order))
    out[order] = score
    return out


def _scored(block: Block, figures: Figures) -> pa.RecordBatch:
    root = block.levels[0].totals
    base = np.log10((root + 0.5) / (figures.tokens + 0.5 * (figures.words + 1)))
    per = lambda x: np.add.reduceat(x, block.starts)
    ids = block.row["doc_ids"]
    return pa.record_batch(
        [
            ids,
            pa.array(block.held),
            pa.array(block.sizes),
            pa.array(per((root > 0)[block.stream].astype(np.int64))),
            pa.array(np.full(len(block.sizes), figures.tokens)),
            pa.array(per(base[block.stream])),
            pa.array(traverse(block, *automaton(block, figures))),
        ],
        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


# --- the job ------------------------------------------------------------------


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Blocks one by one, with their document ids left in Arrow."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in batch.schema.names if n != "doc_ids"}
            if "doc_ids" in batch.schema.names:
                row["doc_ids"] = batch.column("doc_ids")[i].values
            yield row


def _restored(row: dict, settings: LmSettings, n_shards: int, answered: int) -> Block:
    block = Block(row, settings, n_shards)
    for n in range(1, answered + 1):
        if n > 1:
            block.grow()
        block.answer(row[f"replies{n}"] or [])
    return block


def score_texts(docs: DataFrame, settings: LmSettings = LmSettings()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``.

    A null text is empty: its only token is the end. Documents without an id
    are trained on. Repeated rows count as often as they occur. Without
    training documents every token has the base probability; an empty table
    gives an empty table.
    """
    kind = dict(docs.dtypes)["doc_id"]
    blocks = stored(text_blocks(docs, settings), "lm_blocks")
    size = blocks.agg(F.sum("n_tokens").alias("n"), F.sum("n_train").alias("train")).first()
    n_shards = max(1, math.ceil((size["n"] or 0) / settings.shard_keys))
    every = ["block", "held", "lengths", "codes", "hashes", "counts"]
    joined, discounts, words = blocks, [], 0
    for n in range(1, settings.order + 1):

        def ask(batches: Iterator[pa.RecordBatch], n: int = n) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                block = _restored(row, settings, n_shards, n - 1)
                if n > 1:
                    block.grow()
                yield from requests_of(block)
                del block  # before the next is restored

        source = joined.select(*every, *[f"replies{k}" for k in range(1, n)])
        replies = stored(
            source.mapInArrow(ask, REQUESTS).groupBy("shard").applyInArrow(_sum_shard, REPLIES), f"lm_replies{n}"
        )
        told = replies.agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2"), F.sum("distinct_keys").alias("v")).first()
        if n == 1:
            words = told["v"] or 0
        else:
            discounts.append((told["n1"] or 0) / max((told["n1"] or 0) + 2 * (told["n2"] or 0), 1) or 0.5)
        mine = replies.groupBy("block").agg(
            F.collect_list(F.struct("shard", "totals", "kinds")).alias(f"replies{n}")
        )
        joined = joined.join(mine, "block", "left")
    figures = Figures(int(size["train"] or 0), int(words), tuple(discounts))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield _scored(_restored(row, settings, n_shards, settings.order), figures)

    return joined.drop("n_train", "n_tokens").mapInArrow(
        score,
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


@query("op5_lm_scoring")
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the whole ``documents``, learned from four fifths of them."""
    return score_texts(table(spark, sf_dir, "documents"))
