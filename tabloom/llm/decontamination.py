"""Benchmark decontamination by latent semantic retrieval.

1. Every document becomes a sequence of benchmark word codes (0: a word that no
   item has), stored once; all later steps read the codes, not the texts.
2. Passages are windows of ``passage_words`` words. Passage frequencies over
   all documents give the TF-IDF weights.
3. A randomised SVD of the weighted passages: every task multiplies its rows by
   a random matrix and by their own transpose, the products are summed by word
   in a shuffle, and the driver factors the sum, whose size depends on the
   benchmark block alone (Nystrom form, one pass over the passages). The items
   are passages as well, with a weight that keeps their directions. The basis is
   fitted on all passages; a task sums products of word pairs first, of which a
   passage has few, and meets the random matrix once.
4. Passages are compared with the items by cosine in the latent space.
5. Around a candidate passage the longest common subsequence with the item
   decides; a paraphrase, with a shorter one, must hold the item's answer too.

The benchmark is taken in blocks of at most ``block_items`` items and
``block_bytes`` bytes, so what is held by the driver and the tasks is bounded
whatever the benchmark's size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import table
from tabloom.llm.registry import query
from tabloom.session import stored

SLICE_DOCS = 2000
#: commonest words of a block whose pairs a task keeps sums of, 64 MB at most
PAIR_WORDS = 4096
PUNCTUATION = ".,;:!?\"'()[]{}<>«»„“”‘’…*#|-–—"


@dataclass(frozen=True)
class LeakSettings:
    passage_words: int = 64
    spare_rank: int = 32  # latent dimensions beyond the number of items
    oversampling: int = 24
    item_weight: float = 10.0  # energy of all items, as a multiple of all passages'
    min_cosine: float = 0.4
    copied: float = 0.8  # share of an item's words, in order, that make a copy
    paraphrased: float = 0.6  # share that makes a paraphrase if the answer is there
    answer_share: float = 0.2  # the last words of an item are its answer
    answer_found: float = 0.8
    slack: float = 1.3  # length of the text searched for an item, as a multiple
    short_words: int = 8  # a shorter item must stand in the text word by word
    block_items: int = 500
    block_bytes: int = 4 << 20
    basis_passages: int | None = None  # fits the basis on about as many passages of documents chosen by hash; None: on all
    seed: int = 5


@dataclass
class Block:
    """A part of the benchmark: items as code sequences over their own words."""

    ids: list
    items: list[np.ndarray]
    words: pa.Array


def tokens(texts: pa.Array) -> pa.ListArray:
    """Lower-case words without the punctuation around them."""
    split = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    bare = pc.utf8_trim(split.values, characters=PUNCTUATION)
    return pa.ListArray.from_arrays(split.offsets, bare)


def blocks(benchmark: DataFrame, settings: LeakSettings) -> Iterator[Block]:
    """Items in bounded blocks; null and wordless items match nothing."""
    rows = benchmark.select("item_id", "text").where("text is not null").distinct()
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    n = max(math.ceil(size["n"] / settings.block_items), math.ceil((size["b"] or 0) / settings.block_bytes))
    # as many blocks again, since a hash does not fill them evenly
    n = n if n <= 1 else 2 * n
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        split = [[w for w in t if w] for t in tokens(pa.array([r["text"] for r in part], pa.string())).to_pylist()]
        ids = [r["item_id"] for r, t in zip(part, split) if t]
        split = [t for t in split if t]
        if not split:
            continue
        words = sorted({w for t in split for w in t})
        code = {w: i + 1 for i, w in enumerate(words)}
        yield Block(ids, [np.array([code[w] for w in t], np.int32) for t in split], pa.array(words, pa.string()))


def _width(n_words: int) -> str:
    return "<u2" if n_words < 1 << 16 else "<u4"


def coded_documents(docs: DataFrame, block: Block, settings: LeakSettings, slice_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, text_key, codes, tally): each word of a text as its benchmark code.

    ``tally`` is set on one row of each slice of documents: the slice's passages
    in place 0, and how many of them hold each word.
    """
    words, width, kind = block.words, settings.passage_words, _width(len(block.words))
    id_kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
            group = np.cumsum(sizes) // slice_bytes
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(sizes)]]) if len(sizes) else []
            for a, b in zip(cuts[:-1], cuts[1:]):
                part = batch.slice(a, b - a)
                split = tokens(part.column(2))
                found = pc.fill_null(pc.index_in(split.values, value_set=words), -1)
                flat = (found.to_numpy(zero_copy_only=False) + 1).astype(kind)
                at = split.offsets.to_numpy()
                codes = [flat[i:j] for i, j in zip(at[:-1], at[1:])]
                _, code, _, doc, _ = _passages(codes, width, len(words))
                total = np.bincount(code, minlength=len(words) + 1).astype("<i8")
                total[0] = len(doc)
                tally = [total.tobytes()] + [None] * (len(codes) - 1)
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(tally, pa.binary())],
                    names=["doc_id", "text_key", "codes", "tally"],
                )

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, f"doc_id {id_kind}, text_key long, codes binary, tally binary")


def _passages(codes: list[np.ndarray], width: int, n_words: int, useful: np.ndarray | None = None):
    """(passage, code, count) triples of a batch, sorted, and each passage's document and place.

    Only codes marked in ``useful`` give triples.
    """
    lengths = np.array([len(c) for c in codes], np.int64)
    per_doc = -(-lengths // width)
    first = np.concatenate([[0], np.cumsum(per_doc)])
    doc = np.repeat(np.arange(len(codes)), per_doc)
    place = np.arange(first[-1]) - np.repeat(first[:-1], per_doc)
    flat = np.concatenate(codes) if codes else np.zeros(0, np.int32)
    hit = np.flatnonzero(flat if useful is None else useful[flat])
    begin = np.concatenate([[0], np.cumsum(lengths)])
    owner = np.searchsorted(begin, hit, side="right") - 1
    passage = first[owner] + (hit - begin[owner]) // width
    key, count = np.unique(passage * (n_words + 1) + flat[hit], return_counts=True)
    return key // (n_words + 1), key % (n_words + 1), count, doc, place


def _weighted(passage: np.ndarray, code: np.ndarray, count: np.ndarray, idf: np.ndarray):
    """TF-IDF triples with unit length per passage; passages without weight drop out."""
    value = (1 + np.log(count)) * idf[code]
    keep = value > 0
    passage, code, value = passage[keep], code[keep], value[keep]
    if not len(passage):
        return passage, code, value, np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    norm = np.sqrt(np.add.reduceat(value * value, starts))
    return passage, code, value / np.repeat(norm, np.diff(np.append(starts, len(value)))), starts


def _projected(code, value, starts, basis: np.ndarray) -> np.ndarray:
    """Rows of the sparse passages times ``basis``: the k-th entries of all rows at once."""
    out = np.zeros((len(starts), basis.shape[1]), np.float32)
    sizes = np.diff(np.append(starts, len(code)))
    order = np.argsort(-sizes, kind="stable")
    at, left, value = starts[order], sizes[order], value.astype(np.float32)
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k, side="left"))  # rows with more than k entries
        part = basis[code[at[:n] + k]]
        part *= value[at[:n] + k, None]
        out[:n] += part
    back = np.empty_like(out)
    back[order] = out
    return back


def _codes(column: pa.Array, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def passage_counts(coded: DataFrame, n_words: int) -> tuple[np.ndarray, int]:
    """Passages that hold each word, and the number of all passages (code 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_words + 1, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), "<i8")
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["code", "n"])

    tallies = coded.select("tally").where("tally is not null")
    summed = tallies.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = np.zeros(n_words + 1, np.int64)
    for r in summed.collect():  # at most one row per word of the block
        counts[r["code"]] = r["n"]
    n = int(counts[0])
    counts[0] = 0
    return counts, n


def _random(n_words: int, width: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((n_words + 1, width)).astype(np.float32)


def _gram_times(triples, omega: np.ndarray, out: np.ndarray, chunk_rows: int = 4096) -> None:
    """Add X'(X omega) of weighted passages to ``out``."""
    _, code, value, starts = triples
    ends = np.append(starts[1:], len(code))
    for at in range(0, len(starts), chunk_rows):
        rows = slice(at, min(at + chunk_rows, len(starts)))
        a, b = starts[rows][0], ends[rows][-1]
        y = _projected(code[a:b], value[a:b], starts[rows] - a, omega)
        row = np.repeat(np.arange(len(y)), ends[rows] - starts[rows])
        order = np.argsort(code[a:b], kind="stable")
        by_code, heads = code[a:b][order], None
        for lo in range(0, len(order), 1 << 15):
            part = order[lo : lo + (1 << 15)]
            c = by_code[lo : lo + (1 << 15)]
            heads = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            out[c[heads]] += np.add.reduceat(y[row[part]] * value[a:b][part, None].astype(np.float32), heads, axis=0)


class PairSums:
    """X'X of weighted passages that hold only the commonest words of a block.

    Words are ranked by frequency, so most sums lie close together in memory.
    """

    def __init__(self, idf: np.ndarray, most: int = PAIR_WORDS):
        self.words = 1 + np.argsort(idf[1:], kind="stable")[:most]
        self.rank = np.full(len(idf), -1, np.int64)
        self.rank[self.words] = np.arange(len(self.words))
        self.upper = np.zeros(len(self.words) ** 2, np.float32)

    def add(self, triples, chunk_rows: int = 2048):
        """Add the passages; those with a rarer word are given back."""
        passage, code, value, starts = triples
        if not len(starts):
            return triples
        rank, sizes = self.rank[code], np.diff(np.append(starts, len(code)))
        mine = np.repeat(np.minimum.reduceat(rank, starts) >= 0, sizes)
        rest = passage[~mine], code[~mine], value[~mine]
        left = rest[0]
        rest = (*rest, np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]])) if len(left) else np.zeros(0, np.int64))
        passage, rank, value = passage[mine], rank[mine], value[mine].astype(np.float32)
        order = np.argsort(passage * len(self.words) + rank)
        passage, rank, value = passage[order], rank[order], value[order]
        first = np.arange(passage[0], passage[-1] + 1, chunk_rows) if len(passage) else ()
        cuts = [*np.searchsorted(passage, first), len(passage)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            self._add(passage[a:b], rank[a:b], value[a:b])
        return rest

    def _add(self, passage: np.ndarray, rank: np.ndarray, value: np.ndarray) -> None:
        # the k-th next word of the same passage, for all words at once; the diagonal counts half, once in either triangle
        row, at, k = rank * len(self.words), np.arange(len(rank)), 0
        while len(at):
            product = value[at] * value[at + k]
            np.add.at(self.upper, row[at] + rank[at + k], product if k else product / 2)
            k += 1
            at = at[: np.searchsorted(at, len(rank) - k)]
            at = at[passage[at] == passage[at + k]]

    def times(self, omega: np.ndarray, out: np.ndarray) -> None:
        """Add X'X omega to ``out``."""
        half = self.upper.reshape(len(self.words), -1)
        picked = omega[self.words]
        out[self.words] += half @ picked
        out[self.words] += half.T @ picked


def latent_basis(coded: DataFrame, block: Block, idf: np.ndarray, n_passages: int, settings: LeakSettings) -> np.ndarray:
    """Left factors (words by rank) of the randomised SVD of all weighted passages."""
    n_words, width, seed = len(block.words), settings.passage_words, settings.seed
    rank = min(n_words, len(block.items) + settings.spare_rank)
    columns = min(n_words, rank + settings.oversampling)
    piece = 256  # words whose sums travel as one value
    kind = _width(n_words)
    # documents by hash, as many as hold about the wanted number of passages
    parts = max(1, n_passages // settings.basis_passages) if settings.basis_passages else 1
    fitted = coded if parts == 1 else coded.where(F.pmod(F.xxhash64(F.lit(seed), "text_key"), F.lit(parts)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omega = _random(n_words, columns, seed)
        total, pairs = np.zeros((n_words + 1, columns), np.float32), PairSums(idf)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_DOCS):
                codes = _codes(batch.column(0).slice(at, SLICE_DOCS), kind)
                rest = pairs.add(_weighted(*_passages(codes, width, n_words, idf > 0)[:3], idf))
                _gram_times(rest, omega, total)
        pairs.times(omega, total)
        pieces = [(k, total[at : at + piece]) for k, at in enumerate(range(0, n_words + 1, piece))]
        pieces = [(k, x.tobytes()) for k, x in pieces if x.any()]
        yield pa.record_batch(
            [pa.array([k for k, _ in pieces], pa.int64()), pa.array([x for _, x in pieces], pa.binary())], names=["piece", "part"]
        )

    def add(parts: pa.Table) -> pa.Table:
        total = 0.0
        for x in parts["part"]:
            total = total + np.frombuffer(x.as_py(), "<f4").astype(np.float64)
        return pa.table({"piece": parts["piece"][:1], "part": pa.array([total.tobytes()], pa.binary())})

    sums = (
        fitted.select("codes")
        .mapInArrow(run, "piece long, part binary")
        .groupBy("piece")
        .applyInArrow(add, "piece long, part binary")
    )
    z = np.zeros((n_words + 1, columns))
    for r in sums.collect():  # words of the block times rank, whatever the documents
        x = np.frombuffer(bytes(r["part"]), "<f8").reshape(-1, columns)
        z[r["piece"] * piece : r["piece"] * piece + len(x)] = x
    omega = _random(n_words, columns, seed)
    own = np.zeros((n_words + 1, columns), np.float32)
    _gram_times(_item_triples(block, idf, n_words), omega, own)
    # against the passages that were summed, so that items weigh alike at every size
    z += own * (settings.item_weight * max(n_passages / parts, 1) / len(block.items))
    # Nystrom: the Gram matrix is about Z (omega' Z)^-1 Z'
    core = omega.T.astype(np.float64) @ z
    shift = 1e-6 * max(float(np.trace(core)) / max(columns, 1), 1e-12)
    half = np.linalg.cholesky((core + core.T) / 2 + shift * np.eye(columns) + 1e-9 * np.abs(core).max() * np.eye(columns))
    left, _, _ = np.linalg.svd(np.linalg.solve(half, z.T).T, full_matrices=False)
    return left[:, :rank].astype(np.float32)


def _item_triples(block: Block, idf: np.ndarray, n_words: int):
    longest = max(len(x) for x in block.items)
    return _weighted(*_passages(block.items, longest, n_words)[:3], idf)


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit rows."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full, row = (1 << len(a)) - 1, 0
    for x in b.tolist():
        hit = row | where.get(x, 0)
        row = hit & ~(hit - ((row << 1) | 1)) & full
    return row.bit_count()


def verdict(item: np.ndarray, text: np.ndarray, settings: LeakSettings) -> tuple[bool, float]:
    """Whether ``text`` holds the item, and the best share of its words found in order."""
    n = len(item)
    size = n if n < settings.short_words else math.ceil(settings.slack * n)
    step = 1 if n < settings.short_words else max(1, n // 8)
    need = 1.0 if n < settings.short_words else settings.copied
    answer = item[-max(3, math.ceil(settings.answer_share * n)) :]
    found, best = False, 0.0
    inside = np.isin(text, item)
    counts = np.concatenate([[0], np.cumsum(inside)])
    for at in range(0, max(len(text) - size, 0) + step, step):
        piece = text[at : at + size]
        # words of the item, in any order, bound the subsequence
        if counts[min(at + size, len(text))] - counts[min(at, len(text))] < settings.paraphrased * n:
            continue
        share = common_words(item, piece) / n
        same = share >= need or (
            n >= settings.short_words
            and share >= settings.paraphrased
            and common_words(answer, piece) >= settings.answer_found * len(answer)
        )
        found, best = found or same, max(best, share)
    return found, best


def search(coded: DataFrame, block: Block, idf: np.ndarray, basis: np.ndarray, settings: LeakSettings) -> DataFrame:
    """A row per document: its best item, verdict, share and cosine, and its candidates."""
    spark = coded.sparkSession
    n_words, width = len(block.words), settings.passage_words
    kind = _width(n_words)
    _, code, value, starts = triples = _item_triples(block, idf, n_words)
    latent = np.zeros((len(block.items), basis.shape[1]), np.float32)
    if len(starts):
        latent[triples[0][starts]] = _projected(code, value, starts, basis)
    norms = np.linalg.norm(latent, axis=1, keepdims=True)
    latent = np.divide(latent, norms, out=np.zeros_like(latent), where=norms > 0)
    # words x rank and items x rank: bounded by the block
    held = spark.sparkContext.broadcast((idf, basis, latent, block.items))
    names = spark.sparkContext.broadcast(block.ids)
    kinds = dict(coded.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, basis, latent, items = held.value
        ids = names.value
        for whole in batches:
            for first in range(0, whole.num_rows, SLICE_DOCS):
                batch = whole.slice(first, SLICE_DOCS)
                best = found(_codes(batch.column(2), kind), idf, basis, latent, items)
                yield pa.record_batch(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array([x[0] for x in best], pa.bool_()),
                        pa.array([None if x[3] is None else ids[x[3]] for x in best], id_type),
                        pa.array([float(x[1]) for x in best], pa.float64()),
                        pa.array([float(x[2]) for x in best], pa.float64()),
                        pa.array([x[4] for x in best], pa.int64()),
                    ],
                    names=["doc_id", "text_key", "contaminated", "item_id", "lcs_share", "cosine", "n_candidates"],
                )

    def found(codes, idf, basis, latent, items) -> list[tuple]:
        """Per document: verdict, share, cosine and place of its best item, and its candidates."""
        passage, code, count, doc, place = _passages(codes, width, n_words, idf > 0)
        passage, code, value, starts = _weighted(passage, code, count, idf)
        best = [(False, 0.0, 0.0, None, 0)] * len(codes)
        for lo in range(0, len(starts), 8192):
            part = starts[lo : lo + 8192]
            a, b = part[0], (starts[lo + 8192] if lo + 8192 < len(starts) else len(code))
            x = _projected(code[a:b], value[a:b], part - a, basis)
            size = np.linalg.norm(x, axis=1, keepdims=True)
            cosine = np.divide(x, size, out=np.zeros_like(x), where=size > 0) @ latent.T
            for i, k in zip(*np.nonzero(cosine >= settings.min_cosine)):
                p, k = passage[part[i]], int(k)
                d, at = doc[p], place[p] * width
                reach = math.ceil(settings.slack * len(items[k]))
                text = codes[d][max(0, at - reach) : at + width + reach]
                same, share = verdict(items[k], text, settings)
                was, now = best[d], (same, share, float(cosine[i, k]), k)
                better = was[3] is None or (*now[:3], -k) > (*was[:3], -was[3])
                best[d] = (*(now if better else was[:4]), was[4] + 1)
        return best

    id_type = pa.string() if isinstance(block.ids[0], str) else pa.int64()
    id_name = "string" if isinstance(block.ids[0], str) else "long"
    return coded.mapInArrow(
        run,
        f"doc_id {kinds['doc_id']}, text_key long, contaminated boolean, item_id {id_name}, lcs_share double, "
        "cosine double, n_candidates long",
    )


def find_leaks(docs: DataFrame, benchmark: DataFrame, settings: LeakSettings = LeakSettings()) -> DataFrame:
    """(doc_id, text_key, contaminated, item_id, lcs_share, cosine, n_candidates) per row of ``docs``.

    ``item_id`` is the best candidate, contaminated or not, null without one;
    ties go to the larger share, then cosine, then the earlier item. A null or
    empty text is clean. Null items match nothing; without items all documents
    are clean. With several benchmark blocks a document has its best over all.
    """
    out = []
    for block in blocks(benchmark, settings):
        coded = stored(coded_documents(docs, block, settings), "coded")
        counts, n = passage_counts(coded, len(block.words))
        # every word weighs something, also one of all passages: no item is without direction
        idf = np.log((n + 2) / (counts + 1.0))
        idf[0] = 0.0
        basis = latent_basis(coded, block, idf, n, settings)
        out.append(stored(search(coded.drop("tally"), block, idf, basis, settings), "leaks"))
    if not out:
        return docs.select(
            "doc_id",
            F.xxhash64("text").alias("text_key"),
            F.lit(False).alias("contaminated"),
            F.lit(None).cast("long").alias("item_id"),
            F.lit(0.0).alias("lcs_share"),
            F.lit(0.0).alias("cosine"),
            F.lit(0).cast("long").alias("n_candidates"),
        )
    if len(out) == 1:
        return out[0]
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    # every block has a row for each row of docs, so repeated rows come back as often
    best = F.max(F.struct("contaminated", "lcs_share", "cosine", "item_id")).alias("b")
    total, rows = F.sum("n_candidates").alias("n"), (F.count(F.lit(1)) / len(out)).cast("int").alias("copies")
    merged = every.groupBy("doc_id", "text_key").agg(best, total, rows)
    return merged.select(
        "doc_id", "text_key", "b.contaminated", "b.item_id", "b.lcs_share", "b.cosine",
        (F.col("n") / F.col("copies")).cast("long").alias("n_candidates"), F.explode(F.sequence(F.lit(1), "copies")).alias("_copy"),
    ).drop("_copy")


def decontaminate_stage(docs: DataFrame, benchmark: DataFrame, settings: LeakSettings = LeakSettings()) -> DataFrame:
    """The documents that hold no benchmark item; same columns as ``docs``."""
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "doc_id", "text")
    leaks = find_leaks(work, benchmark, settings).where("contaminated").select("doc_id", "text_key").distinct()
    keyed = work.withColumn("text_key", F.xxhash64("text")).alias("d")
    clean = keyed.join(
        stored(leaks, "leaked").alias("l"),
        F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("d.text_key") == F.col("l.text_key")),
        "left_anti",
    )
    return clean.select("_doc.*")


@query("op4_decontamination")
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` against all ``benchmark`` items."""
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_key")
