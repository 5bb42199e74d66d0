"""Packing documents into sequences of at most ``size`` tokens.

Whole sequences are cut off the front of a document; what is left is packed by
the histogram of its lengths. Lengths are placed longest first, each into the
emptiest packs that still have room, all packs of one filling pattern at once;
a new pack is opened only where nothing fits. The state is a list of patterns
with counts, never a list of documents. Packs left with a gap are then closed:
the emptiest are taken apart, and their pieces, cut where they must be, fill the
fullest. Of the last pack sequences of powers of two are made, which need no
padding.

A pattern's item is a length with a range of ranks, so patterns are joined back
to documents by (length, rank). The rank is the place of a document among those
of its length: its place within the task that tokenised it, which is written
with the tokens, plus what earlier tasks hold of that length. No window or
group holds the documents of one length.
"""

from __future__ import annotations

import heapq
import os
import zlib
from bisect import insort
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.functions.joins import attach
from tabloom.llm.common import table
from tabloom.llm.registry import query
from tabloom.session import stored

SLICE_BYTES = 8 << 20
# fixed values: letters that are composed already and whose lower case is one letter (all of Latin but U+0130)
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
MARKS = ".,;:!?"


@dataclass(frozen=True)
class PackSettings:
    size: int = 4096  # tokens of a sequence
    min_piece: int = 32  # a gap below this is padded and not filled by a cut
    end_id: int = 2  # put after each document


class Parts:
    """Ids of word parts by one tokenizer, kept for the parts to come up to ``most`` of them."""

    def __init__(self, tokenizer, most: int = 250_000):
        self.tokenizer, self.most = tokenizer, most
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {}
        self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def rows(self, parts: list[str], at_once: int = 20_000) -> np.ndarray:
        """The number of each part; its ids are ``ids[first:first + size]`` of that row."""
        new = [w for w in parts if w not in self.row]
        if self.row and len(self.row) + len(new) > self.most:
            self._clear()
            new = parts
        sizes, ids = [self.size], [self.ids]
        for at in range(0, len(new), at_once):
            some = new[at : at + at_once]
            coded = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(coded.ids, np.uint32))
            sizes.append(np.bincount(np.array(coded.word_ids, np.int64), minlength=len(some)))
        self.row.update(zip(new, range(len(self.size), len(self.size) + len(new))))
        self.size, self.ids = np.concatenate(sizes), np.concatenate(ids)
        return np.fromiter(map(self.row.__getitem__, parts), np.int64, len(parts))


@lru_cache(maxsize=4)
def _loaded(path: str) -> tuple[Parts, Parts]:
    """Per worker: parts by the whole tokenizer, and Latin letters by its model alone."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    letters = Tokenizer(whole.model)
    letters.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
    return Parts(whole), Parts(letters)


@dataclass(frozen=True)
class WordTokenizer:
    """A ``tokenizers`` file that lower-cases, drops white space and parts letters from punctuation.

    Words between ASCII white space then have ids of their own, and so have the
    letters of a word and the punctuation behind them. Each distinct part is
    encoded once and kept for a while; Latin letters go straight to the model.
    """

    path: str

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(token count of each text, ids of all texts in a row)."""
        whole, letters = _loaded(self.path)
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        known, code = coded.dictionary, np.asarray(coded.indices, np.int64)
        plain = np.asarray(pc.match_substring_regex(known, f"^[{LATIN}]+[{MARKS}]*$"), bool)
        simple = known.filter(pa.array(plain))
        stem = pc.utf8_lower(pc.ascii_rtrim(simple, MARKS)).dictionary_encode()
        tail = pc.replace_substring_regex(simple, f"[{LATIN}]+", "").dictionary_encode()
        stem_row = letters.rows(stem.dictionary.to_pylist())[np.asarray(stem.indices, np.int64)]
        # both lists at once: the second call may clear what the first has kept
        odd = known.filter(pa.array(~plain)).to_pylist()
        other = whole.rows(odd + tail.dictionary.to_pylist())
        odd_row, tail_row = other[: len(odd)], other[len(odd) :][np.asarray(tail.indices, np.int64)]
        # ids of each distinct word: those of its letters, then those of its marks
        size = np.concatenate([letters.size, whole.size, [0]])
        ids = np.concatenate([letters.ids, whole.ids])
        first = np.cumsum(size) - size
        two = np.full((len(known), 2), len(size) - 1)
        two[plain, 0], two[plain, 1] = stem_row, len(letters.size) + tail_row
        two[~plain, 0] = len(letters.size) + odd_row
        ids = ids[spread(first[two.ravel()], size[two.ravel()])]
        size = size[two].sum(axis=1)
        first = np.cumsum(size) - size
        sizes = size[code]
        ends = np.r_[0, np.cumsum(sizes)][np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py()]
        return np.diff(ends), ids[spread(first[code], sizes)]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (sizes[0] numbers), starts[1], ..."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of at most SLICE_BYTES of text, one row at least."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + SLICE_BYTES, "right")))
        yield at, to
        at = to


def _tokenised(tokenizer: WordTokenizer, settings: PackSettings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before = np.zeros(settings.size, np.int64)  # documents per rest so far
        whole = 0
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for at, to in _slices(texts):
                n, ids = tokenizer.encode(texts.slice(at, to - at))
                # the end id after each document
                ids = np.insert(ids, np.cumsum(n), settings.end_id).astype("<u4")
                n = n + 1
                rest, wholes = n % settings.size, n // settings.size
                order = np.argsort(rest, kind="stable")
                count = np.bincount(rest, minlength=settings.size)
                place = np.empty(len(n), np.int64)
                place[order] = np.arange(len(n)) - np.repeat(np.cumsum(count) - count, count)
                place += before[rest]
                before += count
                ends = np.cumsum(n) * 4
                raw = pa.Array.from_buffers(
                    pa.large_binary(), len(n), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(ids)]
                ).cast(pa.binary())
                done = whole + np.cumsum(wholes) - wholes
                whole += int(wholes.sum())
                yield pa.record_batch(
                    [batch.column(0).slice(at, to - at), raw]
                    + [pa.array(c) for c in (n, np.full(len(n), part), rest, place, wholes, done)],
                    names=["doc_id", "ids", "doc_tokens", "part", "rest", "place", "wholes", "done"],
                )

    return run


# -- the plan: patterns with counts ------------------------------------------------------------


@dataclass
class Item:
    """A piece of every pack of a group: tokens [start, start+length) of the rest
    of the document of length ``rest`` with rank ``base`` + shifts + pack."""

    rest: int
    start: int
    length: int
    base: int
    below: Item | None
    below_shift: int


@dataclass
class Group:
    """``count`` packs of one pattern with ``gap`` tokens free."""

    gap: int
    count: int
    top: Item | None = None
    shift: int = 0

    def put(self, rest: int, start: int, length: int, base: int) -> None:
        self.top = Item(rest, start, length, base, self.top, self.shift)
        self.shift, self.gap = 0, self.gap - length

    def split(self, k: int) -> Group:
        """Keep the first ``k`` packs and return the others."""
        other = Group(self.gap, self.count - k, self.top, self.shift + k)
        self.count = k
        return other

    def pop(self) -> tuple[int, int, int, int]:
        item = self.top
        found = item.rest, item.start, item.length, item.base + self.shift
        self.top, self.shift, self.gap = item.below, self.shift + item.below_shift, self.gap + item.length
        return found

    def items(self) -> list[tuple[int, int, int, int]]:
        """From the first placed to the last."""
        out, item, shift = [], self.top, self.shift
        while item is not None:
            out.append((item.rest, item.start, item.length, item.base + shift))
            item, shift = item.below, shift + item.below_shift
        return out[::-1]


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[Group]:
    """Groups that hold every document rest of ``histogram`` (length -> count)."""
    heap: list[tuple[int, int, Group]] = []
    full: list[Group] = []
    made = 0

    def keep(group: Group) -> None:
        nonlocal made
        if group.gap:
            heapq.heappush(heap, (-group.gap, made, group))
            made += 1
        else:
            full.append(group)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if heap and -heap[0][0] >= length:
                group = heapq.heappop(heap)[2]
                if group.count > left:
                    keep(group.split(left))
                group.put(length, 0, length, rank)
                placed = group.count
                keep(group)
            else:
                # opened one by one, each new pack would take what follows until it is full
                each = size // length
                group = Group(size, left // each or 1)
                placed = 0
                while placed < left and group.gap >= length and left - placed >= group.count:
                    group.put(length, 0, length, rank + placed)
                    placed += group.count
                keep(group)
            left -= placed
            rank += placed
    return full + [g for _, _, g in sorted(heap, key=lambda x: (-x[0], x[1]))]


def close_gaps(groups: list[Group], size: int, min_piece: int) -> list[Group]:
    """Take the emptiest packs apart to fill the gaps of the fullest."""

    def padded(group: Group) -> bool:
        fill = size - group.gap
        return group.gap >= min_piece and fill & (fill - 1) != 0

    done: list[Group] = []
    open_: dict[int, list[Group]] = {}  # by size of count, emptiest last: a step moves about as many packs as there are

    def keep(group: Group) -> None:
        if not padded(group):
            done.append(group)
        else:
            insort(open_.setdefault(group.count.bit_length(), []), group, key=lambda g: g.gap)

    for group in groups:
        keep(group)
    while open_:
        most = max(open_)
        row = open_[most]
        taker, giver = row.pop(0), row.pop() if row else None
        if not row:
            del open_[most]
        if giver is None:
            if taker.count == 1:
                done += _powers(taker, size)
            else:
                keep(taker.split(taker.count // 2))
                keep(taker)
            continue
        k = min(taker.count, giver.count)
        for group in (taker, giver):
            if group.count > k:
                keep(group.split(k))
        rest, start, length, base = giver.pop()
        take = min(length, taker.gap)
        taker.put(rest, start, take, base)
        if take < length:
            giver.put(rest, start + take, length - take, base)
        keep(taker)
        if giver.top is not None:
            keep(giver)
    return done


def _powers(group: Group, size: int) -> list[Group]:
    """Sequences of powers of two, which need no padding, from one pack."""
    out: list[Group] = []
    left = size - group.gap
    items = deque(group.items())
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        made = Group(size, 1)
        while room:
            rest, start, length, base = items.popleft()
            take = min(length, room)
            made.put(rest, start, take, base)
            room -= take
            if take < length:
                items.appendleft((rest, start + take, length - take, base))
        out.append(made)
    return out


@dataclass(frozen=True)
class Plan:
    """Where each document rest goes, in arrays.

    ``keys`` opens intervals of rest * SPAN + rank; the documents of interval i
    have the pieces ``first[i]`` to ``first[i + 1]``. There are at most two groups
    for each length below ``size``, whatever the number of documents, and a group
    has at most ``size`` items, so the arrays stay within a few MB on text.
    """

    keys: np.ndarray
    first: np.ndarray
    origin: np.ndarray  # rank that has ``sequence``; the next rank has the next sequence
    start: np.ndarray
    length: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    n_sequences: int
    padding: int


SPAN = 1 << 48


def pack_plan(histogram: dict[int, int], settings: PackSettings) -> Plan:
    size = settings.size
    groups = close_gaps(shortest_pack_first(histogram, size), size, settings.min_piece)
    rows: list[tuple[int, ...]] = []
    n_sequences = padding = 0
    for group in groups:
        offset = 0
        for rest, start, length, base in group.items():
            rows.append((rest * SPAN + base, rest * SPAN + base + group.count, base, start, length, n_sequences, offset))
            offset += length
        n_sequences += group.count
        padding += 0 if offset & (offset - 1) == 0 else (size - offset) * group.count
    low, high, origin, start, length, sequence, offset = np.array(rows, np.int64).reshape(-1, 7).T
    keys = np.unique(np.concatenate([low, high]))
    at, to = np.searchsorted(keys, low), np.searchsorted(keys, high)
    # pieces of one document may lie in groups of other rank ranges: cut to common intervals
    item = np.repeat(np.arange(len(low)), to - at)
    interval = spread(at, to - at)
    order = np.lexsort((start[item], interval))
    item, interval = item[order], interval[order]
    first = np.searchsorted(interval, np.arange(len(keys) + 1))
    parts = [c[item] for c in (origin, start, length, sequence, offset)]
    return Plan(keys, first, *parts, n_sequences, padding)


# -- joining the plan back ---------------------------------------------------------------------

_PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pieces(plan: Plan, settings: PackSettings, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = lambda n: np.asarray(batch.column(batch.schema.get_field_index(n)), np.int64)
            n, rest, wholes = col("doc_tokens"), col("rest"), col("wholes")
            rank = col("place") + col("base")
            row = np.arange(len(n))
            # whole sequences
            own = np.repeat(row, wholes)
            nth = spread(np.zeros_like(wholes), wholes)
            number = plan.n_sequences + (col("whole_base") + col("done"))[own] + nth
            parts = [(own, nth * settings.size, np.full(len(own), settings.size), number, np.zeros_like(nth))]
            # what is left
            left = np.flatnonzero(rest)
            if len(left):
                interval = np.searchsorted(plan.keys, rest[left] * SPAN + rank[left], "right") - 1
                at, to = plan.first[interval], plan.first[interval + 1]
                doc, item = np.repeat(left, to - at), spread(at, to - at)
                start = wholes[doc] * settings.size + plan.start[item]
                number = plan.sequence[item] + rank[doc] - plan.origin[item]
                parts.append((doc, start, plan.length[item], number, plan.offset[item]))
            own, start, length, number, offset = (np.concatenate(c) for c in zip(*parts))
            raw = [memoryview(x) for x in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
            cut = [raw[i][4 * a : 4 * (a + b)] for i, a, b in zip(own.tolist(), start.tolist(), length.tolist())]
            crc = np.fromiter((zlib.crc32(c) for c in cut), np.int64, len(cut))
            columns = [batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(own))]
            columns += [pa.array(c) for c in (start, length, crc, n[own], number, offset)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([bytes(c) for c in cut], pa.binary()))
                names.append("ids")
            yield pa.record_batch(columns, names=names)

    return run


@dataclass(frozen=True)
class Packed:
    """``tokens``: a row per document with its ids and place. ``plan``: the patterns."""

    tokens: DataFrame
    plan: Plan
    settings: PackSettings

    def pieces(self, with_ids: bool = False) -> DataFrame:
        """A row per piece: document, start and length there, sequence and offset there."""
        kind = dict(self.tokens.dtypes)["doc_id"]
        schema = f"doc_id {kind}, {_PIECE}" + ", ids binary" * with_ids
        return self.tokens.mapInArrow(_pieces(self.plan, self.settings, with_ids), schema)

    def sequences(self) -> DataFrame:
        """(sequence_id, n_tokens, ids binary, doc_starts): the packed sequences, unpadded.

        ``doc_starts`` are the offsets at which another document begins. A group
        holds one sequence, so at most ``size`` tokens.
        """
        whole = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
        return self.pieces(True).groupBy("sequence_id").agg(whole.alias("_p")).select(
            "sequence_id",
            F.aggregate("_p", F.lit(0).cast("long"), lambda a, p: a + p["length"]).alias("n_tokens"),
            F.aggregate("_p", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
            F.transform("_p", lambda p: p["offset"]).alias("doc_starts"),
        )


def pack(docs: DataFrame, tokenizer: WordTokenizer, settings: PackSettings = PackSettings()) -> Packed:
    """Pack every row of ``docs`` (doc_id, text).

    A null text counts as empty; every document ends with ``end_id``, so an
    empty one has one token. Rows repeated in id or text are documents of their
    own. A text of any length is one row of one task, and gives one piece per
    whole sequence. An empty table gives no piece. Other columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, ids binary, doc_tokens long, part long, rest long, place long, wholes long, done long"
    tokens = stored(docs.select("doc_id", "text").mapInArrow(_tokenised(tokenizer, settings), schema), "tokens")
    # rows per task and length; the whole sequences of a task stand under the length -1
    counts = tokens.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("n"), F.sum("wholes").alias("wholes"))
    wholes = counts.groupBy("part").agg(F.sum("wholes").alias("n"))
    both = counts.select("part", "rest", "n").unionByName(wholes.select("part", F.lit(-1).cast("long").alias("rest"), "n"))
    earlier = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = both.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    bases = stored(bases, "bases")
    of_task = bases.where("rest = -1").select("part", F.col("base").alias("whole_base"))
    histogram = {
        r["rest"]: r["n"] for r in bases.where("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect()
    }
    placed = attach(
        tokens, bases.where("rest >= 0").join(of_task, "part"), ["part", "rest"], how="inner", weight="n"
    )
    return Packed(placed, pack_plan(histogram, settings), settings)


@query("op11_packing")
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of the whole ``documents`` packed to 4096 tokens."""
    import public_tokenizers

    tokenizer = WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    return pack(table(spark, sf_dir, "documents"), tokenizer).pieces()
