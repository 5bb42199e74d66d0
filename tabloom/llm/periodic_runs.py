"""Runs of words: maximal periodic stretches, found on a grammar of the words.

The word ids of a slice of documents are compressed by Re-Pair: in rounds, each
pair that is more frequent than the pairs it overlaps becomes a nonterminal;
what no longer repeats is paired off as a balanced tree. A run is inside the
expansion of one nonterminal and crosses its boundary, so the runs that cross
each boundary are computed once per nonterminal, on one of its occurrences,
moved to all positions of its derivation, and merged to maximal intervals.

A run of at least ``min_length`` words with period q agrees with itself shifted
by q over half its length or more. Words that lie in no window of that size
which the document repeats are in no run, and break the word ids apart before
they are compressed. That is what makes prose cheap: most of it breaks apart.

Everything is done for a slice of documents at once in arrays; a comparison of
two stretches uses names of all blocks of a power of two words, so it is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import let, table, text_or_empty, words
from tabloom.llm.registry import query

SLICE_BYTES = 4 << 20
CHUNK = 1 << 20  # candidates looked at together
MIN_LENGTH = 12


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (sizes[0] numbers), starts[1], ..."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total)


def repeated_words(code: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Which words lie in a window of words that their document has twice.

    Windows are compared by hash; equal hashes of different windows only keep
    more words.
    """
    n = len(code) - window + 1
    if n <= 0:
        return np.zeros(len(code), bool)
    mixed = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    key = mixed[:n].copy()
    for j in range(1, window):
        key = key * np.uint64(6364136223846793005) + mixed[j : n + j]
    at = np.flatnonzero(doc[:n] == doc[window - 1 :])
    key = key[at] ^ (doc[at].astype(np.uint64) * np.uint64(0x94D049BB133111EB))
    order = np.argsort(key)
    same = np.diff(key[order]) == 0
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    starts = at[order[twice]]
    size = len(code) + 1
    edges = np.bincount(starts, minlength=size) - np.bincount(starts + window, minlength=size)
    return np.cumsum(edges)[:-1] > 0


# -- the grammar -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Grammar:
    """Nonterminal k expands to words ``start[k]`` to ``end[k]`` (one of its
    occurrences) with its boundary before ``middle[k]``; it stands at the places
    ``at[first[k]:first[k + 1]]``. Nonterminals too short for a run are left out."""

    start: np.ndarray
    middle: np.ndarray
    end: np.ndarray
    first: np.ndarray
    at: np.ndarray


def _chosen(sym: np.ndarray, joined: np.ndarray, n_symbols: int) -> np.ndarray:
    """Places of pairs that occur twice and are more frequent than both pairs they overlap."""
    pair = sym[:-1] * n_symbols + sym[1:]
    usable = joined.copy()
    alike = joined & (sym[:-1] == sym[1:])
    # of a stretch a a a a only every second pair
    place = np.arange(len(pair))
    opens = alike.copy()
    opens[1:] &= ~alike[:-1]
    since = place - np.maximum.accumulate(np.where(opens, place, 0))
    usable &= ~(alike & (since % 2 == 1))
    at = np.flatnonzero(usable)
    if not len(at):
        return at
    kinds, kind, count = np.unique(pair[at], return_inverse=True, return_counts=True)
    # ties by a hash, so that no order of the ids makes a long chain
    tie = (kinds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (kinds.astype(np.uint64) >> np.uint64(7))
    rank = np.empty(len(kinds), np.int64)
    rank[np.lexsort((tie * np.uint64(0xBF58476D1CE4E5B9), count))] = np.arange(1, len(kinds) + 1)
    rank[count < 2] = 0
    weight = np.zeros(len(pair) + 2, np.int64)
    weight[at + 1] = rank[kind]
    mid = weight[1:-1]
    return np.flatnonzero((mid > weight[:-2]) & (mid > weight[2:]))


def re_pair(code: np.ndarray, segment: np.ndarray, min_length: int) -> Grammar:
    """Grammar of ``code``; no pair reaches over two segments."""
    sym = np.unique(code, return_inverse=True)[1].astype(np.int64)
    n_symbols = int(sym.max()) + 1 if len(sym) else 0
    pos = np.arange(len(sym))
    length = np.ones(len(sym), np.int64)
    rules, uses, made = [], [], 0
    repeats = True
    while len(sym) > 1:
        joined = segment[pos[:-1]] == segment[pos[1:]]
        chosen = _chosen(sym, joined, n_symbols) if repeats else np.zeros(0, np.int64)
        if not len(chosen):
            repeats = False
            # nothing repeats: pair neighbours, so that each boundary has a nonterminal
            opens = np.r_[True, ~joined]
            place = np.arange(len(sym))
            since = place - np.maximum.accumulate(np.where(opens, place, 0))
            chosen = np.flatnonzero(joined & (since[:-1] % 2 == 0))
            if not len(chosen):
                break
            first, kind = np.arange(len(chosen)), np.arange(len(chosen))
        else:
            _, first, kind = np.unique(sym[chosen] * n_symbols + sym[chosen + 1], return_index=True, return_inverse=True)
        middle = pos[chosen + 1]
        end = middle + length[chosen + 1]
        rules.append((pos[chosen][first], middle[first], end[first]))
        uses.append((made + kind, pos[chosen]))
        sym[chosen] = n_symbols + kind
        length[chosen] += length[chosen + 1]
        stay = np.ones(len(sym), bool)
        stay[chosen + 1] = False
        sym, pos, length = sym[stay], pos[stay], length[stay]
        n_symbols += len(first)
        made += len(first)
    if not rules:
        none = np.zeros(0, np.int64)
        return Grammar(none, none, none, np.zeros(1, np.int64), none)
    start, middle, end = (np.concatenate(c) for c in zip(*rules))
    rule, at = (np.concatenate(c) for c in zip(*uses))
    long = end - start >= min_length
    number = np.cumsum(long) - 1
    mine = long[rule]
    rule, at = number[rule[mine]], at[mine]
    order = np.argsort(rule, kind="stable")
    first = np.searchsorted(rule[order], np.arange(int(long.sum()) + 1))
    return Grammar(start[long], middle[long], end[long], first, at[order])


# -- runs across a boundary --------------------------------------------------------------------


class Blocks:
    """Names of the blocks of 2**k words at each place, and comparisons by them."""

    def __init__(self, code: np.ndarray, seg_end: np.ndarray):
        self.seg_end = seg_end
        place = np.arange(len(code))
        self.names = [np.unique(code, return_inverse=True)[1].astype(np.int32)]
        room = seg_end - place
        size = 1
        while len(room) and room.max() >= 2 * size:
            size *= 2
            fits = np.flatnonzero(room >= size)
            last = self.names[-1]
            both = last[fits].astype(np.int64) * len(code) + last[fits + size // 2]
            name = np.full(len(code), -1, np.int32)
            name[fits] = np.unique(both, return_inverse=True)[1]
            self.names.append(name)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of windows of ``size`` words within a segment, and a name of each."""
        k = size.bit_length() - 1
        if k >= len(self.names):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        fits = np.flatnonzero(self.seg_end - np.arange(len(self.seg_end)) >= size)
        name = self.names[k]
        both = name[fits].astype(np.int64) * len(name) + name[fits + size - (1 << k)]
        return fits, np.unique(both, return_inverse=True)[1].astype(np.int64)

    def agree_after(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Words from ``a`` and ``b`` on that agree, ``limit`` at most."""
        n = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            fits = np.flatnonzero(limit - n >= 1 << k)
            same = fits[self.names[k][a[fits] + n[fits]] == self.names[k][b[fits] + n[fits]]]
            n[same] += 1 << k
        return n

    def agree_before(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Words just before ``a`` and ``b`` that agree, ``limit`` at most."""
        n = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            fits = np.flatnonzero(limit - n >= 1 << k)
            same = fits[self.names[k][a[fits] - n[fits] - (1 << k)] == self.names[k][b[fits] - n[fits] - (1 << k)]]
            n[same] += 1 << k
        return n


class Crossing:
    """Runs that cross the boundary of a nonterminal within its expansion."""

    def __init__(self, code: np.ndarray, seg_end: np.ndarray, grammar: Grammar, min_length: int):
        self.code, self.grammar, self.min_length = code, grammar, min_length
        self.window = (min_length + 1) // 2
        self.blocks = Blocks(code, seg_end)
        fits, name = self.blocks.windows(self.window)
        self.n = len(code) + 1
        self.key = np.sort(name * self.n + fits)
        self.name = np.full(len(code), -1, np.int64)
        self.name[fits] = name
        self.place = np.full(len(code), -1, np.int64)
        self.place[self.key % self.n] = np.arange(len(self.key))

    def _candidates(self, rules: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rule, a, b): equal windows at a < b, the first of their stretch of
        agreement to hold the word before the boundary at ``a`` (the run has a
        period behind the boundary), or the word after it at ``b`` (before it)."""
        g, w = self.grammar, self.window
        start, middle, end = g.start[rules], g.middle[rules], g.end[rules]
        reach = (end - start) // 2
        for ahead in (True, False):
            for j in range(w):
                at = middle - w + j + (not ahead)
                ok = np.flatnonzero((at >= start) & (at + w <= end))
                at_ok, name = at[ok], self.name[at[ok]] * self.n
                if ahead:
                    low = self.place[at_ok] + 1
                    high = np.searchsorted(self.key, name + np.minimum(end[ok] - w, at_ok + reach[ok]), "right")
                else:
                    high = self.place[at_ok]
                    low = np.searchsorted(self.key, name + np.maximum(start[ok], at_ok - reach[ok]), "left")
                sizes = np.maximum(high - low, 0)
                some = np.flatnonzero(sizes)
                # whole rules at a time, about CHUNK candidates
                cuts = np.searchsorted(np.cumsum(sizes[some]), np.arange(CHUNK, int(sizes.sum()) + CHUNK, CHUNK), "left") + 1
                begin = 0
                for cut in np.unique(np.minimum(cuts, len(some))):
                    part = some[begin:cut]
                    begin = cut
                    other = self.key[spread(low[part], sizes[part])] % self.n
                    own = np.repeat(at_ok[part], sizes[part])
                    rule = np.repeat(ok[part], sizes[part])
                    a, b = (own, other) if ahead else (other, own)
                    if j:
                        new = (a == start[rule]) | (self.code[a - 1] != self.code[b - 1])
                        rule, a, b = rule[new], a[new], b[new]
                    yield rules[rule], a, b

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rule, start, end, period), intervals within the expansion of the rule."""
        g = self.grammar
        found = []
        for rule, a, b in self._candidates(np.arange(len(g.start))):
            period = b - a
            begin = a - self.blocks.agree_before(a, b, a - g.start[rule])
            stop = b + self.blocks.agree_after(a, b, g.end[rule] - b)
            good = stop - begin >= np.maximum(self.min_length, 2 * period)
            found.append((rule[good], begin[good], stop[good], period[good]))
        if not found:
            return (np.zeros(0, np.int64),) * 4
        rule, begin, stop, period = (np.concatenate(c) for c in zip(*found))
        # multiples of the smallest period have the same interval
        order = np.lexsort((period, stop, begin, rule))
        rule, begin, stop, period = rule[order], begin[order], stop[order], period[order]
        new = np.r_[True, (np.diff(rule) != 0) | (np.diff(begin) != 0) | (np.diff(stop) != 0)][: len(rule)]
        return rule[new], begin[new], stop[new], period[new]


def all_runs(code: np.ndarray, segment: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of ``code`` within segments, by start and period."""
    none = (np.zeros(0, np.int64),) * 3
    if not len(code):
        return none
    opens = np.flatnonzero(np.r_[True, np.diff(segment) != 0])
    seg_end = np.repeat(np.r_[opens[1:], len(code)], np.diff(np.r_[opens, len(code)]))
    grammar = re_pair(code, segment, min_length)
    rule, begin, stop, period = Crossing(code, seg_end, grammar, min_length).runs()
    # to all places of the derivation
    uses = grammar.first[rule + 1] - grammar.first[rule]
    shift = grammar.at[spread(grammar.first[rule], uses)] - np.repeat(grammar.start[rule], uses)
    begin, stop, period = np.repeat(begin, uses) + shift, np.repeat(stop, uses) + shift, np.repeat(period, uses)
    if not len(begin):
        return none
    # intervals of one period that share a period or more are parts of one run
    order = np.lexsort((begin, period))
    begin, stop, period = begin[order], stop[order], period[order]
    base = period * (len(code) + 1)
    reach = np.maximum.accumulate(base + stop)
    new = np.r_[True, (np.diff(period) != 0) | (reach[:-1] - base[1:] - begin[1:] < period[1:])]
    first = np.flatnonzero(new)
    stop = np.maximum.reduceat(stop, first)
    begin, period = begin[first], period[first]
    order = np.lexsort((period, begin))
    return begin[order], stop[order], period[order]


# -- documents ---------------------------------------------------------------------------------


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + SLICE_BYTES, "right")))
        yield at, to
        at = to


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _runs_of_texts(texts: pa.Array, min_length: int) -> list[pa.Array]:
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    doc = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(lists), np.int64))
    real = np.asarray(pc.binary_length(flat)) > 0
    flat, doc = flat.filter(pa.array(real)), doc[real]
    n_words = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n_words) - n_words
    code = np.asarray(flat.dictionary_encode().indices, np.int64)
    kept = np.flatnonzero(repeated_words(code, doc, (min_length + 1) // 2))
    segment = np.cumsum(np.r_[0, (np.diff(kept) != 1) | (np.diff(doc[kept]) != 0)])[: len(kept)]
    begin, stop, period = all_runs(code[kept], segment, min_length)
    begin, stop = kept[begin], kept[stop - 1] + 1
    owner = doc[begin]
    # a word stays unless a run holds it after its first period
    size = len(code) + 1
    edges = np.bincount(begin + period, minlength=size) - np.bincount(stop, minlength=size)
    stay = np.cumsum(edges)[:-1] == 0
    n_runs = np.bincount(owner, minlength=len(texts))
    run = pa.StructArray.from_arrays([pa.array(c) for c in (begin - first[owner], stop - begin, period)], fields=list(RUN))
    n_kept = np.bincount(doc[stay], minlength=len(texts))
    listed = lambda n, values: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), values)
    joined = pc.binary_join(listed(n_kept, flat.filter(pa.array(stay))), " ")
    return [pa.array(n_words.astype(np.int64)), listed(n_runs, run), joined]


def _documents(min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for at, to in _slices(texts):
                found = _runs_of_texts(texts.slice(at, to - at), min_length)
                yield pa.record_batch([batch.column(0).slice(at, to - at), *found], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of ``docs`` (doc_id, text).

    ``runs`` are all (start, length, period) of at least ``min_length`` words
    and two periods, by start and period. ``collapsed`` is the text without the
    words that a run holds after its first period, joined by single spaces.

    A null or empty text has no words, no runs and an empty ``collapsed``.
    Repeated rows give repeated rows. A text of any length is one row of one
    task. An empty table gives no row. Other columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(_documents(min_length), schema)


def planted(doc_id: Column, text: Column) -> Column:
    """The text, in a tenth of the documents with its end made periodic.

    With h the CRC-32 of the decimal id: if h % 10 = 0, words from number
    a = g % n on, g = h div 10, repeat the first p = 1 + (n - a) div (3 + g % 8)
    of them. A null id leaves the text as it is.
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeat(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, F.greatest(n, F.lit(1)))
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        parts = let(F.struct(a.alias("a"), p.alias("p")), lambda v: F.transform(
            w, lambda x, i: F.when(i < v["a"], x).otherwise(F.get(w, (v["a"] + F.pmod(i - v["a"], v["p"])).cast("int")))
        ))
        return F.array_join(parts, " ")

    return F.when((h % 10) == 0, let(words(text_or_empty(text)), repeat)).otherwise(text)


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each of the whole ``documents``, a tenth of them made periodic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    )
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return periodic_runs(docs).withColumn("_top", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_top.s")).alias("start"),
        F.col("_top.length").alias("length"),
        (-F.col("_top.p")).alias("period"),
        F.floor(1000 * F.col("_top.length") / -F.col("_top.p")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
