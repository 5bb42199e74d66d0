"""Quality by an interpolated modified Kneser-Ney model of trusted text.

The model is one of characters: n-grams of ``order`` code points, which needs
no vocabulary and judges short texts and words never seen. It is trained on a
bounded sample of the documents labelled as good. Counts, continuation counts,
discounts and context weights are grouped and joined by n-gram key in Spark.

Scoring joins the n-grams of the documents with the model's shards: sorted
pieces of at most ``shard_rows`` keys, bounded in number by the sample. A task
finds the distinct n-grams of its texts, merges them with one shard after the
other, and sums the log-probabilities per document. Documents are not shuffled.

A document is kept if its perplexity per character is at most the quantile of
its language over all other trusted documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.functions.joins import attach
from tabloom.llm.common import table
from tabloom.llm.registry import query
from tabloom.session import settle, stored

SYMBOL_BITS = 12
EDGE = (1 << SYMBOL_BITS) - 1  # the mark before and after a text
_HASHED = 3072  # code points from here on share the symbols up to the mark


@dataclass(frozen=True)
class QualitySettings:
    order: int = 5
    max_training_docs: int = 4000  # the least trusted documents by hash, ...
    max_training_chars: int = 4_000_000  # ... as long as they fit
    long_share: float = 0.25  # of these characters; longer texts come last, cut to it
    quantile: float = 0.995
    accuracy: int = 10_000  # of the quantiles
    shard_rows: int = 1 << 18
    chunk_chars: int = 1 << 21
    seed: int = 3


def symbols(text: str) -> np.ndarray:
    """A number below 2**12 per code point; rare scripts share numbers."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where(points < _HASHED, points, _HASHED + (points * 2654435761 >> 7) % (EDGE - _HASHED))


def grams(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams that end at each symbol of the texts and their end marks,
    and the number of them per text."""
    pad = np.full(order - 1, EDGE, np.int64)
    end = np.full(1, EDGE, np.int64)
    parts = [x for t in texts for x in (pad, symbols(t), end)]
    stream = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    lengths = np.array([len(x) for x in parts[1::3]], np.int64) + 1
    keys = np.zeros(max(len(stream) - order + 1, 0), np.int64)
    for k in range(order):
        keys = keys << SYMBOL_BITS | stream[k : k + len(keys)]
    # the positions that end in padding belong to no text
    starts = np.concatenate([[0], np.cumsum(lengths + order - 1)])[:-1]
    keep = np.zeros(len(keys), bool)
    for a, n in zip(starts, lengths):
        keep[a : a + n] = True
    return keys[keep], lengths


def _chunks(texts: list[str], size: int) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``size`` characters; a longer text is a run of its own."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield at, texts[at:i]
            at, total = i, 0
        total += len(t)
    if at < len(texts):
        yield at, texts[at:]


def trusted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents all of whose labels say good and not toxic."""
    good = F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))
    ids = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(good.cast("int")).alias("_good"))
    return docs.join(ids.where("_good = 1").select("doc_id"), "doc_id")


def training_sample(docs: DataFrame, labels: DataFrame, settings: QualitySettings) -> DataFrame:
    """A bounded sample (doc_id, text) of the trusted documents, by hash of id and text.

    The sample is chosen by key; texts are only fetched for the chosen keys,
    whose number is bounded, so they are not shuffled. Repeated rows count once.
    A text of more than ``long_share`` of the characters follows all shorter ones
    and gives one piece of that size, drawn by hash from all its pieces, so that
    no text can keep the others out and no part of a text is preferred.
    """
    key = F.xxhash64(F.lit(settings.seed), "doc_id", "text").alias("_h")
    most = max(int(settings.long_share * settings.max_training_chars), 1)
    size = F.length(F.coalesce("text", F.lit("")))
    keys = docs.select("doc_id", key, F.least(size, F.lit(most)).alias("_n"), (size > most).alias("_long"))
    chosen = (
        trusted_documents(keys, labels)
        .dropDuplicates(["doc_id", "_h"])
        .orderBy("_long", "_h", "doc_id")
        .limit(settings.max_training_docs)
    )
    so_far = F.sum("_n").over(
        Window.orderBy("_long", "_h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    chosen = settle(chosen.withColumn("_sum", so_far).where(F.col("_sum") <= settings.max_training_chars))
    found = docs.select("doc_id", "text", key).join(F.broadcast(chosen.select("doc_id", "_h")), ["doc_id", "_h"])
    return found.dropDuplicates(["doc_id", "_h"]).select("doc_id", _piece(F.col("text"), F.col("_h"), most).alias("text"))


def _piece(text: Column, draw: Column, most: int) -> Column:
    """The text, or one of its pieces of ``most`` characters."""
    n = F.greatest(F.ceil(F.length(text) / most), F.lit(1))
    return F.substring(text, (F.pmod(draw, n) * most + 1).cast("int"), F.lit(most))


def count_grams(texts: DataFrame, settings: QualitySettings) -> DataFrame:
    """(key, c): n-grams of the highest order over a table with a column ``text``."""
    order, size = settings.order, settings.chunk_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [t or "" for t in batch.column(0).to_pylist()]
            for _, part in _chunks(whole, size):
                keys, counts = np.unique(grams(part, order)[0], return_counts=True)
                yield pa.record_batch([pa.array(keys), pa.array(counts.astype(np.int64))], names=["key", "c"])

    return texts.select("text").mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def kneser_ney(counts: DataFrame, order: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Per order from 1: (key, p) of the n-grams seen, and (key, weight) of their contexts.

    The highest order has counts, the others the number of different symbols
    before an n-gram. Discounts for counts of one, two and more come from the
    counts of counts.
    """
    tables = [settle(counts)]
    for n in range(order - 1, 0, -1):
        tail = F.col("key").bitwiseAND(F.lit((1 << SYMBOL_BITS * n) - 1))
        tables.insert(0, settle(tables[0].groupBy(tail.alias("key")).agg(F.count(F.lit(1)).alias("c"))))
    probabilities, weights = [], []
    lower: DataFrame | None = None
    for n, seen in enumerate(tables, 1):
        row = seen.agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
        n1, n2, n3, n4 = (float(row[f"n{k}"]) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        cuts = [
            min(max(k - (k + 1) * y * more / some, 0.05), k - 0.05) if some else 0.5
            for k, some, more in ((1, n1, n2), (2, n2, n3), (3, n3, n4))
        ]
        cut: Column = F.when(F.col("c") == 1, cuts[0]).when(F.col("c") == 2, cuts[1]).otherwise(cuts[2])
        head = F.shiftright("key", SYMBOL_BITS)
        contexts = seen.groupBy(head.alias("h")).agg(
            F.sum("c").alias("total"), (F.sum(cut) / F.sum("c")).alias("weight")
        )
        joined = seen.withColumn("h", head).join(contexts, "h")
        own = (F.col("c") - cut) / F.col("total")
        if lower is None:
            here = joined.select("key", (own + F.col("weight") * 2.0**-SYMBOL_BITS).alias("p"))
        else:
            tail = F.col("key").bitwiseAND(F.lit((1 << SYMBOL_BITS * (n - 1)) - 1))
            below = lower.select(F.col("key").alias("_tail"), F.col("p").alias("_p"))
            here = joined.withColumn("_tail", tail).join(below, "_tail").select(
                "key", (own + F.col("weight") * F.col("_p")).alias("p")
            )
        lower = settle(here)
        probabilities.append(lower)
        weights.append(contexts.select(F.col("h").alias("key"), "weight"))
    return probabilities, weights


def _shards(values: DataFrame, column: str, rows: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted keys and logs in pieces; their number is bounded by the training sample."""
    local = values.select("key", F.log(column).alias("v")).toPandas().sort_values("key")
    keys, logs = local["key"].to_numpy(np.int64), local["v"].to_numpy(np.float64)
    return [(keys[a : a + rows], logs[a : a + rows]) for a in range(0, len(keys), rows)]


def _merged(wanted: np.ndarray, shards: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The value of each sorted key of ``wanted``, NaN where no shard has it."""
    out = np.full(len(wanted), np.nan)
    for keys, values in shards:
        a, b = np.searchsorted(wanted, [keys[0], keys[-1] + 1])
        at = np.minimum(np.searchsorted(keys, wanted[a:b]), len(keys) - 1)
        out[a:b] = np.where(keys[at] == wanted[a:b], values[at], out[a:b])
    return out


def log_probabilities(wanted: np.ndarray, order: int, probabilities, weights) -> np.ndarray:
    """Log-probability of the last symbol of each sorted highest-order key given the others."""
    out = np.zeros(len(wanted))
    open_, keys = np.arange(len(wanted)), wanted
    for n in range(order, 0, -1):
        distinct, back = np.unique(keys, return_inverse=True)
        found = _merged(distinct, probabilities[n - 1])[back]
        done = ~np.isnan(found)
        out[open_[done]] += found[done]
        open_, keys = open_[~done], keys[~done]
        heads, back = np.unique(keys >> SYMBOL_BITS, return_inverse=True)
        out[open_] += np.nan_to_num(_merged(heads, weights[n - 1]))[back]
        keys = keys & ((1 << SYMBOL_BITS * (n - 1)) - 1)
    out[open_] += -SYMBOL_BITS * np.log(2)
    return out


def score_documents(docs: DataFrame, shards, settings: QualitySettings) -> DataFrame:
    """(doc_id, lang, text_key, n_symbols, log_p) per row; the end mark is a symbol too."""
    held = docs.sparkSession.sparkContext.broadcast(shards)
    order, size = settings.order, settings.chunk_chars
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probabilities, weights = held.value
        for batch in batches:
            texts = [t or "" for t in batch.column(3).to_pylist()]
            sums, sizes = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for at, part in _chunks(texts, size):
                keys, lengths = grams(part, order)
                codes, distinct = pd.factorize(keys)
                rank = np.argsort(distinct)
                logs = np.empty(len(distinct))
                logs[rank] = log_probabilities(distinct[rank], order, probabilities, weights)
                ends = np.cumsum(lengths)
                sums[at : at + len(part)] = np.add.reduceat(logs[codes], ends - lengths)
                sizes[at : at + len(part)] = lengths
            yield pa.record_batch(
                [*[batch.column(i) for i in range(3)], pa.array(sizes), pa.array(sums)],
                names=["doc_id", "lang", "text_key", "n_symbols", "log_p"],
            )

    rows = docs.select("doc_id", "lang", F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(
        run, f"doc_id {kinds['doc_id']}, lang {kinds['lang']}, text_key long, n_symbols long, log_p double"
    )


def classify_quality(
    docs: DataFrame, labels: DataFrame, settings: QualitySettings = QualitySettings()
) -> DataFrame:
    """(doc_id, lang, n_symbols, perplexity, threshold, kept) for every row of ``docs``.

    A null text counts as empty: its only symbol is the end mark. Null
    languages form a group. A language without trusted documents outside the
    sample takes the quantile over all languages; without any trusted document
    there is no model and everything is kept, with null figures. Repeated rows
    are judged alike.
    """
    sample = stored(training_sample(docs, labels, settings), "trusted_sample")
    if sample.isEmpty():
        none = {k: F.lit(None).cast("double") for k in ("perplexity", "threshold")}
        return docs.select(
            "doc_id", "lang", (F.length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("n_symbols")
        ).withColumns({**none, "kept": F.lit(True)})
    probabilities, weights = kneser_ney(count_grams(sample, settings), settings.order)
    shards = (
        [_shards(t, "p", settings.shard_rows) for t in probabilities],
        [_shards(t, "weight", settings.shard_rows) for t in weights],
    )
    scored = stored(score_documents(docs, shards, settings), "scored").withColumn(
        "perplexity", F.exp(-F.col("log_p") / F.col("n_symbols"))
    )
    used = F.broadcast(sample.select("doc_id", F.lit(True).alias("_used")).distinct())  # bounded by the sample
    judges = trusted_documents(scored, labels).join(used, "doc_id", "left")
    cut = F.percentile_approx("perplexity", settings.quantile, settings.accuracy)
    fresh = judges.where("_used is null")
    overall = (fresh if not fresh.isEmpty() else judges).agg(cut).first()[0]
    by_lang = (
        fresh.withColumn("_lang", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")))
        .groupBy("_lang")
        .agg(cut.alias("threshold"))
    )
    keyed = scored.withColumn("_lang", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")))
    return (
        attach(keyed, by_lang, ["_lang"], max_rows=50_000)
        .withColumn("threshold", F.coalesce("threshold", F.lit(overall)))
        .withColumn("kept", F.col("perplexity") <= F.col("threshold"))
        .select("doc_id", "lang", "n_symbols", "perplexity", "threshold", "kept")
    )


@query("op1_quality_classifier")
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of the whole ``documents``, trained on their labels."""
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
