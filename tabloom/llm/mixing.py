"""Mixing sources to target weights.

The words of a source, taken in a fixed order of its documents, are packed into
blocks of ``block_words``. The mix is a number of output shards. Each shard
draws how many blocks it takes from each source: the whole part of the expected
count is given and the rest is drawn from a multinomial, which keeps the sums
near their targets. The slots of a source, counted through all shards, are
mapped to block indexes by a pseudorandom permutation of that source, one pass
after the other, and joined with the blocks by index.

All draws are hashes of row keys, so that a rerun or a recomputed task gives
the same mix. No window or group holds a whole source: running totals are made
within buckets of about ``bucket_docs`` documents and over the buckets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.functions.joins import attach
from tabloom.functions.running import running
from tabloom.llm.common import table, text_or_empty, unhashed
from tabloom.llm.registry import query
from tabloom.session import settle, stored

MAX_BROADCAST_SOURCES = 50_000


@dataclass(frozen=True)
class MixSettings:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)  # of the sources in order, repeating
    max_passes: int = 3  # times that a source is used at most
    block_words: int = 32
    shard_slots: int = 4096  # about so many blocks make an output shard
    bucket_docs: int = 1000
    rounds: int = 16  # of the permutation
    task_slots: int = 100_000
    task_shards: int = 10_000  # output shards that a task draws for
    seed: int = 7


@dataclass(frozen=True)
class Mix:
    """``docs``: a row per document with its place in its source's word stream.
    ``sources``: sizes and targets. ``slots``: shard, source, pass and block index."""

    docs: DataFrame
    sources: DataFrame
    slots: DataFrame


def permuted(i: Column, n: Column, key: Column, rounds: int) -> Column:
    """Image of ``i`` under a pseudorandom permutation of 0..n-1 (swap or not)."""

    def turn(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        high = F.greatest(x, partner)
        swap = F.xxhash64(key, r, high).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), i.cast("long"), turn)


def source_targets(sources: DataFrame, settings: MixSettings) -> DataFrame:
    """Add ``weight`` and ``target`` to a table (source, source_size).

    Sources are weighted in code point order, null last. A target above
    ``max_passes`` times its source is cut, and the excess is shared by weight
    among the others until none is above. The windows run over sources, not
    over documents.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weights = F.array(*[F.lit(float(w)) for w in settings.weights])
    ranked = sources.withColumn("rank", F.row_number().over(by_name)).withColumns(
        {
            "weight": F.get(weights, (F.col("rank") - 1) % len(settings.weights)),
            "_cap": F.col("source_size") * F.lit(float(settings.max_passes)),
            "_total": F.sum("source_size").over(everything).cast("double"),
        }
    )
    by_ratio = Window.orderBy(F.col("_cap") / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(onwards)
    leveled = ranked.withColumn("_level", level)
    free = F.when(F.col("_cap") > F.col("_level") * F.col("weight"), F.col("_level"))
    share = F.max(free).over(everything) * F.col("weight")
    return leveled.withColumn("target", F.least(F.col("_cap"), F.coalesce(share, F.col("_cap")))).drop(
        "_cap", "_total", "_level"
    )


def _shard_counts(sources: DataFrame, settings: MixSettings) -> DataFrame:
    """(rank, shard, n): blocks that each output shard takes from each source."""
    everything = Window.partitionBy()
    expected = (
        sources.where("n_blocks > 0")
        .withColumn("_slots", F.col("target") / F.col("source_size") * F.col("n_blocks"))
        .withColumn(
            "_shards", F.greatest(F.ceil(F.sum("_slots").over(everything) / settings.shard_slots), F.lit(1))
        )
        .withColumn("_each", F.col("_slots") / F.col("_shards"))
        .withColumn("_part", F.col("_each") - F.floor("_each"))
        .withColumns(
            {
                "_to": F.sum("_part").over(Window.orderBy("rank")),
                "_all": F.sum("_part").over(everything),
                "_n": F.count(F.lit(1)).over(everything),
            }
        )
    )
    expected = settle(expected)
    figures = expected.select("_shards", "_all", "_n").first()
    spark = sources.sparkSession
    if figures is None:
        return spark.createDataFrame([], "rank int, shard long, n long")
    n_shards, all_parts, n_sources = int(figures["_shards"]), figures["_all"], figures["_n"]
    # few rows that become many: dealt out by runs of shards before they are written out
    step = settings.task_shards
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n_shards - 1) // step).cast("long"))).alias("_run")
    n_runs = max(1, math.ceil(n_shards / step))
    sure = (
        expected.where("_each >= 1")
        .select("rank", F.floor("_each").alias("n"), runs)
        .repartition(n_runs, "rank", "_run")
        .select("rank", F.explode(F.sequence(F.col("_run") * step, F.least((F.col("_run") + 1) * step, F.lit(n_shards)) - 1)).alias("shard"), "n")
    )
    # the interval of a source on the line of parts, cut into cells to be joined by
    cell = lambda x: F.floor(x * F.col("_n") / F.col("_all"))
    start = F.col("_to") - F.col("_part")
    cells = expected.where("_part > 0").select(
        "rank",
        start.alias("_lo"),
        F.col("_to").alias("_hi"),
        F.explode(F.sequence(cell(start), cell(F.col("_to")))).alias("_cell"),
    )
    u = lambda *x: unhashed(F.xxhash64(F.lit(settings.seed), *x))
    draws = (
        spark.range(0, n_shards, 1, n_runs)
        .select(F.lit(all_parts).alias("_all"), F.lit(n_sources).alias("_n"), F.col("id").alias("shard"))
        .where("_all > 0")
        .withColumn("_k", F.floor(F.col("_all") + u(F.lit("draws"), F.col("shard"))))
        .where("_k > 0")
        .select("_all", "_n", "shard", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_k"))).alias("_d"))
        .withColumn("_x", u(F.lit("draw"), F.col("shard"), F.col("_d")) * F.col("_all"))
        .select("shard", "_x", cell(F.col("_x")).alias("_cell"))
    )
    drawn = (
        draws.join(cells, "_cell")
        .where((F.col("_x") >= F.col("_lo")) & (F.col("_x") < F.col("_hi")))
        .select("rank", "shard", F.lit(1).cast("long").alias("n"))
    )
    return sure.unionByName(drawn).groupBy("rank", "shard").agg(F.sum("n").alias("n"))


def plan_mix(docs: DataFrame, settings: MixSettings = MixSettings(), text_col: str = "text") -> Mix:
    """Sizes, targets and slots of a mix of ``docs`` (doc_id, text, source).

    A null text has size 0. A null source is a source of its own, the last.
    Repeated rows are mixed as separate documents. Documents of size 0 take
    part in no block. An empty table gives empty results.
    """
    sizes = stored(
        docs.select(
            "doc_id",
            "source",
            F.regexp_count(text_or_empty(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
            F.xxhash64(F.lit(settings.seed), "doc_id", text_col).alias("_key"),
        ).withColumn("_src", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))),
        "sizes",
    )
    sums = sizes.groupBy("_src", "source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")
    )
    sources = settle(
        source_targets(sums, settings)
        .withColumn("n_blocks", F.ceil(F.col("source_size") / settings.block_words))
        .withColumn("n_buckets", F.ceil(F.col("n_docs") / settings.bucket_docs))
    )
    placed = attach(
        sizes,
        sources.select("_src", "rank", "source_size", "target", "n_docs", "n_buckets"),
        ["_src"],
        how="inner",
        weight="n_docs",
        max_rows=MAX_BROADCAST_SOURCES,
    ).withColumn("_bucket", F.pmod("_key", F.col("n_buckets")))
    buckets = placed.groupBy("rank", "_bucket").agg(F.sum("size").alias("_size"))
    bucket_starts = running(stored(buckets, "buckets"), ["rank"], [F.col("_bucket")], {"_upto": ("sum", "_size")}).select(
        "rank", "_bucket", (F.col("_upto") - F.col("_size")).alias("_base")
    )
    within = (
        Window.partitionBy("rank", "_bucket")
        .orderBy("_key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = (
        placed.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(bucket_starts, ["rank", "_bucket"])
        .withColumn("start", F.col("_base") + F.col("_before"))
        .select("doc_id", "source", "rank", "size", "source_size", "target", "start")
    )
    counts = stored(_shard_counts(sources, settings), "shard_counts")
    counted = running(counts, ["rank"], [F.col("shard")], {"_to": ("sum", "n")}).withColumn("_from", F.col("_to") - F.col("n"))
    expected = F.sum(F.col("target") / F.col("source_size") * F.col("n_blocks"))
    n_slots = sources.where("source_size > 0").agg(expected).first()[0] or 0
    # few rows that become many: dealt to as many tasks as their slots need
    counted = counted.repartition(max(1, math.ceil(n_slots / settings.task_slots)), "rank", "shard")
    slots = (
        attach(
            counted,
            sources.select("rank", "n_blocks", "source_size"),
            ["rank"],
            how="inner",
            weight="source_size",
            max_rows=MAX_BROADCAST_SOURCES,
        )
        .select(
            "rank",
            "shard",
            "n_blocks",
            F.explode(F.sequence(F.col("_from"), F.col("_from") + F.col("n") - 1)).alias("slot"),
        )
        .withColumn("pass", F.floor(F.col("slot") / F.col("n_blocks")))
        # a draw beyond the last pass that a source may have is void
        .where(F.col("pass") < settings.max_passes)
        .withColumn(
            "block",
            permuted(
                F.pmod("slot", F.col("n_blocks")),
                F.col("n_blocks"),
                F.xxhash64(F.lit(settings.seed), F.col("rank"), F.col("pass")),
                settings.rounds,
            ),
        )
        .select("rank", "shard", "slot", "pass", "block")
    )
    return Mix(placed, sources, slots)


def pieces(mix: Mix, settings: MixSettings = MixSettings()) -> DataFrame:
    """The part of a document that lies in each block: (rank, block, start, words)."""
    size = F.lit(settings.block_words)
    end = F.col("start") + F.col("size")
    first = F.floor(F.col("start") / size)
    last = F.floor((end - 1) / size)
    return (
        mix.docs.where("size > 0")
        .withColumn("block", F.explode(F.sequence(first, last)))
        .withColumn(
            "words",
            F.least(end, (F.col("block") + 1) * size) - F.greatest(F.col("start"), F.col("block") * size),
        )
    )


def mix_sources(docs: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """A row per document: what the mix takes of it, and its source's target."""
    mix = plan_mix(docs, settings)
    times = mix.slots.groupBy("rank", "block").agg(F.count(F.lit(1)).alias("_times"))
    keys = ["doc_id", "source", "rank", "size", "source_size", "target", "start"]
    taken = (
        pieces(mix, settings)
        .join(times, ["rank", "block"], "left")
        .groupBy(*keys)
        .agg(F.sum(F.col("words") * F.coalesce(F.col("_times"), F.lit(0))).alias("taken"))
    )
    empty = mix.docs.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return taken.unionByName(empty).select("doc_id", "source", "size", "source_size", "target", "taken")


@query("op9_mixing")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each of the whole ``documents``."""
    return mix_sources(table(spark, sf_dir, "documents"))
