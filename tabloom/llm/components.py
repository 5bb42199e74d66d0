"""Connected components of a link table, by repeated joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.session import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); ``root`` is the least node reachable.

    Alternates two steps until nothing changes: every node sends its larger
    neighbours to its least neighbour, then its smaller ones. Both keep the
    components and take a logarithmic number of rounds in practice. The minima
    are combined before the shuffle, and a node with many links is only a skewed
    join key, which adaptive execution splits. Each round is written to the
    shared folder, so that a lost executor repeats one round at most. Nothing
    but a count reaches the driver.
    """
    edges = links.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    edges = stored(edges.distinct(), "links")
    before = None
    while True:
        # each node and all its neighbours, itself among them
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(large.distinct(), "links")
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            edges.join(least, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edges = stored(small, "links")
        now = edges.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if now == before:
            break
        before = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
