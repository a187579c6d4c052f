"""Connected components by contraction, shared by operators 6 and 9."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.runtime import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges(a, b)`; component = the least node reached.

    Alternating large-star and small-star contraction: each round is two
    aggregations with map-side combine, so a hub is reduced before the shuffle,
    and the number of rounds grows with the logarithm of the diameter. Rows with
    a null end are ignored; a self-loop yields the node alone. Every round is
    checkpointed, so a lost executor costs one round at most.
    """
    raw = edges.select(F.col("a"), F.col("b")).where("a is not null and b is not null")
    links = cut(raw.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    own = links.select(F.col("u").alias("node")).union(links.select("v")).distinct()
    links = links.where("u <> v")
    before = None
    while True:
        both = links.union(links.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above u go to the least of u's neighbourhood
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: neighbours below u, and u itself, go to that least
        small_low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            big.join(small_low, "u")
            .select(F.explode(F.array(F.col("v"), F.col("u"))).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        links = cut(small)
        now = links.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            break
        before = now
    return own.join(links.select(F.col("u").alias("node"), F.col("v").alias("c")), "node", "left").select(
        "node", F.coalesce("c", "node").alias("component")
    )
