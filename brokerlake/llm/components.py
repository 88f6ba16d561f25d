"""Connected components of a link table, without ever bringing links together on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brokerlake.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long), root the smallest node reachable.

    Alternating large-star and small-star steps; each step is a minimum per node, which Spark
    combines before the shuffle, and a join on the node that it can split where one node has very
    many links. Each round is a table in the shared folder. Rounds grow as the logarithm of the
    nodes. NULL ends and links of a node to itself add nothing.
    """
    pairs = stored(
        links.where("a <> b").select(
            F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
        ).distinct(),
        "links",
    )
    state = None
    while True:
        found = pairs.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("u", "v"), 16))).first()
        if found[0] == 0 or found == state:
            break
        state = found
        both = pairs.union(pairs.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(least, "u").where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).distinct()
        )
        pairs = stored(small, "links")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
