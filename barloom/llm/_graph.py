"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm._common import staged

ROUNDS = 60


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has a link: root is the smallest node it reaches.

    Alternating large-star and small-star steps: every node passes the smallest of its neighbours to those above it,
    then to those below, until the links are stars.  The rounds grow with the logarithm of the diameter.
    Minima are reduced before the shuffle and joined back, so a hub may be split like any skewed join.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs = staged(pairs, "links")
    state = None
    for _ in range(ROUNDS):
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).union(joined.select("u", F.col("low").alias("v")))
        pairs = staged(small.where("u <> v").distinct(), "links")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select(F.col("v"), F.col("v"))).distinct()
        state = now
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
