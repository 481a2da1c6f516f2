"""Connected components of a graph given as edges, by star contraction.

Each round lets every node hand its larger neighbours to its least one (large
star), then its smaller neighbours and itself to the least of them (small star).
The edges end as stars around each component's least node. Both steps are a
grouped minimum joined back, so the edges stay linear in number and a node
with many neighbours is split like any other hot join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odonto.session import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b).

    ``component`` is the least node that is reachable. Loops and repeated
    edges change nothing; without edges the result is empty.
    """
    e = stage(edges.filter(F.col("a") != F.col("b"))
              .select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
    before = None
    while (now := tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("lo", "hi"))).first())) != before:
        before = now
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
            e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.filter(F.col("v") > F.col("u")).join(least, "u")
                 .select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct())
        roots = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(roots, "hi").filter(F.col("lo") != F.col("m")).select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        e = stage(small.unionByName(roots.select(F.col("m").alias("lo"), "hi")).distinct())
    return (e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
            .unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()))
