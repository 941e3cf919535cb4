"""Connected components of a table of links, by alternating stars, in DataFrame operations.

Every round is linear in the links and leaves each node of a component nearer to its smallest node; the number of
rounds is logarithmic. Minima are aggregated before they are shuffled; joins on a node with very many links are
plain equi-joins that adaptive execution can split. Each round is a staged table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link; component is its smallest node. Loops and repeats do no harm."""
    stage = Stage(links.sparkSession, "components")
    hi, lo = F.greatest(a, b), F.least(a, b)
    edges = stage.put(links.where(F.col(a) != F.col(b)).select(hi.alias("u"), lo.alias("v")).distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = stage.put(large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        after = stage.put(small.distinct())
        stage.drop(edges, large)
        edges = after
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = state
