"""Connected components of links that stay distributed throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkripple.llm.common import cut


def stars(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), root the smallest node it reaches; roots themselves included.

    Alternates the two star rewrites: every node's larger neighbours, then its
    smaller ones, are linked to its smallest neighbour, until nothing changes.
    Grouping is by aggregates with map-side combine and joins that adaptive
    execution splits where one node has many links. Each round is written to the
    checkpoint folder. Null ends and self links are ignored.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    size = edges.count()
    state = None
    while size:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*").filter("hi <> lo").distinct()
        edges = cut(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo") % 1_000_000_007)).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots)
