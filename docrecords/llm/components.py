"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecords.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` to ``(node, root)``: for each linked node the smallest node that it reaches.

    Rounds of two star operations: every node hands its larger neighbours to its smallest one, then its smaller ones.
    Each round keeps at most the number of links, halves distances, and is written to the shared folder. Neighbours are
    only ever reduced to a minimum per node, so no group is gathered in one place. No links: no rows.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct(), "links"
    )
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # larger neighbours of u point to the smallest of u and its neighbours
        large = (
            both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct()
        )
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        # u and its smaller neighbours point to the smallest of them
        small = large.join(down, "hi").select(
            F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("e")
        )
        fresh = stored(small.select("e.hi", "e.lo").filter("hi <> lo").distinct(), "links")
        changed = fresh.exceptAll(edges).limit(1).count() + edges.exceptAll(fresh).limit(1).count()
        edges = fresh
        if not changed:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
