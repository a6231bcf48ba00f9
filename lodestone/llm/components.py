"""Connected components of a table of links, without bringing links to the driver.

Large-star and small-star steps in turn: each links the neighbours of a node to its least neighbour, so that every
component ends as a star around its least node.  Each round is one table in the shared folder; the driver sees a count
and a checksum of it only.  An empty table of links gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, scope, store, with_unique


def _starred(links: DataFrame, large: bool) -> DataFrame:
    """links: distinct rows a > b.  Every neighbour of a node, or every smaller one, is linked to the least of them."""
    if large:
        around = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = links
    least = store(around.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least")), "least")
    # the centre of a large star has many neighbours
    joined = with_unique(around, least, "a", partitions(links.sparkSession))
    if large:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return store(moved.where(F.col("a") > F.col("b")).distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long), in either order, repeated or not: (node, root) for every node but the roots themselves."""
    with scope(links.sparkSession, "node-roots"):
        now = store(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") > F.col("b")).distinct(), "links")
        mark = None
        while True:
            seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
            if (seen["n"], seen["h"]) == mark or not seen["n"]:
                return store(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "node-roots")
            mark = (seen["n"], seen["h"])
            now = _starred(_starred(now, True), False)
