"""Connected components of a graph given by links, by alternating large and small stars.

Each round links the larger neighbours of every node, then the smaller ones, to the least of its
neighbourhood (Kiveris et al., Connected Components in MapReduce and Beyond, 2014).  Only
minima are aggregated, so no neighbourhood is gathered in one place; each round is written to the
shared folder, which cuts the lineage.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulant.sources.scratch import discard, materialize


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links`` ``(a, b)`` but the roots; a root is the least node.

    Nodes are integers; loops, repeated and reversed links do no harm.  No links give no rows.
    """
    spark = links.sparkSession
    links, path = materialize(links.where("a <> b").distinct(), "links")
    mark = None
    while True:
        new, new_path = materialize(_small_star(_large_star(links)), "links")
        # a star forest no longer changes
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        discard(spark, path)
        links, path = new, new_path
        if now == mark:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
