"""Connected components by alternating large and small stars, all in Spark.

Each round replaces a component's links by links to smaller nodes until every
node links to the smallest of its component.  Minima are pre-aggregated before
the shuffle and hubs are joined, not gathered, so a hub's links can be split over
tasks.  Rounds are cut by checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import checkpointed


def _large_star(links: DataFrame) -> DataFrame:
    """Neighbours above a node link to the smallest of the node and its neighbours."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its neighbours below link to the smallest of these (links go down)."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b): every linked node but the smallest of its component, and that smallest node."""
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    links = checkpointed(links)
    before = state(links)
    while True:
        links = checkpointed(_small_star(_large_star(links)))
        after = state(links)
        if after == before:
            return links
        before = after
