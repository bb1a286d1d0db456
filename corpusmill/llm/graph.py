"""Connected components of links, by joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import spool


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links (a, b) reach from each linked id.

    Each round hangs every id onto its smallest neighbour, follows the hangers
    to their tops and replaces the links by links between tops, which at least
    halves the ids that still have links. Rounds are written out, so lineage
    stays short, and minima combine before the shuffle, so a hub does no harm.
    """
    left = spool(edges.where(F.col("a") != F.col("b"))
                 .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    found: DataFrame | None = None
    while not left.isEmpty():
        smallest = _both_ways(left).groupBy("a").agg(F.min("b").alias("b"))
        up = spool(smallest.select(F.col("a").alias("id"), F.least("a", "b").alias("top")), "hangers")
        while True:  # a hanger of a hanger goes to the latter's top
            above = up.select(F.col("id").alias("top"), F.col("top").alias("higher"))
            moved = spool(up.join(above, "top").select("id", F.col("higher").alias("top"),
                                                       (F.col("higher") != F.col("top")).alias("moved")), "hangers")
            up = moved.select("id", "top")
            if moved.where("moved").isEmpty():
                break
        if found is None:
            found = up
        else:
            later = up.select(F.col("id").alias("top"), F.col("top").alias("higher"))
            found = spool(found.join(later, "top", "left").select("id", F.coalesce("higher", "top").alias("top")), "tops")
        a = up.select(F.col("id").alias("a"), F.col("top").alias("ta"))
        b = up.select(F.col("id").alias("b"), F.col("top").alias("tb"))
        between = left.join(a, "a").join(b, "b").where("ta != tb")
        left = spool(between.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links")
    if found is None:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found.select("id", F.col("top").alias("component"))
