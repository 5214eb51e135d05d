"""Connected components of a graph given by its links."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.storage import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) with the least node that links (a, b) reach as label; nodes without links are left out.

    Alternates two steps until the links are stars around least nodes: every larger neighbour
    of a node, then every smaller one, is tied to the least node around. The least neighbour comes
    from a partial aggregate and a join, so a node with very many links is not one group. Links that
    are stars already, as most are that the caller has, take one aggregate and no step.
    """
    links = materialize(
        links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not are_stars(links):
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Equal rows go at the end of the round, which spares a shuffle here.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(smallest.select("a", F.col("m").alias("b")))
        links = materialize(small.where("a != b").distinct(), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).union(links.select("b", "b").distinct())


def are_stars(links: DataFrame) -> bool:
    """Has every larger end of the distinct links (a, b), a > b, one link only? Then b is the least node of its component."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("b", F.lit(0), F.lit(1)))
    most = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).agg(F.max(F.when(F.col("up") > 0, F.col("up") + F.col("down"))))
    return (most.first()[0] or 1) == 1
