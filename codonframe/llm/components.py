"""Connected components of a link table, by large-star and small-star rounds.

Both operations keep the components and pull every node towards the smallest
node near it; a few rounds, about the logarithm of the longest chain, leave
stars. All state lies in tables in the shared folder, where a round's tables make
way for the next one's. A hot node's neighbours
meet only in aggregates with partial sums and in joins that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, only_kept, stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _least(pairs: DataFrame) -> DataFrame:
    """For each node a of (a, b): the least of a and its b."""
    return stored(pairs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a")))


def _ordered(links: DataFrame) -> DataFrame:
    return links.where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node that links reach) of every node of (a, b) links."""
    spark = links.sparkSession
    with only_kept(spark) as here:
        edges = here.keep(stored(_ordered(links.select(F.col("a").alias("x"), F.col("b").alias("y")))))
    held = here.kept
    mark = _mark(edges)
    while mark[0]:
        with only_kept(spark) as here:
            # Large star: greater neighbours of a go to the least near a. Small star: a and its lesser neighbours do.
            pairs = _both(edges)
            large = stored(_ordered(pairs.join(_least(pairs), "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("x"), F.col("m").alias("y"))))
            down = large.select(F.col("b").alias("a"), F.col("a").alias("b"))
            least = _least(down)
            pulled = down.join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
            edges = here.keep(stored(_ordered(pulled.unionByName(least.select(F.col("a").alias("x"), F.col("m").alias("y"))))))
        discard(spark, held)
        held = here.kept
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    nodes = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return nodes.groupBy("node").agg(F.min("component").alias("component")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
