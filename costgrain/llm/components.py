"""Connected components of a link table, by alternating star contraction.

Every round turns the links into links to smaller nodes: the large star joins a
node's larger neighbours to its smallest one, the small star does so with the
smaller neighbours. It ends when the links no longer change, and each node then
points at the smallest node of its component. Rounds grow with the logarithm of
the nodes. Rounds are cut by checkpoints, and links never reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costgrain.llm.common import apart, cut


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = apart(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "a")
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(apart(least, "a"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a long, b long) that is not the
    smallest of its component. Links to oneself and with a null end are ignored."""
    now = cut(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = _mark(now)
    while True:
        now = cut(_small_star(_large_star(now).distinct()).distinct())
        seen, mark = mark, _mark(now)
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
