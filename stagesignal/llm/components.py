"""Connected components of a link table by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagesignal.llm.common import cut, group_join


def components(links: DataFrame) -> DataFrame:
    """links(a, b) long -> (node, root): every node that has a link, with the smallest node it reaches.

    A star step hangs every neighbour of a node on the smallest one. The number of links never grows, and the
    number of rounds goes with the logarithm of the longest path. The links of a node with very many of them stay where
    they are. Self-links and repeats are dropped first."""
    edges = cut(_clean(links.select(F.col("a").cast("long"), F.col("b").cast("long"))))
    seen = _mark(edges)
    while seen[0]:
        n = seen[0]
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
        large = group_join(both, low, ["u"], "n", 2 * n).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        down = cut(_clean(large).select(F.col("a").alias("u"), F.col("b").alias("v")))
        low = cut(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        joined = group_join(down, low, ["u"], "n", n)
        edges = cut(_clean(joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select("u", "m"))))
        if seen == (seen := _mark(edges)):
            break
    tree = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return tree.union(tree.select("root").distinct().select("root", "root"))


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
