"""Connected components of a link table, by joins and grouped minima.

Each round points every node at its least neighbour, follows the pointers to their roots and replaces the links
by links between roots; a round at least halves the parts that still have links. Nothing is gathered in one task:
minima are combined before the shuffle, and joins on a root that many nodes share are splittable skewed joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwatt.session import checkpointed


def pointed(links: DataFrame) -> DataFrame:
    """(node, root): every node of the links and the root of its tree of least neighbours."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("to")))
    trees = checkpointed(both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("root")))
    while True:
        up = trees.filter("node <> root").select(F.col("node").alias("root"), F.col("root").alias("above"))
        if up.join(trees.filter("node <> root").select("root").distinct(), "root", "left_semi").isEmpty():
            return trees
        trees = checkpointed(trees.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of `links` (a, b): component is the least node that links reach.

    Repeated links, links both ways and links of a node to itself are harmless; null ends are ignored.
    """
    links = links.select("a", "b").filter("a is not null and b is not null")
    links = checkpointed(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while found is None or not links.isEmpty():
        trees = pointed(links)
        found = trees.withColumnRenamed("root", "component") if found is None else checkpointed(found.join(trees.select(F.col("node").alias("component"), F.col("root").alias("up")), "component", "left").select("node", F.coalesce("up", "component").alias("component")))
        a = trees.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = trees.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = links.filter("a <> b").join(a, "a").join(b, "b").filter("ra <> rb")
        links = checkpointed(left.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return found
