"""Connected components of an undirected graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)``: the least node of its component.

    Each round gives a node the least root among its neighbours' and then the root of that root, so
    that long chains halve; rounds end when no root changes. Tables are written between rounds.
    Nodes of a link to themselves count; nulls don't.
    """
    edges = links.select("a", "b").where("a is not null and b is not null").distinct()
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    roots = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "roots")
    while True:
        near = (both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("near")))
        stepped = roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("far"))
        moved = written(stepped.join(jump, "root", "left").select("node", "old", F.least("root", "far").alias("root")), "roots")
        if moved.where("root != old").isEmpty():
            return moved.select("node", "root")
        roots = moved.select("node", "root")
