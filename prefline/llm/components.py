"""Connected components of an edge table by repeated joins; nothing goes to the driver
but a count and a checksum a round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def forest(n: int, a, b) -> list[tuple[int, int]]:
    """(root, member) of the components of edges a-b over 0..n-1; the root is the least."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a, b):
        x, y = find(int(x)), find(int(y))
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(find(x), x) for x in range(n) if find(x) != x]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge; component: its least node.

    Each round sends every neighbour of a node, and the node, to the least of them.
    Edges become stars around the least node of a component, in a number of rounds
    that grows with the logarithm of its width; they never outnumber twice the input.
    The leasts are written first: read back, they are dealt anew for the join, and Spark
    can split the partition of a node with very many neighbours.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("node", "to").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            return now.groupBy("node").agg(F.min("to").alias("component")).unionByName(
                now.select(F.col("to").alias("node"), F.col("to").alias("component")).distinct().join(
                    now.select("node").distinct(), "node", "left_anti"))
        seen = tuple(mark)
        both = now.unionByName(now.select(F.col("to").alias("node"), F.col("node").alias("to")))
        least = both.groupBy(F.col("node").alias("of")).agg(F.min("to").alias("low"))
        least = written(least.select("of", F.least("of", "low").alias("low")), "leasts")
        sent = both.join(least, F.col("node") == F.col("of"))
        sent = sent.select(F.col("to").alias("node"), F.col("low").alias("to")).unionByName(least.select(F.col("of").alias("node"), F.col("low").alias("to")))
        now = written(sent.where("node <> to").select(F.greatest("node", "to").alias("node"), F.least("node", "to").alias("to")).distinct(), "edges")
