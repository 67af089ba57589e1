"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from configsieve.llm.storage import settled


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node in `edges` (a, b: long).

    Each round links every node to the smallest node known around it: edges
    turn into (node, smallest neighbour) stars, first towards larger nodes, then
    towards smaller ones, until nothing changes; rounds grow with the logarithm
    of the longest chain.  A round's groups are aggregated with `min`, so a hub
    is never gathered.  Rounds are written to the shared folder.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    links = settled(links, "links")
    before = None
    while True:
        # Large star: a node's larger neighbours move to the smallest of its neighbourhood.
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # Written, so that both sides of the join come from plain exchanges: a hub's links are then split.
        low = settled(low, "lowest")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a > b").distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = small.unionByName(low.select("a", F.col("m").alias("b"))).where("a > b").distinct()
        links = settled(links, "links")
        seen = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)


def joined_roots(n: int, left, right) -> list[int]:
    """For 0 .. n-1, the smallest number reachable by the links left[k]-right[k], within one task."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(left, right, strict=True):
        a, b = find(int(a)), find(int(b))
        if a != b:
            root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]
