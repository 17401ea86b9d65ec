"""Connected components of a link table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_table


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b: long), label being the component's smallest node.

    Alternates large-star and small-star: each node hands its larger, then its smaller neighbours to the smallest
    one it knows. Neighbours are never gathered: minima are aggregates with a map-side step, and each is written
    before it is joined back, so both sides of a join are sorted straight from a shuffle and adaptive execution can
    split the centre of a large star. The number of rounds grows as the logarithm of the largest component.
    """
    edges = cut(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = least = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
        star = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a != b").distinct()
        written = star = cut(star, "star")
        least = cut(star.groupBy("b").agg(F.min("a").alias("m")), "least")
        pulled = star.join(least, "b").select("a", "b", "m")
        star = pulled.select(F.col("m").alias("a"), "b").union(pulled.select("m", "a")).where("a != b").distinct()
        before, edges = edges, cut(star, "edges")
        for done in (before, large, least, written):
            drop_table(done)
        if state == (state := _state(edges)):
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).union(edges.select("a", "a").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.select(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
