"""Connected components of an edge table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import discard, materialize, rejoin


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node reachable) for every node of edges (a, b).

    Alternates large-star and small-star steps (Kiveris et al., 2014) until nothing changes: each step gives a node's
    larger, then smaller neighbours to its least neighbour. A hub's neighbours are dealt to several tasks. Every step is a written table; the number of steps grows
    with the logarithm of the component size.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")

    def state(x: DataFrame):
        return x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = state(e)
    while before[0]:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = rejoin(both, least, ["a"], "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "cc")
        discard(e)
        m = large.groupBy("a").agg(F.min("b").alias("m"))
        small = rejoin(large, m, ["a"], "b").select(F.col("b").alias("a"), F.col("m").alias("b")).union(m.select("a", F.col("m").alias("b")))
        e = materialize(small.where("a <> b").distinct(), "cc")
        discard(large)
        after = state(e)
        if after == before:
            break
        before = after
    # now every node but a root has its root alone
    out = materialize(e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "cc")
    discard(e)
    return out
