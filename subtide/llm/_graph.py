"""Connected components of an edge table, kept in Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide.llm._tables import forget, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of (a long, b long): the least node of its component.

    Alternates large-star and small-star steps until nothing changes; both only
    take minima by key, so a node with very many links is no single task's work.
    """
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: every node's smaller neighbours, and itself, point at the least of them
        low = large.where("a <> b").distinct()
        floor = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(floor, "a").select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("m")), F.struct(F.col("a").alias("x"), F.col("m")))).alias("s"))
        nxt = written(small.select(F.col("s.x").alias("a"), F.col("s.m").alias("b")).where("a <> b").distinct(), "edges")
        # every edge points at a root once no node has two targets and no target is a source
        split = nxt.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
        chain = nxt.select("b").join(nxt.select(F.col("a").alias("b")), "b", "left_semi")
        done = split.isEmpty() and chain.isEmpty()
        forget(e)
        e = nxt
        if done:
            break
    roots = e.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
