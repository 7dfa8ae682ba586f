"""Connected components of a table of links, without gathering links or nodes anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the smallest node that links reach.

    Nodes are of any type with an order. Each round points every node at its smallest neighbour,
    follows these pointers twice, and contracts the links to the nodes pointed at; rounds end when no
    link joins two different nodes, after a number that is logarithmic in the longest chain.
    Pre-aggregated minima keep a node with very many links from filling one task.
    """
    found = staged = None
    rest = links.select("a", "b").filter("a <> b").distinct()
    while True:
        both = rest.union(rest.select("b", "a"))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root"))
        nearest = materialize(least, "pointers")
        if nearest.isEmpty():
            break
        steps = materialize(_follow(_follow(nearest, nearest), _follow(nearest, nearest)), "pointers")
        discard(nearest)
        ends = steps.select(F.col("node").alias("b"), F.col("root").alias("end_b"))
        moved = rest.join(steps.withColumnRenamed("node", "a"), "a").join(ends, "b").select(F.least("root", "end_b").alias("a"), F.greatest("root", "end_b").alias("b"))
        rest = materialize(moved.filter("a <> b").distinct(), "links")
        discard(staged)
        staged, before = rest, found
        if before is None:
            found = steps
        else:
            found = materialize(_follow(before, steps), "roots")
            discard(before, steps)
        if rest.isEmpty():
            break
    if found is None:
        both = links.select(F.col("a").alias("node"), F.col("a").alias("root"))
        return links.sparkSession.createDataFrame([], both.schema)
    return found


def _follow(pointers: DataFrame, further: DataFrame) -> DataFrame:
    further = further.select(F.col("node").alias("root"), F.col("root").alias("further"))
    return pointers.join(further, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
