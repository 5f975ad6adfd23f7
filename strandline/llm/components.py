"""Connected components of an edge table by least labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node of its component. Labels stay in Spark; each round is a written table.

    In a round every node takes the least label among its own and its neighbours', then that label's own label, so a
    chain of n nodes takes about log n rounds. A neighbour of very many nodes is a skewed key of the edge side only, which
    adaptive execution splits; minima are taken before the shuffle."""
    both = written(
        edges.select(F.explode(F.array(
            F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))
        )).alias("e")).select("e.x", "e.y").where("x <> y").distinct(),
        "edges"
    )
    labels = both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("least")).select("node", F.least("node", "least").alias("root"))
    while True:
        labels = written(labels, "labels")
        near = both.join(labels.select(F.col("node").alias("y"), "root"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("root").alias("far"))
        step = written(step.join(jump, "new").select("node", "root", F.least("new", "far").alias("new")), "labels")
        if step.where("new <> root").isEmpty():
            return labels
        labels = step.select("node", F.col("new").alias("root"))
