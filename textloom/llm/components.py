"""Connected components of a graph in DataFrames, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.shared import discard, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of an edge; a component is named by its least node.

    In each round every label moves to the least label next to it, then once more along those moves; edges between
    equal labels vanish and the others are merged, until none is left. A node with very many edges costs no more than
    its edges: minima are combined before they are shuffled.
    """
    first = edges = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("component", F.col("node"))
    read = [first]  # by the labels, which are made at the end
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("to")).select("a", F.least("a", "to").alias("to"))
        once = written(least, "moves")
        again = once.select(F.col("a").alias("to"), F.col("to").alias("further"))
        moves = written(once.join(again, "to", "left").select("a", F.coalesce("further", "to").alias("to")), "moves")
        discard(once)
        read.append(moves)
        labels = labels.join(moves, F.col("component") == F.col("a"), "left").select("node", F.coalesce("to", "component").alias("component"))
        of_b = moves.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        left = written(edges.join(moves.withColumnRenamed("to", "to_a"), "a").join(of_b, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).where("a <> b").distinct(), "edges")
        if edges is not first:
            discard(edges)
        edges = left
    made = written(labels, "components")
    discard(edges, *read)
    return made
