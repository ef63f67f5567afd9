"""Connected components of a stored table of links, by contraction; nothing comes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipsight.llm.shared import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b): the label is the same all over a component.

    In each round a node moves to its smallest neighbour (and on to where that one
    moves), links are renamed and links within a node go.  Every node that is not the
    smallest around it disappears, so the rounds are few and links only get fewer.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = None
    edges = stored(both.filter("a <> b").distinct())
    while not edges.isEmpty():
        moves = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
        onward = moves.select(F.col("a").alias("to"), F.col("to").alias("then"))
        parent = stored(moves.join(onward, "to", "left").select(F.col("a").alias("node"), F.coalesce("then", "to").alias("label")))
        if labels is None:
            labels = parent
        else:
            renamed = parent.select(F.col("node").alias("label"), F.col("label").alias("new"))
            labels = stored(labels.join(renamed, "label", "left").select("node", F.coalesce("new", "label").alias("label")))
        to_a = parent.select(F.col("node").alias("a"), F.col("label").alias("new_a"))
        to_b = parent.select(F.col("node").alias("b"), F.col("label").alias("new_b"))
        moved = edges.join(to_a, "a").join(to_b, "b").select(F.col("new_a").alias("a"), F.col("new_b").alias("b"))
        edges = stored(moved.filter("a <> b").distinct())
    if labels is None:
        return links.sparkSession.createDataFrame([], "node long, label long")
    return labels
