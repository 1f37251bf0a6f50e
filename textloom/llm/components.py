"""Connected components of links between 64-bit nodes, by hash-to-min with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def connected_components(links: DataFrame, files: int = 1, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """links: a, b (long). Returns the edges (a, b in both directions, each once, with those of `known`), and node, comp
    for every node in a link; comp is the smallest node it reaches.

    Each round takes the least label among a node and its neighbours, then the label of
    that label, so the number of rounds grows with the logarithm of the longest path. Labels
    are combined before the shuffle; no neighbourhood is ever gathered. The neighbours of a hub and the members of a
    giant component share a key in a join of which the other side holds it once, so Spark can split it. Each round is
    written to the shared folder, in `files` files, so a lost executor costs one round at most. Repeated links and
    links of a node with itself change nothing; no links give two empty tables.
    """
    both = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
    edges = materialise((both if known is None else both.union(known)).distinct(), "edges", files)
    labels = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels", files)
    last = labels
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        least = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("comp").alias("next"))
        moved = materialise(least.join(jump, "via", "left").select("node", "old", F.least("via", F.coalesce("next", "via")).alias("comp")), "labels", files)
        release(last)
        last, labels = moved, moved.select("node", "comp")
        if moved.filter("old <> comp").isEmpty():
            return edges, labels
