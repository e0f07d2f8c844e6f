"""Connected components of a graph of links, as DataFrame rounds.

Each round every node takes the least label among itself and its neighbours, then the label of its label (pointer
jumping), so labels travel doubling distances. Sums and minima are combined before the shuffle; a node with many
neighbours is a key of an aggregate, never a group in one task. Rounds write their table to the shared folder, so a lost
executor costs one round's tasks at most; the table of the round before is then dropped. Only one number a round (rows that changed) reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, staged_at


def components(links: DataFrame, max_rounds: int = 200, most: int | None = None) -> DataFrame:
    """``links`` (a, b) as longs -> (node, label): label is the least node that can be reached. Nodes without links are absent.

    Nulls are dropped; loops, repeated links and either direction are allowed. ``most`` is about how many links there are, if
    that is known; it sizes files only. Raises if ``max_rounds`` do not suffice.
    """
    spark = links.sparkSession
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).dropna().distinct()
    edges, edge_path = staged_at(both, "edges", most)
    nodes = edges.count()  # at most; from the files' footers
    labels, path = staged_at(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")), "labels", nodes)
    for _ in range(max_rounds):
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label"))
        done, new_path = staged_at(step, "labels", nodes)
        discard(spark, path)  # the round before is not read again
        labels, path = done.select("node", "label"), new_path
        if not done.filter(F.col("old") != F.col("label")).limit(1).count():
            discard(spark, edge_path)
            return labels
    raise RuntimeError(f"labels still change after {max_rounds} rounds")
