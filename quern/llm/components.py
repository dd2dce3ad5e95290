"""Connected components of a table of links, as joins and minima: nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialise, parts_of, release


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of the links (a, b); label is the smallest node of the component.

    Each round takes the smallest label among a node and its neighbours and then that label's own, so paths shorten by
    more than half. Every round is a written table, in as few parts as its rows need; a hot node's links are dealt
    out by the join and its label is the least of partial ones.
    """
    spark = links.sparkSession
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = materialise(both, 2 * links.count())
    parts = parts_of(both.count())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label"))
    labels = materialise(labels.coalesce(parts))
    while True:
        near = both.join(labels.select(F.col("node").alias("a"), "label"), "a").coalesce(parts).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        near = materialise(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("to")).coalesce(parts))
        jump = near.select(F.col("node").alias("to"), F.col("to").alias("further"))
        moved = materialise(near.join(jump, "to", "left").select("node", "label", F.least("to", F.coalesce("further", "to")).alias("new")).coalesce(parts))
        changed = not moved.where("label <> new").isEmpty()
        release(spark, near, labels)
        labels = moved.select("node", F.col("new").alias("label"))
        if not changed:
            release(spark, both)
            return labels
