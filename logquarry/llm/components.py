"""Connected components of links, by smallest label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import discard, stored


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """links: a, b, `rows` of them where known. Returns (node, label) for every linked node; label is the least node
    of its component. Each round every node takes the least label around it, then the
    label of its label; labels of paths so halve their way in every round."""
    links = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                   .distinct(), "links", rows=rows)
    nodes = None if rows is None else 2 * rows
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                    .select("node", F.least("node", "m").alias("label")), "labels", rows=nodes)
    while True:
        around = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m")))
        least = labels.join(around, labels["node"] == around["a"]).select(
            "node", "label", F.least("label", "m").alias("new"))
        least = stored(least, "labels-around", rows=nodes)
        ends = least.select(F.col("node").alias("_lq_end"), F.col("new").alias("_lq_jump"))
        jumped = stored(least.join(ends, least["new"] == ends["_lq_end"]).select(
            "node", F.col("_lq_jump").alias("new"), (F.col("_lq_jump") != F.col("label")).alias("moved")), "labels", rows=nodes)
        discard(least, labels)
        labels = jumped.select("node", F.col("new").alias("label"))
        labels._lq_path = jumped._lq_path
        if not jumped.where("moved").limit(1).count():
            discard(links)
            return labels
