"""Connected components over pairs of longs, without a collection of the graph anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW_ROWS, look_up, saved


def components(pairs: DataFrame) -> DataFrame:
    """(node, label): the smallest node of its component, for each node of pairs (a, b).

    Each round takes the smallest label among neighbours and then the label of that label, so the number of rounds grows with
    the logarithm of the longest path; each round's result is a reliable checkpoint. No pairs give no rows.
    """
    edges = saved(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    total = edges.count()
    labels = saved(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        heard = look_up(edges, labels.select(F.col("node").alias("b"), "label"), "b", total).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("least"))
        step = labels.join(heard, "node").select("node", F.least("label", "least").alias("next"), F.col("label").alias("old"))
        step = saved(step) if total > FEW_ROWS else step  # it is read twice then
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        done = saved(look_up(step, jump, "next", total).select("node", F.least("next", "far").alias("label"), "old"))
        changed = done.filter("label <> old").limit(1).count()
        labels = done.select("node", "label")
        if not changed:
            return labels
