"""Connected components of a link table, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import materialize


@staged
def components(links: DataFrame) -> DataFrame:
    """Stored ``node, label`` of all nodes of ``a, b`` links; the label is the smallest node reachable.

    Every round takes the smallest label among neighbours and then the label of that label, so paths halve.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(both.distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("label"))
        lower = materialize(lower, "labels")
        of = lower.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = lower.join(of, "label").select("node", F.col("root").alias("label"))
        jumped = materialize(jumped, "labels")
        old = labels.withColumnRenamed("label", "old")
        if not jumped.join(old, "node").where(F.col("label") != F.col("old")).limit(1).count():
            return jumped
        labels = jumped
