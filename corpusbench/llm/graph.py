"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusbench.session import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """v, component (the smallest id reachable) for every id in links (a, b).

    Labels fall to the least label among the neighbours, then each follows its
    label's own label, so long chains shorten by half a round. Each round is
    written to the shared folder; both sides of each join are then plain
    exchanges, whose hot keys adaptive execution splits. Nothing but the count
    of changes comes to the driver. No links: no rows.
    """
    a, b = F.col("a"), F.col("b")
    both = links.where(a != b).select("a", "b").union(links.where(a != b).select(b.alias("a"), a.alias("b"))).distinct()
    edges = materialize(both, "links")
    labels = materialize(edges.groupBy(a.alias("v")).agg(F.min(F.least(a, b)).alias("component")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("v", "b"), "b").groupBy(a.alias("v")).agg(F.min("component").alias("seen"))
        lower = labels.join(near, "v").select("v", F.col("component").alias("old"), F.least("component", "seen").alias("component"))
        lower = materialize(lower, "lower-labels")
        jump = lower.select(F.col("v").alias("component"), F.col("component").alias("next"))
        after = lower.join(jump, "component").select("v", "old", F.least("component", "next").alias("component"))
        after = materialize(after, "next-labels")
        labels = after.select("v", "component")
        if not after.where("component <> old").limit(1).count():
            return labels
