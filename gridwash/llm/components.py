"""Connected components of a graph that is spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwash.session import frozen


def components(edges: DataFrame) -> DataFrame:
    """``v, label`` for every end of an edge ``a, b``: the smallest vertex that is reachable from ``v``.

    Each round takes the smallest label among the neighbours and then the label of that label, which halves the way to go.
    Labels are written to the shared folder after every round, so lineage stays short; only a count of changes reaches
    the driver. Loops, repeated edges and edges with a NULL end are ignored.
    """
    ends = edges.filter("a <> b").select("a", "b")
    both = frozen(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = frozen(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("n"))
                    .select("v", F.least("v", "n").alias("label")), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v"))
                .agg(F.min("label").alias("near")))
        lower = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("next"))
        # Labels are vertices themselves, so the label of a label comes from the same table.
        jump = labels.select(F.col("v").alias("next"), F.col("label").alias("further"))
        new = frozen(lower.join(jump, "next").select("v", "old", F.least("next", "further").alias("label")), "labels")
        changed = new.filter("label <> old").limit(1).count()
        labels = new.select("v", "label")
        if not changed:
            return labels
