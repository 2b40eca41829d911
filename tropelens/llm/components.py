"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tropelens.llm.common import written


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b) -> (node, component): the smallest node of each component; nodes without a link don't appear.

    Each round every node takes the smallest label among its own and its neighbours', then the label of its label. All
    tables stay distributed; each round's labels are written to the shared folder. Sums at hubs are made before the
    shuffle. Null ends and self-links are ignored, repeated links count once.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("m"))
        new = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        roots = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        new = new.join(roots, "component", "left").select("node", "old", F.least("component", F.coalesce("root", "component")).alias("component"))
        new = written(new, "labels")
        changed = new.where("component <> old").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle within {most_rounds} rounds")
