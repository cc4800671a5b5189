"""Connected components by smallest reachable id, with staged tables between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.sources.workspace import staged

MAX_ROUNDS = 200


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (columns a and b, longs); component is the smallest id reachable.

    Each round takes the smallest label among the neighbours and then the label of that label, so chains
    shorten by powers. Every round is written to the shared folder. Edges with a null end are left out.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    links = staged(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = staged(
        links.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("component")), "labels"
    )
    for _ in range(MAX_ROUNDS):
        near = (
            links.join(labels.select(F.col("id").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        )
        lower = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        jump = labels.select(F.col("id").alias("mid"), F.col("component").alias("far"))
        moved = staged(
            lower.join(jump, "mid").select("id", F.least("mid", "far").alias("component"), (F.least("mid", "far") < F.col("old")).alias("moved")),
            "labels",
        )
        labels = moved.select("id", "component")
        if moved.where("moved").isEmpty():
            return labels
    raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")
