"""Connected components over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.tables import materialize, shared_dir

__all__ = ["connected_components", "materialize", "shared_dir"]


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges(a, b)`` of longs -> ``(id, component)``: each end of an edge with the smallest id that it reaches.

    Every round hooks a node to its smallest neighbour, follows the hooks twice and
    contracts the edges, so that the edge table shrinks until none is left. The tables
    of each round are written to the shared folder; nothing goes to the driver but row
    counts. Self-loops and repeated edges are allowed, null ends are dropped, and an
    empty table gives an empty result.
    """
    left = materialize(
        edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        f"{name}-edges",
    )
    labels = None
    step = 0
    while True:
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("p"))
        up = hooks.select(F.col("a").alias("p"), F.col("p").alias("q"))
        hooks = hooks.join(up, "p").select("a", F.col("q").alias("p"))
        hooks = materialize(hooks, f"{name}-hooks{step}")
        root = hooks.select(F.col("a").alias("label"), F.col("p").alias("to"))
        if labels is None:
            labels = hooks.select(F.col("a").alias("id"), F.col("p").alias("label"))
        else:
            labels = labels.join(root, "label", "left").select("id", F.coalesce("to", "label").alias("label"))
            labels = materialize(labels, f"{name}-labels{step}")
        left = (
            left.join(hooks.select("a", "p"), "a")
            .join(hooks.select(F.col("a").alias("b"), F.col("p").alias("q")), "b")
            .where("p <> q")
            .select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
            .distinct()
        )
        left = materialize(left, f"{name}-edges{step}")
        if left.isEmpty():
            return labels.select("id", F.col("label").alias("component"))
        step += 1
