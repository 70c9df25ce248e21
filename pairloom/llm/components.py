"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.shared import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` of every id in ``edges(a, b)``: the smallest id reachable.

    Each round hangs every id that has a smaller neighbour under its smallest
    one, follows these links to their ends by doubling, and puts ends in place
    of ids in the edges; at least half of the ids of each component go in a
    round.  Grouping takes minima, which combine before the shuffle, so a hub
    with a third of all edges is no hot spot.  Each round is cut to the shared
    folder.  Loops and repeated edges do no harm; no edges give no rows.
    """
    pair = [F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")]
    left = cut(edges.where("a <> b").select(*pair).distinct())
    labels = left.select(F.explode(F.array("lo", "hi")).alias("id")).distinct().withColumn("component", F.col("id"))
    while not left.isEmpty():
        parent = left.groupBy("hi").agg(F.min("lo").alias("up"))
        while True:
            above = parent.select(F.col("hi").alias("_id"), F.col("up").alias("_up"))
            jumped = cut(
                parent.join(above, parent["up"] == above["_id"], "left").select(
                    "hi", F.coalesce("_up", "up").alias("up"), F.col("_up").isNotNull().alias("moved")
                )
            )
            parent = jumped.select("hi", "up")
            if jumped.where("moved").isEmpty():
                break
        end = parent.select(F.col("hi").alias("_id"), F.col("up").alias("_end"))
        labels = labels.join(end, labels["component"] == end["_id"], "left").select(
            "id", F.coalesce("_end", "component").alias("component")
        )
        ends = left.join(end, left["lo"] == end["_id"], "left").select(F.coalesce("_end", "lo").alias("a"), "hi")
        ends = ends.join(end, ends["hi"] == end["_id"], "left").select("a", F.coalesce("_end", "hi").alias("b"))
        left = cut(ends.where("a <> b").select(*pair).distinct())
    return cut(labels)
