"""Connected components of an edge table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bourse.llm.common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, label): the smallest id of the component of every id that has an edge.

    Each round hooks every id to its smallest neighbour, follows the hooks to
    their ends by doubling, and contracts the graph to those ends.  Only local
    minima survive a round, so at most half of the ids with edges do.  Results of
    rounds are tables in the shared folder.
    """
    edges = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("to"))
                    .select("id", F.least("id", "to").alias("to")), "hooks")
        while True:
            onward = up.select(F.col("id").alias("to"), F.col("to").alias("next")).where("to <> next")
            if up.join(onward, "to", "left_semi").isEmpty():
                break
            up = stored(up.join(onward, "to", "left").select("id", F.coalesce("next", "to").alias("to")), "hooks")
        if labels is None:
            labels = up.select("id", F.col("to").alias("label"))
        else:
            step = up.select(F.col("id").alias("label"), "to")
            labels = stored(labels.join(step, "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
        edges = stored(edges.join(up.select(F.col("id").alias("a"), F.col("to").alias("x")), "a")
                       .join(up.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
                       .select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct(), "edges")
        if edges.isEmpty():
            return labels
