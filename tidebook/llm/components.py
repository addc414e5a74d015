"""Connected components by randomised contraction: every round each node moves to the least of its closed
neighbourhood in an order drawn anew, which takes a constant share of the nodes away, whatever the graph's shape.

All steps are joins and map-side combined minima, so a node with many links is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.scratch import stored


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node of a link between two different nodes; equal roots mean one component.

    Links may repeat and stand in either direction. A link with a null end or with itself says nothing and is skipped.
    The root is some member of the component. No links: an empty table.
    """
    a, b = F.col(left), F.col(right)
    links = stored(edges.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "links")
    kind = links.schema["a"].dataType.simpleString()
    moves: list[DataFrame] = []
    while not links.isEmpty():
        draw = len(moves)
        rank = lambda c: F.xxhash64(F.lit(draw), c)
        best = (
            links.select("a", "b")
            .union(links.select("b", "a"))
            .groupBy("a")
            .agg(F.min(F.struct(rank(F.col("b")).alias("rank"), F.col("b").alias("id"))).alias("best"))
        )
        own = F.struct(rank(F.col("a")).alias("rank"), F.col("a").alias("id"))
        move = stored(best.select(F.col("a").alias("node"), F.when(own < F.col("best"), F.col("a")).otherwise(F.col("best.id")).alias("root")), "moves")
        moves.append(move)
        to_a, to_b = move.toDF("a", "to_a"), move.toDF("b", "to_b")
        links = stored(
            links.join(to_a, "a")
            .join(to_b, "b")
            .where("to_a != to_b")
            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
            .distinct(),
            "links",
        )
    if not moves:
        return links.select(F.col("a").cast(kind).alias("node"), F.col("b").cast(kind).alias("root"))
    roots = moves[-1]
    for move in reversed(moves[:-1]):
        later = roots.toDF("root", "last")
        roots = move.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return roots
