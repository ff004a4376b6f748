"""Walks over edges of string keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.checkpoints import saved


def edges_by_priority(*sources: DataFrame) -> DataFrame:
    """(src, dst) edges of several sources; of one that several have, the first source's counts."""
    tagged = [s.select("src", "dst", F.lit(i).alias("priority")) for i, s in enumerate(sources)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out.groupBy("src", "dst").agg(F.min("priority").alias("priority"))


def walk(edges: DataFrame, starts: DataFrame, depth: int = 6) -> DataFrame:
    """(start, node, hops) of all nodes within `depth` hops of each start; a node counts at its least distance.

    Every hop is checkpointed, so that a hop's plan is one join however deep the walk is.
    """
    edges = saved(edges.select("src", "dst"))
    frontier = starts.select(F.col("start"), F.col("start").alias("node"), F.lit(0).alias("hops"))
    seen = frontier
    for hop in range(1, depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("start", F.col("dst").alias("node")).distinct()
        frontier = saved(step.join(seen, ["start", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("hops > 0")
