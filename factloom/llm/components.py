"""Connected components of a graph of integer ids, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import saved


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) edges to (id, component): the smallest id that each id is connected with.

    Every round joins each id's neighbours to the smallest of them; the number of edges never grows, and a hub's
    neighbours are handled by partial aggregates and a join that can be split, never by one task: what is joined is
    written first, since adaptive execution splits no join right above an aggregate.  Rounds are checkpointed, so a
    lost executor costs one round.  Self edges, repeats and nulls are dropped.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = saved(edges)
    state = signature(edges)
    for _ in range(most_rounds):
        edges = saved(star(star(edges, large=True), large=False))
        now = signature(edges)
        if now == state:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        state = now
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
    return tuple(row)


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each id's larger neighbours get its smallest neighbour (or itself); small: its smaller ones do, and it."""
    both = edges.select("a", "b")
    if large:
        both = both.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    if large:
        least = saved(least.withColumn("m", F.least("a", "m")))
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = saved(least)
        out = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()
