"""Exact quantiles of groups of any size.

A sketch of each group, merged from partial ones, gives split points whose ranks are known within a bound; the quantile lies
between two of them.  Rows between these are counted and sketched again until few are left, and only those are ordered.  No
group is ever in one buffer; a round leaves about one in a hundred rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.checkpoints import saved

#: Split points of a sketch, and its accuracy: ranks are off by 1 / ACCURACY of the rows at most, far below 1 / POINTS.
POINTS = 512
ACCURACY = 10_000


def exact_quantiles(rows: DataFrame, group: str, value: str, p: float = 0.5, few: int = 10_000) -> DataFrame:
    """Of each group n (values that are not null) and the quantile, interpolated between the two values next to it.

    few: distinct values of a group that one task may order.  Null groups are left out, as are groups without values.
    """
    name, group = group, "_group"
    values = rows.select(F.col(name).alias(group), F.col(value).cast("double").alias("x")).where("_group is not null and x is not null")
    n = F.count(F.lit(1))
    state = values.groupBy(group).agg(n.alias("n"), n.alias("inside"), F.min("x").alias("low"), F.max("x").alias("high")).withColumn("below", F.lit(0).cast("long"))
    state = saved(state.select(group, "n", "inside", "below", "low", "high", F.lit(False).alias("stuck")))
    points = [i / POINTS for i in range(POINTS + 1)]
    within = (F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high"))
    rank = F.lit(float(p)) * (F.col("n") - 1)
    while not (left := state.where((F.col("inside") > few) & (F.col("low") < F.col("high")) & ~F.col("stuck"))).isEmpty():
        inner = values.join(left.select(group, "low", "high"), group).where(within)
        splits = inner.groupBy(group).agg(F.percentile_approx("x", points, ACCURACY).alias("s"))
        # the places of the ranks on either side among the split points, one point further out each
        start, end = [(side(rank) - F.col("below")) / F.col("inside") * POINTS for side in (F.floor, F.ceil)]
        narrow = left.join(splits, group).select(
            group, "n", "below", F.col("inside").alias("before"),
            F.greatest("low", F.get("s", F.greatest(F.floor(start).cast("int") - 1, F.lit(0)))).alias("low"), F.least("high", F.get("s", F.least(F.ceil(end).cast("int") + 1, F.lit(POINTS)))).alias("high"),
            F.col("low").alias("old_low"), F.col("high").alias("old_high"),
        )
        narrow = saved(narrow)
        counted = values.join(narrow.select(group, "low", "high", "old_low", "old_high"), group).where((F.col("x") >= F.col("old_low")) & (F.col("x") <= F.col("old_high")))
        counted = counted.groupBy(group).agg(F.count_if(F.col("x") < F.col("low")).alias("more"), F.count_if(within).alias("inside"))
        # a split point that is off by more than its bound would lose the rank: then the old range stays
        new = narrow.join(counted, group)
        below = F.col("below") + F.col("more")
        holds = (below <= F.floor(rank)) & (below + F.col("inside") > F.ceil(rank))
        done = [F.when(holds, a).otherwise(b).alias(c) for c, a, b in (("inside", F.col("inside"), F.col("before")), ("below", below, F.col("below")), ("low", F.col("low"), F.col("old_low")), ("high", F.col("high"), F.col("old_high")))]
        new = new.select(group, "n", *done, (~holds | (F.col("inside") == F.col("before"))).alias("stuck"))
        state = saved(state.join(new.select(group), group, "left_anti").unionByName(new))
    counts = values.join(state.select(group, "low", "high"), group).where(within).groupBy(group, "x").agg(n.alias("c"))
    upto = F.sum("c").over(Window.partitionBy(group).orderBy("x"))
    ordered = counts.withColumn("upto", upto).join(state.select(group, "n", "below"), group).withColumn("upto", F.col("upto") + F.col("below"))
    at = [F.min(F.when(F.col("upto") > side(rank), F.col("x"))) for side in (F.floor, F.ceil)]
    out = ordered.groupBy(group).agg(F.first("n").alias("n"), at[0].alias("a"), at[1].alias("b"))
    return out.select(F.col(group).alias(name), "n", (F.col("a") + (F.col("b") - F.col("a")) * (rank - F.floor(rank))).alias("quantile"))
