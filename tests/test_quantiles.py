import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import hygiene, monitor
from factloom.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("p", [0.5, 0.0, 1.0, 0.9, 0.37])
def test_exact_in_rounds(spark, p):
    """One group with most rows, ties, outliers, one value only, and nulls; so few rows may be ordered that several rounds are needed."""
    rnd = random.Random(int(p * 100))
    rows = [("big", rnd.lognormvariate(0, 5)) for _ in range(9000)] + [("ties", float(rnd.choice([1, 2, 2, 2, 3]))) for _ in range(3000)] + [("one", 7.0)] * 2000 + [("pair", 1.0), ("pair", 4.0)] + [("none", None), (None, 1.0)]
    rows += [("far", x) for x in [-1e300, 1e300, 0.0] + [rnd.random() * 1e-9 for _ in range(2000)]]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r["g"]: (r["n"], r["quantile"]) for r in exact_quantiles(df, "g", "v", p, few=20).collect()}
    for g in ("big", "ties", "one", "pair", "far"):
        own = [v for k, v in rows if k == g]
        assert got[g][0] == len(own) and got[g][1] == pytest.approx(np.quantile(own, p), rel=1e-12)
    assert set(got) == {"big", "ties", "one", "pair", "far"}


def test_medians_of_large_groups(spark):
    df = spark.range(40000).select((F.col("id") % 3).alias("s"), F.xxhash64("id").cast("double").alias("v"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("t"))
    got = {r["s"]: r for r in monitor.medians(df, "s", "v", "t", F.lit("2024-01-01 12:00:00").cast("timestamp"), "1 day", "7 days", 30).collect()}
    for r in df.groupBy("s").agg(F.percentile("v", 0.5).alias("m")).collect():
        assert got[r["s"]]["recent_median"] == got[r["s"]]["longer_median"] == r["m"]


def test_streaks(spark):
    rows = [("a", 1, True), ("a", 2, False), ("a", 3, True), ("a", 4, True), ("b", 1, True), ("b", 2, True), ("c", 1, True), ("c", 2, False)]
    got = monitor.streaks(spark.createDataFrame(rows, "s string, t int, bad boolean"), "s", ["t"], F.col("bad"))
    assert dict(map(tuple, got.collect())) == {"a": 2, "b": 2, "c": 0}


def test_chains(spark):
    """A chain of nine, and one that branches."""
    skus = ["AB-1" + "0" * i for i in range(9)] + ["CD-1", "CD-12", "CD-13", "CD-124"]
    parts = spark.createDataFrame([(i, "v", s) for i, s in enumerate(skus)], "part_id long, vendor string, sku string")
    got = {r["part_id"]: (r["root"], r["depth"]) for r in hygiene.chains(hygiene.extensions(parts)).collect()}
    assert got == {**{i: (0, i) for i in range(9)}, 9: (9, 0), 10: (9, 1), 11: (9, 1), 12: (9, 2)}
