"""Replays equal working everything out again, and read only what changed."""

import re

from pyspark.sql import functions as F

from factloom.operators import replay as x
from factloom.operators.effects import merge_effects
from factloom.plans import replays
from factloom.plans.merging import readings


def rows(df):
    return sorted((tuple(r) for r in df.select("event_id", "field", *x.READ).collect()), key=repr)


def test_renormalized_is_full(spark, sf_dir):
    path = replays.stored(spark, sf_dir)
    got = x.renormalized(spark, path, "event_id", replays.NEW, "1")
    assert x.changed_fields(spark, path, replays.NEW, "1") == ["power_max", "weight"]
    assert x.changed_fields(spark, path, replays.OLD, "1") == [] and len(x.changed_fields(spark, path, replays.OLD, "2")) == 5
    plan = got._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[[^\]]*\]", plan)
    assert filters and all("power_max" in f and "weight" in f and "users" not in f and "note" not in f for f in filters)
    full = x.valued(replays.stated(spark, sf_dir), replays.NEW)
    new = got.select("event_id", "field", "now.*").unionByName(spark.read.parquet(f"{path}/values").where(~F.col("field").isin("power_max", "weight")).select("event_id", "field", *x.READ))
    assert rows(new) == rows(full)
    assert x.renormalized(spark, path, "event_id", replays.OLD, "1").count() == 0


def test_refreshed_is_full(spark, sf_dir):
    path = replays.stored(spark, sf_dir)
    now = replays.stated(spark, sf_dir, changed=True)
    got = x.refreshed(spark, path, now, "event_id", replays.OLD)
    whole = spark.read.parquet(f"{path}/values")
    new = got.select("event_id", "field", "now.*").unionByName(whole.join(got, ["event_id", "field"], "left_anti").select("event_id", "field", *x.READ))
    assert rows(new) == rows(x.valued(now, replays.OLD))
    assert x.refreshed(spark, path, replays.stated(spark, sf_dir), "event_id", replays.OLD).count() == 0
    few = x.refreshed(spark, path, now.where("event_id % 50 = 0 and event_id < 400"), "event_id", replays.OLD)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", few._jdf.queryExecution().executedPlan().toString())


def test_remerged_is_full(spark, sf_dir):
    key, order = ["user_id", "event_type"], ["ts", "event_id"]
    was = readings(spark, sf_dir)
    mine = F.col("user_id") % 10 == 3
    now = was.withColumn("num", F.when(mine & (F.col("num") > 20), 100.0).otherwise(F.col("num")))
    part, _ = x.remerged(merge_effects(was, key, order), now, was.where(mine).select(*key).distinct(), key, order)
    full = merge_effects(now, key, order)
    for a, b in zip(part, full, strict=True):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
