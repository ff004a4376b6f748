"""Alarms without repeats, against going through the rows of each key in order."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators.monitor import alarms

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC).replace(tzinfo=None)


def in_order(rows, seconds):
    last, out = {}, set()
    for source, n, t in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[1])):
        if source not in last or (t - last[source]).total_seconds() >= seconds:
            last[source] = t
            out.add((source, n))
    return out


@pytest.mark.parametrize(("seed", "spans", "gap"), [(1, 1, 3), (2, 2, 13), (3, 24, 400), (4, 3, 2000), (5, 1000, 60)])
def test_alarms(spark, seed, spans, gap):
    """One source holds most events; times repeat, meet the pause exactly, and pauses pass between some."""
    rng, rows, t = random.Random(seed), [], 0
    for n in range(600):
        t += rng.choice([0, 1, gap, 60, 60 * gap if n % 97 == 0 else 0])
        rows.append((rng.choice(["hot"] * 6 + ["cold", None]), n, T0 + datetime.timedelta(seconds=t)))
    rows += [("cold", 1000, None), ("never", 1001, None)]
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, "source string, event_id long, ts timestamp").repartition(5)
    out = alarms(log, ["source"], "ts", minutes=1, spans=spans)
    assert out.columns == log.columns
    got = [(r["source"], r["event_id"]) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == in_order(rows, 60)


def test_rows_repeated_and_before_1970(spark):
    rows = [("a", 1, T0), ("a", 1, T0), ("a", 2, T0 - datetime.timedelta(days=40000)), ("a", 3, T0 - datetime.timedelta(days=40000, minutes=-60)), ("a", 4, T0 - datetime.timedelta(days=40000, minutes=-59))]
    log = spark.createDataFrame(rows, "source string, event_id long, ts timestamp").withColumn("m", F.create_map(F.lit("x"), F.col("event_id")))
    assert sorted(r["event_id"] for r in alarms(log, ["source"], "ts").collect()) == [1, 2, 3]
    assert alarms(log.limit(0), ["source"], "ts").count() == 0
