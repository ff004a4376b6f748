"""Replays of stored readings after rules or texts changed, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..functions.normalize import Field
from ..operators import replay as x
from ..operators.effects import merge_effects
from ..sources.checkpoints import shared_folder
from ..sources.tables import load
from .merging import READINGS_SQL, effects_sql, readings
from .queries import query

OLD = {f.key: f for f in (Field("weight", "n", "kg"), Field("power_max", "n", "W", (0, 50_000)), Field("users", "n"), Field("note", "s"), Field("slots", "n", "slots"))}
NEW = OLD | {"weight": Field("weight", "n", "g"), "power_max": Field("power_max", "n", "W", (0, 30_000))}
FIELD_SQL = "CASE event_type WHEN 'purchase' THEN 'weight' WHEN 'click' THEN 'power_max' WHEN 'view' THEN 'users' WHEN 'signup' THEN 'note' ELSE 'slots' END"


def stated(spark, d, changed: bool = False) -> DataFrame:
    """A reading of each event: of five fields by its type.  changed: as another pass finds them, some other, some lost."""
    kind, i = F.col("event_type"), F.col("event_id")
    more = F.when(i % 50 == 0, 1).otherwise(0) if changed else F.lit(0)
    value = F.col("value") + more
    whole = lambda c: F.round(c).cast("long").cast("string")
    raw = F.when(kind == "purchase", F.concat(F.round(value, 1).cast("string"), F.lit(" kg"))).when(kind == "click", F.concat(whole(value * 100), F.lit(" W"))).when(kind == "view", F.concat(whole(value), F.lit("k"))).when(kind == "signup", F.concat(F.lit("about "), (F.col("user_id") + more).cast("string")))
    field = F.when(kind == "purchase", "weight").when(kind == "click", "power_max").when(kind == "view", "users").when(kind == "signup", "note").otherwise("slots")
    raw = F.when(i % 70 != 1, raw) if changed else raw
    return load(spark, d, "events").select("event_id", field.alias("field"), F.lit("Value").alias("label"), raw.alias("raw"), (i % 5).cast("int").alias("tier"))


def stored(spark, d) -> str:
    path = f"{shared_folder(spark)}/values-{uuid.uuid4().hex}"
    x.write_store(stated(spark, d), "event_id", OLD, "1", path)
    return path


RULES_SQL = f"""SELECT event_id, {FIELD_SQL} AS field, CASE WHEN event_type = 'purchase' AND round(value, 1) = 0 OR event_type = 'click' AND round(value * 100) <= 30000 THEN 'same' WHEN event_id % 5 = 0 THEN 'protected' WHEN event_type = 'purchase' THEN 'changed' ELSE 'refused' END AS outcome FROM events WHERE event_type IN ('purchase', 'click')"""


@query(RULES_SQL)
def replay_rules(spark, d):
    """After two fields' rules changed: their readings, from their own partitions."""
    return x.renormalized(spark, stored(spark, d), "event_id", NEW, "1").select("event_id", "field", "outcome")


@query(f"""SELECT event_id, {FIELD_SQL} AS field, CASE WHEN event_id % 70 = 1 THEN 'unrecoverable:RAW_LOST_VALUE_PRESENT' WHEN event_id % 5 = 0 THEN 'protected' ELSE 'changed' END AS outcome FROM events WHERE event_type <> 'error' AND (event_id % 50 = 0 OR event_id % 70 = 1)""")
def replay_texts(spark, d):
    """After some texts changed or were lost: those readings, from their buckets."""
    return x.refreshed(spark, stored(spark, d), stated(spark, d, changed=True), "event_id", OLD).select("event_id", "field", "outcome")


@query(f"""SELECT field, n, count(*) FILTER (outcome = 'changed') AS changed, count(*) FILTER (outcome = 'refused') AS refused, count(*) FILTER (outcome = 'protected') AS protected, count(*) FILTER (outcome = 'same') AS same, count(*) FILTER (outcome = 'changed') AS alarms,
  count(*) FILTER (outcome = 'refused') <= 0.2 * n AND count(*) FILTER (outcome = 'changed') = 0 AS passed FROM ({RULES_SQL}) JOIN (SELECT {FIELD_SQL} AS field, count(*) AS n FROM events GROUP BY 1) USING (field) GROUP BY field, n""")
def replay_gate(spark, d):
    """Whether the replay may be written: the change of unit multiplies every weight by a thousand, and is stopped."""
    path = stored(spark, d)
    total = spark.read.parquet(f"{path}/values").groupBy("field").agg(F.count(F.lit(1)).alias("n"))
    return x.change_gate(x.renormalized(spark, path, "event_id", NEW, "1"), ["field"], total)


AGAIN_SQL = f"{READINGS_SQL.strip().replace('readings AS', 'own AS', 1)}, readings AS (SELECT * REPLACE (CASE WHEN user_id % 10 = 3 AND num > 20 THEN 100 ELSE num END AS num) FROM own WHERE NOT (user_id % 10 = 3 AND event_id % 9 = 0))"


@query(f"""SELECT event_id, CASE WHEN b.action IS NULL OR starts_with(b.action, 'refused') THEN 'retract' WHEN b.action IN ('agree_same_doc', 'corroborate') THEN 'agree' WHEN b.action IN ('insert', 'revision_change', 'supersede', 'list_union') THEN 'rewrite' ELSE 'open' END AS fate
  FROM (WITH RECURSIVE {effects_sql(READINGS_SQL.strip(), 'false')} SELECT event_id, action FROM m WHERE user_id % 10 = 3 AND (action = 'protected' OR starts_with(action, 'conflict'))) a LEFT JOIN (WITH RECURSIVE {effects_sql(AGAIN_SQL, 'false')} SELECT event_id, action FROM m) b USING (event_id)""")
def replay_conflicts(spark, d):
    """Conflicts that were open, after a part of the keys was read again: only those keys are merged again."""
    key, order = ["user_id", "event_type"], ["ts", "event_id"]
    was = readings(spark, d)
    mine = F.col("user_id") % 10 == 3
    now = was.where(~(mine & (F.col("event_id") % 9 == 0))).withColumn("num", F.when(mine & (F.col("num") > 20), 100.0).otherwise(F.col("num")))
    touched = was.where(mine).select(*key).distinct()
    return x.remerged(merge_effects(was, key, order), now, touched, key, order)[1].select("at.event_id", "fate")
