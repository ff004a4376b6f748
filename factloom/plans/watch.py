"""Watching queries over a queue and runs derived from events and orders, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import watch
from ..sources.tables import load
from . import warehouse as w
from .queries import query

QUEUE_SQL = """
queue AS (SELECT event_id AS id, user_id % 12 AS source, CASE event_type WHEN 'view' THEN 'part-page' WHEN 'click' THEN 'search' WHEN 'purchase' THEN 'datasheet' WHEN 'signup' THEN 'listing' ELSE 'gpl' END AS task, ['pending', 'leased', 'done', 'done', 'failed'][1 + event_id % 5] AS status, ts AS seen,
  CASE WHEN event_id % 9 = 0 THEN 'blocked' WHEN event_id % 4 = 1 OR user_id % 12 = 5 AND event_id % 3 > 0 THEN 'not_listed' ELSE 'ok' END AS outcome, CASE WHEN user_id % 12 = 3 THEN 0 ELSE value END AS facts, CASE WHEN user_id % 12 = 4 THEN 0 ELSE event_id % 3 END AS found,
  (event_id % 3)::INT AS priority, ts + INTERVAL 2 MINUTE * (event_id % 4) AS next_at, (SELECT max(ts) FROM events) AS now FROM events)
"""
MINUTES = "(epoch_us(now) - epoch_us({0})) / 60000000"


def queue(spark, d) -> DataFrame:
    e = load(spark, d, "events")
    i, source = F.col("event_id"), F.col("user_id") % 12
    task = F.when(F.col("event_type") == "view", "part-page").when(F.col("event_type") == "click", "search").when(F.col("event_type") == "purchase", "datasheet").when(F.col("event_type") == "signup", "listing").otherwise("gpl")
    status = F.element_at(F.array(*[F.lit(x) for x in ("pending", "leased", "done", "done", "failed")]), (i % 5 + 1).cast("int"))
    outcome = F.when(i % 9 == 0, "blocked").when((i % 4 == 1) | ((source == 5) & (i % 3 > 0)), "not_listed").otherwise("ok")
    next_at = F.col("ts") + F.make_interval(mins=(2 * (i % 4)).cast("int"))
    rows = e.select(i.alias("id"), source.alias("source"), task.alias("task"), status.alias("status"), F.col("ts").alias("at"), outcome.alias("outcome"), F.when(source == 3, 0.0).otherwise(F.col("value")).alias("facts"), F.when(source == 4, 0).otherwise(i % 3).alias("found"), (i % 3).cast("int").alias("priority"), next_at.alias("next_at"), F.col("ts").alias("leased_at"))
    return watch.with_now(rows, "at")


@query(f"WITH {QUEUE_SQL} SELECT source, min_by(id, (seen, id)) AS id, round(max({MINUTES.format('seen')}))::BIGINT AS minutes, count(*) AS n FROM queue WHERE status = 'leased' AND {MINUTES.format('seen')} > 20 GROUP BY 1")
def hung_leases(spark, d):
    return watch.hung_leases(queue(spark, d))


@query(w.with_tables("SELECT run_id, kind, round((epoch_us(now) - epoch_us(started_at)) / 60000000)::BIGINT AS minutes, coalesce(last_done > run_id, false) AS superseded FROM (SELECT *, (SELECT max(started_at) FROM runs) AS now FROM runs) LEFT JOIN (SELECT kind, max(run_id) AS last_done FROM runs WHERE status = 'succeeded' GROUP BY 1) USING (kind) WHERE status = 'running' AND (coalesce(last_done > run_id, false) OR (epoch_us(now) - epoch_us(started_at)) / 60000000 > 90)", "runs"))
def stale_runs(spark, d):
    return watch.stale_runs(watch.with_now(w.runs(spark, d), "started_at"))


@query(f"WITH {QUEUE_SQL} SELECT source, runnable, round(idle)::BIGINT AS minutes FROM (SELECT source, count(*) FILTER (status = 'pending') AS runnable, (epoch_us(max(now)) - epoch_us(max(seen) FILTER (status <> 'pending'))) / 60000000 AS idle FROM queue GROUP BY 1) WHERE runnable > 0 AND coalesce(idle, 1e9) > 15")
def stalled_sources(spark, d):
    return watch.stalls(queue(spark, d))


@query(f"""WITH {QUEUE_SQL}, c AS (SELECT source, count(*) FILTER (content AND done) AS content_done, count(*) FILTER (content AND done AND facts > 0) AS with_facts, count(*) FILTER (content AND outcome = 'not_listed') AS content_missing, count(*) FILTER (NOT content AND done) AS discovery_done,
  coalesce(sum(found) FILTER (NOT content AND done), 0)::BIGINT AS discovered, count(*) FILTER (NOT content AND outcome = 'not_listed') AS discovery_missing, count(*) FILTER (outcome = 'blocked') AS blocked FROM (SELECT *, task IN ('part-page', 'datasheet', 'gpl') AS content, outcome IN ('ok', 'not_listed') AS done FROM queue) GROUP BY 1)
  SELECT *, array_to_string(list_filter([CASE WHEN content_done >= 10 AND with_facts = 0 AND content_missing < content_done THEN 'zero_yield' END, CASE WHEN content_done >= 10 AND with_facts > 0 AND content_missing >= content_done * 0.6 THEN 'not_listed' END, CASE WHEN discovery_done >= 20 AND discovered = 0 AND discovery_missing < discovery_done THEN 'dead_discovery' END, CASE WHEN blocked >= 5 THEN 'blocked' END], lambda x: x IS NOT NULL), ',') AS verdicts FROM c""")
def source_verdicts(spark, d):
    return watch.verdicts(watch.yields(queue(spark, d))).withColumn("verdicts", F.array_join("verdicts", ","))


@query("""SELECT c_custkey, entries, matched, written, CASE WHEN entries < 20 THEN NULL WHEN matched = 0 THEN 'no_landing' WHEN written = 0 AND matched >= 20 THEN 'no_facts_landed' WHEN matched / entries < 0.3 THEN 'low_landing' END AS verdict
  FROM (SELECT o_custkey AS c_custkey, count(*) AS entries, count(*) FILTER (o_orderstatus = 'F' AND o_custkey % 7 <> 0) AS matched, count(*) FILTER (o_orderstatus = 'F' AND o_custkey % 5 <> 0) AS written FROM (SELECT o_custkey % 40 AS o_custkey, o_orderstatus FROM orders) GROUP BY 1)""")
def landing_verdicts(spark, d):
    o = load(spark, d, "orders").groupBy((F.col("o_custkey") % 40).alias("c_custkey"))
    done, key = F.col("o_orderstatus") == "F", F.col("o_custkey") % 40
    o = o.agg(F.count(F.lit(1)).alias("entries"), F.count_if(done & (key % 7 != 0)).alias("matched"), F.count_if(done & (key % 5 != 0)).alias("written"))
    return o.withColumn("verdict", watch.landing(F.col("entries"), F.col("matched"), F.col("written")))


@query(f"WITH {QUEUE_SQL}, t AS (SELECT id % 16 AS worker, min((priority, next_at, id)) AS o FROM queue WHERE status = 'pending' AND next_at <= now OR status = 'leased' AND {MINUTES.format('seen')} > 30 GROUP BY 1) SELECT worker, o[3] AS id, o[1] AS priority, o[3] % 5 = 1 AS stolen FROM t")
def next_tasks(spark, d):
    return watch.next_tasks(queue(spark, d), 16)


@query("""SELECT part_id, id, tier, width FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY tier, width DESC NULLS LAST, id) AS r FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS part_id, (l_suppkey % 4)::INT AS tier, CASE WHEN l_quantity > 5 THEN (l_quantity * 20)::INT END AS width,
  l_linestatus = 'O' AND l_suppkey % 3 = 0 AS leased, l_linenumber % 5 AS tries FROM lineitem) WHERE NOT leased AND tries < 3 AND id NOT IN (SELECT o_orderkey * 10 + 1 FROM orders WHERE o_orderstatus = 'P')) WHERE r = 1""")
def image_candidates(spark, d):
    c = load(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("part_id"), (F.col("l_suppkey") % 4).cast("int").alias("tier"), F.when(F.col("l_quantity") > 5, (F.col("l_quantity") * 20).cast("int")).alias("width"), ((F.col("l_linestatus") == "O") & (F.col("l_suppkey") % 3 == 0)).alias("leased"), (F.col("l_linenumber") % 5).alias("tries"))
    decided = load(spark, d, "orders").where("o_orderstatus = 'P'").select((F.col("o_orderkey") * 10 + 1).alias("id"))
    return watch.image_candidates(c, decided).select("part_id", "id", "tier", "width")


@query(f"""WITH {QUEUE_SQL} SELECT source, count(*) FILTER (age <= 60) AS done_1h, count(*) FILTER (age <= 1440) AS done_24h, count(*) AS done_7d, round(coalesce(sum(facts) FILTER (age <= 1440), 0), 2) AS facts_24h, quantile_cont(facts, 0.5) FILTER (age <= 1440) AS median_24h, quantile_cont(facts, 0.5) AS median_7d
  FROM (SELECT *, {MINUTES.format('seen')} AS age FROM queue) WHERE outcome = 'ok' AND age <= 10080 GROUP BY 1""")
def source_throughput(spark, d):
    return watch.throughput(queue(spark, d))


@query("SELECT user_id, event_type, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY ALL HAVING count(*) > 1")
def duplicates_rolling(spark, d):
    """Keys seen more than once in the 24 hours before now."""
    e = watch.with_now(load(spark, d, "events"), "ts").where(watch.minutes(F.col("now"), F.col("ts")) < 1440)
    return e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
