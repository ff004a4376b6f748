"""Watching a queue of tasks and a history of runs: hung leases, stale runs, stalls, yields, next tasks, candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .quantiles import exact_quantiles

# Limits of the alarms.
HUNG_MINUTES, STALE_MINUTES, STALL_MINUTES, STEAL_MINUTES = 20, 90, 15, 30
ZERO_YIELD_DONE, NOT_LISTED_SHARE, DEAD_DISCOVERY_DONE, BLOCKS = 10, 0.6, 20, 5
LANDING_ENTRIES, LANDING_SHARE = 20, 0.30
CONTENT, DISCOVERY = ("part-page", "datasheet", "gpl", "eol"), ("search", "listing")


def with_now(rows: DataFrame, at: str) -> DataFrame:
    """Rows with the latest time of all: one value, joined to each."""
    return rows.crossJoin(F.broadcast(rows.agg(F.max(at).alias("now"))))


def minutes(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 60_000_000


def hung_leases(queue: DataFrame) -> DataFrame:
    """Of each source the oldest task leased for over HUNG_MINUTES, and how many such there are.  queue: id, source, status, at, now."""
    hung = queue.where(F.col("status") == "leased").withColumn("age", minutes(F.col("now"), F.col("at"))).where(F.col("age") > HUNG_MINUTES)
    return hung.groupBy("source").agg(F.min_by("id", F.struct("at", "id")).alias("id"), F.round(F.max("age")).cast("long").alias("minutes"), F.count(F.lit(1)).alias("n"))


def stale_runs(runs: DataFrame) -> DataFrame:
    """Open runs of over STALE_MINUTES, or with a later run of their kind that succeeded.  runs: run_id, kind, status, started_at, now."""
    done = runs.where("status = 'succeeded'").groupBy("kind").agg(F.max("run_id").alias("last_done"))
    out = runs.where("status = 'running'").join(done, "kind", "left")
    superseded = F.coalesce(F.col("last_done") > F.col("run_id"), F.lit(False))
    age = minutes(F.col("now"), F.col("started_at"))
    return out.where(superseded | (age > STALE_MINUTES)).select("run_id", "kind", F.round(age).cast("long").alias("minutes"), superseded.alias("superseded"))


def stalls(queue: DataFrame) -> DataFrame:
    """Sources with runnable tasks of which none was touched for STALL_MINUTES."""
    idle = minutes(F.max("now"), F.max(F.when(F.col("status") != "pending", F.col("at"))))
    out = queue.groupBy("source").agg(F.count_if(F.col("status") == "pending").alias("runnable"), idle.alias("idle"))
    return out.where((F.col("runnable") > 0) & (F.coalesce("idle", F.lit(1e9)) > STALL_MINUTES)).select("source", "runnable", F.round("idle").cast("long").alias("minutes"))


def yields(queue: DataFrame) -> DataFrame:
    """Counters of each source by kind of task.  queue: source, task, outcome, facts, found."""
    content, discovery = F.col("task").isin(*CONTENT), F.col("task").isin(*DISCOVERY)
    done, missing = F.col("outcome").isin("ok", "not_listed"), F.col("outcome") == "not_listed"
    return queue.groupBy("source").agg(
        F.count_if(content & done).alias("content_done"), F.count_if(content & (F.col("facts") > 0) & done).alias("with_facts"), F.count_if(content & missing).alias("content_missing"),
        F.count_if(discovery & done).alias("discovery_done"), F.coalesce(F.sum(F.when(discovery & done, F.col("found"))), F.lit(0)).alias("discovered"), F.count_if(discovery & missing).alias("discovery_missing"),
        F.count_if(F.col("outcome") == "blocked").alias("blocked"),
    )


def verdicts(counters: DataFrame) -> DataFrame:
    """Alarms of a source by rules over its counters: those that hold, in order."""
    rules = {
        "zero_yield": (F.col("content_done") >= ZERO_YIELD_DONE) & (F.col("with_facts") == 0) & (F.col("content_missing") < F.col("content_done")),
        "not_listed": (F.col("content_done") >= ZERO_YIELD_DONE) & (F.col("with_facts") > 0) & (F.col("content_missing") >= F.col("content_done") * NOT_LISTED_SHARE),
        "dead_discovery": (F.col("discovery_done") >= DEAD_DISCOVERY_DONE) & (F.col("discovered") == 0) & (F.col("discovery_missing") < F.col("discovery_done")),
        "blocked": F.col("blocked") >= BLOCKS,
    }
    return counters.withColumn("verdicts", F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()])))


def landing(entries: Column, matched: Column, written: Column) -> Column:
    """What a run brought home: no_landing, no_facts_landed, low_landing, or null where all is well or too little was tried."""
    return F.when(entries < LANDING_ENTRIES, None).when(matched == 0, "no_landing").when((written == 0) & (matched >= LANDING_ENTRIES), "no_facts_landed").when(matched / entries < LANDING_SHARE, "low_landing")


def next_tasks(queue: DataFrame, workers: int) -> DataFrame:
    """The task that each worker takes next: of its bucket the first by priority, due time and id among those that are due, or
    leased for so long that they may be stolen.  queue: id, priority, next_at, status, leased_at, now."""
    due = ((F.col("status") == "pending") & (F.col("next_at") <= F.col("now"))) | ((F.col("status") == "leased") & (minutes(F.col("now"), F.col("leased_at")) > STEAL_MINUTES))
    order = F.struct("priority", "next_at", "id")
    taken = queue.where(due).groupBy((F.col("id") % workers).alias("worker")).agg(F.min(F.struct(order.alias("o"), (F.col("status") == "leased").alias("stolen"))).alias("t"))
    return taken.select("worker", F.col("t.o.id").alias("id"), F.col("t.o.priority").alias("priority"), "t.stolen")


def image_candidates(candidates: DataFrame, decided: DataFrame, attempts: int = 3) -> DataFrame:
    """One candidate for each part: lowest tier, widest hint, first id, without those decided, leased or tried too often."""
    free = candidates.join(decided.select("id"), "id", "left_anti").where(f"not leased and tries < {attempts}")
    order = Window.partitionBy("part_id").orderBy("tier", F.desc_nulls_last("width"), "id")
    return free.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def throughput(queue: DataFrame) -> DataFrame:
    """Done tasks of each source within an hour, a day and a week of now, their facts, and the medians of the last two."""
    age = minutes(F.col("now"), F.col("at"))
    q = queue.where((F.col("outcome") == "ok") & (age <= 7 * 1440)).withColumn("age", age)
    hour, day = F.col("age") <= 60, F.col("age") <= 1440
    counts = q.groupBy("source").agg(F.count_if(hour).alias("done_1h"), F.count_if(day).alias("done_24h"), F.count(F.lit(1)).alias("done_7d"), F.round(F.coalesce(F.sum(F.when(day, F.col("facts"))), F.lit(0.0)), 2).alias("facts_24h"))
    for name, rows in (("median_24h", q.where(day)), ("median_7d", q)):
        counts = counts.join(exact_quantiles(rows, "source", "facts").select("source", F.col("quantile").alias(name)), "source", "left")
    return counts
