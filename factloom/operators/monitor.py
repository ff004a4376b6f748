"""Monitoring of a log of attempts: windows, medians, streaks, leases, alarms."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .quantiles import exact_quantiles


def window_stats(log: DataFrame, at: str, kind: str, source: str, minutes: int = 60) -> DataFrame:
    """Per source and tumbling window: attempts of each kind, and the share of errors."""
    w = F.window(F.col(at).cast("timestamp"), f"{minutes} minutes")
    out = log.groupBy(source, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(kind) == "error").alias("errors"), F.sum("value").alias("total"))
    return out.select(source, F.col("w.start").alias("window_start"), "n", "errors", F.round(F.col("errors") / F.col("n"), 4).alias("error_share"), F.round("total", 2).alias("total"))


def medians(log: DataFrame, source: str, value: str, at: str, now: Column, recent: str, longer: str, least: int) -> DataFrame:
    """Median of the recent and the longer window, and drift where the first is below half the second."""
    age = now - F.col(at)
    kinds = log.select(source).distinct()
    log = log.where(age <= F.expr(f"interval {longer}"))
    recently = exact_quantiles(log.where(age <= F.expr(f"interval {recent}")), source, value).select(source, F.col("n").alias("n_recent"), F.col("quantile").alias("recent_median"))
    out = exact_quantiles(log, source, value).select(source, F.col("quantile").alias("longer_median"))
    out = kinds.join(out, source, "left").join(recently, source, "left").withColumn("n_recent", F.coalesce("n_recent", F.lit(0)))
    drift = (F.col("n_recent") >= least) & (F.col("recent_median") < 0.5 * F.col("longer_median"))
    return out.withColumn("drift", F.coalesce(drift, F.lit(False)))


def streaks(log: DataFrame, source: str, at: list[str], bad: Column) -> DataFrame:
    """Length of each source's latest unbroken run of bad attempts: those after its last good one, by two aggregates."""
    when = F.struct(*at)
    marked = log.select(source, when.alias("at"), bad.alias("bad"))
    last_good = marked.groupBy(source).agg(F.max(F.when(~F.col("bad"), F.col("at"))).alias("good"))
    after = F.col("good").isNull() | (F.col("at") > F.col("good"))
    return marked.join(last_good, source).groupBy(source).agg(F.count_if(after).alias("streak"))


def latest_events(log: DataFrame, key: list[str], at: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in at])
    return log.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def duplicates(log: DataFrame, key: list[str], at: str) -> DataFrame:
    """Keys seen more than once on a day."""
    return log.groupBy(*key, F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def alarms(log: DataFrame, key: list[str], at: str, tie: str = "event_id", minutes: int = 60, spans: int = 24) -> DataFrame:
    """Alarms that are written: the first of each key, and each one at least so many minutes after the last one written.

    Which ones are written depends on those before, but over a stretch of time only through one number: from when on an alarm
    may be written.  So distinct times are cut into stretches of `spans` times the pause, and every stretch works out alone
    what it would hand on for each number it could be handed (`handed_on`).  Only these steps meet in one task a key, one
    number in hand; then each stretch writes its alarms, at most one for each pause.  A task holds the distinct times of one
    key in one stretch, however long the key's history is.  Of rows at one time the least tie is written; rows without a time
    are never.
    """
    span = minutes * 60_000_000
    rows = log.withColumn("_at", F.unix_micros(F.col(at).cast("timestamp"))).where("_at is not null")
    times = rows.select(*key, "_at").distinct().withColumn("_stretch", F.floor(F.col("_at") / (span * spans)).cast("long"))
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.select(*key).schema)
    stretch = [*key, "_stretch"]

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        upto, free = handed_on(np.sort(pdf["_at"].to_numpy()), span)
        return pdf[stretch].iloc[[0] * len(upto)].assign(_upto=upto, _free=free)

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, place, free, entered = None, None, 0, 0
        for pdf in batches:
            out = []
            names = pdf[key].astype(object).where(pdf[key].notna(), None).itertuples(index=False, name=None)
            for i, (k, s, upto, after) in enumerate(zip(names, pdf["_stretch"].tolist(), pdf["_upto"].tolist(), pdf["_free"].tolist(), strict=True)):
                if k != now:
                    now, place, free = k, None, -(2**62)
                if s != place:
                    place, entered = s, free
                    out.append((i, entered))
                if entered <= upto and free == entered:
                    free = after
            picked = pdf[stretch].iloc[[i for i, _ in out]]
            yield picked.assign(_entered=np.array([x for _, x in out], dtype="int64"))

    def written(pdf: pd.DataFrame) -> pd.DataFrame:
        at_, free, kept = np.sort(pdf["_at"].to_numpy()), int(pdf["_entered"].iloc[0]), []
        while (i := int(np.searchsorted(at_, free))) < len(at_):
            kept.append(int(at_[i]))
            free = kept[-1] + span
        return pdf[key].iloc[[0] * len(kept)].assign(_at=np.array(kept, dtype="int64"))

    def same(columns: list[str]) -> Column:
        return reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in columns])

    handed = times.groupBy(*stretch).applyInPandas(steps, f"{keys}, _stretch long, _upto long, _free long")
    entered = handed.repartition(*key).sortWithinPartitions(*stretch, "_upto").mapInPandas(entries, f"{keys}, _stretch long, _entered long")
    met = times.alias("l").join(entered.alias("r"), same(stretch)).select("l.*", "r._entered")
    kept = met.groupBy(*stretch).applyInPandas(written, f"{keys}, _at long")
    hit = rows.alias("l").join(kept.alias("r"), same([*key, "_at"]), "left_semi")
    order = F.struct(F.col(tie), *[F.col(c) for c, t in log.dtypes if c != tie and not t.startswith("map")])
    return hit.groupBy(*key, "_at").agg(F.min_by(F.struct(*log.columns), order).alias("r")).select("r.*")


def handed_on(times: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Steps (upto, free) of a stretch with these distinct times in order: who may write from a time of at most upto on, and
    above the step before, hands on that the next may be written from free on.  Neighbours that hand on the same are one
    step.  What is handed in comes from before the first time, so steps beyond one pause after it are never needed."""
    after = np.searchsorted(times, times + span)
    free = times + span
    for i in range(len(times) - 1, -1, -1):  # from the last back: each time's next one is known already
        if after[i] < len(times):
            free[i] = free[after[i]]
    n = min(int(after[0]) + 1, len(times))
    last = np.append(free[1:n] != free[: n - 1], True)
    return times[:n][last], free[:n][last]


def sessions(log: DataFrame, key: str, at: str, minutes: int = 30) -> DataFrame:
    """Runs of events with gaps of at most so many minutes."""
    w = Window.partitionBy(key).orderBy(at, "event_id")
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))
    marked = log.withColumn("_new", F.coalesce((gap > minutes * 60_000_000).cast("int"), F.lit(1)))
    numbered = marked.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def leases(queue: DataFrame, workers: int, priority: Column, key: str) -> DataFrame:
    """Next tasks without row locks: each worker owns a hash bucket and takes its first task by priority."""
    worker = F.col(key) % workers
    w = Window.partitionBy("worker").orderBy("priority", key)
    return queue.select(key, worker.alias("worker"), priority.alias("priority")).withColumn("turn", F.row_number().over(w)).where("turn = 1").drop("turn")


def disposition(outcome: Column, attempt: Column) -> tuple[Column, Column]:
    """Next status and minutes of back-off of a fetch."""
    status = F.when(outcome == "ok", "done").when(outcome == "not_listed", "closed").when(outcome == "blocked", "paused").otherwise("pending")
    wait = F.when(status == "pending", F.least(F.lit(360.0), 5 * F.pow(F.lit(2.0), attempt - 1)))
    return status, wait
