"""Stored values worked out again after rules or texts changed, without reading what did not change.

A store holds every reading with its raw text and the value made of it, in partitions by field and bucket of keys.  Beside it
is a small table with the fingerprint of each field's rules.  Every reading carries the fingerprint of its own raw text and
label.  Whatever has the fingerprints it had is left alone: fields are told apart by the small table before any reading is
read, keys by two columns, and only the partitions of what changed are read whole.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.normalize import Field
from ..sources.checkpoints import saved
from .effects import Effects, merge_effects
from .labels import typed
from .writes import ALARM_MAGNITUDE, magnitude

BUCKETS = 16
READ = ("num", "low", "high", "flag", "text", "items", "reason")


def rule_print(field: Field, version: str) -> str:
    return hashlib.sha256(f"{version}\n{field!r}".encode()).hexdigest()[:16]


def with_prints(readings: DataFrame, key: str) -> DataFrame:
    """readings: key, field, label, raw and more; with bucket and the fingerprint of what its value is made of."""
    missing = F.lit("\0")
    stated = F.concat_ws("\x1f", F.coalesce("label", missing), F.coalesce("raw", missing))
    return readings.withColumns({"bucket": F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"), "print": F.sha2(stated, 256)})


def valued(rows: DataFrame, fields: dict[str, Field]) -> DataFrame:
    """The readings with their values; a null raw text has none."""
    read = typed(rows, fields)
    return read.select(*rows.columns, *[F.when(F.col("raw").isNotNull(), F.col(f"v.{c}")).alias(c) for c in READ])


def write_store(readings: DataFrame, key: str, fields: dict[str, Field], version: str, path: str) -> None:
    spark = readings.sparkSession
    valued(with_prints(readings, key), fields).write.partitionBy("field", "bucket").parquet(f"{path}/values")
    rules = spark.createDataFrame([(k, rule_print(f, version)) for k, f in fields.items()], "field string, rule string")
    rules.coalesce(1).write.parquet(f"{path}/rules")


def changed_fields(spark: SparkSession, path: str, fields: dict[str, Field], version: str) -> list[str]:
    """Fields whose rules are not those that the store was made with.  One row a field."""
    made = {r["field"]: r["rule"] for r in spark.read.parquet(f"{path}/rules").collect()}
    return sorted(k for k, f in fields.items() if made.get(k) != rule_print(f, version))


def partitions(places: list[tuple[str, list[int] | None]]) -> Column:
    """The partitions of these fields, or of some buckets of them."""
    each = [(F.col("field") == f) & (F.lit(True) if buckets is None else F.col("bucket").isin(buckets)) for f, buckets in places]
    return reduce(or_, each, F.lit(False))


def outcome() -> Column:
    """What a replay makes of a stored reading: unrecoverable (no raw text any more), refused, same or changed; what was
    reviewed (tier 0) is protected from change and from refusal."""
    rest = [c for c in READ[:-1] if c != "num"]
    had = reduce(or_, [F.col(f"was.{c}").isNotNull() for c in READ[:-1]])
    close = F.coalesce(F.abs(F.col("was.num") - F.col("now.num")) < 1e-6, F.col("was.num").isNull() & F.col("now.num").isNull())
    same = reduce(and_, [F.col(f"was.{c}").eqNullSafe(F.col(f"now.{c}")) for c in rest], close)
    protected = F.col("tier") == 0
    return (
        F.when((F.trim(F.coalesce("raw", F.lit(""))) == "") & ~had, "unrecoverable:GAP_ROW_NEVER_NORMALISED")
        .when(F.trim(F.coalesce("raw", F.lit(""))) == "", "unrecoverable:RAW_LOST_VALUE_PRESENT")
        .when(F.col("now.reason").isNotNull(), F.when(protected, "protected").otherwise("refused"))
        .when(same, "same")
        .otherwise(F.when(protected, "protected").otherwise("changed"))
    )


def replayed(old: DataFrame, fresh: DataFrame, key: str, fields: dict[str, Field]) -> DataFrame:
    """Stored readings beside the same readings worked out anew: key, field, tier, was, now, outcome, magnitude."""
    now = valued(fresh, fields)
    was = old.select(key, "field", F.struct(*READ).alias("was"))
    both = now.select(key, "field", "tier", "raw", F.struct(*READ).alias("now")).join(was, [key, "field"], "left")
    return both.select(key, "field", "tier", "was", "now", outcome().alias("outcome"), magnitude(F.col("was.num"), F.col("now.num")).alias("magnitude"))


def renormalized(spark: SparkSession, path: str, key: str, fields: dict[str, Field], version: str) -> DataFrame:
    """Readings of fields whose rules changed, worked out again from their stored raw texts; the partitions of all other
    fields are not read."""
    dirty = changed_fields(spark, path, fields, version)
    old = spark.read.parquet(f"{path}/values").where(partitions([(f, None) for f in dirty]))
    return replayed(old, old.drop(*READ), key, {f: fields[f] for f in dirty} or fields)


def refreshed(spark: SparkSession, path: str, readings: DataFrame, key: str, fields: dict[str, Field]) -> DataFrame:
    """Readings whose raw text or label is not what the store has, worked out again.

    Fingerprints are compared by two columns of the store; values are read from the partitions of what changed alone."""
    now = with_prints(readings, key)
    prints = spark.read.parquet(f"{path}/values").select(key, "field", F.col("print").alias("known"))
    dirty = saved(now.join(prints, [key, "field"], "left").where(~F.col("print").eqNullSafe(F.col("known"))).drop("known"))
    places = dirty.groupBy("field").agg(F.array_sort(F.collect_set("bucket")).alias("buckets")).collect()  # one row a field, BUCKETS at most
    old = spark.read.parquet(f"{path}/values").where(partitions([(r["field"], r["buckets"]) for r in places]))
    return replayed(old, dirty, key, {r["field"]: fields[r["field"]] for r in places if r["field"] in fields} or fields)


def change_gate(outcomes: DataFrame, group: list[str], total: DataFrame, most: float = 0.2) -> DataFrame:
    """Of each group, whether so few of all its readings change or are refused, and none a thousandfold, that a replay may be
    written.  total: group and n, the readings that the store has."""
    n = outcomes.groupBy(*group).agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("changed", "refused", "protected", "same")], F.count_if((F.col("outcome") == "changed") & (F.round("magnitude", 6) >= ALARM_MAGNITUDE)).alias("alarms"))
    share = [F.col(c) <= most * F.col("n") for c in ("changed", "refused")]
    return total.join(n, group).withColumn("passed", share[0] & share[1] & (F.col("alarms") == 0))


def remerged(before: Effects, readings: DataFrame, touched: DataFrame, key: list[str], order: list[str]) -> tuple[Effects, DataFrame]:
    """Merging after some keys' readings changed: only those keys are merged again, all others stay as they were.

    Returns the effects, and for each conflict that was open in a touched key what became of it: open, agree, rewrite (the
    reading now takes the row's place), retract (it is refused or gone).
    """
    again = merge_effects(readings.join(touched, key, "left_semi"), key, order)
    parts = [old.join(touched, key, "left_anti").unionByName(new) for old, new in zip(before, again, strict=True)]
    action = F.col("action")
    fate = F.when(action.isNull() | F.startswith(action, F.lit("refused")) | F.startswith(action, F.lit("gap")), "retract").when(action.isin("agree_same_doc", "corroborate"), "agree").when(action.isin("insert", "revision_change", "supersede", "list_union"), "rewrite").otherwise("open")
    were = before.conflicts.where("resolution is null").join(touched, key, "left_semi").select(*key, "at")
    return Effects(*parts), were.join(again.actions.select(*key, "at", "action"), [*key, "at"], "left").select(*key, "at", fate.alias("fate"))
