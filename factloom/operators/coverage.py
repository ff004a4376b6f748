"""What is known and what is missing: completeness, gap ledger, promotion of fields, invariants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def condition(tree: dict, field: str = "field_key") -> Column:
    """A condition over one entity's facts as an aggregate: eq, ne, in, gte, truthy on a key, any, all.

    `ne` needs the value to exist.
    """
    if "any" in tree:
        return reduce(lambda a, b: a | b, [condition(t, field) for t in tree["any"]])
    if "all" in tree:
        return reduce(lambda a, b: a & b, [condition(t, field) for t in tree["all"]])
    own = F.col(field) == tree["key"]
    text = F.col("value_text")
    tests = {
        "eq": lambda v: text == F.lit(str(v)),
        "ne": lambda v: text != F.lit(str(v)),
        "in": lambda v: text.isin(*[str(x) for x in v]),
        "gte": lambda v: F.col("value_num") >= F.lit(float(v)),
        "truthy": lambda v: text.isNotNull() & ~text.isin("", "false", "0"),
    }
    op = next(k for k in tree if k in tests)
    return F.coalesce(F.bool_or(own & tests[op](tree[op])), F.lit(False))


def completeness(parts: DataFrame, facts: DataFrame, profile: dict[str, dict | None]) -> DataFrame:
    """Per part: required fields (whose condition holds), present and missing ones, and the share in per cent.

    facts: rendered ones.  profile: required keys, each with a condition or None.
    """
    aggs = []
    for key, tree in profile.items():
        has = F.coalesce(F.bool_or((F.col("field_key") == key) & F.col("value_text").isNotNull()), F.lit(False))
        needed = condition(tree) if tree else F.lit(True)
        aggs.append(F.struct(F.lit(key).alias("key"), needed.alias("needed"), has.alias("has")))
    own = parts.select("part_id").join(facts, "part_id", "left").groupBy("part_id").agg(F.array(*aggs).alias("k"))
    needed = F.filter("k", lambda x: x["needed"])
    missing = F.transform(F.filter(needed, lambda x: ~x["has"]), lambda x: x["key"])
    out = own.select("part_id", F.size(needed).cast("long").alias("required"), (F.size(needed) - F.size(missing)).cast("long").alias("present"), F.array_sort(missing).alias("missing"))
    return out.withColumn("percent", F.when(F.col("required") > 0, F.round(F.col("present").cast("decimal(18,4)") * 100 / F.col("required"), 1).cast("double")))


def gap_ledger(missing: DataFrame, facts: DataFrame, checks: DataFrame, capable: DataFrame) -> DataFrame:
    """A row for each missing field of a part: the state on record, and sources checked of those that could have it.

    missing(part_id, missing), checks(part_id, source), capable(source, field_key).
    """
    gaps = missing.select("part_id", F.explode("missing").alias("field_key"))
    able = gaps.join(capable, "field_key", "left")
    seen = checks.select("part_id", "source", F.lit(True).alias("seen")).distinct()
    counted = able.join(seen, ["part_id", "source"], "left").groupBy("part_id", "field_key").agg(F.countDistinct("source").alias("capable"), F.countDistinct(F.when(F.col("seen"), F.col("source"))).alias("checked"))
    state = facts.where("is_current").groupBy("part_id", "field_key").agg(F.min("state").alias("state"))
    out = counted.join(state, ["part_id", "field_key"], "left")
    return out.withColumn("state", F.coalesce("state", F.when(F.col("capable") == 0, "no_source").otherwise("gap_unattempted")))


def promotion(facts: DataFrame, least_share: float = 0.6, least_parts: int = 30) -> DataFrame:
    """Fields by the share of parts with any fact that have them, and whether they should become required."""
    own = facts.where("value_text is not null").select("part_id", "field_key").distinct()
    n = own.agg(F.countDistinct("part_id").alias("n"))
    shares = own.groupBy("field_key").agg(F.count(F.lit(1)).alias("parts")).crossJoin(F.broadcast(n))
    share = F.round(F.col("parts") / F.col("n"), 4)
    reason = F.when(F.col("n") < least_parts, "too_few_parts").when(share < least_share, "share_too_low").otherwise("promote")
    return shares.select("field_key", "parts", share.alias("share"), reason.alias("reason"))


def invariants(checks: dict[str, DataFrame], key: str) -> DataFrame:
    """Zero-row queries: name, number of offenders and the first three."""
    rows = [offenders(df, key) for df in checks.values()]
    named = [r.select(F.lit(name).alias("name"), "offenders", "first_three") for name, r in zip(checks, rows, strict=True)]
    return reduce(lambda a, b: a.unionByName(b), named)


def offenders(df: DataFrame, key: str) -> DataFrame:
    top = df.select(F.col(key).cast("string").alias("k")).orderBy("k").limit(3).agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("first_three"))
    return df.agg(F.count(F.lit(1)).alias("offenders")).crossJoin(top)


def never_fewer(counts: DataFrame, kind: list[str], at: str, value: str) -> DataFrame:
    """Runs whose count is below the run of the kind before."""


    w = Window.partitionBy(*kind).orderBy(at)
    return counts.withColumn("before", F.lag(value).over(w)).where(F.col(value) < F.col("before"))


def gate(golden: DataFrame, produced: DataFrame, key: list[str], value: str) -> DataFrame:
    """Precision and recall of produced values against golden ones."""
    g, p = golden.select(*key, F.col(value).alias("want")), produced.select(*key, F.col(value).alias("got"))
    both = g.join(p, key, "full_outer")
    out = both.agg(F.count_if(F.col("want").isNotNull()).alias("expected"), F.count_if(F.col("got").isNotNull() & F.col("want").isNotNull()).alias("compared"), F.count_if(F.col("want") == F.col("got")).alias("right"))
    return out.withColumns({"precision": F.round(F.col("right") / F.nullif(F.col("compared"), F.lit(0)), 4), "recall": F.round(F.col("right") / F.nullif(F.col("expected"), F.lit(0)), 4)})
