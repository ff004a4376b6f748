"""Whether a dictionary, its aliases, profiles and conditions agree with one another; every problem is a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

KINDS = ("n", "nr", "b", "e", "s", "ls")


def problems(fields: DataFrame, aliases: DataFrame, profiles: DataFrame, conditions: DataFrame) -> DataFrame:
    """place, item and problem, of all tables at once.

    fields: key, kind, unit, low, high, domain (array), label; aliases: alias, field, section, rank; profiles: category, field;
    conditions: category, field, depends_on (a condition that names several fields has a row for each).
    Fields of aliases that begin with __ are sentinels.  A condition on a field that its own profile lacks never holds, so the
    field that depends on it would be a gap that closes itself: that is a problem too.
    """

    def found(rows: DataFrame, where, place: str, item, problem: str) -> DataFrame:
        return rows.where(where).select(F.lit(place).alias("place"), item.alias("item"), F.lit(problem).alias("problem"))

    key, kind = F.col("key"), F.col("kind")
    known = fields.select(F.col("key").alias("field")).distinct()
    pair = F.concat_ws("/", "category", "field")
    named = aliases.where(~F.startswith("field", F.lit("__")))
    spelt = aliases.groupBy(F.lower(F.trim("alias")).alias("alias"), "section", "rank").agg(F.countDistinct("field").alias("n"))
    within = conditions.join(profiles.select("category", F.col("field").alias("depends_on")).distinct(), ["category", "depends_on"], "left_anti")
    out = [
        found(fields.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "n > 1", "field", key, "stated more than once"),
        found(fields, ~F.coalesce(kind.isin(*KINDS), F.lit(False)), "field", key, "unknown type"),
        found(fields, F.coalesce(F.trim("label"), F.lit("")) == "", "field", key, "no label"),
        found(fields, (kind == "e") & (F.coalesce(F.size("domain"), F.lit(0)) <= 0), "field", key, "choice without a domain"),
        found(fields, (kind == "n") & F.col("unit").isNull() & F.col("low").isNull(), "field", key, "number without unit and band"),
        found(fields, F.col("low") >= F.col("high"), "field", key, "band without values"),
        found(named.join(known, "field", "left_anti"), F.lit(True), "alias", F.col("alias"), "field not in the dictionary"),
        found(spelt, "n > 1", "alias", F.col("alias"), "several fields at one rank"),
        found(aliases, ~F.coalesce(F.col("alias").rlike(r"[\p{L}\p{N}]"), F.lit(False)), "alias", F.coalesce("alias", F.lit("")), "no word"),
        found(profiles.join(known, "field", "left_anti"), F.lit(True), "profile", pair, "field not in the dictionary"),
        found(conditions.join(profiles.distinct(), ["category", "field"], "left_anti"), F.lit(True), "condition", pair, "field not in the profile"),
        found(within, F.lit(True), "condition", F.concat_ws("/", "category", "field", "depends_on"), "depends on a field that the profile lacks"),
    ]
    return reduce(DataFrame.unionByName, out).distinct()
