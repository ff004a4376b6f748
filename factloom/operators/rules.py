"""Rule tables over rows: labels to fields, capabilities, versions, lists, ledgers, mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def map_label(label: Column, rules: list[tuple[str, str]]) -> Column:
    """The field of the first rule that matches a label; tried again without a unit in brackets at its end."""

    def first(text: Column) -> Column:
        out = F.lit(None).cast("string")
        for pattern, field in reversed(rules):
            out = F.when(text.rlike(f"(?i){pattern}"), field).otherwise(out)
        return out

    return F.coalesce(first(label), first(F.regexp_replace(label, r"\s*\([^)]*\)\s*$", "")))


def capable(parts: DataFrame, capabilities: DataFrame, category: str) -> DataFrame:
    """(part_id, source, field_key) by capabilities of a part's category and those of any (null) category.

    Two equi joins instead of one with OR: the wildcard rows are few and match all parts.
    """
    own = parts.select("part_id", category).join(capabilities.where(F.col(category).isNotNull()), category).select("part_id", "source", "field_key")
    anywhere = parts.select("part_id").crossJoin(capabilities.where(F.col(category).isNull()).select("source", "field_key"))
    return own.unionByName(anywhere).distinct()


def version_key(version: Column) -> Column:
    """Numbers of a dotted version, as an array that compares in order; null if it is none."""
    return F.when(version.rlike(r"^v?[0-9]+(\.[0-9]+)*$"), F.transform(F.split(F.regexp_replace(version, "^v", ""), r"\."), lambda x: x.cast("int")))


def list_union(lists: Column) -> Column:
    """Items of several lists in order of first appearance, compared without case."""
    return F.aggregate(F.flatten(lists), F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x)))


def same_items(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def unanimous(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Each key's value if all its rows agree, else null; and the most common one, ties to the lowest."""
    counts = rows.groupBy(*key, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*key).agg(F.when(F.count(F.lit(1)) == 1, F.min(value)).alias("unanimous"), F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("common"))


def top_per_group(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)


def inventory(rows: DataFrame, label: str, sample: str, n: int = 3) -> DataFrame:
    """Each label's rows, and its n smallest distinct samples, kept bounded while aggregating."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    w = Window.partitionBy(label).orderBy(sample)
    few = rows.select(label, sample).distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    return counts.join(few.groupBy(label).agg(F.array_join(F.sort_array(F.collect_list(sample)), ",").alias("samples")), label)


def pauses(log: DataFrame, key: str, kind: str, at: list[str], paused: list[str], resumed: list[str]) -> DataFrame:
    """Whether each key is paused: its latest pause or resumption says so."""
    last = log.where(F.col(kind).isin(*paused, *resumed)).groupBy(key).agg(F.max(F.struct(*at, kind)).getField(kind).alias("last"))
    return last.select(key, F.col("last").isin(*paused).alias("paused"))


def mentions(texts: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """Known tokens that texts mention, each once a text: tokens become rows and meet the known ones in an equi join."""
    tokens = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z]{3,})"), 1))).alias("token"))
    return tokens.join(known, "token").select(key, "token")


def decision(shared_by: Column, placeholder: Column, width: Column, most: int = 3, least_width: int = 300) -> Column:
    """Why an image is refused, in order; keep if it is not."""
    return F.when(placeholder, "placeholder").when(shared_by > most, "shared").when(width < least_width, "tiny").otherwise("keep")
