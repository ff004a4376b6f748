"""Labels to fields by a dictionary of aliases.

Aliases are a trie of words, held as a table: a row for each beginning of an alias.  Labels are walked down the trie level by
level, from every word on, all distinct labels at once: a join a level, and what leaves the trie goes.  The longest alias that
a label holds decides; of equally long ones that of the row's own section, then the one with the lower rank, then the first.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.normalize import Field, is_heading, normalized
from ..sources.checkpoints import saved


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def trie(aliases: DataFrame) -> DataFrame:
    """Beginnings of the aliases: prefix and depth."""
    split = aliases.select(words(F.col("alias")).alias("w"))
    steps = split.select("w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("depth")).where("size(w) > 0")
    return steps.select(F.array_join(F.slice("w", F.lit(1), F.col("depth")), " ").alias("prefix"), "depth").distinct()


def found(labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """Every alias in every distinct label: label, start, depth (in words), prefix (the alias as words)."""
    nodes = saved(trie(aliases))
    deepest = nodes.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("n")).first()["n"]
    split = labels.select("label").where("label is not null").distinct().withColumn("w", words(F.col("label")))
    level = split.select("label", "w", F.posexplode("w").alias("start", "prefix"))
    out = []
    for depth in range(1, deepest + 1):
        level = level.join(nodes.where(F.col("depth") == depth).select("prefix"), "prefix", "left_semi")
        out.append(level.select("label", "start", F.lit(depth).alias("depth"), "prefix"))
        following = F.get("w", F.col("start") + depth)
        level = level.where(following.isNotNull()).select("label", "w", "start", F.concat_ws(" ", "prefix", following).alias("prefix"))
    whole = aliases.select(F.array_join(words(F.col("alias")), " ").alias("prefix")).distinct()
    return reduce(DataFrame.unionByName, out).join(whole, "prefix", "left_semi") if out else labels.select("label", F.lit(0).alias("start"), F.lit(0).alias("depth"), F.lit("").alias("prefix")).limit(0)


def mapped_labels(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """The field of each distinct pair of label and section, null where no alias fits.

    rows: label, section; aliases: alias, field, section (null: any), rank.
    """
    pairs = saved(rows.select("label", "section").distinct())
    spelt = aliases.select(F.array_join(words(F.col("alias")), " ").alias("prefix"), "field", F.col("section").alias("own"), "rank")
    hits = saved(found(pairs, aliases)).join(spelt, "prefix")
    order = F.struct(-F.col("depth"), F.col("own").isNull(), "rank", "start", "field")
    fits = pairs.join(hits, "label").where("own is null or own = section")
    best = fits.groupBy("label", F.coalesce("section", F.lit("\0")).alias("_s")).agg(F.min_by("field", order).alias("field"), F.min(order).alias("_o"))
    return pairs.withColumn("_s", F.coalesce("section", F.lit("\0"))).join(best.select("label", "_s", "field"), ["label", "_s"], "left").drop("_s")


_rules: dict[tuple[str, Field], Column] = {}


def rule(field: Field) -> Column:
    """The rules of a field over the columns raw and label; put together once a session, as they are large."""
    key = (SparkContext.getOrCreate().applicationId, field)
    if key not in _rules:
        _rules[key] = normalized(F.col("raw"), F.col("label"), field)
    return _rules[key]


def read_texts(rows: DataFrame, fields: dict[str, Field]) -> DataFrame:
    """v: each row's raw text by the rules of its field; null where the field has no rules."""
    rules = {k: rule(f) for k, f in fields.items() if f.kind != "ls"}
    lists = {k: f for k, f in fields.items() if f.kind == "ls"}
    value = reduce(lambda acc, x: acc.when(F.col("field") == x[0], x[1]), rules.items(), F.when(F.lit(False), next(iter(rules.values()))))
    parts = [rows.where(F.col("field").isNull() | ~F.col("field").isin(*lists)).withColumn("v", value)]
    parts += [rows.where(F.col("field") == k).withColumn("v", rule(f)) for k, f in lists.items()]
    return reduce(DataFrame.unionByName, parts)


def joined_back(rows: DataFrame, texts: DataFrame, key: list[str]) -> DataFrame:
    """rows with what is known of their text; a null in the key is a value like others."""
    more = [F.col(f"t.{c}") for c in texts.columns if c not in key]
    return rows.alias("r").join(texts.alias("t"), reduce(and_, [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in key]), "left").select("r.*", *more)


def typed(rows: DataFrame, fields: dict[str, Field]) -> DataFrame:
    """v as in `read_texts`; every distinct text is read once, however many rows state it."""
    key = ["field", "label", "raw"]
    return joined_back(rows, read_texts(rows.select(*key).distinct(), fields), key)


def mapped(rows: DataFrame, aliases: DataFrame, fields: dict[str, Field]) -> DataFrame:
    """rows (label, section, raw and more) with field, outcome and v.

    outcome: section (the value repeats the label), unmapped, sentinel (a field that begins with __), the reason of a refused
    value, no_rules (a field that the types lack), or ok.
    """
    key = ["label", "section", "raw"]
    texts = joined_back(rows.select(*key).distinct(), mapped_labels(rows, aliases), key[:2])
    outcome = (
        F.when(is_heading(F.col("label"), F.col("raw")), "section")
        .when(F.col("field").isNull(), "unmapped")
        .when(F.startswith("field", F.lit("__")), "sentinel")
        .when(~F.col("field").isin(*fields), "no_rules")
        .otherwise(F.coalesce("v.reason", F.lit("ok")))
    )
    return joined_back(rows, read_texts(texts, fields).withColumn("outcome", outcome), key)


def unmapped_report(rows: DataFrame, samples: int = 3) -> DataFrame:
    """Unmapped labels with their number, sections and smallest sample values."""
    lost = rows.where("outcome = 'unmapped'").groupBy("label", "section", "raw").agg(F.count(F.lit(1)).alias("n"))
    first = lost.groupBy("label").agg(F.sum("n").alias("n"), F.countDistinct("section").alias("sections"))
    from .rules import top_per_group

    shown = top_per_group(lost.select("label", "raw").distinct(), "label", [F.col("raw")], samples)
    shown = shown.groupBy("label").agg(F.array_sort(F.collect_list("raw")).alias("samples"))
    return first.join(shown, "label", "left")
