"""Stored values against the pages that they were read from, parsed anew.

A stored value names its cell: page, table, row and column.  The pages are parsed again, and each value meets its own cell by
an equi join; what is not there is looked for in the other cells of its page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.checkpoints import saved
from .cells import bulletin_dates, cells

#: Parts of a group in which the first rows are looked for before all of them are.
PARTS = 32


def sampled(rows: DataFrame, group: str, keys: list[str], size: int, seed: str = "") -> DataFrame:
    """Of each group the `size` rows that come first by a hash of their keys: the same ones each time.  A large group is
    looked through in parts, each of which hands on that many rows at most."""
    dice = F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in keys]))
    dealt = rows.withColumn("_dice", dice).withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(PARTS)))
    for by in (["_part", group], [group]):
        w = Window.partitionBy(*by).orderBy("_dice", *keys)
        dealt = dealt.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= size)
    return dealt.drop("_dice", "_part", "_nth")


def folded(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def reread(facts: DataFrame, pages: DataFrame, page: str = "page_id") -> DataFrame:
    """facts (page, tbl, r, c, raw and more) with verdict: same, moved (the value stands in another cell of the page), wrong
    (its cell holds another value), vanished (neither the cell nor the value is there).  pages: page and html; a page that
    is gone has no cells.  Case and white space do not count."""
    now = saved(cells(pages.where("html is not null"), page, "html").select(page, "tbl", "r", "c", folded(F.col("text")).alias("_now")))
    asked = facts.withColumn("_raw", folded(F.coalesce("raw", F.lit(""))))
    there = asked.join(now, [page, "tbl", "r", "c"], "left")
    elsewhere = now.select(page, F.col("_now").alias("_raw")).distinct().withColumn("_moved", F.lit(True))
    verdict = F.when(F.col("_now") == F.col("_raw"), "same").when(F.col("_moved"), "moved").when(F.col("_now").isNotNull(), "wrong").otherwise("vanished")
    return there.join(elsewhere, [page, "_raw"], "left").withColumn("verdict", verdict).drop("_now", "_raw", "_moved")


def reread_gate(verdicts: DataFrame, group: str, least: float = 0.98) -> DataFrame:
    """Of each group how many values were read again with each verdict, and whether enough stand where they stood."""
    kinds = ("same", "moved", "wrong", "vanished")
    counts = verdicts.groupBy(group).agg(F.count(F.lit(1)).alias("sampled"), *[F.count_if(F.col("verdict") == k).alias(k) for k in kinds])
    return counts.withColumn("passed", F.col("same") >= least * F.col("sampled"))


def redated(stored: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Stored dates (key, milestone, day) against those that bulletins state now: of each milestone how many are stored, found
    on their page, stand there with another day, or are missing; and how many stated dates are not stored."""
    now = bulletin_dates(pages, key, "html").groupBy(key, "milestone").agg(F.min("day").alias("stated"))
    both = stored.join(now, [key, "milestone"], "full")
    has, states = F.col("day").isNotNull(), F.col("stated").isNotNull()
    counts = both.groupBy("milestone").agg(F.count_if(has).alias("stored"), F.count_if(F.col("day") == F.col("stated")).alias("found"), F.count_if(has & states & (F.col("day") != F.col("stated"))).alias("other_day"), F.count_if(has & ~states).alias("missing"), F.count_if(states & ~has).alias("not_stored"))
    return counts.withColumn("passed", F.col("found") == F.col("stored"))
