"""Page furniture: what stands on so many pages of a site that it says nothing of any of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def site_of(url: Column) -> Column:
    """The host of an address without a first label that only says how to show the page (www, m, blog and the like)."""
    host = F.lower(F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1))
    return F.regexp_replace(host, r"^(?:www[0-9]*|m|mobile|amp|blog)\.(?=.*\.)", "")


def furniture(items: DataFrame, pages: DataFrame, least_share: float = 0.5, least_pages: int = 3) -> DataFrame:
    """Items (links, images or blocks of text) of each site that stand on at least least_pages of its pages and on
    least_share of them.

    items: page_id, item; pages: page_id, site, each page once.  Returns site, item, pages (with the item) and of (all pages).
    Counted with partial sums, so a site may have any number of pages, and an item may stand on all of them.
    """
    own = pages.select("page_id", "site").where("site is not null")
    sizes = own.groupBy("site").agg(F.count(F.lit(1)).alias("of"))
    counts = items.where("item is not null").select("page_id", "item").distinct().join(own, "page_id").groupBy("site", "item").agg(F.count(F.lit(1)).alias("pages"))
    return counts.where(F.col("pages") >= least_pages).join(sizes, "site").where(F.col("pages") >= least_share * F.col("of"))


def without_furniture(items: DataFrame, pages: DataFrame, least_share: float = 0.5, least_pages: int = 3) -> DataFrame:
    """The items, with all their columns, that are not furniture of their page's site; items of pages without a site stay."""
    gone = furniture(items, pages, least_share, least_pages).select(F.col("site").alias("_site"), F.col("item").alias("_item"))
    placed = items.join(pages.select("page_id", F.col("site").alias("_own")), "page_id", "left")
    return placed.join(gone, (F.col("_own") == F.col("_site")) & (F.col("item") == F.col("_item")), "left_anti").drop("_own")
