"""Evidence on part numbers that look made up: another number of the vendor with a digit, such as that of a footnote, behind it.

Everything that the verdict asks is counted from rows: who names the numbers, in what kind of document, what else is known of
them, whether they stand in a chain of numbers that extend one another, and how many numbers share the stem.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.checkpoints import saved
from .writes import fabricated_verdict

PDF = "vendor_datasheet_pdf"


def extensions(parts: DataFrame) -> DataFrame:
    """Pairs of a number and the same one with one digit more, within a vendor.  parts: part_id, vendor, sku."""
    long = parts.where(r"sku rlike '[0-9]$' and length(sku) > 3").select(F.col("part_id").alias("long_id"), "vendor", F.col("sku").alias("long_sku"), F.expr("left(sku, length(sku) - 1)").alias("short_sku"))
    return long.join(parts.select(F.col("part_id").alias("short_id"), "vendor", F.col("sku").alias("short_sku")), ["vendor", "short_sku"])


def chains(pairs: DataFrame) -> DataFrame:
    """The number that each chain of extensions begins with, and how many steps away from it each one stands.

    Pointers double: a member that pointed k steps back points 2 k steps back a round later, so a chain as long as a number has
    digits takes a few joins, whatever the number of chains.  Returns part_id, root, depth (0: the root itself).
    """
    members = pairs.select(F.col("long_id").alias("part_id")).unionByName(pairs.select(F.col("short_id").alias("part_id"))).distinct()
    back = saved(members.join(pairs.select(F.col("long_id").alias("part_id"), F.col("short_id").alias("root")), "part_id", "left").select("part_id", F.coalesce("root", "part_id").alias("root"), F.col("root").isNotNull().cast("int").alias("depth")))
    while True:
        ahead = back.select(F.col("part_id").alias("root"), F.col("root").alias("further"), F.col("depth").alias("more"))
        new = saved(back.join(ahead, "root").select("part_id", F.col("further").alias("root"), (F.col("depth") + F.col("more")).alias("depth")))
        if new.agg(F.coalesce(F.sum("depth"), F.lit(0))).first()[0] == back.agg(F.coalesce(F.sum("depth"), F.lit(0))).first()[0]:
            return back
        back = new


def fabricated_evidence(parts: DataFrame, named: DataFrame, independent: DataFrame) -> DataFrame:
    """A row for each number that extends another one, with all that the verdict asks, and the verdict.

    parts: part_id, vendor, sku, reviewed; named: part_id, doc_id, kind (documents that name a part, repeats allowed);
    independent: part_id, a row for each other thing known of a part (an alias, image, relation, date or check).
    """
    pairs = saved(extensions(parts))
    ids = pairs.select(F.col("long_id").alias("part_id")).unionByName(pairs.select(F.col("short_id").alias("part_id"))).distinct()
    docs = saved(named.join(ids, "part_id", "left_semi").select("part_id", "doc_id", "kind").distinct())
    pdf = docs.where(F.col("kind") == PDF)
    pdfs = docs.groupBy(F.col("part_id").alias("long_id")).agg(F.countDistinct(F.when(F.col("kind") == PDF, F.col("doc_id"))).alias("pdf_docs"), F.count_if(F.col("kind") != PDF).alias("other_docs"))
    both = pairs.select("long_id", "short_id").join(pdf.select(F.col("part_id").alias("long_id"), "doc_id").distinct(), "long_id").join(pdf.select(F.col("part_id").alias("short_id"), "doc_id").distinct(), ["short_id", "doc_id"])
    shared = both.groupBy("long_id").agg(F.count(F.lit(1)).alias("shared"))
    known = independent.join(ids, "part_id", "left_semi").groupBy(F.col("part_id").alias("long_id")).agg(F.count(F.lit(1)).alias("known"))
    stem = F.regexp_replace("sku", "[0-9]+$", "")
    stems = parts.where(r"sku rlike '[0-9]$'").groupBy("vendor", stem.alias("stem")).agg(F.count(F.lit(1)).alias("series"))
    chain = chains(pairs)
    further = pairs.select(F.col("short_id").alias("long_id")).distinct().withColumn("further", F.lit(True))
    chained = chain.select(F.col("part_id").alias("long_id"), "root", "depth").join(further, "long_id", "left")
    rows = pairs.join(parts.select(F.col("part_id").alias("long_id"), "reviewed"), "long_id").withColumn("stem", F.regexp_replace("long_sku", "[0-9]+$", ""))
    rows = rows.join(pdfs, "long_id", "left").join(shared, "long_id", "left").join(known, "long_id", "left").join(stems, ["vendor", "stem"], "left").join(chained, "long_id", "left").na.fill(0, ["pdf_docs", "other_docs", "shared", "known", "series"])
    rows = rows.withColumns({"independent": F.col("known") + F.col("other_docs"), "shared_pdf": F.col("shared") > 0, "chained": (F.col("depth") > 1) | F.coalesce("further", F.lit(False))})
    return rows.select("long_id", "short_id", "reviewed", "independent", "pdf_docs", "shared_pdf", "chained", "series", "root", "depth", fabricated_verdict().alias("verdict"))
