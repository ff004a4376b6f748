"""Specification tables written from part rows and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.grids import table_defects, table_facts
from ..sources.tables import load
from .queries import query

FACTS = """SELECT p_brand, '{0}' AS shape, 'AX-' || p_partkey::VARCHAR AS subject, l AS label, CASE l WHEN 'Size' THEN p_size::VARCHAR WHEN 'Name' THEN p_name ELSE p_type END AS value
  FROM part, (VALUES ('Size'), ('Name'), ('Type')) t(l)"""


def cells(*xs):
    return F.concat(*[F.concat(F.lit("<td>"), x.cast("string"), F.lit("</td>")) for x in xs])


@query(FACTS.format("A"))
def model_rows(spark, d):
    """Shape A: a page for each brand, a row for each part."""
    row = F.concat(F.lit("<tr>"), cells(F.concat(F.lit("AX-"), F.col("p_partkey")), F.col("p_size"), F.col("p_name"), F.col("p_type")), F.lit("</tr>"))
    pages = load(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_list(row)), "").alias("rows"))
    head = "<p>x</p><table><tr><th>Model</th><th>Size</th><th>Name</th><th>Type</th></tr>"
    return table_facts(pages.select("p_brand", F.concat(F.lit(head), "rows", F.lit("</table>")).alias("html")), "p_brand", "html").select("p_brand", "shape", "subject", "label", "value")


@query(FACTS.format("B"))
def model_columns(spark, d):
    """Shape B: a page for each part, attributes in the rows."""
    p = load(spark, d, "part")
    name = F.concat(F.lit("AX-"), F.col("p_partkey"))
    rows = [F.concat(F.lit(f"<tr><td>{label}</td><td>"), c.cast("string"), F.lit("</td></tr>")) for label, c in (("Size", F.col("p_size")), ("Name", F.col("p_name")), ("Type", F.col("p_type")))]
    html = F.concat(F.lit("<table><tr><th>Feature</th><th>"), name, F.lit("</th></tr>"), *rows, F.lit("</table>"))
    return table_facts(p.select("p_brand", html.alias("html")), "p_brand", "html").select("p_brand", "shape", "subject", "label", "value")


def two_headers(spark, d):
    """A page for each part: a header of two rows, a model in each row, and some rows that do not fit the header."""
    k, lit = F.col("p_partkey"), F.lit
    said = lambda *xs: F.concat(*[lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    head = "<table><tr><th rowspan=2>Model</th><th rowspan=2>Size</th><th colspan=2>Supply</th><th rowspan=2>Default or upgrade</th></tr><tr><th>Main</th><th>500 W</th></tr>"
    kind = F.when(k % 7 == 0, "Custom").when(k % 2 == 0, "Default").otherwise("Upgrade")
    whole = said("<tr>", cells(said("AX-", k), F.col("p_size"), F.col("p_name"), lit("720*W"), kind), "</tr>")
    odd = F.when(k % 5 == 0, said("<tr>", cells(said("AX-", k, "-S"), F.col("p_size")), "</tr>")).when(k % 5 == 1, said("<tr>", cells(said("AX-", k, "-M"), F.col("p_size"), lit("a"), lit("b"), lit("c"), lit("d")), "</tr>")).otherwise("")
    shifted = said("<table><tr>", cells(said("BX-", k), F.col("p_size")), "</tr><tr>", cells(said("BX-", k + 1), lit("1")), "</tr><tr>", cells(said("BX-", k + 2), lit("2")), "</tr></table>")
    return load(spark, d, "part").select("p_partkey", said(head, whole, odd, "</table>", F.when(k % 11 == 0, shifted).otherwise("")).alias("html"))


@query("""SELECT p_partkey, 'A' AS shape, 'AX-' || p_partkey AS subject, l AS label, CASE l WHEN 'Size' THEN p_size::VARCHAR WHEN 'Supply [Main]' THEN p_name ELSE 'Custom' END AS value, '1:2:' || CASE l WHEN 'Size' THEN 1 WHEN 'Supply [Main]' THEN 2 ELSE 4 END AS locator
  FROM part, (VALUES ('Size'), ('Supply [Main]'), ('Default or upgrade')) t(l) WHERE l <> 'Default or upgrade' OR p_partkey % 7 = 0""")
def two_header_facts(spark, d):
    return table_facts(two_headers(spark, d), "p_partkey", "html")


@query("""SELECT p_partkey, 'GROUP_HEADER_IS_CONDITION' AS defect, '1:c3' AS locator FROM part UNION ALL SELECT p_partkey, 'SCHEMA_MATCH_LOW', '2:r0' FROM part WHERE p_partkey % 11 = 0
  UNION ALL SELECT p_partkey, 'ROW_DISCRIMINATOR_COLUMN', '1:c4' FROM part WHERE p_partkey % 7 > 0 UNION ALL SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'TABLE_SPLIT_DETECTED' ELSE 'GRID_MISALIGNED' END, '1:r3' FROM part WHERE p_partkey % 5 < 2""")
def two_header_defects(spark, d):
    return table_defects(two_headers(spark, d), "p_partkey", "html")
