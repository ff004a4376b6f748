"""Tables written from part rows and read back cell by cell, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..operators import cells as x
from ..operators.extraction import extracted
from ..sources.tables import load, spread
from .queries import query


def row(*items) -> Column:
    parts = [F.lit(i) if isinstance(i, str) else i.cast("string") for i in items]
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), p, F.lit("</td>")) for p in parts], F.lit("</tr>"))


def sectioned(spark, d):
    size, key = F.col("p_size"), F.col("p_partkey")
    model = F.concat(F.lit("AX-"), (key + 1000).cast("string"))
    other = F.concat(F.lit("BX-"), (key + 1000).cast("string"), F.lit("="))
    html = F.concat(
        F.lit("<table><tr><td colspan='3'>Weight</td></tr>"), row("Model", "Bare", "Packed"), row(model, size, size + 1), row(other, size + 2, "-"), F.lit("<tr><td colspan='3'>Noise</td></tr>"), row(model, size + 3, "N/A"), row("General", "x", "y"),
        F.lit("</table><table>"), row("Feature", model, F.concat(F.lit("CX-"), (key + 1000).cast("string"))), row("Colour", F.col("p_name"), F.col("p_type")), F.lit("</table>"),
    )
    return x.cells(load(spark, d, "part").select("p_partkey", html.alias("html")), "p_partkey", "html")


@query("""SELECT p_partkey, subject, label, value FROM (SELECT p_partkey, 'AX-' || (p_partkey + 1000) AS a, 'BX-' || (p_partkey + 1000) || '=' AS b, p_size AS s FROM part) p, LATERAL (VALUES (a, 'Weight [Bare]', s::VARCHAR), (a, 'Weight [Packed]', (s + 1)::VARCHAR), (b, 'Weight [Bare]', (s + 2)::VARCHAR), (a, 'Noise', (s + 3)::VARCHAR)) v(subject, label, value)""")
def sectioned_tables(spark, d):
    return x.sections(sectioned(spark, d), "p_partkey").select("p_partkey", "subject", "label", "value")


@query("SELECT p_partkey, unnest(['AX-' || (p_partkey + 1000), 'BX-' || (p_partkey + 1000) || '=', 'CX-' || (p_partkey + 1000)]) AS subject FROM part")
def document_subjects(spark, d):
    return x.subjects(sectioned(spark, d), "p_partkey")


def bulletins(spark, d):
    day = F.col("o_orderdate")

    def long(c):
        return F.date_format(c, "MMMM d, yyyy")

    key = (F.col("o_orderkey") + 1000).cast("string")
    html = F.concat(
        F.lit("<table>"), row("Name", "Value"), F.lit("</table><table>"), row("End-of-Life Announcement Date", "x", long(day)), row("End-of-Sale Date: HW", "y", long(day + F.expr("interval 100 days"))), row("End-of-Sale Date: again", "y", long(day)), row("Last Ship Date", "z", "soon"), row("Last Date of Support", "z", long(day + F.expr("interval 1000 days"))),
        F.lit("</table><table>"), row(F.concat(F.lit("OLD-"), key), "one"), F.lit("</table><table>"), row("Affected", "Text", "New"), row(F.concat(F.lit("OLD-"), key), "a", F.concat(F.lit("NEW-"), key)), row(F.concat(F.lit("OLD-"), key, F.lit("-E")), "b", "see the notes"), F.lit("</table>"),
    )
    return spread(load(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey").select("o_orderkey", html.alias("html"))


@query("SELECT o_orderkey, m AS milestone, strftime(o_orderdate + INTERVAL 1 DAY * n, '%Y-%m-%d') AS day FROM orders, (VALUES ('announced', 0), ('end_of_sale', 100), ('end_of_support', 1000)) t(m, n)")
def bulletin_dates(spark, d):
    return x.bulletin_dates(bulletins(spark, d), "o_orderkey", "html").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("SELECT o_orderkey, 'OLD-' || (o_orderkey + 1000) || s AS pid, CASE WHEN s = '' THEN 'NEW-' || (o_orderkey + 1000) END AS successor FROM orders, (VALUES (''), ('-E')) t(s)")
def bulletin_parts(spark, d):
    return x.bulletin_parts(bulletins(spark, d), "o_orderkey", "html")


@query("SELECT p_partkey, '/eol/' || p_size || '.html' AS value FROM part")
def bulletin_links(spark, d):
    def link(*parts):
        return F.concat(F.lit("<a href='"), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts], F.lit("'>x</a>"))

    size = F.col("p_size")
    html = F.concat(link("/eol/", size, ".html"), link("/eol/", size, "-de.html"), link("/eol/", size, ".pdf"), link("/eol/", size, ".html"), link("/p/", size, ".html"))
    pages = load(spark, d, "part").select("p_partkey", html.alias("html"))
    return x.bulletin_links(extracted(pages, "p_partkey", "html", ("link",)), "p_partkey")


@query("""SELECT page_id, CASE WHEN regexp_matches(b, 'end.of.(sale|life|support)|/eol') THEN 'eol' WHEN regexp_matches(b, 'release.notes|white.?paper|case.study') THEN 'non_datasheet' WHEN regexp_matches(b, 'licens') THEN 'licence' WHEN regexp_matches(b, 'software|virtual') THEN 'software' WHEN share >= 0.02 THEN 'hw_datasheet' ELSE 'unclear' END AS class
  FROM (SELECT page_id, lower(regexp_extract(html, '<title>([^<]*)</title>', 1) || ' ' || url || CASE WHEN page_id % 9 = 1 THEN '/eol/x' WHEN page_id % 9 = 2 THEN ' white paper' WHEN page_id % 9 = 3 THEN ' license' WHEN page_id % 9 = 4 THEN ' virtual' ELSE '' END) AS b, (page_id % 5) / 100 AS share FROM pages)""")
def document_classes(spark, d):
    more = F.when(F.col("page_id") % 9 == 1, "/eol/x").when(F.col("page_id") % 9 == 2, " white paper").when(F.col("page_id") % 9 == 3, " license").when(F.col("page_id") % 9 == 4, " virtual").otherwise("")
    kind = x.document_class(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.concat("url", more), F.col("page_id") % 5 / 100)
    return load(spark, d, "pages").select("page_id", kind.alias("class"))
