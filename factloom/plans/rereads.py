"""Gates that read pages again, lists filled up after a filter, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import furniture, paging, reread as x
from ..operators.cells import cells
from ..operators.extraction import extracted
from ..sources.tables import load, spread
from .cells import row
from .queries import query

VERDICT_SQL = """CASE p_partkey % 10 WHEN 1 THEN CASE WHEN r = 0 THEN 'wrong' ELSE 'same' END WHEN 2 THEN CASE WHEN r = 1 THEN 'same' ELSE 'moved' END WHEN 3 THEN 'vanished' ELSE 'same' END"""


def pages(spark, d, again: bool) -> DataFrame:
    """A page of each part with three facts.  again: as it is later, when one in ten states another weight, one in ten has its
    rows turned round, and one in ten has lost its table."""
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = [row("Weight", size), row("Noise", size + 3), row("Colour", F.upper("p_name") if again else F.col("p_name"))]
    html = F.concat(F.lit("<table>"), *rows, F.lit("</table>"))
    if again:
        other = F.concat(F.lit("<table>"), row("Weight", size + 1), *rows[1:], F.lit("</table>"))
        turned = F.concat(F.lit("<table>"), *rows[::-1], F.lit("</table>"))
        html = F.when(k % 10 == 1, other).when(k % 10 == 2, turned).when(k % 10 == 3, F.lit("<p>gone</p>")).otherwise(html)
    return load(spark, d, "part").select(k.alias("page_id"), F.col("p_brand").alias("source"), html.alias("html"))


def stored(spark, d) -> DataFrame:
    """The facts as they were read: the second cell of every row."""
    was = pages(spark, d, again=False)
    return cells(was, "page_id", "html").where("c = 1").withColumnRenamed("text", "raw").join(was.select("page_id", "source"), "page_id")


@query(f"SELECT p_partkey AS page_id, r::INT AS r, {VERDICT_SQL} AS verdict FROM part, (VALUES (0), (1), (2)) t(r)")
def cells_reread(spark, d):
    """Every stored value against its cell now."""
    return x.reread(stored(spark, d), pages(spark, d, again=True)).select("page_id", "r", "verdict")


@query(f"""SELECT source, count(*) AS sampled, count(*) FILTER (verdict = 'same') AS same, count(*) FILTER (verdict = 'moved') AS moved, count(*) FILTER (verdict = 'wrong') AS wrong, count(*) FILTER (verdict = 'vanished') AS vanished, count(*) FILTER (verdict = 'same') >= 0.98 * count(*) AS passed
  FROM (SELECT p_brand AS source, {VERDICT_SQL} AS verdict FROM part, (VALUES (0), (1), (2)) t(r) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY md5('gate:' || p_partkey || ':' || r), p_partkey, r) <= 40) GROUP BY 1""")
def cells_gate(spark, d):
    """Forty values of each source, the same ones each time, read again."""
    some = x.sampled(stored(spark, d), "source", ["page_id", "r"], 40, "gate")
    return x.reread_gate(x.reread(some, pages(spark, d, again=True).drop("source")), "source")


@query("""SELECT milestone, count(*) AS stored, count(*) FILTER (o_orderkey % 25 <> 4 OR milestone <> 'announced') AS found, count(*) FILTER (o_orderkey % 25 = 4 AND milestone = 'announced') AS other_day, 0::BIGINT AS missing, 0::BIGINT AS not_stored, count(*) FILTER (o_orderkey % 25 = 4 AND milestone = 'announced') = 0 AS passed
  FROM orders, (VALUES ('announced'), ('end_of_sale'), ('end_of_support')) t(milestone) GROUP BY 1""")
def dates_reread(spark, d):
    """Stored dates against those on the bulletins: one in 25 announcements was stored a day late."""
    day = F.col("o_orderdate")
    fmt = lambda c: F.date_format(c, "MMMM d, yyyy")
    html = F.concat(F.lit("<table>"), row("End-of-Life Announcement Date", fmt(day)), row("End-of-Sale Date", fmt(day + F.expr("interval 100 days"))), row("Last Date of Support", fmt(day + F.expr("interval 1000 days"))), F.lit("</table>"))
    o = spread(load(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    dates = F.explode(F.create_map(F.lit("announced"), F.to_date(day + F.make_dt_interval(F.when(F.col("o_orderkey") % 25 == 4, 1).otherwise(0))), F.lit("end_of_sale"), F.to_date(day + F.expr("interval 100 days")), F.lit("end_of_support"), F.to_date(day + F.expr("interval 1000 days")))).alias("milestone", "day")
    return x.redated(o.select("o_orderkey", dates), o.select("o_orderkey", html.alias("html")), "o_orderkey")


@query("""SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') ORDER BY c_acctbal DESC, c_custkey LIMIT 75""")
def filled_page(spark, d):
    """The 75 largest balances without an open order, taken in batches until there are enough."""
    late = load(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return paging.filled(load(spark, d, "customer").select("c_custkey", "c_acctbal"), [("c_acctbal", True), ("c_custkey", False)], lambda rows: rows.join(late, "c_custkey", "left_anti"), 75, batch=40)


LINKS_SQL = r"""sites AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^(www[0-9]*|m|mobile|amp|blog)\.', '') AS site FROM pages),
links AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS item FROM pages),
rare AS (SELECT site, item, count(DISTINCT page_id) AS pages, any_value(n) AS of FROM links JOIN sites USING (page_id) JOIN (SELECT site, count(*) AS n FROM sites GROUP BY 1) USING (site) GROUP BY ALL HAVING count(DISTINCT page_id) >= 3 AND count(DISTINCT page_id) >= 0.03 * any_value(n))"""


def site_links(spark, d) -> tuple[DataFrame, DataFrame]:
    p = load(spark, d, "pages")
    links = extracted(p, "page_id", "html", ("link",)).select("page_id", F.col("value").alias("item"), "label")
    return links, p.select("page_id", furniture.site_of(F.col("url")).alias("site"))


@query(f"WITH {LINKS_SQL} SELECT site, item, pages, of FROM rare")
def site_furniture(spark, d):
    """Links that at least three pages of a site and three in a hundred have."""
    return furniture.furniture(*site_links(spark, d), least_share=0.03)


@query(f"WITH {LINKS_SQL} SELECT page_id, count(*) AS links FROM links JOIN sites USING (page_id) ANTI JOIN rare USING (site, item) GROUP BY 1")
def content_links(spark, d):
    """How many links of each page are its own."""
    return furniture.without_furniture(*site_links(spark, d), least_share=0.03).groupBy("page_id").agg(F.count(F.lit(1)).alias("links"))
