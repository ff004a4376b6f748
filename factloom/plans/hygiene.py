"""Evidence on made-up numbers over a catalogue from the tables, and the same in SQL.

Numbers are those of parts; customers stand for documents, each naming a part and, in some segments, the one a digit shorter;
suppliers stand for what else is known.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hygiene as x
from ..sources.tables import load
from .queries import query

CATALOGUE_SQL = """
parts AS (SELECT p_partkey AS part_id, 'V' || p_size % 3 AS vendor, CASE WHEN p_partkey % 4 = 0 THEN 'AX-' ELSE 'BX-' END || p_partkey AS sku, p_size = 50 AS reviewed FROM part),
named AS (SELECT part_id, doc_id, kind FROM (SELECT c_custkey AS doc_id, CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY') THEN 'vendor_datasheet_pdf' ELSE 'vendor_page' END AS kind, unnest(CASE WHEN c_nationkey % 3 > 0 THEN [k, k // 10] ELSE [k] END) AS part_id FROM (SELECT *, c_custkey * 7 % (SELECT count(*) FROM part) AS k FROM customer))),
independent AS (SELECT s_suppkey * 11 % (SELECT count(*) FROM part) AS part_id FROM supplier)
"""


def catalogue(spark, d):
    p, key = load(spark, d, "part"), F.col("p_partkey")
    n = p.count()
    parts = p.select(key.alias("part_id"), F.concat(F.lit("V"), (F.col("p_size") % 3).cast("string")).alias("vendor"), F.concat(F.when(key % 4 == 0, "AX-").otherwise("BX-"), key.cast("string")).alias("sku"), (F.col("p_size") == 50).alias("reviewed"))
    at = F.col("c_custkey") * 7 % n
    pdf = F.when(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE", "MACHINERY"), x.PDF).otherwise("vendor_page")
    named = load(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), pdf.alias("kind"), F.explode(F.when(F.col("c_nationkey") % 3 > 0, F.array(at, F.floor(at / 10))).otherwise(F.array(at))).alias("part_id"))
    return parts, named, load(spark, d, "supplier").select((F.col("s_suppkey") * 11 % n).alias("part_id"))


@query(f"""WITH RECURSIVE {CATALOGUE_SQL.strip()}, pairs AS (SELECT l.part_id AS long_id, s.part_id AS short_id, vendor, l.sku FROM parts l JOIN parts s USING (vendor) WHERE regexp_matches(l.sku, '[0-9]$') AND length(l.sku) > 3 AND s.sku = left(l.sku, length(l.sku) - 1)),
  up AS (SELECT long_id, short_id AS root, 1 AS depth FROM pairs UNION ALL SELECT up.long_id, p.short_id, depth + 1 FROM up JOIN pairs p ON p.long_id = up.root), tops AS (SELECT long_id, arg_max(root, depth) AS root, max(depth) AS depth FROM up GROUP BY 1),
  v AS (SELECT long_id, p.short_id, reviewed, (SELECT count(*) FROM independent i WHERE i.part_id = long_id) + (SELECT count(*) FROM (SELECT DISTINCT part_id, doc_id, kind FROM named) n WHERE n.part_id = long_id AND kind = 'vendor_page') AS independent, (SELECT count(DISTINCT doc_id) FROM named n WHERE n.part_id = long_id AND kind = 'vendor_datasheet_pdf') AS pdf_docs,
    EXISTS (SELECT 1 FROM named a JOIN named b USING (doc_id) WHERE a.part_id = long_id AND b.part_id = p.short_id AND a.kind = 'vendor_datasheet_pdf' AND b.kind = a.kind) AS shared_pdf, (depth > 1 OR EXISTS (SELECT 1 FROM pairs c WHERE c.short_id = p.long_id)) AS chained, (SELECT count(*) FROM parts q WHERE q.vendor = p.vendor AND regexp_matches(q.sku, '[0-9]$') AND regexp_replace(q.sku, '[0-9]+$', '') = regexp_replace(p.sku, '[0-9]+$', '')) AS series, root, depth
  FROM pairs p JOIN parts ON part_id = long_id JOIN tops USING (long_id))
  SELECT long_id, short_id, independent, pdf_docs, shared_pdf, chained, series, root, depth, CASE WHEN reviewed THEN 'long_operator_reviewed' WHEN independent > 0 THEN 'long_has_independent_evidence' WHEN pdf_docs = 0 THEN 'long_no_pdf_evidence' WHEN pdf_docs > 1 THEN 'long_multiple_pdfs' WHEN NOT shared_pdf THEN 'base_not_named_by_that_pdf' WHEN chained THEN 'footnote_chain' WHEN series > 2 THEN 'numeric_series' ELSE 'retire:pdf_footnote_digit' END AS verdict FROM v""")
def fabricated_evidence(spark, d):
    return x.fabricated_evidence(*catalogue(spark, d)).drop("reviewed")
