"""A finder over the part facts: its page and its facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.tools import Facet, Tool, facets, run
from ..sources.tables import load, rendered
from .queries import KINDS, facts_of, query

TOOL = Tool("red-parts", "words=red", (Facet("type", "multi"), Facet("size", "range"), Facet("brand", "select"), Facet("large", "toggle")), ("brand", "size", "span"), "size", ({"size_min": "10"},))
CHOSEN = "EXISTS (SELECT 1 FROM shown f WHERE f.part_id = p_partkey AND f.field_key = 'words' AND list_contains(f.value_list, 'red'))"


@query(f"""SELECT p_partkey AS part_id, coalesce(-v.value_num, 1e30) AS sort_value, b.value_text AS cell_brand, v.value_text AS cell_size, s.value_text AS cell_span FROM part
  LEFT JOIN shown v ON v.part_id = p_partkey AND v.field_key = 'size' LEFT JOIN shown b ON b.part_id = p_partkey AND b.field_key = 'brand' LEFT JOIN shown s ON s.part_id = p_partkey AND s.field_key = 'span'
  WHERE {CHOSEN} AND EXISTS (SELECT 1 FROM shown f WHERE f.part_id = p_partkey AND f.field_key = 'size' AND f.value_num >= 10) ORDER BY 2, 1 LIMIT 51""")
def finder_page(spark, d):
    parts = load(spark, d, "part").select(F.col("p_partkey").alias("part_id"))
    return run(TOOL, parts, rendered(facts_of(spark, d)), KINDS, {"size_min": "10"}, down=True)


@query(f"""SELECT place, t.field_key, value, coalesce(parts, 0)::BIGINT AS parts FROM (VALUES (0, 'type'), (1, 'size'), (2, 'brand'), (3, 'large')) t(place, field_key) LEFT JOIN (
  SELECT field_key, value_text AS value, count(DISTINCT part_id) AS parts FROM shown JOIN part ON part_id = p_partkey WHERE field_type IN ('e', 's', 'b') AND value_text IS NOT NULL AND {CHOSEN} GROUP BY ALL) v ON v.field_key = t.field_key""")
def finder_facets(spark, d):
    parts = load(spark, d, "part").select(F.col("p_partkey").alias("part_id"))
    return facets(TOOL, parts, rendered(facts_of(spark, d)), KINDS)
