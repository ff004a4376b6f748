"""Inheritance of what documents state of families, and the same in SQL.

Suppliers stand for documents, which list the parts of their order lines; a line with a large quantity states a value of its own part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import inherit as x
from ..sources.tables import load
from .queries import query

SHAPES = ("AX-", "CAB-", "N9K-PAC-", "DS-SFP-", "BX-", "CX-", "DX-SSD-", "EX-")
INHERIT_SQL = f"""
parts AS (SELECT p_partkey AS part_id, {list(SHAPES)}[1 + p_partkey % 8] || p_partkey AS sku, CASE WHEN p_size % 9 = 0 THEN 'license' ELSE 'hardware' END AS class, CASE WHEN p_size % 11 = 0 THEN 'transceiver' ELSE p_type END AS category, p_size % 5 AS f, CASE WHEN p_size % 7 = 0 THEN 'the series' WHEN p_size % 7 = 1 THEN 'blue things' ELSE 'Model ' || (100 + p_size % 5) END AS family FROM part),
listed AS (SELECT DISTINCT l_suppkey AS doc_id, l_partkey AS part_id FROM lineitem),
docs AS (SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 6 = 0 THEN 'blue line' ELSE 'model-' || (100 + s_nationkey % 5) || ' datasheet' END AS family, s_nationkey % 5 AS f, s_suppkey % 6 = 0 AS blue, round(s_acctbal) AS v FROM supplier),
own AS (SELECT l_suppkey AS doc_id, l_partkey AS part_id, CASE WHEN l_suppkey % 2 = 0 THEN 'temp_operating' ELSE 'mac_table' END AS field, 0 AS level, min(l_quantity)::DOUBLE AS value FROM lineitem WHERE l_quantity > 48 GROUP BY ALL),
ruled AS (SELECT o.*, CASE WHEN category = 'transceiver' AND field = 'mac_table' THEN 'not_applicable:transceiver' END AS rule FROM own o JOIN parts USING (part_id)),
offers AS (SELECT doc_id, part_id, field, CASE WHEN field = 'certifications' THEN 2 ELSE 1 END AS level, v AS value, CASE WHEN field = 'weight' THEN 'class_b' WHEN class = 'license' THEN 'class:license' WHEN part_id % 8 = 1 THEN 'component:CAB-' WHEN part_id % 8 = 2 THEN 'component:-PAC-' WHEN part_id % 8 = 3 THEN 'component:SFP' WHEN part_id % 8 = 6 THEN 'component:-SSD' WHEN category = 'transceiver' THEN 'category:transceiver'
    WHEN p.family = 'the series' THEN 'family:unknown' WHEN (p.family = 'blue things') <> blue THEN 'family:unknown' WHEN NOT blue AND p.f <> d.f THEN 'family:mismatch'
    WHEN EXISTS (SELECT 1 FROM ruled r WHERE r.rule IS NULL AND r.doc_id = d.doc_id AND r.part_id = p.part_id AND r.field = t.field) THEN 'own_value' WHEN field IN ('temp_operating', 'mac_table') AND EXISTS (SELECT 1 FROM ruled r WHERE r.rule IS NULL AND r.doc_id = d.doc_id AND r.field = t.field) THEN 'exception_in_document' WHEN field = 'colour' THEN 'no_class' END AS rule
  FROM docs d JOIN listed USING (doc_id) JOIN parts p USING (part_id), (VALUES ('weight'), ('temp_operating'), ('mac_table'), ('certifications'), ('colour')) t(field)),
vals AS (SELECT doc_id, part_id, field, level, value, rule FROM ruled UNION ALL SELECT * FROM offers)
"""


def offered(spark, d) -> DataFrame:
    p, k, size = load(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    shape = F.element_at(F.array(*[F.lit(s) for s in SHAPES]), (k % 8 + 1).cast("int"))
    family = F.when(size % 7 == 0, "the series").when(size % 7 == 1, "blue things").otherwise(F.concat(F.lit("Model "), (size % 5 + 100).cast("string")))
    parts = p.select(k.alias("part_id"), F.concat(shape, k.cast("string")).alias("sku"), F.when(size % 9 == 0, "license").otherwise("hardware").alias("class"), F.when(size % 11 == 0, "transceiver").otherwise(F.col("p_type")).alias("category"), family.alias("family"))
    li = load(spark, d, "lineitem")
    listed = li.select(F.col("l_suppkey").alias("doc_id"), F.col("l_partkey").alias("part_id"))
    field = F.when(F.col("l_suppkey") % 2 == 0, "temp_operating").otherwise("mac_table")
    own = li.where("l_quantity > 48").groupBy(F.col("l_suppkey").alias("doc_id"), F.col("l_partkey").alias("part_id"), field.alias("field")).agg(F.min("l_quantity").cast("double").alias("value"))
    own = own.select("doc_id", F.lit(x.OWN).alias("level"), "part_id", F.lit(None).cast("string").alias("family"), "field", "value")
    name = F.when(F.col("s_suppkey") % 6 == 0, "blue line").otherwise(F.concat(F.lit("model-"), (F.col("s_nationkey") % 5 + 100).cast("string"), F.lit(" datasheet")))
    fields = F.explode(F.array(*[F.lit(f) for f in ("weight", "temp_operating", "mac_table", "certifications", "colour")])).alias("field")
    wide = load(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), name.alias("family"), F.round("s_acctbal").cast("double").alias("value"), fields)
    wide = wide.select("doc_id", F.when(F.col("field") == "certifications", x.DOCUMENT).otherwise(x.FAMILY).alias("level"), F.lit(None).cast("long").alias("part_id"), "family", "field", "value")
    return x.inherited(own.unionByName(wide), listed, parts, x.classes_of(spark, A="certifications", B="weight", C="temp_operating mac_table"))


@query(f"WITH {INHERIT_SQL.strip()} SELECT part_id, field, level, doc_id, value FROM (SELECT *, row_number() OVER (PARTITION BY part_id, field ORDER BY level, doc_id, value) AS r FROM vals WHERE rule IS NULL) WHERE r = 1")
def inherited_values(spark, d):
    """What each part takes from all documents: its own values, then those of its family, then those of a document."""
    return x.nearest(offered(spark, d))


@query(f"WITH {INHERIT_SQL.strip()} SELECT rule, count(*) AS n FROM vals WHERE rule IS NOT NULL GROUP BY 1")
def inheritance_refusals(spark, d):
    return x.refusals(offered(spark, d))
