"""Queries of upkeep over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import maintenance as m
from ..sources.tables import load
from .queries import facts_of, query


@query("SELECT event_id FROM events WHERE (event_id % 6) NOT IN (2, 5)")
def succeeded_runs(spark, d):
    runs = spark.createDataFrame([(i, "failed" if i % 3 == 2 else "succeeded") for i in range(6)], "run_id long, status string")
    return m.succeeded(load(spark, d, "events").select("event_id", (F.col("event_id") % 6).alias("run_id")), runs).select("event_id")


@query("""WITH h AS (SELECT event_id AS id, (event_id % 4) AS run_id, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS superseded_by FROM events)
  SELECT a.id, CASE WHEN b.run_id = 3 THEN NULL ELSE a.superseded_by END AS superseded_by FROM h a LEFT JOIN h b ON b.id = a.superseded_by WHERE a.run_id <> 3""")
def rollback_run(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    h = load(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 4).alias("run_id"), F.lead("event_id").over(w).alias("superseded_by"))
    return m.rolled_back(h, 3).select("id", "superseded_by")


@query("""SELECT part_id, field_key, state, value_text, is_current AND NOT coalesce(tier = 4 AND field_key = 'price', false) AS is_current FROM facts
  UNION ALL SELECT part_id, field_key, 'gap_unattempted', NULL, true FROM facts WHERE is_current AND tier = 4 AND field_key = 'price'""")
def retract_facts(spark, d):
    f = facts_of(spark, d).select("part_id", "field_key", "state", "value_text", "tier", "is_current")
    return m.retracted(f, (F.col("tier") == 4) & (F.col("field_key") == "price")).drop("tier")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 1 WHEN event_id % 3 = 0 THEN 2 WHEN event_id % 3 = 1 AND event_id % 2 = 0 THEN 3 WHEN event_id % 3 = 1 THEN 4 ELSE 9 END AS tier FROM events")
def restamp_tiers(spark, d):
    e = load(spark, d, "events").select("event_id", (F.col("event_id") % 3).alias("doc_id"), F.when(F.col("event_id") % 2 == 0, "table").otherwise("text").alias("method"), F.lit(9).alias("tier"))
    kinds = F.broadcast(spark.createDataFrame([(0, "pdf"), (1, "html")], "doc_id long, doc_kind string"))
    return m.restamped(e, kinds, {("pdf", "table"): 1, ("pdf", "text"): 2, ("html", "table"): 3, ("html", "text"): 4}).select("event_id", "tier")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'added' WHEN c_custkey % 5 = 0 THEN 'orphan' WHEN c_custkey % 3 = 0 THEN 'changed' ELSE 'same' END AS change FROM customer WHERE NOT (c_custkey % 7 = 0 AND c_custkey % 5 = 0)""")
def dictionary_sync(spark, d):
    c = load(spark, d, "customer")
    old = c.where("c_custkey % 7 <> 0").select("c_custkey", "c_mktsegment", F.lit(None).cast("string").alias("note"))
    new = c.where("c_custkey % 5 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.lit("x")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), F.lit(None).cast("string").alias("note"))
    return m.changes(old, new, ["c_custkey"], ["c_mktsegment", "note"])


@query("""SELECT l_orderkey, l_partkey, count(*) AS offers, CASE WHEN count(*) = 1 THEN 'single' WHEN count(DISTINCT l_quantity) = 1 THEN 'repeat' WHEN count(DISTINCT l_suppkey) = 1 THEN 'same_doc' ELSE 'compete' END AS outcome FROM lineitem GROUP BY 1, 2""")
def collision_rule(spark, d):
    return m.collisions(load(spark, d, "lineitem"), ["l_orderkey", "l_partkey"], "l_quantity", "l_suppkey")


@query("""SELECT CASE WHEN s_suppkey % 4 = 1 THEN lower(s_name) WHEN s_suppkey % 4 = 2 THEN s_name || 'X' ELSE s_name END AS sku, 'c' || (s_suppkey % 3)::VARCHAR AS category,
  CASE WHEN s_suppkey % 11 = 0 THEN 'refused' WHEN s_suppkey % 4 = 1 THEN 'case_variant' WHEN s_suppkey % 4 = 2 AND s_suppkey % 3 = 2 THEN 'unmapped_category' WHEN s_suppkey % 4 = 2 THEN 'new' ELSE 'existing' END AS outcome FROM supplier""")
def enumeration(spark, d):
    s, k = load(spark, d, "supplier"), F.col("s_suppkey")
    sku = F.when(k % 4 == 1, F.lower("s_name")).when(k % 4 == 2, F.concat("s_name", F.lit("X"))).otherwise(F.col("s_name"))
    listed = s.select(sku.alias("sku"), F.concat(F.lit("c"), (k % 3).cast("string")).alias("category"), (k % 11 == 0).alias("refused"))
    return m.enumerated(listed, s.select(F.col("s_name").alias("sku")), spark.createDataFrame([("c0",), ("c1",)], "category string"))


@query("""SELECT sku, pages, coalesce(category, 'unknown') AS category FROM (SELECT user_id AS sku, count(DISTINCT event_id % 50) AS pages, bool_or(event_id % 97 = 0) AS vendor FROM events GROUP BY 1)
  LEFT JOIN (SELECT user_id AS sku, min_by(event_type, (-n, event_type)) AS category FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY ALL) GROUP BY 1) USING (sku) WHERE pages >= 36 OR vendor""")
def unknown_promotion(spark, d):
    e = load(spark, d, "events")
    unknown = e.select(F.col("user_id").alias("sku"), (F.col("event_id") % 50).alias("page_id"), (F.col("event_id") % 97 == 0).alias("vendor_page"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("category"))
    return m.promoted(unknown, 36)


@query(""", s(field_key, source, tier) AS (VALUES ('price', 'a', 1), ('size', 'a', 1), ('size', 'b', 3), ('span', 'b', 3)), able AS (SELECT part_id, source, s.tier, count(*) AS fields FROM facts JOIN s USING (field_key) WHERE is_current AND state = 'gap_unattempted' GROUP BY ALL),
  fresh AS (SELECT * FROM able WHERE NOT (source = 'a' AND part_id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')) AND NOT (source = 'b' AND part_id % 10 = 0))
  SELECT source, part_id, fields, (50 + 10 * tier)::INT AS priority FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY fields DESC, part_id) AS r FROM fresh) WHERE r <= 20""")
def gap_plan(spark, d):
    gaps = facts_of(spark, d).where("is_current and state = 'gap_unattempted'").select("part_id", "field_key")
    sources = F.broadcast(spark.createDataFrame([("price", "a", 1), ("size", "a", 1), ("size", "b", 3), ("span", "b", 3)], "field_key string, source string, tier int"))
    checks = load(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("part_id"), F.lit("a").alias("source")).distinct()
    queue = load(spark, d, "part").where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("part_id"), F.lit("b").alias("source"))
    return m.planned(gaps, sources, checks, queue, 20)


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'never' ELSE CASE WHEN p_size > 40 THEN 'document_names_it' WHEN p_size < 10 THEN 'out_of_scope' WHEN p_partkey % 3 = 1 THEN 'family_wide' WHEN p_size % 2 = 0 THEN 'no_exception' ELSE 'refused' END END AS verdict,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey % 2 = 0 END AS matches FROM part""")
def inheritance(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    kind = F.element_at(F.array(F.lit("B"), F.lit("A"), F.lit("C")), (k % 3 + 1).cast("int"))
    name = F.when(k % 5 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" ax-"), k.cast("string")))
    family = F.when(k % 2 == 0, F.concat(F.lit("AX-"), k.cast("string"), F.lit(" series 2"))).otherwise(F.lit("AX series 2"))
    return load(spark, d, "part").select("p_partkey", m.may_inherit(kind, size > 40, size >= 10, size % 2 == 1).alias("verdict"), m.family_matches(name, family).alias("matches"))
