"""Further queries over the test tables: rule tables, ledgers, reports."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.text import pattern_verdicts
from ..operators import coverage, merge, rules
from ..sources.tables import load, rendered
from .queries import facts_of, query


@query("SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_extendedprice, nth FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey)::INT AS nth FROM lineitem) WHERE nth <= 5")
def top_per_outcome(spark, d):
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]
    return rules.top_per_group(load(spark, d, "lineitem"), "l_returnflag", order, 5).select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "nth")


@query("""SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'ring' WHEN contains(p_name, 'small') OR contains(p_name, 'large') THEN 'size' WHEN p_partkey % 2 = 0 THEN 'unit' END AS field FROM part""")
def label_mapping(spark, d):
    label = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " rate (Gbps)").otherwise(" rates (Gbps)"))
    return load(spark, d, "part").select("p_partkey", rules.map_label(label, [("ring", "ring"), ("small|large", "size"), ("rate$", "unit")]).alias("field"))


@query("""SELECT DISTINCT p_partkey AS part_id, source, field_key FROM part JOIN (VALUES ('PROMO', 'a', 'size'), ('LARGE', 'b', 'size'), (NULL, 'c', 'brand'), ('PROMO', 'c', 'brand')) t(p_type_, source, field_key) ON p_type_ IS NULL OR p_type_ = p_type""")
def capability_join(spark, d):
    able = spark.createDataFrame([("PROMO", "a", "size"), ("LARGE", "b", "size"), (None, "c", "brand"), ("PROMO", "c", "brand")], "p_type string, source string, field_key string")
    return rules.capable(load(spark, d, "part").select(F.col("p_partkey").alias("part_id"), "p_type"), able, "p_type")


@query("""SELECT l_suppkey, 'v' || max(a)::VARCHAR || '.' || (max(a * 100 + b) % 100)::VARCHAR AS newest FROM (SELECT l_suppkey, (l_partkey % 12)::INT AS a, (l_orderkey % 15)::INT AS b FROM lineitem) GROUP BY 1""")
def newest_version(spark, d):
    v = F.concat_ws(".", F.concat(F.lit("v"), (F.col("l_partkey") % 12).cast("string")), (F.col("l_orderkey") % 15).cast("string"))
    li = load(spark, d, "lineitem").select("l_suppkey", v.alias("v"))
    return li.groupBy("l_suppkey").agg(F.max_by("v", rules.version_key(F.col("v"))).alias("newest"))


@query("SELECT p_brand, string_agg(w, ',' ORDER BY o) AS words FROM (SELECT p_brand, lower(w) AS w, min(p_partkey * 10 + i) AS o FROM (SELECT p_brand, p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part) GROUP BY 1, 2) GROUP BY 1")
def list_union_fold(spark, d):
    p = load(spark, d, "part").select("p_brand", F.struct("p_partkey", F.split("p_name", " ").alias("w")).alias("x"))
    lists = p.groupBy("p_brand").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return lists.select("p_brand", F.array_join(rules.list_union(F.transform("xs", lambda x: x["w"])), ",").alias("words"))


@query("SELECT p_partkey, list_sort(list_distinct(string_split(p_name, ' '))) = list_sort(list_distinct(string_split(other, ' '))) AS same FROM (SELECT p_partkey, p_name, lead(p_name, 1, 'x') OVER (PARTITION BY p_brand ORDER BY p_partkey) AS other FROM part)")
def list_equality(spark, d):
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    p = load(spark, d, "part").withColumn("other", F.lead("p_name", 1, "x").over(w))
    return p.select("p_partkey", rules.same_items(F.split("p_name", " "), F.split("other", " ")).alias("same"))


@query("""SELECT p_brand, p_size, CASE WHEN count(*) = 1 THEN min(p_type) END AS unanimous, min_by(p_type, (-n, p_type)) AS common FROM (SELECT p_brand, p_size, p_type, count(*) AS n FROM part GROUP BY ALL) GROUP BY 1, 2""")
def unanimous_or_common(spark, d):
    return rules.unanimous(load(spark, d, "part"), ["p_brand", "p_size"], "p_type")


@query("SELECT field_key, rows, string_agg(value_text, ',' ORDER BY value_text) AS samples FROM (SELECT field_key, value_text, rows, row_number() OVER (PARTITION BY field_key ORDER BY value_text) AS r FROM (SELECT field_key, value_text, sum(count(*)) OVER (PARTITION BY field_key)::BIGINT AS rows FROM shown WHERE value_text IS NOT NULL GROUP BY 1, 2)) WHERE r <= 3 GROUP BY 1, 2")
def label_inventory(spark, d):
    return rules.inventory(rendered(facts_of(spark, d)).where("value_text is not null"), "field_key", "value_text")


@query("SELECT source, count(*) AS pages, count(*) FILTER (contains(text, chr(10))) AS with_lines, round(count(*) FILTER (contains(text, chr(10))) / count(*)::DOUBLE, 4) AS yield FROM documents GROUP BY 1")
def yield_report(spark, d):
    hit = F.contains("text", F.lit("\n"))
    return load(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("pages"), F.count_if(hit).alias("with_lines"), F.round(F.count_if(hit) / F.count(F.lit(1)), 4).alias("yield"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) FILTER (event_type IN ('error', 'signup')) = 'error' AS paused FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1")
def pause_ledger(spark, d):
    return rules.pauses(load(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"], ["error"], ["signup"])


@query("""SELECT event_type, queued, per_hour, round(queued / per_hour, 2) AS hours_left, per_hour < 20 AS throttled FROM (
  SELECT event_type, count(*) FILTER (event_id % 3 = 0) AS queued, count(*) FILTER (event_id % 3 > 0 AND ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR) / 24.0::DOUBLE AS per_hour FROM events GROUP BY 1) WHERE per_hour > 0""")
def throughput_eta(spark, d):
    e = load(spark, d, "events")
    e = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))
    done = (F.col("event_id") % 3 > 0) & (F.col("ts") > F.col("now") - F.expr("interval 24 hours"))
    out = e.groupBy("event_type").agg(F.count_if(F.col("event_id") % 3 == 0).alias("queued"), (F.count_if(done) / F.lit(24.0)).alias("per_hour")).where("per_hour > 0")
    return out.select("event_type", "queued", "per_hour", F.round(F.col("queued") / F.col("per_hour"), 2).alias("hours_left"), (F.col("per_hour") < 20).alias("throttled"))


@query("SELECT o_orderpriority, month, n, before FROM (SELECT *, lag(n) OVER (PARTITION BY o_orderpriority ORDER BY month) AS before FROM (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1, 2)) WHERE n < before")
def monotonic_counts(spark, d):
    months = load(spark, d, "orders").groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return coverage.never_fewer(months, ["o_orderpriority"], "month", "n")


@query("""SELECT 'the' AS name, count(*) FILTER (regexp_matches(text, '\\bthe\\b')) AS matches, count(*) FILTER (regexp_matches(text, '\\bthe\\b')) >= 3 AS accepted FROM documents
  UNION ALL SELECT 'digits', count(*) FILTER (regexp_matches(text, '[0-9]{4}')), count(*) FILTER (regexp_matches(text, '[0-9]{4}')) >= 3 FROM documents
  UNION ALL SELECT 'never', count(*) FILTER (contains(text, 'qqqqq')), count(*) FILTER (contains(text, 'qqqqq')) >= 3 FROM documents""".replace("\\\\", "\\"))
def pattern_validation(spark, d):
    return pattern_verdicts(load(spark, d, "documents"), [("the", r"\bthe\b"), ("digits", "[0-9]{4}"), ("never", "qqqqq")])


@query("""SELECT doc_id, token FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '([a-z]{3,})')) AS token FROM documents) JOIN (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS token FROM part UNION SELECT 'the' UNION SELECT 'and') USING (token)""")
def token_mentions(spark, d):
    known = load(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("token")).union(spark.createDataFrame([("the",), ("and",)], "token string")).distinct()
    return rules.mentions(load(spark, d, "documents"), "doc_id", "text", known)


@query("""SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'placeholder' WHEN n > 3 THEN 'shared' WHEN page_id % 400 < 300 AND page_id % 2 = 0 THEN 'tiny' ELSE 'keep' END AS decision FROM pages JOIN (SELECT length(html) % 50 AS h, count(*) AS n FROM pages GROUP BY 1) ON h = length(html) % 50""")
def image_decision(spark, d):
    p = load(spark, d, "pages").select("page_id", (F.length("html") % 50).alias("h"))
    p = p.join(p.groupBy("h").agg(F.countDistinct("page_id").alias("n")), "h")
    width = F.when(F.col("page_id") % 2 == 0, F.col("page_id") % 400)
    return p.select("page_id", rules.decision(F.col("n"), F.col("page_id") % 9 == 0, width).alias("decision"))


@query("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NOT NULL AND (a.k IS NULL OR b.at > a.at OR (b.at = a.at AND b.tier < a.tier)) THEN coalesce(b.at, a.at) ELSE coalesce(a.at, b.at) END AS at,
  CASE WHEN b.k IS NOT NULL AND (a.k IS NULL OR b.at > a.at OR (b.at = a.at AND b.tier < a.tier)) THEN coalesce(b.tier, a.tier) ELSE coalesce(a.tier, b.tier) END AS tier,
  CASE WHEN b.k IS NOT NULL AND (a.k IS NULL OR b.at > a.at OR (b.at = a.at AND b.tier < a.tier)) THEN coalesce(b.status, a.status) ELSE coalesce(a.status, b.status) END AS status
  FROM (SELECT o_orderkey AS k, (o_orderkey % 7)::INT AS at, 2 AS tier, CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END AS status FROM orders WHERE o_orderkey % 5 > 0) a
  FULL JOIN (SELECT o_orderkey AS k, (o_orderkey % 6)::INT AS at, (o_orderkey % 4)::INT AS tier, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS status FROM orders WHERE o_orderkey % 2 = 0) b ON a.k = b.k""")
def newer_lifecycle(spark, d):
    o = load(spark, d, "orders")
    k = F.col("o_orderkey")
    a = o.where(k % 5 > 0).select(k.alias("k"), (k % 7).cast("int").alias("at"), F.lit(2).alias("tier"), F.when(k % 4 > 0, F.col("o_orderstatus")).alias("status"))
    b = o.where(k % 2 == 0).select(k.alias("k"), (k % 6).cast("int").alias("at"), (k % 4).cast("int").alias("tier"), F.when(k % 3 > 0, F.col("o_orderpriority")).alias("status"))
    return merge.newer_wins(a, b, "k", "at", "tier", ["status"])


@query("SELECT DISTINCT part_id, source FROM (SELECT l_partkey AS part_id, 'supplier' AS source FROM lineitem UNION SELECT p_partkey, 'catalogue' FROM part UNION SELECT l_partkey, 'returns' FROM lineitem WHERE l_returnflag = 'R')")
def record_sources(spark, d):
    li = load(spark, d, "lineitem")
    by = [li.select(F.col("l_partkey").alias("part_id"), F.lit("supplier").alias("source")), load(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.lit("catalogue").alias("source")), li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("part_id"), F.lit("returns").alias("source"))]
    return by[0].unionByName(by[1]).unionByName(by[2]).distinct()


@query("SELECT part_id, value FROM (SELECT DISTINCT CASE WHEN l_partkey % 10 = 3 THEN l_partkey - 3 ELSE l_partkey END AS part_id, l_suppkey AS value FROM lineitem)")
def reparent_twins(spark, d):
    rows = load(spark, d, "lineitem").select(F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("value")).distinct()
    moves = load(spark, d, "part").where("p_partkey % 10 = 3").select(F.col("p_partkey").alias("from_id"), (F.col("p_partkey") - 3).alias("to_id"))
    return merge.reparent(rows, moves, "part_id", ["value"])
