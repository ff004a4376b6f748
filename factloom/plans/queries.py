"""Queries over the test tables, one or more for each kind of operator, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import numbers, text as rules
from ..operators import coverage, extraction, filters, graph, merge, monitor, paging, reads, sampling
from ..sources.tables import current, doc_id, load, part_facts, rendered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The facts of part_facts for SQL.
FACTS = """
base AS (
  SELECT p_partkey AS part_id, 1 AS position, 'brand' AS field_key, 'e' AS field_type, p_brand AS value_text, NULL::DOUBLE AS value_num, NULL::DOUBLE AS value_min, NULL::DOUBLE AS value_max, NULL::BOOLEAN AS value_bool, p_brand AS value_str, NULL::VARCHAR[] AS value_list FROM part
  UNION ALL SELECT p_partkey, 2, 'type', 'e', p_type, NULL, NULL, NULL, NULL, p_type, NULL FROM part
  UNION ALL SELECT p_partkey, 3, 'size', 'n', p_size::DOUBLE::VARCHAR, p_size, NULL, NULL, NULL, NULL, NULL FROM part
  UNION ALL SELECT p_partkey, 4, 'price', 'n', p_retailprice::VARCHAR, p_retailprice, NULL, NULL, NULL, NULL, NULL FROM part
  UNION ALL SELECT p_partkey, 5, 'title', 's', p_name, NULL, NULL, NULL, NULL, p_name, NULL FROM part
  UNION ALL SELECT p_partkey, 6, 'words', 'ls', '["' || replace(p_name, ' ', '","') || '"]', NULL, NULL, NULL, NULL, NULL, string_split(p_name, ' ') FROM part
  UNION ALL SELECT p_partkey, 7, 'span', 'nr', '{"max":' || (p_size + p_partkey % 10)::DOUBLE::VARCHAR || ',"min":' || p_size::DOUBLE::VARCHAR || '}', NULL, p_size, p_size + p_partkey % 10, NULL, NULL, NULL FROM part
  UNION ALL SELECT p_partkey, 8, 'large', 'b', CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END, NULL, NULL, NULL, p_size > 25, NULL, NULL FROM part),
stated AS (SELECT *, CASE (part_id + 3 * position) % 7 WHEN 0 THEN 'unverified' WHEN 1 THEN 'conflict' WHEN 2 THEN 'corroborated' WHEN 3 THEN 'gap_unattempted' ELSE 'verified' END AS state,
  ((part_id + position) % 5)::INT AS tier, (part_id + position) % 11 <> 0 AS is_current FROM base),
facts AS (SELECT part_id, field_key, field_type, state, tier, is_current,
  CASE WHEN state <> 'gap_unattempted' THEN value_text END AS value_text, CASE WHEN state <> 'gap_unattempted' THEN value_num END AS value_num,
  CASE WHEN state <> 'gap_unattempted' THEN value_min END AS value_min, CASE WHEN state <> 'gap_unattempted' THEN value_max END AS value_max,
  CASE WHEN state <> 'gap_unattempted' THEN value_bool END AS value_bool, CASE WHEN state <> 'gap_unattempted' THEN value_str END AS value_str,
  CASE WHEN state <> 'gap_unattempted' THEN value_list END AS value_list FROM stated),
shown AS (SELECT * FROM facts WHERE is_current AND state IN ('verified', 'corroborated'))
"""
KINDS = {"brand": "e", "type": "e", "size": "n", "price": "n", "title": "s", "words": "ls", "span": "nr", "large": "b", "ports": "struct"}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with the same in SQL if SQL can express it."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = f"WITH {FACTS} {sql}" if ("shown" in sql or "facts" in sql) and not sql.lstrip().startswith("WITH") else sql
        return f

    return add


def facts_of(spark: SparkSession, d: str) -> DataFrame:
    return part_facts(load(spark, d, "part"))


# Facets and statistics

@query("""SELECT field_key, value, parts, rank, distinct_values FROM (SELECT *, row_number() OVER (PARTITION BY field_key ORDER BY parts DESC, value)::INT AS rank, count(*) OVER (PARTITION BY field_key) AS distinct_values
  FROM (SELECT field_key, value, count(DISTINCT part_id) AS parts FROM (SELECT part_id, field_key, value_text AS value FROM shown WHERE field_type IN ('e', 's', 'b') AND value_text IS NOT NULL
  UNION ALL SELECT part_id, field_key, unnest(value_list) FROM shown WHERE field_type = 'ls') GROUP BY ALL)) WHERE rank <= 50""")
def facet_values(spark, d):
    return reads.facet_values(rendered(facts_of(spark, d))).select("field_key", "value", "parts", "rank", "distinct_values")


@query("SELECT field_key, count(DISTINCT part_id) AS parts, min(coalesce(value_num, value_min)) AS low, max(coalesce(value_num, value_max)) AS high FROM shown WHERE field_type IN ('n', 'nr') GROUP BY field_key")
def facet_ranges(spark, d):
    return reads.facet_ranges(rendered(facts_of(spark, d)))


# Filters

def filter_query(key: str, text: str, *conditions: str):
    terms = " ".join(f"AND EXISTS (SELECT 1 FROM shown f WHERE f.part_id = p_partkey AND {c})" for c in conditions)

    def run(spark, d):
        parts = load(spark, d, "part").select(F.col("p_partkey").alias("part_id"), "p_name")
        return filters.filtered(parts, rendered(facts_of(spark, d)), text, KINDS)

    query(f"SELECT p_partkey AS part_id, p_name FROM part WHERE true {terms}", key)(run)


filter_query("filter_ge", "size>=40", "field_key = 'size' AND value_num >= 40")
filter_query("filter_number_not_equal", "size!=10", "field_key = 'size' AND value_num <> 10")
filter_query("filter_range_contains", "span=30", "field_key = 'span' AND value_min <= 30 AND value_max >= 30")
filter_query("filter_range_below", "span<15", "field_key = 'span' AND value_max < 15")
filter_query("filter_bool", "large=true", "field_key = 'large' AND value_bool")
filter_query("filter_enum", "brand=Brand#17", "field_key = 'brand' AND value_str = 'Brand#17'")
filter_query("filter_not_equal", "type!=PROMO", "field_key = 'type' AND value_str <> 'PROMO'")
filter_query("filter_contains", "title~RING", "field_key = 'title' AND contains(lower(value_str), 'ring')")
filter_query("filter_list_member", "words=red", "field_key = 'words' AND list_contains(value_list, 'red')")
filter_query("filter_list_contains", "words~idg", "field_key = 'words' AND len(list_filter(value_list, lambda x: contains(lower(x), 'idg'))) > 0")
filter_query("filter_all_terms", "size>10,size<=30,words=red,large=false", "field_key = 'size' AND value_num > 10", "field_key = 'size' AND value_num <= 30", "field_key = 'words' AND list_contains(value_list, 'red')", "field_key = 'large' AND NOT value_bool")


@query("SELECT part_id, field_key, state FROM facts WHERE is_current AND state IN ('conflict', 'unverified')")
def filter_states(spark, d):
    known = ("verified", "corroborated", "unverified", "conflict", "gap_unattempted")
    return current(facts_of(spark, d)).where(filters.one_of("state", "conflict,unverified", known, known[:2])).select("part_id", "field_key", "state")


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'small') OR contains(lower(p_brand), 'brand#1')")
def filter_prefix_or_substring(spark, d):
    p = load(spark, d, "part")
    return p.where(F.col("p_name").startswith("small") | F.contains(F.lower("p_brand"), F.lit("brand#1"))).select("p_partkey", "p_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1998-01-01')")
def anti_not_checked(spark, d):
    recent = load(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, d, "customer").select("c_custkey").join(recent, "c_custkey", "left_anti")


# Paging

@query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice, o_orderkey) > (100000.0, 50) ORDER BY o_totalprice, o_orderkey LIMIT 26")
def keyset_page(spark, d):
    return paging.page(load(spark, d, "orders"), [("o_totalprice", False), ("o_orderkey", False)], 25, [100000.0, 50]).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE (c_acctbal, c_custkey) < (5000.0, 10) ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 21")
def keyset_desc(spark, d):
    return paging.page(load(spark, d, "customer"), [("c_acctbal", True), ("c_custkey", True)], 20, [5000.0, 10]).select("c_custkey", "c_acctbal")


@query("SELECT c_mktsegment, c_nationkey, c_custkey FROM customer WHERE c_nationkey < 20 OR (c_nationkey = 20 AND (c_mktsegment > 'BUILDING' OR (c_mktsegment = 'BUILDING' AND c_custkey > 5))) ORDER BY c_nationkey DESC, c_mktsegment, c_custkey LIMIT 31")
def keyset_mixed(spark, d):
    keys = [("c_nationkey", True), ("c_mktsegment", False), ("c_custkey", False)]
    return paging.page(load(spark, d, "customer"), keys, 30, [20, "BUILDING", 5]).select("c_mktsegment", "c_nationkey", "c_custkey")


@query("SELECT p_partkey, sort_value FROM (SELECT p_partkey, coalesce(-(CASE WHEN p_size % 3 <> 0 THEN p_size END)::DOUBLE, 1e30) AS sort_value FROM part) ORDER BY sort_value, p_partkey LIMIT 41")
def keyset_missing_last(spark, d):
    value = F.when(F.col("p_size") % 3 != 0, F.col("p_size").cast("double"))
    p = load(spark, d, "part").select("p_partkey", paging.missing_last(value, True).alias("sort_value"))
    return paging.page(p, [("sort_value", False), ("p_partkey", False)], 40)


# Projections

@query("""SELECT p_partkey, p_brand, coalesce(n, 0)::BIGINT AS fact_count, coalesce(l, 0)::BIGINT AS line_count, CASE WHEN l IS NULL THEN 'unknown' ELSE 'sold' END AS status
  FROM part LEFT JOIN (SELECT part_id, count(*) AS n FROM shown GROUP BY 1) ON part_id = p_partkey LEFT JOIN (SELECT l_partkey, count(*) AS l FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
def part_summary(spark, d):
    f = rendered(facts_of(spark, d)).groupBy(F.col("part_id").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    li = load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("l"))
    out = load(spark, d, "part").select("p_partkey", "p_brand").join(f, "p_partkey", "left").join(li, "p_partkey", "left")
    return out.select("p_partkey", "p_brand", F.coalesce("n", F.lit(0)).alias("fact_count"), F.coalesce("l", F.lit(0)).alias("line_count"), F.when(F.col("l").isNull(), "unknown").otherwise("sold").alias("status"))


@query("SELECT o_orderkey, count(*) AS n_lines, string_agg(l_linenumber::VARCHAR || ':' || l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def nested_record(spark, d):
    li = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("lines"))
    out = load(spark, d, "orders").select("o_orderkey").join(li, "o_orderkey")
    return out.select("o_orderkey", F.size("lines").cast("long").alias("n_lines"), F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",").alias("lines"))


@query("""SELECT p_partkey AS part_id, k.pos AS place, k.key AS field_key, s.value_text AS cell FROM part CROSS JOIN (VALUES (0, 'size'), (1, 'brand'), (2, 'span')) AS k(pos, key)
  LEFT JOIN shown s ON s.part_id = p_partkey AND s.field_key = k.key""")
def declared_columns(spark, d):
    keys = F.broadcast(spark.createDataFrame([(0, "size"), (1, "brand"), (2, "span")], "place int, field_key string"))
    parts = load(spark, d, "part").select(F.col("p_partkey").alias("part_id"))
    cells = rendered(facts_of(spark, d)).select("part_id", "field_key", F.col("value_text").alias("cell"))
    return parts.crossJoin(keys).join(cells, ["part_id", "field_key"], "left").select("part_id", "place", "field_key", "cell")


@query("SELECT doc_id, source, url_hash FROM (SELECT doc_id, source, substr(sha1(source || '/' || doc_id::VARCHAR), 1, 16) AS url_hash FROM documents)")
def document_identity(spark, d):
    return load(spark, d, "documents").select("doc_id", "source", doc_id(F.concat_ws("/", "source", F.col("doc_id").cast("string"))).alias("url_hash"))


# Families, comparison, similarity, search

@query("""SELECT c_nationkey, sum(n)::BIGINT AS members, min_by(c_mktsegment, (-n, c_mktsegment)) AS dominant, max(n)::BIGINT AS dominant_n, sum(debt)::BIGINT AS in_debt
  FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS debt FROM customer GROUP BY ALL) GROUP BY c_nationkey""")
def family_rollup(spark, d):
    return reads.families(load(spark, d, "customer"), ["c_nationkey"], "c_mktsegment", {"in_debt": F.col("c_acctbal") < 0})


@query("""SELECT family, field_key, value_text, n, having_any AS having FROM (
  SELECT *, row_number() OVER (PARTITION BY family, field_key ORDER BY n DESC, value_text) AS r FROM (SELECT p_type AS family, field_key, value_text, count(DISTINCT part_id) AS n
  FROM shown JOIN part ON part_id = p_partkey WHERE value_text IS NOT NULL GROUP BY ALL)) JOIN (SELECT p_type AS family, count(DISTINCT part_id) AS having_any FROM shown JOIN part ON part_id = p_partkey WHERE value_text IS NOT NULL GROUP BY 1) USING (family)
  WHERE r = 1 AND n * 100 >= having_any * 35""")
def shared_facts(spark, d):
    members = load(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_type").alias("family"))
    return reads.shared_facts(members, rendered(facts_of(spark, d)), "family", 35)


@query("""SELECT k.field_key, r.place, r.part_id, CASE WHEN f.state IN ('verified', 'corroborated') THEN f.value_text END AS value, f.state, (vals > 1 OR n < 4) AS differs
  FROM (SELECT field_key, count(*) AS n, count(DISTINCT value_text) AS vals FROM shown WHERE part_id IN (3, 14, 15, 92) AND value_text IS NOT NULL GROUP BY 1) k
  CROSS JOIN (VALUES (0, 3), (1, 14), (2, 15), (3, 92)) AS r(place, part_id) LEFT JOIN (SELECT * FROM facts WHERE is_current) f ON f.field_key = k.field_key AND f.part_id = r.part_id""")
def compare_parts(spark, d):
    return reads.compare(current(facts_of(spark, d)), [3, 14, 15, 92])


@query("""SELECT s.part_id, count(*) FILTER (s.value_text = o.value_text) AS shared, count(*) FILTER (s.value_text IS DISTINCT FROM o.value_text) AS different
  FROM shown s JOIN part p ON p.p_partkey = s.part_id JOIN shown o ON o.part_id = 5 AND o.field_key = s.field_key AND o.value_text IS NOT NULL
  WHERE s.part_id <> 5 AND p.p_type = (SELECT p_type FROM part WHERE p_partkey = 5) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def similar_parts(spark, d):
    members = load(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_type").alias("family"))
    return reads.similar(members, rendered(facts_of(spark, d)), 5)


TRIGRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len('  ' || w || ' ') - 1), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"""SELECT p_partkey, p_name, score FROM (SELECT p_partkey, p_name, round(CASE WHEN lower(p_name) = 'small rings' THEN 1.0 ELSE raw END, 3) AS score, raw FROM (
  SELECT p_partkey, p_name, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE AS raw
  FROM (SELECT p_partkey, p_name, {TRIGRAMS.format('p_name')} AS a, {TRIGRAMS.format("'small rings'")} AS b FROM part))) WHERE contains(lower(p_name), 'small rings') OR raw >= 0.3""")
def search_similarity(spark, d):
    return reads.search(load(spark, d, "part").select("p_partkey", "p_name"), "p_name", "small rings").select("p_partkey", "p_name", "score")


@query("""SELECT m.method, s.slug FROM (SELECT DISTINCT event_type || '_' || c AS method FROM events CROSS JOIN (VALUES ('page'), ('html:view'), ('api')) t(c)) m
  JOIN (VALUES ('view'), ('click'), ('api')) s(slug) ON contains(':' || replace(m.method, '_', ':') || ':', ':' || s.slug || ':')""")
def source_attribution(spark, d):
    ends = F.explode(F.array(F.lit("page"), F.lit("html:view"), F.lit("api")))
    methods = load(spark, d, "events").select("event_type").distinct().withColumn("c", ends).select(F.concat_ws("_", "event_type", "c").alias("method"))
    return reads.segment_join(methods, F.broadcast(spark.createDataFrame([("view",), ("click",), ("api",)], "slug string")))


@query("""SELECT c_mktsegment, count(*) AS customers, count(DISTINCT o_custkey) AS with_orders, coalesce(sum(n), 0)::BIGINT AS orders, round(coalesce(sum(total), 0), 2) AS total
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1""")
def stats_by_group(spark, d):
    o = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    c = load(spark, d, "customer").select("c_custkey", "c_mktsegment").join(o, "c_custkey", "left")
    return c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"), F.count("n").alias("with_orders"), F.coalesce(F.sum("n"), F.lit(0)).alias("orders"), F.round(F.coalesce(F.sum("total"), F.lit(0.0)), 2).alias("total"))


@query("SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def stats_grouping_sets(spark, d):
    load(spark, d, "lineitem").createOrReplaceTempView("stats_lineitem")
    return spark.sql("SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) AS n, sum(l_quantity) AS quantity FROM stats_lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")


@query("SELECT n_name, r_name, coalesce(s, 0)::BIGINT AS suppliers, coalesce(c, 0)::BIGINT AS customers FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
def vendor_counts(spark, d):
    s = load(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("s"))
    c = load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("c"))
    n = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.join(s, "n_nationkey", "left").join(c, "n_nationkey", "left").select("n_name", "r_name", F.coalesce("s", F.lit(0)).alias("suppliers"), F.coalesce("c", F.lit(0)).alias("customers"))


# Life cycle, changes, graph

@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate <= TIMESTAMP '1997-06-30' ORDER BY o_orderdate, o_orderkey LIMIT 51")
def lifecycle_window(spark, d):
    o = load(spark, d, "orders").where(F.col("o_orderdate").between(F.lit(filters.day("1997-03-01")).cast("timestamp_ntz"), F.lit(filters.day("1997-06-30")).cast("timestamp_ntz")))
    return paging.page(o, [("o_orderdate", False), ("o_orderkey", False)], 50).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderstatus")


@query("SELECT event_id, user_id, event_type FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-20', 0) ORDER BY ts, event_id LIMIT 101")
def change_feed(spark, d):
    return paging.page(load(spark, d, "events"), [("ts", False), ("event_id", False)], 100, ["2024-01-20 00:00:00", 0]).select("event_id", "user_id", "event_type")


@query("""WITH RECURSIVE seq AS (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders), e AS (SELECT * FROM seq WHERE dst IS NOT NULL),
  w AS (SELECT o_orderkey AS start, o_orderkey AS node, 0 AS hops FROM orders UNION ALL SELECT w.start, e.dst, w.hops + 1 FROM w JOIN e ON e.src = w.node WHERE w.hops < 6)
  SELECT start, node, hops FROM w WHERE hops > 0""")
def successor_chain(spark, d):
    o = load(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    edges = o.select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(w).alias("dst")).where("dst is not null")
    return graph.walk(edges, o.select(F.col("o_orderkey").alias("start")))


@query("SELECT src, dst, min(priority)::INT AS priority FROM (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, 0 AS priority FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT DISTINCT l_partkey, l_suppkey, 1 FROM lineitem WHERE l_linestatus = 'O') GROUP BY 1, 2")
def edges_by_priority(spark, d):
    li = load(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_returnflag", "l_linestatus")
    return graph.edges_by_priority(li.where("l_returnflag = 'R'"), li.where("l_linestatus = 'O'"))


# Coverage

PROFILE = {"brand": None, "size": None, "title": None, "span": {"any": [{"key": "type", "in": ["PROMO", "LARGE"]}, {"key": "size", "gte": 30}]}, "price": {"key": "type", "ne": "SMALL"}}
COVERAGE = """
own AS (SELECT p_partkey AS part_id, field_key, value_text, value_num FROM part LEFT JOIN shown ON part_id = p_partkey),
has AS (SELECT part_id, coalesce(bool_or(field_key = 'brand' AND value_text IS NOT NULL), false) AS b, coalesce(bool_or(field_key = 'size' AND value_text IS NOT NULL), false) AS s, coalesce(bool_or(field_key = 'title' AND value_text IS NOT NULL), false) AS t,
  coalesce(bool_or(field_key = 'span' AND value_text IS NOT NULL), false) AS r, coalesce(bool_or(field_key = 'price' AND value_text IS NOT NULL), false) AS p,
  coalesce(bool_or(field_key = 'type' AND value_text IN ('PROMO', 'LARGE')), false) OR coalesce(bool_or(field_key = 'size' AND value_num >= 30), false) AS rn, coalesce(bool_or(field_key = 'type' AND value_text <> 'SMALL'), false) AS pn FROM own GROUP BY part_id),
cov AS (SELECT part_id, (3 + rn::INT + pn::INT)::BIGINT AS required, (b::INT + s::INT + t::INT + (rn AND r)::INT + (pn AND p)::INT)::BIGINT AS present,
  list_sort(list_filter(['brand', 'size', 'title', 'span', 'price'], lambda k: CASE k WHEN 'brand' THEN NOT b WHEN 'size' THEN NOT s WHEN 'title' THEN NOT t WHEN 'span' THEN rn AND NOT r ELSE pn AND NOT p END)) AS missing FROM has)
"""


def scored(spark, d) -> DataFrame:
    parts = load(spark, d, "part").select(F.col("p_partkey").alias("part_id"))
    return coverage.completeness(parts, rendered(facts_of(spark, d)), PROFILE)


def completeness(spark, d):
    return scored(spark, d).select("part_id", "required", "present", F.array_join("missing", ",").alias("missing"), "percent")


def gap_ledger(spark, d):
    checks = load(spark, d, "lineitem").select(F.col("l_partkey").alias("part_id"), (F.col("l_suppkey") % 4).cast("int").alias("source")).distinct()
    able = F.broadcast(spark.createDataFrame([(0, "brand"), (1, "brand"), (1, "size"), (2, "title"), (3, "span"), (2, "span"), (0, "span")], "source int, field_key string"))
    return coverage.gap_ledger(scored(spark, d), facts_of(spark, d), checks, able)


QUERIES |= {"completeness": completeness, "gap_ledger": gap_ledger}
ORACLE_SQL["completeness"] = f"WITH {FACTS}, {COVERAGE} SELECT part_id, required, present, array_to_string(missing, ',') AS missing, round((present::DECIMAL(18,4) * 100 / required)::DOUBLE, 1) AS percent FROM cov"
ORACLE_SQL["gap_ledger"] = f"""WITH {FACTS}, {COVERAGE}, gaps AS (SELECT part_id, unnest(missing) AS field_key FROM cov),
able AS (SELECT * FROM (VALUES (0, 'brand'), (1, 'brand'), (1, 'size'), (2, 'title'), (3, 'span'), (2, 'span'), (0, 'span')) t(source, field_key)),
checks AS (SELECT DISTINCT l_partkey AS part_id, l_suppkey % 4 AS source FROM lineitem)
SELECT g.part_id, g.field_key, count(DISTINCT a.source) AS capable, count(DISTINCT c.source) AS checked,
  coalesce(min(f.state), CASE WHEN count(DISTINCT a.source) = 0 THEN 'no_source' ELSE 'gap_unattempted' END) AS state
FROM gaps g LEFT JOIN able a ON a.field_key = g.field_key LEFT JOIN checks c ON c.part_id = g.part_id AND c.source = a.source
LEFT JOIN (SELECT part_id, field_key, state FROM facts WHERE is_current) f ON f.part_id = g.part_id AND f.field_key = g.field_key GROUP BY ALL"""


@query("""SELECT field_key, parts, round(parts / n::DOUBLE, 4) AS share, CASE WHEN n < 30 THEN 'too_few_parts' WHEN round(parts / n::DOUBLE, 4) < 0.6 THEN 'share_too_low' ELSE 'promote' END AS reason
  FROM (SELECT field_key, count(DISTINCT part_id) AS parts FROM shown WHERE value_text IS NOT NULL GROUP BY 1) CROSS JOIN (SELECT count(DISTINCT part_id) AS n FROM shown WHERE value_text IS NOT NULL)""")
def required_promotion(spark, d):
    return coverage.promotion(rendered(facts_of(spark, d)))


INVARIANTS_SQL = {
    "rendered_has_document": "SELECT part_id AS k FROM facts WHERE state IN ('verified', 'corroborated') AND tier >= 1 AND part_id % 29 = 0",
    "field_is_declared": "SELECT part_id FROM facts WHERE field_key NOT IN ('brand', 'type', 'size', 'price', 'title', 'words', 'large')",
    "one_current_row": "SELECT part_id FROM (SELECT part_id, CASE WHEN part_id % 41 = 0 AND field_key = 'type' THEN 'brand' ELSE field_key END AS f FROM facts WHERE is_current) GROUP BY part_id, f HAVING count(*) > 1",
    "category_has_profile": "SELECT p_partkey FROM part WHERE p_type NOT IN ('PROMO', 'LARGE', 'SMALL', 'ECONOMY', 'STANDARD')",
    "conflict_is_open": "SELECT part_id FROM facts WHERE state = 'conflict' AND is_current AND part_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O')",
    "superseded_forward": "SELECT o_orderkey FROM (SELECT o_orderkey, o_orderdate, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n < o_orderdate",
    "counts_do_not_fall": "SELECT day FROM (SELECT kind, day, n, lag(n) OVER (PARTITION BY kind ORDER BY day) AS before FROM (SELECT event_type AS kind, strftime(ts, '%Y%m%d')::BIGINT AS day, count(*) AS n FROM events GROUP BY ALL)) WHERE n < before",
    "no_control_characters": r"SELECT doc_id FROM documents WHERE regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]')",
    "gap_has_no_value": "SELECT part_id FROM facts WHERE state = 'gap_unattempted' AND value_text IS NOT NULL",
}


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS offenders, coalesce(string_agg(k, ',' ORDER BY k) FILTER (r <= 3), '') AS first_three FROM (SELECT k, row_number() OVER (ORDER BY k) AS r FROM (SELECT x.k::VARCHAR AS k FROM ({q}) AS x(k)))" for n, q in INVARIANTS_SQL.items()))
def invariants(spark, d):
    """Each rule as the rows that break it."""
    facts, part, orders, events = facts_of(spark, d), load(spark, d, "part"), load(spark, d, "orders"), load(spark, d, "events")
    open_parts = load(spark, d, "lineitem").where("l_linestatus = 'O'").select(F.col("l_partkey").alias("part_id"))
    misfiled = F.when((F.col("part_id") % 41 == 0) & (F.col("field_key") == "type"), "brand").otherwise(F.col("field_key"))
    following = F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    daily = events.groupBy("event_type", F.date_format("ts", "yyyyMMdd").cast("long").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    before = F.lag("n").over(Window.partitionBy("event_type").orderBy("day"))
    broken = {
        "rendered_has_document": rendered_or_not(facts).where("seen and tier >= 1 and part_id % 29 = 0").select("part_id"),
        "field_is_declared": facts.where(~F.col("field_key").isin("brand", "type", "size", "price", "title", "words", "large")).select("part_id"),
        "one_current_row": current(facts).groupBy("part_id", misfiled.alias("f")).count().where("count > 1").select("part_id"),
        "category_has_profile": part.where(~F.col("p_type").isin("PROMO", "LARGE", "SMALL", "ECONOMY", "STANDARD")).select("p_partkey"),
        "conflict_is_open": current(facts).where("state = 'conflict'").join(open_parts, "part_id", "left_anti").select("part_id"),
        "superseded_forward": orders.withColumn("n", following).where("n < o_orderdate").select("o_orderkey"),
        "counts_do_not_fall": daily.withColumn("before", before).where("n < before").select("day"),
        "no_control_characters": load(spark, d, "documents").where(F.col("text").rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")).select("doc_id"),
        "gap_has_no_value": facts.where("state = 'gap_unattempted' and value_text is not null").select("part_id"),
    }
    return coverage.invariants({n: rows.toDF("k") for n, rows in broken.items()}, "k")


def rendered_or_not(facts: DataFrame) -> DataFrame:
    return facts.withColumn("seen", F.col("state").isin("verified", "corroborated"))


@query("""SELECT count(want) AS expected, count(*) FILTER (want IS NOT NULL AND got IS NOT NULL) AS compared, count(*) FILTER (want = got) AS "right",
  round(count(*) FILTER (want = got) / nullif(count(*) FILTER (want IS NOT NULL AND got IS NOT NULL), 0)::DOUBLE, 4) AS precision, round(count(*) FILTER (want = got) / nullif(count(want), 0)::DOUBLE, 4) AS recall
  FROM (SELECT part_id, value_text AS got FROM shown WHERE field_key = 'brand') FULL JOIN (SELECT p_partkey AS part_id, CASE WHEN p_partkey % 50 = 0 THEN 'x' ELSE p_brand END AS want FROM part WHERE p_size < 30) USING (part_id)""")
def extract_gate(spark, d):
    golden = load(spark, d, "part").where("p_size < 30").select(F.col("p_partkey").alias("part_id"), F.when(F.col("p_partkey") % 50 == 0, "x").otherwise(F.col("p_brand")).alias("value_text"))
    return coverage.gate(golden, rendered(facts_of(spark, d)).where("field_key = 'brand'"), ["part_id"], "value_text")


# Merge and history

@query("""SELECT event_id, user_id, event_type, superseded_by, superseded_by IS NULL AS is_current FROM (
  SELECT *, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS superseded_by FROM events)""")
def supersede_history(spark, d):
    return merge.history(load(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type", "superseded_by", "is_current")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def current_rows(spark, d):
    return merge.latest(load(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("""SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(o.c_mktsegment, n.c_mktsegment) AS c_mktsegment, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal, greatest(o.c_nationkey, n.c_nationkey) AS c_nationkey,
  CASE WHEN o.c_custkey IS NULL THEN 'inserted' WHEN n.c_custkey IS NULL THEN 'untouched' ELSE 'merged' END AS change
  FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS c_mktsegment, c_acctbal, c_nationkey FROM customer WHERE c_custkey % 5 <> 0) o
  FULL JOIN (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal + 1 END AS c_acctbal, c_nationkey + 1 AS c_nationkey FROM customer WHERE c_custkey % 2 = 0) n ON o.c_custkey = n.c_custkey""")
def upsert_fill(spark, d):
    c = load(spark, d, "customer")
    old = c.where("c_custkey % 5 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("c_mktsegment"), "c_acctbal", "c_nationkey")
    new = c.where("c_custkey % 2 = 0").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal") + 1).alias("c_acctbal"), (F.col("c_nationkey") + 1).alias("c_nationkey"))
    return merge.upsert(old, new, ["c_custkey"], {"c_mktsegment": "fill", "c_acctbal": "force", "c_nationkey": "greatest"})


@query("""SELECT user_id, min_by(event_type, (event_id % 5, event_id)) FILTER (value > 10) AS best_type, min_by(value, (event_id % 5, event_id)) AS value, min(event_id % 5)::INT AS tier FROM events GROUP BY user_id""")
def upsert_lower_tier(spark, d):
    e = load(spark, d, "events").select("user_id", F.when(F.col("value") > 10, F.col("event_type")).alias("best_type"), "value", (F.col("event_id") % 5).cast("int").alias("tier"), F.col("event_id").alias("id"))
    return merge.lower_tier_wins(e, ["user_id"], ["best_type", "value"])


@query("""WITH tokens AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN lower(s_name) WHEN 2 THEN s_name || '=' ELSE 'alias-' || s_suppkey::VARCHAR END AS token FROM supplier)
  SELECT token, 'resolved' AS outcome, (s_suppkey % 4 + 1)::INT AS step, s_suppkey AS part_id FROM tokens WHERE s_suppkey % 4 < 3
  UNION ALL SELECT token, CASE WHEN s_suppkey % 8 = 3 THEN 'resolved' ELSE 'unknown' END, CASE WHEN s_suppkey % 8 = 3 THEN 4 END, CASE WHEN s_suppkey % 8 = 3 THEN s_suppkey END FROM tokens WHERE s_suppkey % 4 = 3""")
def entity_resolution(spark, d):
    s = load(spark, d, "supplier")
    key, alias = F.col("s_suppkey"), F.concat(F.lit("alias-"), F.col("s_suppkey").cast("string"))
    token = F.when(key % 4 == 0, F.col("s_name")).when(key % 4 == 1, F.lower("s_name")).when(key % 4 == 2, F.concat("s_name", F.lit("="))).otherwise(alias)
    aliases = s.where("s_suppkey % 8 = 3").select(alias.alias("value"), key.alias("part_id"))
    return merge.resolve(s.select(token.alias("token")), s.select(F.col("s_name").alias("sku"), key.alias("part_id")), aliases)


@query("""SELECT folded, count(*) AS members, min(k) AS keep, count(DISTINCT n) AS spellings FROM (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS n, lower(p_name) AS folded FROM part) GROUP BY 1 HAVING count(DISTINCT n) > 1""")
def case_duplicates(spark, d):
    names = load(spark, d, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("n"))
    return merge.case_groups(names, "n", "k")


NAMES = "SELECT s_suppkey AS k, s_name AS n FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_name || '-HW' FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey + 2000000, left(s_name, length(s_name) - 1) FROM supplier WHERE s_suppkey % 10 = 7"


def variant_names(spark, d):
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("n"))
    suffixed = s.where("k % 3 = 0").select((F.col("k") + 1000000).alias("k"), F.concat("n", F.lit("-HW")).alias("n"))
    return s.unionByName(suffixed).unionByName(s.where("k % 10 = 7").select((F.col("k") + 2000000).alias("k"), F.expr("left(n, length(n) - 1)").alias("n")))


@query(f"WITH x AS ({NAMES}) SELECT a.k AS variant, left(a.n, length(a.n) - 3) AS stem, b.k AS base FROM x a JOIN x b ON a.n LIKE '%-HW' AND left(a.n, length(a.n) - 3) = b.n")
def hw_variants(spark, d):
    return merge.suffix_pairs(variant_names(spark, d), "n", "k", "-HW")


@query(f"WITH x AS ({NAMES}) SELECT a.k AS longer, b.n AS name, b.k AS shorter FROM x a JOIN x b ON left(a.n, length(a.n) - 1) = b.n")
def fabricated_pairs(spark, d):
    return merge.cut_pairs(variant_names(spark, d), "n", "k")


@query("SELECT c_custkey, strftime(greatest(max(o_orderdate), TIMESTAMP '1995-01-01'), '%Y-%m-%d') AS touched_at FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def change_touch(spark, d):
    parents = load(spark, d, "customer").select("c_custkey", F.lit("1995-01-01 00:00:00").cast("timestamp_ntz").alias("touched_at"))
    out = merge.touched(parents, "c_custkey", "touched_at", load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("touched_at")))
    return out.withColumn("touched_at", F.date_format("touched_at", "yyyy-MM-dd"))


@query("SELECT p_partkey, slug FROM (SELECT p_partkey, replace(p_name, ' ', '-') || CASE WHEN r + coalesce(n, 0) > 1 THEN '-' || (r + coalesce(n, 0))::VARCHAR ELSE '' END AS slug FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part WHERE p_partkey % 2 = 1) LEFT JOIN (SELECT p_name, count(*) AS n FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) USING (p_name))")
def unique_slugs(spark, d):
    p = load(spark, d, "part").select("p_partkey", rules.slug(F.col("p_name")).alias("base"))
    taken = p.where("p_partkey % 2 = 0").groupBy("base").agg(F.count(F.lit(1)).alias("n"))
    return merge.unique_slugs(p.where("p_partkey % 2 = 1"), taken, "base", "p_partkey").select("p_partkey", "slug")


# Values out of text

@query("SELECT p_partkey, p_retailprice * 1000 AS en_value, p_retailprice * 1000 AS de_value, p_size::DOUBLE AS minus FROM part")
def normalize_numbers(spark, d):
    amount = F.round(F.col("p_retailprice") * 1000, 0)
    en = F.format_number(amount, 2)
    de = F.translate(en, ",.", ".,")
    p = load(spark, d, "part")
    return p.select("p_partkey", numbers.parse_number(en).alias("en_value"), numbers.parse_number(de, "de").alias("de_value"), (-numbers.parse_number(F.concat(F.lit("−"), F.col("p_size")))).alias("minus"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN (p_size * 1000)::DOUBLE END AS mbps, CASE p_partkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' ELSE 'UNIT_UNKNOWN' END AS reason, round(p_size * 25.4, 6) AS mm FROM part")
def convert_units(spark, d):
    p = load(spark, d, "part")
    raw = F.concat(F.lit("up to "), F.col("p_size").cast("string"), F.element_at(F.array(F.lit(" Gbps"), F.lit(" Gbps full duplex"), F.lit(" kg")), (F.col("p_partkey") % 3 + 1).cast("int")))
    c = numbers.convert(raw, "Mbps")
    return p.select("p_partkey", c["value"].alias("mbps"), F.coalesce(c["reason"], F.lit("ok")).alias("reason"), numbers.convert(F.concat(F.col("p_size"), F.lit(" in")), "mm")["value"].alias("mm"))


@query("SELECT p_partkey, p_size::DOUBLE AS low, (p_size + 5)::DOUBLE AS high, p_size * 10.0::DOUBLE AS h, 20.0::DOUBLE AS w, (p_size + 1) * 10.0::DOUBLE AS d, (p_size * 1000)::DOUBLE AS n FROM part")
def ranges_and_dimensions(spark, d):
    p = load(spark, d, "part")
    size = F.col("p_size").cast("string")
    r = numbers.number_range(F.concat(size, F.lit(" to "), (F.col("p_size") + 5).cast("string"), F.lit(" °C")))
    dims = numbers.dimensions(F.concat(size, F.lit(" x 2 x "), (F.col("p_size") + 1).cast("string"), F.lit(" cm")))
    return p.select("p_partkey", r["low"].alias("low"), r["high"].alias("high"), dims["h"].alias("h"), dims["w"].alias("w"), dims["d"].alias("d"), numbers.count_value(F.concat(size, F.lit("k entries"))).alias("n"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'license' WHEN 1 THEN 'service' WHEN 2 THEN 'accessory' WHEN 3 THEN 'bundle' ELSE 'hardware' END AS class,
  CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'has_space' WHEN 2 THEN 'digits_only' WHEN 3 THEN 'no_digit' ELSE 'too_short' END AS reason FROM part""")
def classify_class(spark, d):
    p = load(spark, d, "part")
    turn = (F.col("p_partkey") % 5 + 1).cast("int")

    def pick(*xs):
        return F.element_at(F.array(*xs), turn)

    k = F.col("p_partkey").cast("string")
    sku = pick(F.concat(F.lit("L-"), k), F.concat(F.lit("CON-"), k), F.concat(F.lit("AX-"), k), F.concat(F.lit("AX-"), k, F.lit("-BUN=")), F.concat(F.lit("AX-"), k))
    name = pick(*[F.concat(F.col("p_name"), F.lit(x)) for x in ("", "", " cable", "", "")])
    token = pick(F.concat(F.lit("AX-"), k, F.lit("T")), F.lit("AX 12"), F.concat(F.lit("9999"), k), F.lit("CABLE-RED"), F.lit("A1"))
    return p.select("p_partkey", rules.product_class(sku, name).alias("class"), rules.part_number_reason(token).alias("reason"))


@query("""SELECT doc_id, CASE WHEN text IS NULL THEN 'missing' WHEN trim(text) = '' THEN 'empty' WHEN lower(trim(text)) IN ('n/a', 'na', 'none', 'null', '-', 'tbd', 'unknown') THEN 'void_value' WHEN length(trim(text)) < 6 THEN 'too_short' WHEN length(trim(text)) > 400 THEN 'too_long'
  WHEN len(list_filter(range(1, length(trim(text)) - 4), lambda i: substr(trim(text), i, 6) = repeat(substr(trim(text), i, 1), 6) AND substr(trim(text), i, 1) <> chr(10))) > 0 THEN 'repeated_filler'
  WHEN len(list_filter(regexp_split_to_array(trim(text), '[ \t\n\r]+'), lambda w: regexp_matches(w, '[A-Za-z]{2,}'))) < 2 THEN 'not_prose' END AS reason FROM documents""")
def text_quality(spark, d):
    return load(spark, d, "documents").select("doc_id", rules.description_reason(F.col("text")).alias("reason"))


@query(r"""SELECT page_id, rtrim(lower(regexp_replace(regexp_replace(url, '^[a-zA-Z]+://', ''), '[?#].*$', '')), '/') AS raw_key, TRY_CAST(nullif(regexp_extract(url, '[?&](?:w|width|wid)=([0-9]+)', 1), '') AS INT) AS width FROM pages""")
def image_url_key(spark, d):
    return load(spark, d, "pages").select("page_id", rules.url_key(F.col("url")).alias("raw_key"), rules.size_hint(F.col("url")).alias("width"))


@query("SELECT p_partkey, p_name || ',' || p_brand || ',' || p_type || ',' || p_size::VARCHAR AS items, 4::BIGINT AS n FROM part")
def list_split(spark, d):
    raw = F.concat(F.col("p_name"), F.lit("; "), F.col("p_brand"), F.lit(" and "), F.col("p_type"), F.lit(", "), F.col("p_size").cast("string"))
    items = rules.split_list(raw)
    return load(spark, d, "part").select("p_partkey", items.alias("i")).select("p_partkey", F.array_join("i", ",").alias("items"), F.size("i").cast("long").alias("n"))


@query("SELECT p_partkey, 'RJ45' AS typ, '1G' AS speed, p_size AS n FROM part UNION ALL SELECT p_partkey, 'SFP+', '10G', p_size + 1 FROM part")
def port_parse(spark, d):
    raw = F.concat(F.col("p_size").cast("string"), F.lit(" x 1G RJ45, "), (F.col("p_size") + 1).cast("string"), F.lit(" x 10G SFP+"))
    ports = load(spark, d, "part").select("p_partkey", F.explode(rules.parse_ports(raw)).alias("x"))
    return ports.select("p_partkey", "x.typ", "x.speed", "x.n")


# Extraction

def part_html():
    def row(label: str, value) -> list:
        return [F.lit(f"<tr><td>{label}</td><td>"), value.cast("string"), F.lit("</td></tr>")]

    head = "<html><body><h1>x</h1><table><tr><td colspan='2'>General</td></tr>"
    return F.concat(F.lit(head), *row("Brand", F.col("p_brand")), *row("Size", F.col("p_size")), F.lit("</table><dl><dt>Name</dt><dd>"), F.col("p_name"), F.lit("</dd></dl><a href='/p/"), F.col("p_partkey").cast("string"), F.lit("'>more</a></body></html>"))


@query("""SELECT p_partkey, 'table' AS kind, '1:2' AS locator, 'General > Brand' AS label, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'table', '1:3', 'General > Size', p_size::VARCHAR FROM part
  UNION ALL SELECT p_partkey, 'dl', '', 'Name', p_name FROM part UNION ALL SELECT p_partkey, 'link', '', 'more', '/p/' || p_partkey::VARCHAR FROM part""")
def table_pairs(spark, d):
    pages = load(spark, d, "part").select("p_partkey", part_html().alias("html"))
    return extraction.extracted(pages, "p_partkey", "html", ("table", "dl", "link"))


@query("SELECT p_partkey, 0 AS line, 'Brand' AS label, p_brand AS value FROM part UNION ALL SELECT p_partkey, 2, 'Size', p_size::VARCHAR || ' mm' FROM part")
def colon_pairs(spark, d):
    text = F.concat(F.lit("Brand: "), F.col("p_brand"), F.lit("\nThis is a sentence: it ends.\nSize:  "), F.col("p_size").cast("string"), F.lit(" mm"))
    return extraction.colon_pairs(load(spark, d, "part").select("p_partkey", text.alias("t")), "p_partkey", "t")


@query(r"""SELECT page_id, 'link' AS kind, '' AS locator, label, value FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS value, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS label FROM pages)""")
def page_links(spark, d):
    return extraction.extracted(load(spark, d, "pages"), "page_id", "html", ("link",))


@query("SELECT page_id, length(html) < 40000 AND regexp_matches(html[1:8000], '(?i)just a moment|verify you are human|captcha|access denied') AS challenge FROM pages")
def challenge_pages(spark, d):
    return load(spark, d, "pages").select("page_id", extraction.is_challenge(F.col("html")).alias("challenge"))


# Monitoring

@query("SELECT user_id, strftime(time_bucket(INTERVAL 60 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') / count(*)::DOUBLE, 4) AS error_share, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def window_stats(spark, d):
    return monitor.window_stats(load(spark, d, "events"), "ts", "event_type", "user_id").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("""SELECT event_type, count(*) FILTER (age <= INTERVAL 1 DAY) AS n_recent, quantile_cont(value, 0.5) FILTER (age <= INTERVAL 1 DAY) AS recent_median, quantile_cont(value, 0.5) FILTER (age <= INTERVAL 7 DAY) AS longer_median,
  coalesce(count(*) FILTER (age <= INTERVAL 1 DAY) >= 30 AND quantile_cont(value, 0.5) FILTER (age <= INTERVAL 1 DAY) < 0.5 * quantile_cont(value, 0.5) FILTER (age <= INTERVAL 7 DAY), false) AS drift
  FROM (SELECT *, (SELECT max(ts) FROM events) - ts AS age FROM events) GROUP BY 1""")
def medians_drift(spark, d):
    e = load(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    return monitor.medians(e.crossJoin(F.broadcast(now)), "event_type", "value", "ts", F.col("now"), "1 day", "7 days", 30)


@query("""SELECT user_id, coalesce(min(r) FILTER (event_type = 'view'), max(r) + 1)::BIGINT - 1 AS streak FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) GROUP BY 1""")
def failure_streak(spark, d):
    return monitor.streaks(load(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") != "view")


@query("SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicates_24h(spark, d):
    return monitor.duplicates(load(spark, d, "events"), ["user_id", "event_type"], "ts").withColumn("day", F.col("day").cast("string"))


@query("""WITH RECURSIVE e AS (SELECT event_id, ts, user_id % 5 AS source FROM events WHERE event_type = 'error'),
  w AS (SELECT source, min((ts, event_id)) AS x FROM e GROUP BY 1 UNION ALL SELECT source, y FROM (SELECT w.source, (SELECT min((e.ts, e.event_id)) FROM e WHERE e.source = w.source AND e.ts >= w.x[1] + INTERVAL 60 MINUTE) AS y FROM w) WHERE y IS NOT NULL)
  SELECT source, x[2] AS event_id FROM w""")
def alarm_dedupe(spark, d):
    errors = load(spark, d, "events").where("event_type = 'error'").select((F.col("user_id") % 5).alias("source"), "event_id", "ts")
    return monitor.alarms(errors, ["source"], "ts").select("source", "event_id")


@query("""SELECT user_id, session, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2""")
def gap_sessions(spark, d):
    return monitor.sessions(load(spark, d, "events"), "user_id", "ts").select("user_id", "session", "n")


@query("SELECT event_id, (event_id % 16) AS worker, priority FROM (SELECT event_id, priority, row_number() OVER (PARTITION BY event_id % 16 ORDER BY priority, event_id) AS r FROM (SELECT event_id, (CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END)::INT AS priority FROM events)) WHERE r = 1")
def lease_assignment(spark, d):
    priority = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2).otherwise(3)
    return monitor.leases(load(spark, d, "events"), 16, priority, "event_id")


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'done' WHEN 'signup' THEN 'closed' WHEN 'error' THEN 'paused' ELSE 'pending' END AS status,
  CASE WHEN event_type IN ('click', 'purchase') THEN least(360.0, 5 * pow(2, event_id % 10 - 1)) END AS wait_minutes FROM events""")
def fetch_disposition(spark, d):
    outcome = F.when(F.col("event_type") == "view", "ok").when(F.col("event_type") == "signup", "not_listed").when(F.col("event_type") == "error", "blocked").otherwise("timeout")
    status, wait = monitor.disposition(outcome, F.col("event_id") % 10)
    return load(spark, d, "events").select("event_id", status.alias("status"), wait.alias("wait_minutes"))


# Samples

@query("SELECT doc_id, source, nth FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('s' || doc_id::VARCHAR), doc_id)::INT AS nth FROM documents) WHERE nth <= 5")
def sample_stratified(spark, d):
    return sampling.stratified(load(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 5)


@query("SELECT doc_id FROM documents ORDER BY md5('u' || doc_id::VARCHAR), doc_id LIMIT 50")
def sample_uniform(spark, d):
    return sampling.uniform(load(spark, d, "documents").select("doc_id"), "doc_id", 50)


# Joins and aggregates

@query("SELECT o_orderpriority, count(*) AS n_orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_custkey) AS customers FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def revenue_by_priority(spark, d):
    li = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    j = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(li, "o_orderkey")
    return j.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("r"), 2).alias("revenue"), F.countDistinct("o_custkey").alias("customers"))


@query("""SELECT l_suppkey, usual, bool_and((l_quantity, l_linenumber) > (2, 1)) AS all_above, bool_and(l_quantity > 0) AS all_positive, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, strftime(min(l_shipdate), '%Y-%m-%d') AS first_ship
  FROM lineitem JOIN (SELECT l_suppkey, min_by(l_returnflag, (-n, l_returnflag)) AS usual FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1) USING (l_suppkey) GROUP BY 1, 2""")
def supplier_aggregates(spark, d):
    li = load(spark, d, "lineitem")
    return li.groupBy("l_suppkey").agg(F.mode("l_returnflag", True).alias("usual"), F.bool_and((F.col("l_quantity") > 2) | ((F.col("l_quantity") == 2) & (F.col("l_linenumber") > 1))).alias("all_above"), F.bool_and(F.col("l_quantity") > 0).alias("all_positive"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("flags"), F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("first_ship"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k, (json_extract_string(props, '$.k')::INT > 50) AS high FROM events")
def json_projection(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return load(spark, d, "events").select("event_id", k.alias("k"), (k > 50).alias("high"))
