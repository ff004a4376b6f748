"""Composite reads over the warehouse derived from the test tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import paging, records
from ..operators.chains import chains_of_all
from ..sources.tables import load, rendered
from . import warehouse as w
from .queries import COVERAGE, KINDS, facts_of, query, scored

def sql_of(body: str, *tables: str, more: str = "") -> str:
    """SQL over facts and tables of the warehouse."""
    return f", {', '.join(w.WAREHOUSE[t].strip() for t in tables)}{', ' + more if more else ''} {body}"


PCT = f"{COVERAGE}, pct AS (SELECT part_id, required, present, missing, round((present::DECIMAL(18,4) * 100 / required)::DOUBLE, 1) AS percent FROM cov)"
SUMMARY_SQL = """SELECT p.part_id, vendor, sku, trim(regexp_replace(lower(sku), '[^a-z0-9]+', '-', 'g'), '-') AS slug, category, family, class, name, coalesce(l.status, 'unknown') AS status, coalesce(n, 0)::BIGINT AS fact_count,
  CASE WHEN class = 'hardware' THEN percent END AS percent, EXISTS (SELECT 1 FROM checks c WHERE c.part_id = p.part_id AND c.outcome = 'ok' AND c.times > 4) AS has_image
  FROM parts p LEFT JOIN life l USING (part_id) LEFT JOIN (SELECT part_id, count(*) AS n FROM shown GROUP BY 1) f USING (part_id) LEFT JOIN pct s USING (part_id)"""


def imaged(spark, d):
    return w.checks(spark, d).where("outcome = 'ok' and times > 4").select("part_id")


@query(sql_of(f"{SUMMARY_SQL} WHERE class = 'hardware' AND (contains(lower(sku), 'e') OR contains(lower(name), 'e')) AND EXISTS (SELECT 1 FROM life x WHERE x.part_id = p.part_id) AND EXISTS (SELECT 1 FROM shown x WHERE x.part_id = p.part_id AND x.field_key = 'size' AND x.value_num >= 10) AND (sku, p.part_id) > ('ECONOMY', 0) ORDER BY sku, p.part_id LIMIT 51", "parts", "life", "checks", more=PCT))
def parts_page(spark, d):
    """A page of parts by their columns, by what they have and by facts; summaries of that page only."""
    facts, life = rendered(facts_of(spark, d)), w.life(spark, d)
    some = records.having(w.parts(spark, d), life)
    page = records.filtered_page(some, facts, "size>=10", KINDS, [("sku", False), ("part_id", False)], 50, ["ECONOMY", 0], part_class="hardware", q="e")
    return records.summaries(page, life, facts, scored(spark, d), imaged(spark, d))


@query(sql_of(f"{SUMMARY_SQL} WHERE class <> 'accessory' AND starts_with(sku_norm, 'PROMO-1') AND vendor IN ('Brand#1', 'Brand#17')", "parts", "life", "checks", more=PCT))
def part_conditions(spark, d):
    base = w.parts(spark, d).where(F.col("vendor").isin("Brand#1", "Brand#17"))
    some = records.part_conditions(base, part_class="!accessory", prefix="promo-1")
    return records.summaries(some, w.life(spark, d), rendered(facts_of(spark, d)), scored(spark, d), imaged(spark, d))


@query(w.with_tables("""SELECT vendor, token, min_by(part_id, (sku <> token, part_id)) AS part_id FROM (SELECT p.vendor, CASE WHEN p.part_id % 3 = 0 THEN upper(p.sku) WHEN p.part_id % 3 = 1 THEN lower(p.sku) ELSE p.sku END AS token FROM parts p) a JOIN parts p2 USING (vendor) WHERE p2.sku_norm = upper(token) GROUP BY ALL""", "parts"))
def sku_lookup(spark, d):
    p = w.parts(spark, d)
    turn = F.col("part_id") % 3
    asked = p.select("vendor", F.when(turn == 0, F.upper("sku")).when(turn == 1, F.lower("sku")).otherwise(F.col("sku")).alias("token"))
    return records.resolved_sku(p, asked).select("vendor", "token", "part_id")


@query(sql_of("""SELECT p.part_id, sku, coalesce(f.facts, '') AS facts, coalesce(r.relations, '') AS relations, coalesce(c.sources, '') AS sources, percent, coalesce(i.images, '') AS images FROM parts p
  LEFT JOIN (SELECT part_id, string_agg(field_key || '=' || value_text, '|' ORDER BY field_key, value_text) AS facts FROM shown WHERE value_text IS NOT NULL GROUP BY 1) f USING (part_id)
  LEFT JOIN (SELECT from_id AS part_id, string_agg(kind || ':' || to_id || ':' || tier, '|' ORDER BY kind, to_id, tier) AS relations FROM relations GROUP BY 1) r USING (part_id)
  LEFT JOIN (SELECT part_id, string_agg(source || ':' || outcome, '|' ORDER BY source, outcome) AS sources FROM checks GROUP BY 1) c USING (part_id) LEFT JOIN pct USING (part_id)
  LEFT JOIN (SELECT part_id, string_agg('https://x.example/img/' || source, '|' ORDER BY outcome = 'ok' DESC, times DESC, source) AS images FROM checks GROUP BY 1) i USING (part_id)""", "parts", "relations", "checks", more=PCT))
def part_records(spark, d):
    """Whole records: each child table is grouped once and joined."""
    facts = rendered(facts_of(spark, d)).where("value_text is not null")
    checks = w.checks(spark, d)
    images = checks.select("part_id", F.when(F.col("outcome") == "ok", 0).otherwise(1).alias("place"), (-F.col("times")).alias("size"), F.concat(F.lit("/"), "source", F.lit("/")).alias("path"))
    out = records.records(w.parts(spark, d).select("part_id", "sku"), facts=(facts, ["field_key", "value_text"]), relations=(w.relations(spark, d).withColumnRenamed("from_id", "part_id"), ["kind", "to_id", "tier"]), sources=(checks, ["source", "outcome"]), images=(images, ["place", "size", "path"]))
    out = out.join(scored(spark, d).select("part_id", "percent"), "part_id", "left")
    texts = {"facts": lambda x: F.concat_ws("=", x["field_key"], x["value_text"]), "relations": lambda x: F.concat_ws(":", x["kind"], x["to_id"], x["tier"]), "sources": lambda x: F.concat_ws(":", x["source"], x["outcome"]), "images": lambda x: records.image_url("https://x.example/", x["path"])}
    return out.select("part_id", "sku", "percent", *[F.array_join(F.transform(c, f), "|").alias(c) for c, f in texts.items()])


ACCEPTED = "accepted AS (SELECT part_id, field_key, min_by(value, (tier, doc_id, value)) AS value, min(tier) AS tier FROM evidence GROUP BY ALL)"


def accepted(spark, d):
    return w.evidence(spark, d).groupBy("part_id", "field_key").agg(F.min(F.struct("tier", "doc_id", "value")).alias("b")).select("part_id", "field_key", "b.value", "b.tier")


@query(w.with_tables(f", {ACCEPTED} SELECT a.part_id, a.value, count(*) AS n, string_agg(e.tier || ':' || e.doc_id || ':' || e.value::INT, ',' ORDER BY e.tier, e.doc_id, e.value) AS evidence FROM accepted a JOIN evidence e USING (part_id, field_key) GROUP BY 1, 2", "evidence"))
def fact_evidence(spark, d):
    out = records.with_evidence(accepted(spark, d), w.evidence(spark, d))
    shown = F.transform("evidence", lambda e: F.concat_ws(":", e["tier"], e["doc_id"], e["value"].cast("int")))
    return out.select("part_id", "value", F.size("evidence").cast("long").alias("n"), F.array_join(shown, ",").alias("evidence"))


@query(w.with_tables(f", {ACCEPTED} SELECT e.part_id, e.doc_id, e.value AS rejected, a.value AS kept, CASE WHEN a.tier = 0 THEN 'tier0_protected' WHEN a.tier = e.tier THEN 'same_tier' ELSE 'cross_tier:' || a.tier || 'v' || e.tier END AS reason FROM evidence e JOIN accepted a USING (part_id, field_key) WHERE e.value <> a.value", "evidence"))
def open_conflicts(spark, d):
    return records.open_conflicts(w.evidence(spark, d), accepted(spark, d)).select("part_id", "doc_id", F.col("value").alias("rejected"), "kept", "reason")


@query("""SELECT event_id, user_id, event_type, value, replaced_by, new_value, nth FROM (SELECT *, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS replaced_by, lead(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS new_value,
  (row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) - 1)::INT AS nth FROM events) WHERE replaced_by IS NOT NULL""")
def fact_history(spark, d):
    return records.superseded(load(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value").select("event_id", "user_id", "event_type", "value", "replaced_by", "new_value", "nth")


EDGES = """holders AS (SELECT vendor, sku_norm, min(part_id) AS id FROM parts GROUP BY ALL),
edges AS (SELECT src, dst, min((via, coalesce(dst_id, -1)))[1] AS via, nullif(min((via, coalesce(dst_id, -1)))[2], -1) AS dst_id FROM (
  SELECT r.from_id AS src, p.sku_norm AS dst, p.part_id AS dst_id, 1 AS via FROM relations r JOIN parts p ON p.part_id = r.to_id WHERE kind = 'successor'
  UNION ALL SELECT r.to_id, p.sku_norm, p.part_id, 1 FROM relations r JOIN parts p ON p.part_id = r.from_id WHERE kind = 'predecessor'
  UNION ALL SELECT l.part_id, upper(l.successor_sku), h.id, 2 FROM life l JOIN parts p ON p.part_id = l.part_id LEFT JOIN holders h ON h.vendor = p.vendor AND h.sku_norm = upper(l.successor_sku) WHERE l.successor_sku IS NOT NULL) GROUP BY ALL)"""


#: Parts whose chains are asked for.
REQUESTED = (3, 14, 15, 92, 107, 150)


def chain_sql(edges: str, asked: str = " WHERE part_id IN (3, 14, 15, 92, 107, 150)") -> str:
    hops = [f"h0 AS (SELECT part_id AS start, sku_norm AS dst, part_id AS dst_id, 0 AS hops, 0 AS via FROM parts{asked}), s0 AS (SELECT * FROM h0)"]
    for i in range(1, 7):
        hops.append(f"h{i} AS (SELECT start, dst, nullif(min((via, coalesce(dst_id, -1)))[2], -1) AS dst_id, {i} AS hops, min((via, coalesce(dst_id, -1)))[1] AS via FROM (SELECT h.start, e.dst, e.dst_id, e.via FROM h{i - 1} h JOIN {edges} e ON e.src = h.dst_id) x WHERE (start, dst) NOT IN (SELECT start, dst FROM s{i - 1}) GROUP BY start, dst), s{i} AS (SELECT * FROM s{i - 1} UNION ALL SELECT * FROM h{i})")
    return ", ".join(hops)


@query(w.with_tables(f", {EDGES}, {chain_sql('edges', '')} SELECT start, dst, hops, via FROM s6 WHERE hops > 0", "parts", "life", "relations"))
def successors_of_parts(spark, d):
    """Successors, up to six hops, of every part."""
    p = w.parts(spark, d)
    edges = records.chain_edges(p, w.relations(spark, d), w.life(spark, d))
    return chains_of_all(edges, p)


BACK = "back AS (SELECT e.dst_id AS src, p.sku_norm AS dst, p.part_id AS dst_id, e.via FROM edges e JOIN parts p ON p.part_id = e.src WHERE e.dst_id IS NOT NULL)"


@query(w.with_tables(f", {EDGES}, {BACK}, {chain_sql('back')} SELECT start, dst, hops, via FROM s6 WHERE hops > 0", "parts", "life", "relations"))
def predecessors_of_parts(spark, d):
    p = w.parts(spark, d)
    edges = records.chain_edges(p, w.relations(spark, d), w.life(spark, d)).where("dst_id is not null")
    back = edges.join(p.select(F.col("part_id").alias("src"), "sku_norm"), "src").select(F.col("dst_id").alias("src"), F.col("sku_norm").alias("dst"), F.col("src").alias("dst_id"), "via")
    return records.chains(p.where(F.col("part_id").isin(*REQUESTED)).select(F.col("part_id").alias("start"), "part_id"), back, p)


@query(sql_of("""SELECT part_id, CASE WHEN class <> 'hardware' THEN 'not_hardware' WHEN required IS NULL THEN 'never_scored' ELSE 'scored' END AS head, CASE WHEN class = 'hardware' AND required IS NOT NULL THEN present ELSE 0 END AS present, CASE WHEN class = 'hardware' AND required IS NOT NULL THEN array_to_string(missing, ',') ELSE '' END AS missing
  FROM parts LEFT JOIN (SELECT * FROM pct WHERE part_id % 13 <> 0) USING (part_id)""", "parts", more=PCT))
def part_gaps(spark, d):
    out = records.part_gaps(w.parts(spark, d), scored(spark, d).where("part_id % 13 <> 0"))
    return out.withColumn("missing", F.array_join("missing", ","))


@query(w.with_tables("""SELECT part_id, vendor, sku, status, strftime(announced, '%Y-%m-%d') AS announced, strftime(end_of_sale, '%Y-%m-%d') AS end_of_sale, strftime(last_ship, '%Y-%m-%d') AS last_ship, strftime(end_of_support, '%Y-%m-%d') AS end_of_support, successor_sku, coalesce(strftime(CASE WHEN part_id % 7 <> 0 THEN end_of_sale END, '%Y-%m-%d'), '9999-12-31') AS sort_day
  FROM parts JOIN life USING (part_id) WHERE (end_of_sale >= DATE '2000-01-01' AND end_of_support <= DATE '2007-12-31') AND (sort_day, part_id) > ('2000-06-01', 0) ORDER BY sort_day, part_id LIMIT 61""", "parts", "life"))
def lifecycle_page(spark, d):
    """Parts with a life cycle by date of end of sale, undated ones last."""
    dates = ("announced", "end_of_sale", "last_ship", "end_of_support")
    dated = w.parts(spark, d).join(w.life(spark, d), "part_id").where("end_of_sale >= date '2000-01-01' and end_of_support <= date '2007-12-31'")
    day = F.coalesce(F.date_format(F.when(F.col("part_id") % 7 != 0, F.col("end_of_sale")), "yyyy-MM-dd"), F.lit("9999-12-31"))
    rows = dated.select("part_id", "vendor", "sku", "status", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in dates], "successor_sku", day.alias("sort_day"))
    return paging.page(rows, [("sort_day", False), ("part_id", False)], 60, ["2000-06-01", 0])


@query(sql_of("""SELECT part_id, sku, coalesce(facts, '') AS facts FROM (SELECT * FROM parts WHERE category = 'LARGE' AND part_id > 20 ORDER BY part_id LIMIT 201) LEFT JOIN (SELECT part_id, string_agg(field_key || '=' || value_text, '|' ORDER BY field_key, value_text) AS facts FROM shown WHERE value_text IS NOT NULL GROUP BY 1) USING (part_id)""", "parts"))
def export_page(spark, d):
    """Whole records of one page of at most 200 parts: the page is chosen before anything is joined."""
    page = paging.page(records.part_conditions(w.parts(spark, d), category="LARGE"), [("part_id", False)], 200, [20]).select("part_id", "sku")
    facts = rendered(facts_of(spark, d)).where("value_text is not null").join(page, "part_id", "left_semi")
    out = records.records(page, facts=(facts, ["field_key", "value_text"]))
    return out.select("part_id", "sku", F.array_join(F.transform("facts", lambda x: F.concat_ws("=", x["field_key"], x["value_text"])), "|").alias("facts"))


@query(w.with_tables("SELECT c.category, count(p.part_id) AS parts, count(p.part_id) FILTER (p.class = 'hardware') AS hardware FROM (SELECT DISTINCT p_type AS category FROM part UNION SELECT 'UNUSED') c LEFT JOIN (SELECT * FROM parts WHERE vendor <> 'Brand#17') p USING (category) GROUP BY 1", "parts"))
def category_counts(spark, d):
    """Categories with their parts; those without any are kept."""
    p = w.parts(spark, d)
    known = p.select("category").distinct().unionByName(spark.createDataFrame([("UNUSED",)], "category string"))
    own = p.where("vendor <> 'Brand#17'").groupBy("category").agg(F.count(F.lit(1)).alias("parts"), F.count_if(F.col("class") == "hardware").alias("hardware"))
    return known.join(own, "category", "left").select("category", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("parts", "hardware")])


@query("""SELECT f.field_key, f.field_type, c.category, CASE WHEN f.field_key IN ('brand', 'size', 'title') THEN 'req' WHEN f.field_key = 'span' AND c.category IN ('PROMO', 'LARGE') THEN 'cond' WHEN f.field_key = 'price' AND c.category <> 'SMALL' THEN 'opt' ELSE 'na' END AS kind
  FROM (SELECT DISTINCT field_key, field_type FROM facts) f CROSS JOIN (SELECT DISTINCT p_type AS category FROM part) c""")
def field_listing(spark, d):
    """The dictionary with what each category asks for; not asked for: na."""
    fields = facts_of(spark, d).select("field_key", "field_type").distinct()
    categories = load(spark, d, "part").select(F.col("p_type").alias("category")).distinct()
    asked = categories.select("category", F.explode(F.array(*[F.struct(F.lit(k).alias("field_key"), v.alias("kind")) for k, v in {
        "brand": F.lit("req"), "size": F.lit("req"), "title": F.lit("req"), "span": F.when(F.col("category").isin("PROMO", "LARGE"), "cond"), "price": F.when(F.col("category") != "SMALL", "opt"),
    }.items()])).alias("x")).select("category", "x.*").where("kind is not null")
    return fields.crossJoin(categories).join(asked, ["field_key", "category"], "left").withColumn("kind", F.coalesce("kind", F.lit("na")))


@query("""SELECT doc_id, url_hash, parts, first_parts FROM (SELECT d.doc_id, substr(sha1(source || '/' || d.doc_id), 1, 16) AS url_hash, count(DISTINCT l_partkey) AS parts FROM documents d LEFT JOIN lineitem ON l_orderkey % 500 = d.doc_id GROUP BY ALL)
  LEFT JOIN (SELECT doc_id, string_agg(l_partkey, ',' ORDER BY l_partkey) AS first_parts FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l_partkey) AS r FROM (SELECT DISTINCT l_orderkey % 500 AS doc_id, l_partkey FROM lineitem)) WHERE r <= 10 GROUP BY 1) USING (doc_id)""")
def document_pages(spark, d):
    """Each document with the true number of its parts and the first ten."""
    own = load(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("doc_id"), "l_partkey").distinct()
    counts = own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"))
    first = own.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("l_partkey"))).where("r <= 10")
    first = first.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_partkey")), lambda x: x.cast("string")), ",").alias("first_parts"))
    docs = load(spark, d, "documents").select("doc_id", F.substring(F.sha1(F.concat_ws("/", "source", F.col("doc_id").cast("string"))), 1, 16).alias("url_hash"))
    return docs.join(counts, "doc_id", "left").join(first, "doc_id", "left").withColumn("parts", F.coalesce("parts", F.lit(0)))


@query(w.with_tables("SELECT run_id, kind, status, strftime(started_at, '%Y-%m-%d') AS day FROM runs WHERE status <> 'running' AND (started_at, run_id) < (TIMESTAMP '1998-06-01', 100) ORDER BY started_at DESC, run_id DESC LIMIT 41", "runs"))
def run_history(spark, d):
    rows = paging.page(w.runs(spark, d).where("status <> 'running'"), [("started_at", True), ("run_id", True)], 40, ["1998-06-01 00:00:00", 100])
    return rows.select("run_id", "kind", "status", F.date_format("started_at", "yyyy-MM-dd").alias("day"))


@query(sql_of("SELECT field_key, count(*) AS parts_missing, count(*) FILTER (NOT tried) AS gap_unattempted, count(*) FILTER (tried) AS gap_confirmed FROM (SELECT part_id, unnest(missing) AS field_key, part_id IN (SELECT part_id FROM checks WHERE outcome = 'not_listed') AS tried FROM pct) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100", "checks", more=PCT))
def gap_fields(spark, d):
    tried = w.checks(spark, d).where("outcome = 'not_listed'").select("part_id").distinct().withColumn("tried", F.lit(True))
    gaps = scored(spark, d).select("part_id", F.explode("missing").alias("field_key")).join(tried, "part_id", "left")
    out = gaps.groupBy("field_key").agg(F.count(F.lit(1)).alias("parts_missing"), F.count_if(F.col("tried").isNull()).alias("gap_unattempted"), F.count("tried").alias("gap_confirmed"))
    return out.orderBy(F.desc("parts_missing"), "field_key").limit(100)


@query(sql_of("SELECT category, count(*) FILTER (class = 'hardware') AS hardware_parts, count(*) FILTER (percent = 100) AS parts_complete, round(avg(present::DECIMAL(18,4) * 100 / required)::DOUBLE, 1) AS mean_percent FROM parts LEFT JOIN pct USING (part_id) GROUP BY 1", "parts", more=PCT))
def gap_categories(spark, d):
    p = w.parts(spark, d).join(scored(spark, d), "part_id", "left")
    share = F.col("present").cast("decimal(18,4)") * 100 / F.col("required")
    return p.groupBy("category").agg(F.count_if(F.col("class") == "hardware").alias("hardware_parts"), F.count_if(F.col("percent") == 100).alias("parts_complete"), F.round(F.avg(share.cast("double")), 1).alias("mean_percent"))


@query(sql_of("""SELECT vendor, count(*) AS parts, count(*) FILTER (class = 'hardware') AS hardware, count(f.part_id) AS with_facts, coalesce(sum(n), 0)::BIGINT AS facts, round(avg(n), 1) AS mean_facts, count(l.part_id) AS with_lifecycle, count(*) FILTER (percent = 100) AS complete, count(DISTINCT category) AS categories
  FROM parts LEFT JOIN (SELECT part_id, count(*) AS n FROM shown GROUP BY 1) f USING (part_id) LEFT JOIN life l USING (part_id) LEFT JOIN pct USING (part_id) GROUP BY 1""", "parts", "life", more=PCT))
def warehouse_stats(spark, d):
    n = rendered(facts_of(spark, d)).groupBy("part_id").agg(F.count(F.lit(1)).alias("n"))
    life = w.life(spark, d).select("part_id", F.lit(True).alias("dated"))
    p = w.parts(spark, d).join(n, "part_id", "left").join(life, "part_id", "left").join(scored(spark, d), "part_id", "left")
    return p.groupBy("vendor").agg(
        F.count(F.lit(1)).alias("parts"), F.count_if(F.col("class") == "hardware").alias("hardware"), F.count("n").alias("with_facts"), F.coalesce(F.sum("n"), F.lit(0)).alias("facts"), F.round(F.avg("n"), 1).alias("mean_facts"),
        F.count("dated").alias("with_lifecycle"), F.count_if(F.col("percent") == 100).alias("complete"), F.countDistinct("category").alias("categories"),
    )


@query(w.with_tables("""SELECT s.source, count(DISTINCT c.part_id) AS checked, count(DISTINCT c.part_id) FILTER (c.outcome = 'ok') AS answered, coalesce(any_value(e.named), 0)::BIGINT AS named FROM (SELECT DISTINCT 'source' || s_suppkey % 8 AS source FROM supplier) s LEFT JOIN checks c USING (source)
  LEFT JOIN (SELECT 'source' || doc_id % 6 AS source, count(DISTINCT part_id) AS named FROM evidence GROUP BY 1) e USING (source) GROUP BY 1""", "checks", "evidence"))
def source_counts(spark, d):
    """Sources with what they were asked, what they answered, and parts whose evidence names them; unused ones are kept."""
    c = w.checks(spark, d).groupBy("source").agg(F.countDistinct("part_id").alias("checked"), F.countDistinct(F.when(F.col("outcome") == "ok", F.col("part_id"))).alias("answered"))
    e = w.evidence(spark, d).groupBy(F.concat(F.lit("source"), (F.col("doc_id") % 6).cast("string")).alias("source")).agg(F.countDistinct("part_id").alias("named"))
    s = load(spark, d, "supplier").select(F.concat(F.lit("source"), (F.col("s_suppkey") % 8).cast("string")).alias("source")).distinct()
    return s.join(c, "source", "left").join(e, "source", "left").select("source", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("checked", "answered", "named")])


@query("SELECT 'ok' AS status, (SELECT count(*) FROM part) AS parts, (SELECT count(*) FROM documents) AS documents")
def health(spark, d):
    n = load(spark, d, "part").agg(F.count(F.lit(1)).alias("parts")).crossJoin(load(spark, d, "documents").agg(F.count(F.lit(1)).alias("documents")))
    return n.select(F.lit("ok").alias("status"), "parts", "documents")


@query(sql_of("""SELECT part_id, sku, strftime(end_of_sale, '%Y-%m-%d') AS end_of_sale FROM parts JOIN life USING (part_id) WHERE class = 'hardware' AND status = 'end_of_sale' AND EXISTS (SELECT 1 FROM shown s WHERE s.part_id = parts.part_id AND field_key = 'brand' AND value_str <> 'Brand#3') ORDER BY end_of_sale, part_id LIMIT 26""", "parts", "life"))
def finder_lifecycle(spark, d):
    from ..operators.filters import filtered

    some = records.part_conditions(w.parts(spark, d), part_class="hardware").join(w.life(spark, d).where("status = 'end_of_sale'"), "part_id")
    some = filtered(some, rendered(facts_of(spark, d)), "brand!=Brand#3", KINDS)
    return paging.page(some.withColumn("end_of_sale", F.date_format("end_of_sale", "yyyy-MM-dd")), [("end_of_sale", False), ("part_id", False)], 25).select("part_id", "sku", "end_of_sale")


@query(w.with_tables("""SELECT r.from_id, r.to_id, p.sku AS target, p.part_id IS NOT NULL AS held FROM relations r LEFT JOIN (SELECT * FROM parts WHERE class = 'hardware') p ON p.part_id = r.to_id WHERE r.kind = 'compatible'""", "parts", "relations"))
def finder_relations(spark, d):
    """One hop from every part; targets that the catalogue does not hold are listed too."""
    targets = w.parts(spark, d).where("class = 'hardware'").select(F.col("part_id").alias("to_id"), F.col("sku").alias("target"))
    some = w.relations(spark, d).where("kind = 'compatible'")
    return some.join(targets, "to_id", "left").select("from_id", "to_id", "target", F.col("target").isNotNull().alias("held"))


@query(w.with_tables("SELECT DISTINCT part_id, kind, ref FROM (SELECT part_id, 'check' AS kind, source AS ref FROM checks UNION ALL SELECT part_id, 'fact', 'doc' || doc_id % 50 FROM evidence UNION ALL SELECT from_id, 'relation', 'tier' || tier FROM relations UNION ALL SELECT part_id, 'lifecycle', status FROM life UNION ALL SELECT part_id, 'alias', lower(sku) FROM parts WHERE sku <> lower(sku) UNION ALL SELECT part_id, 'image', source FROM checks WHERE outcome = 'ok' AND times > 4)", "parts", "checks", "evidence", "relations", "life"))
def all_record_sources(spark, d):
    """The six ways in which a record names its sources, each source once."""
    def tagged(rows, kind, ref, key="part_id"):
        return rows.select(F.col(key).alias("part_id"), F.lit(kind).alias("kind"), ref.alias("ref"))

    checks, p = w.checks(spark, d), w.parts(spark, d)
    kinds = [
        tagged(checks, "check", F.col("source")), tagged(w.evidence(spark, d), "fact", F.concat(F.lit("doc"), (F.col("doc_id") % 50).cast("string"))), tagged(w.relations(spark, d), "relation", F.concat(F.lit("tier"), F.col("tier").cast("string")), "from_id"),
        tagged(w.life(spark, d), "lifecycle", F.col("status")), tagged(p.where("sku <> lower(sku)"), "alias", F.lower("sku")), tagged(checks.where("outcome = 'ok' and times > 4"), "image", F.col("source")),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out.distinct()
