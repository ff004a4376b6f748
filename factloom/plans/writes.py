"""Queries of write-side decisions over the test tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import writes as x
from ..sources.tables import load
from . import warehouse as w
from .queries import FACTS, facts_of, query


def lines():
    return F.count(F.lit(1))


@query("""SELECT l_partkey, CASE WHEN reviewed THEN 'long_operator_reviewed' WHEN independent > 0 THEN 'long_has_independent_evidence' WHEN pdf_docs = 0 THEN 'long_no_pdf_evidence' WHEN pdf_docs > 1 THEN 'long_multiple_pdfs' WHEN NOT shared THEN 'base_not_named_by_that_pdf' WHEN chained THEN 'footnote_chain' WHEN series > 2 THEN 'numeric_series' ELSE 'retire:pdf_footnote_digit' END AS verdict
  FROM (SELECT l_partkey, l_partkey % 19 = 0 AS reviewed, count(*) FILTER (l_linenumber = 7 AND l_returnflag = 'R') AS independent, count(DISTINCT l_suppkey % 2) FILTER (l_linenumber = 1) AS pdf_docs, l_partkey % 3 > 0 AS shared, l_partkey % 11 = 1 AS chained, count(*) FILTER (l_linenumber = 2) AS series FROM lineitem GROUP BY 1)""")
def fabricated_verdicts(spark, d):
    key, n = F.col("l_partkey"), F.col("l_linenumber")
    rows = load(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_if((n == 7) & (F.col("l_returnflag") == "R")).alias("independent"), F.countDistinct(F.when(n == 1, F.col("l_suppkey") % 2)).alias("pdf_docs"), F.count_if(n == 2).alias("series"))
    rows = rows.withColumns({"reviewed": key % 19 == 0, "shared_pdf": key % 3 > 0, "chained": key % 11 == 1})
    return rows.select("l_partkey", x.fabricated_verdict().alias("verdict"))


@query(w.with_tables("SELECT vendor, family, min_by(part_id, (part_id % 7 <> 0, sku <> upper(sku), -n, part_id)) AS survivor, count(*) AS members FROM parts JOIN (SELECT l_partkey AS part_id, count(*) AS n FROM lineitem GROUP BY 1) USING (part_id) GROUP BY 1, 2 HAVING count(*) > 1", "parts"))
def twin_survivors(spark, d):
    n = load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part_id")).agg(lines().alias("n_facts"))
    rows = w.parts(spark, d).join(n, "part_id").withColumns({"id": F.col("part_id"), "reviewed": F.col("part_id") % 7 == 0})
    return x.survivors(rows, ["vendor", "family"]).where("members > 1")


RANKS = "CASE {0} WHEN 'gap_unattempted' THEN 0 WHEN 'gap_confirmed' THEN 1 WHEN 'not_applicable' THEN 2 END"
STATE = "CASE WHEN state = 'unverified' THEN 'gap_confirmed' WHEN state = 'conflict' THEN 'not_applicable' ELSE state END"


@query(f"""SELECT part_id, field_key, CASE WHEN held IS NULL AND g IS NOT NULL THEN 'gap_moved' WHEN held IS NULL THEN 'moved_uncontested' WHEN g > h THEN 'gap_promoted' WHEN g IS NOT NULL AND h IS NOT NULL THEN 'gap_parked_under_gap' WHEN g IS NOT NULL THEN 'gap_parked_under_value' ELSE 'merged' END AS outcome
  FROM (SELECT l.part_id, l.field_key, s.state AS held, {RANKS.format('l.state')} AS g, {RANKS.format('s.state')} AS h FROM (SELECT part_id, field_key, {STATE} AS state FROM facts WHERE is_current AND part_id % 2 = 1) l LEFT JOIN (SELECT part_id + 1 AS part_id, field_key, {STATE} AS state FROM facts WHERE is_current AND part_id % 2 = 0) s USING (part_id, field_key))""")
def twin_facts(spark, d):
    """Facts of each odd part moved to the even one before it."""
    state = F.when(F.col("state") == "unverified", "gap_confirmed").when(F.col("state") == "conflict", "not_applicable").otherwise(F.col("state"))
    f = facts_of(spark, d).where("is_current").select("part_id", "field_key", state.alias("state"))
    held = f.where("part_id % 2 = 0").select((F.col("part_id") + 1).alias("part_id"), "field_key", F.col("state").alias("held"))
    return f.where("part_id % 2 = 1").join(held, ["part_id", "field_key"], "left").select("part_id", "field_key", x.twin_fact(F.col("held"), F.col("state")).alias("outcome"))


@query("""SELECT category, field_key, parts, denom, CASE WHEN field_key = 'words' AND category = 'LARGE' THEN 'sentinel' WHEN field_key = 'span' THEN 'struct' WHEN field_key = 'title' THEN 'identity' WHEN field_key = 'size' AND category <> 'PROMO' THEN 'unit-less-number' WHEN field_key = 'brand' THEN 'already-required' WHEN field_key = 'large' AND category = 'SMALL' THEN 'not-applicable'
  WHEN field_key = 'type' AND category = 'PROMO' THEN 'hand-written' WHEN category = 'ECONOMY' THEN 'absent-from-generated-profile' WHEN denom < 30 THEN 'below-min-parts' WHEN parts / denom < 0.6 THEN 'below-min-share' ELSE 'promote' END AS reason
  FROM (SELECT p_type AS category, field_key, count(DISTINCT part_id) AS parts FROM shown JOIN part ON p_partkey = part_id WHERE value_text IS NOT NULL GROUP BY ALL) JOIN (SELECT p_type AS category, count(DISTINCT part_id) AS denom FROM shown JOIN part ON p_partkey = part_id WHERE value_text IS NOT NULL GROUP BY 1) USING (category)""")
def promotion_reasons(spark, d):
    own = facts_of(spark, d).where("is_current and state in ('verified', 'corroborated') and value_text is not null").join(load(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_type").alias("category")), "part_id")
    denom = own.groupBy("category").agg(F.countDistinct("part_id").alias("denom"))
    rows = own.groupBy("category", "field_key", "field_type").agg(F.countDistinct("part_id").alias("parts")).join(denom, "category")
    key, category = F.col("field_key"), F.col("category")
    rows = rows.withColumns({
        "type": F.when(key == "span", "struct").otherwise(F.col("field_type")), "sentinel": (key == "words") & (category == "LARGE"), "identity": key == "title", "unit": F.when(key == "price", "EUR"), "band": category == "PROMO",
        "current": F.when(key == "brand", "req").when((key == "large") & (category == "SMALL"), "na").otherwise("opt"), "hand_written": (key == "type") & (category == "PROMO"), "in_generated": category != "ECONOMY",
    })
    return rows.select("category", "field_key", "parts", "denom", x.promotion_reason().alias("reason"))


PIDS_SQL = """
bulletins AS (SELECT l_orderkey AS bulletin_id, ['WS-C', 'C', '', 'C1-'][1 + l_linenumber % 4] || (1000 + l_partkey) || '-' || l_suppkey % 3 || ['', '-E', '-S', '/K9', '=', ''][1 + l_suppkey % 6] AS pid, CASE WHEN l_quantity > 20 THEN 'NEW-' || l_suppkey END AS successor, l_linenumber % 4 AS n_dates, strftime(l_shipdate, '%Y-%m-%d') AS end_of_sale FROM lineitem),
mine AS (SELECT p_partkey AS part_id, (1000 + p_partkey) || '-' || p_size % 3 || ['', '-E', '-L'][1 + p_size % 3] AS sku FROM part),
norm AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(pid), '/K9(\\+\\+)?$', ''), '[+=]+$', ''), '^(WS-C|WSC|WS-|WS|C1-)', ''), '^C([0-9])', '\\1') AS whole FROM bulletins),
best AS (SELECT core, max_by((bulletin_id, successor, end_of_sale), (n_dates, end_of_sale, -bulletin_id, pid)) AS b FROM (SELECT *, regexp_replace(whole, '-([ESLA])$', '') AS core FROM norm) WHERE contains(core, '-') GROUP BY core),
exact AS (SELECT whole, min_by(successor, (bulletin_id, pid)) FILTER (successor IS NOT NULL) AS exact FROM norm GROUP BY whole)
"""


@query(f"WITH {PIDS_SQL.strip()} SELECT part_id, b[1] AS bulletin_id, b[3] AS end_of_sale, CASE WHEN e.exact IS NOT NULL THEN e.exact WHEN e.whole IS NULL THEN b[2] END AS successor FROM mine JOIN best ON core = regexp_replace(sku, '-([ESLA])$', '') LEFT JOIN exact e ON e.whole = mine.sku")
def bulletin_lifecycles(spark, d):
    li = load(spark, d, "lineitem")

    def turn(by, *items):
        return F.element_at(F.array(*[F.lit(i) for i in items]), (by % len(items) + 1).cast("int"))

    pid = F.concat(turn(F.col("l_linenumber"), "WS-C", "C", "", "C1-"), (F.col("l_partkey") + 1000).cast("string"), F.lit("-"), (F.col("l_suppkey") % 3).cast("string"), turn(F.col("l_suppkey"), "", "-E", "-S", "/K9", "=", ""))
    bulletins = li.select(F.col("l_orderkey").alias("bulletin_id"), pid.alias("pid"), F.when(F.col("l_quantity") > 20, F.concat(F.lit("NEW-"), F.col("l_suppkey").cast("string"))).alias("successor"), (F.col("l_linenumber") % 4).alias("n_dates"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("end_of_sale"))
    sku = F.concat((F.col("p_partkey") + 1000).cast("string"), F.lit("-"), (F.col("p_size") % 3).cast("string"), turn(F.col("p_size"), "", "-E", "-L"))
    mine = load(spark, d, "part").select(F.col("p_partkey").alias("part_id"), sku.alias("sku"))
    return x.bulletin_successors(mine, bulletins).select("part_id", "bulletin_id", "end_of_sale", "successor")


@query("""WITH p AS (SELECT DISTINCT l_orderkey, l_partkey AS id, 'P-' || l_partkey AS sku FROM lineitem WHERE l_returnflag = 'N'), o AS (SELECT DISTINCT l_orderkey, CASE WHEN l_partkey % 13 = 0 THEN 'TBD' ELSE 'O-' || l_partkey END AS optic, CASE WHEN l_partkey % 2 = 0 AND l_partkey % 13 <> 0 THEN l_partkey END AS optic_id FROM lineitem WHERE l_returnflag = 'R')
  SELECT id AS from_id, optic AS to_sku, 'supports_transceiver' AS kind FROM p JOIN o USING (l_orderkey) WHERE optic <> 'TBD' UNION SELECT optic_id, sku, 'compatible' FROM p JOIN o USING (l_orderkey) WHERE optic_id IS NOT NULL""")
def compatibility_edges(spark, d):
    li, key = load(spark, d, "lineitem"), F.col("l_partkey")
    platforms = li.where("l_returnflag = 'N'").select("l_orderkey", key.alias("id"), F.concat(F.lit("P-"), key.cast("string")).alias("sku"))
    optics = li.where("l_returnflag = 'R'").select("l_orderkey", F.when((key % 2 == 0) & (key % 13 != 0), key).alias("id"), F.when(key % 13 == 0, "TBD").otherwise(F.concat(F.lit("O-"), key.cast("string"))).alias("sku"))
    return x.compatibility(platforms, optics, "l_orderkey")


@query("""SELECT event_id, round(CASE WHEN a = b THEN 1 WHEN a = 0 OR b = 0 THEN 1e6 ELSE greatest(abs(a / b), abs(b / a)) END, 6) AS magnitude, a <> b AND (a < 0) <> (b < 0) AS sign_flip, event_id % 3 = 1 AND NOT abs(value - 7) / greatest(abs(value), 7) <= 0.005 AS permuted
  FROM (SELECT *, CASE WHEN event_id % 10 = 0 THEN 0 ELSE value END AS a, value * [1, -1, 1000, 1.5][1 + event_id % 4] AS b FROM events)""")
def change_magnitudes(spark, d):
    e, i, v = load(spark, d, "events"), F.col("event_id"), F.col("value")
    a, b = F.when(i % 10 == 0, 0.0).otherwise(v), v * F.element_at(F.array(*[F.lit(y) for y in (1.0, -1.0, 1000.0, 1.5)]), (i % 4 + 1).cast("int"))
    old = F.array(v, F.lit(7.0), F.lit(900.0))
    new = F.when(i % 3 == 0, old).when(i % 3 == 1, F.array(F.lit(7.0), v, F.lit(900.0))).otherwise(F.array(v * 2, F.lit(70.0), F.lit(1.0)))
    return e.select("event_id", F.round(x.magnitude(a, b), 6).alias("magnitude"), x.sign_flip(a, b).alias("sign_flip"), x.permuted(old, new).alias("permuted"))


OUTCOME_SQL = """CASE WHEN raw IS NULL AND v IS NULL THEN 'unrecoverable:GAP_ROW_NEVER_NORMALISED' WHEN raw IS NULL THEN 'unrecoverable:RAW_LOST_VALUE_PRESENT' WHEN refused THEN CASE WHEN tier = 0 THEN 'protected' ELSE 'refused' END WHEN same THEN 'same' WHEN tier = 0 THEN 'protected' ELSE 'changed' END"""
REPLAY_SQL = f"SELECT event_id, event_type, {OUTCOME_SQL} AS outcome FROM (SELECT event_id, event_type, CASE WHEN event_id % 6 > 0 THEN value::VARCHAR END AS raw, CASE WHEN event_id % 12 > 0 THEN value END AS v, event_id % 7 = 3 AS refused, event_id % 4 <> 1 AND event_id % 12 > 0 AS same, event_id % 5 AS tier FROM events)"


def replayed(spark, d):
    e, i = load(spark, d, "events"), F.col("event_id")
    value = F.when(i % 12 > 0, F.col("value"))
    outcome = x.replay(F.when(i % 6 > 0, F.col("value").cast("string")), value, F.when(i % 4 != 1, F.col("value")).otherwise(F.col("value") + 1), F.when(i % 7 == 3, "PARSE_FAIL"), i % 5)
    return e.select("event_id", "event_type", outcome.alias("outcome"))


@query(REPLAY_SQL)
def replay_outcomes(spark, d):
    return replayed(spark, d)


@query(f"SELECT event_type, count(*) AS n, round(count(*) FILTER (outcome = 'changed') / count(*), 6) AS changed_share, count(*) FILTER (outcome = 'protected') AS protected, count(*) FILTER (outcome = 'changed') * 100 <= count(*) * 20 AND count(*) FILTER (outcome = 'refused') * 100 <= count(*) * 20 AS passed FROM ({REPLAY_SQL}) GROUP BY 1")
def change_gate(spark, d):
    """Whether so few rows change or are refused that a replay may be written."""
    r = replayed(spark, d).groupBy("event_type").agg(lines().alias("n"), F.count_if(F.col("outcome") == "changed").alias("changed"), F.count_if(F.col("outcome") == "protected").alias("protected"), F.count_if(F.col("outcome") == "refused").alias("refused"))
    return r.select("event_type", "n", F.round(F.col("changed") / F.col("n"), 6).alias("changed_share"), "protected", ((F.col("changed") * 100 <= F.col("n") * 20) & (F.col("refused") * 100 <= F.col("n") * 20)).alias("passed"))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_suppkey % 9 = 0 THEN 'skip:no_current_fact' WHEN l_partkey % 8 = 0 THEN 'retract:gap_unattempted' WHEN l_partkey % 8 = 1 THEN 'retract:not_applicable' WHEN l_linenumber = 6 THEN 'skip:no_rejected_value' WHEN l_quantity = 10 THEN 'agree' WHEN l_returnflag = 'A' THEN 'open:drift' WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'rewrite' WHEN l_returnflag = 'R' THEN 'reapply' ELSE 'open' END AS decision FROM lineitem""")
def remerge_decisions(spark, d):
    q = F.col("l_quantity")
    action = F.when(F.col("l_returnflag") == "A", "corroborate").when(F.col("l_returnflag") == "R", "supersede").otherwise("conflict")
    decision = x.remerge(F.when(q == 10, "exact"), F.col("l_partkey") % 8 != 0, F.col("l_partkey") % 8 != 1, F.when(F.col("l_suppkey") % 9 != 0, q), F.when(F.col("l_linenumber") != 6, q + 1), action, F.when(F.col("l_linestatus") == "O", "raw"))
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", decision.alias("decision"))


@query("SELECT l_partkey, max(l_quantity) AS confidence, max_by(l_returnflag || l_linestatus, (l_quantity, -l_orderkey, -l_linenumber, -l_suppkey)) AS method, max(CASE WHEN l_linestatus = 'O' THEN (l_quantity * 10)::INT END) AS width, min(CASE WHEN l_returnflag = 'R' THEN 'accepted' WHEN l_returnflag = 'A' THEN 'rejected' END) AS decision FROM lineitem GROUP BY 1")
def image_upserts(spark, d):
    """Confidence only rises and its method follows it; a pending candidate takes the larger hint; a decision is never reset."""
    q = F.col("l_quantity")
    order = F.struct(q, -F.col("l_orderkey"), -F.col("l_linenumber"), -F.col("l_suppkey"))
    decided = F.when(F.col("l_returnflag") == "R", "accepted").when(F.col("l_returnflag") == "A", "rejected")
    return load(spark, d, "lineitem").groupBy("l_partkey").agg(F.max(q).alias("confidence"), F.max_by(F.concat("l_returnflag", "l_linestatus"), order).alias("method"), F.max(F.when(F.col("l_linestatus") == "O", (q * 10).cast("int"))).alias("width"), F.min(decided).alias("decision"))


@query(w.with_tables(f", {FACTS.strip()} SELECT c.part_id, k.field_key, CASE WHEN f.state IS NULL THEN 'inserted' WHEN f.state = 'gap_unattempted' THEN 'superseded' ELSE 'refused' END AS outcome FROM (SELECT DISTINCT part_id FROM checks WHERE outcome = 'not_listed' AND source = 'source2') c CROSS JOIN (VALUES ('brand'), ('size')) k(field_key) LEFT JOIN (SELECT * FROM facts WHERE is_current) f ON f.part_id = c.part_id AND f.field_key = k.field_key", "checks"))
def confirmed_gaps(spark, d):
    """Gaps that a source confirmed: they take the place of gaps not tried, never of a value."""
    keys = F.explode(F.array(F.lit("brand"), F.lit("size"))).alias("field_key")
    asked = w.checks(spark, d).where("outcome = 'not_listed' and source = 'source2'").select("part_id").distinct().select("part_id", keys)
    now = facts_of(spark, d).where("is_current").select("part_id", "field_key", "state")
    outcome = F.when(F.col("state").isNull(), "inserted").when(F.col("state") == "gap_unattempted", "superseded").otherwise("refused")
    return asked.join(now, ["part_id", "field_key"], "left").select("part_id", "field_key", outcome.alias("outcome"))


@query("SELECT p_partkey, ['document', 'own', 'named', 'unresolved'][1 + p_partkey % 4] AS kind, CASE WHEN p_partkey % 4 = 2 THEN 'AB-1,AB-2' ELSE '' END AS skus FROM part")
def fact_scopes(spark, d):
    own = F.concat(F.lit("SKU-"), F.col("p_partkey").cast("string"))
    label = F.element_at(F.array(F.lit("Weight, all models"), F.concat(F.lit("Weight of "), F.lower(own)), F.lit("Weight (ab-2, AB-1, ZZ-9)"), F.concat(F.lit("Weight "), "p_name")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return load(spark, d, "part").select("p_partkey", x.scope(label, own, F.array(F.lit("AB-1"), F.lit("AB-2"))).alias("s")).select("p_partkey", "s.kind", "s.skus")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN p_size = 9 END AS matches FROM part")
def family_matches(spark, d):
    size = F.col("p_size").cast("string")
    a = F.concat(F.lit("Series "), size, F.lit(" X switches"))
    b = F.element_at(F.array(F.concat(F.lit("the "), size, F.lit("X line")), F.concat(F.lit("model 77"), size), F.lit("Series 9 X"), F.lit("no model")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return load(spark, d, "part").select("p_partkey", x.family_matches(a, b).alias("matches"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_linenumber % 4 < 3 THEN l_linenumber END AS tbl, CASE WHEN l_linenumber % 4 < 3 THEN l_suppkey END AS row, CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 5 END AS cell, CASE WHEN l_linenumber % 4 BETWEEN 1 AND 2 THEN l_orderkey END AS page FROM lineitem")
def locators(spark, d):
    li = load(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_suppkey", x.locator(place()).alias("p")).select("l_orderkey", "l_linenumber", "l_suppkey", "p.tbl", "p.row", "p.cell", "p.page")


def place():
    t, r, p = (F.col(c).cast("string") for c in ("l_linenumber", "l_suppkey", "l_orderkey"))
    spot = F.concat(F.lit("t"), t, F.lit(":r"), r)
    return F.element_at(F.array(spot, F.concat(F.lit("p"), p, F.lit(":"), spot), F.concat(F.lit("p"), p, F.lit(":"), spot, F.lit(":c5")), F.concat(F.lit("row "), r)), (F.col("l_linenumber") % 4 + 1).cast("int"))


@query("""SELECT DISTINCT f.l_orderkey, f.l_linenumber, f.l_suppkey, f.l_partkey FROM lineitem f JOIN lineitem b ON b.l_orderkey = f.l_orderkey AND b.l_linenumber = f.l_linenumber AND b.l_quantity > 45 WHERE f.l_linenumber % 4 < 3""")
def suspect_facts(spark, d):
    """Facts from tables with a reported defect: same document, page and table."""
    li = load(spark, d, "lineitem").withColumn("place", place()).withColumn("doc", F.col("l_orderkey"))
    return x.suspects(li, li.where("l_quantity > 45").select("doc", "place")).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").distinct()


@query("SELECT category, field_key, count(value_text) AS live, count(*) FILTER (value_text IS NULL) AS gaps FROM (SELECT p_type AS category, field_key, value_text FROM facts JOIN part ON p_partkey = part_id WHERE is_current) WHERE NOT (category IN ('PROMO', 'LARGE') AND field_key IN ('size', 'brand')) GROUP BY ALL")
def applicability_census(spark, d):
    profile = spark.createDataFrame([(c, k) for c in ("PROMO", "LARGE") for k in ("size", "brand")], "category string, field_key string")
    f = facts_of(spark, d).where("is_current").join(load(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_type").alias("category")), "part_id")
    return x.census(f, profile)


@query("SELECT l_orderkey, min_by(category, (-n, first)) AS category, max(n) AS n FROM (SELECT l_orderkey, p_type AS category, count(*) AS n, min(l_linenumber * 1000000 + l_partkey) AS first FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL) GROUP BY 1")
def document_categories(spark, d):
    li = load(spark, d, "lineitem").join(load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("category")), "l_partkey")
    return x.majority(li.withColumn("at", F.col("l_linenumber") * 1000000 + F.col("l_partkey")), "l_orderkey", "category", "at")


@query("""WITH r AS (SELECT doc_id, source, n_chars > 1500 AS flagged, row_number() OVER (PARTITION BY source ORDER BY (n_chars > 1500) DESC, md5('g' || doc_id), doc_id) AS nth FROM documents), g AS (SELECT source, count(*) AS size, max(flagged) AS f, row_number() OVER (ORDER BY max(flagged) DESC, md5('g' || source), source) AS place FROM r GROUP BY 1)
  SELECT doc_id, source, flagged FROM r JOIN g USING (source) WHERE place <= 60 AND nth <= greatest(1, least(size, round(size / (SELECT count(*) FROM documents) * least(60, (SELECT count(*) FROM documents)))))""")
def sample_proportional(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "source", (F.col("n_chars") > 1500).alias("flagged"))
    return x.proportional_sample(docs, "source", "doc_id", "flagged", 60, "g")


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) WHERE n % 40 = 0")
def sample_systematic(spark, d):
    return x.every_nth(load(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 40)


@query("SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'not_snake_case' WHEN 1 THEN 'control_character' WHEN 2 THEN 'word_boundary' WHEN 3 THEN 'duplicate' WHEN 4 THEN 'too_broad' WHEN 5 THEN 'no_hits' END AS refusal FROM part")
def proposal_checks(spark, d):
    turn = F.col("p_partkey") % 7
    name = F.when(turn == 0, F.initcap("p_name")).otherwise(F.concat(F.lit("field_"), F.col("p_partkey").cast("string")))
    pattern = F.when(turn == 1, F.concat("p_name", F.lit("\n"))).when(turn == 2, F.concat(F.lit("\\b"), "p_name")).when(turn == 4, F.lit("^a.*$")).otherwise(F.col("p_name"))
    return load(spark, d, "part").select("p_partkey", x.proposal_refusal(name, pattern, turn == 3, F.when(turn == 5, 0).otherwise(F.col("p_size"))).alias("refusal"))


@query("""SELECT l_orderkey, l_returnflag AS label, count(*) AS n, CASE WHEN count(*) > 1 AND bool_and(l_quantity > 5) THEN string_agg('item ' || l_partkey, '; ' ORDER BY l_linenumber, l_partkey, l_quantity) ELSE min_by((CASE WHEN l_quantity > 5 THEN '• ' ELSE '' END) || 'item ' || l_partkey, (l_linenumber, l_partkey, l_quantity)) END AS value FROM lineitem GROUP BY 1, 2""")
def list_fragments(spark, d):
    """Marked list items of one subject and label as one value."""
    li = load(spark, d, "lineitem")
    value = F.concat(F.when(F.col("l_quantity") > 5, "• ").otherwise(""), F.lit("item "), F.col("l_partkey").cast("string"))
    rows = li.select("l_orderkey", F.col("l_returnflag").alias("label"), F.struct("l_linenumber", "l_partkey", "l_quantity").alias("at"), value.alias("value"))
    return x.joined_fragments(rows, ["l_orderkey", "label"], "at")


@query(f"SELECT outcome AS rule, count(*) AS n, string_agg(event_id, ',' ORDER BY event_id) FILTER (r <= 5) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY event_id) AS r FROM ({REPLAY_SQL})) GROUP BY 1")
def hygiene_report(spark, d):
    """Each rule with its count and the first five examples: counted whole, examples cut to five before they are gathered."""
    from pyspark.sql import Window

    rows = replayed(spark, d)
    counts = rows.groupBy(F.col("outcome").alias("rule")).agg(lines().alias("n"))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("outcome").orderBy("event_id"))).where("r <= 5")
    first = first.groupBy(F.col("outcome").alias("rule")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda i: i.cast("string")), ",").alias("examples"))
    return counts.join(first, "rule")


@query("""SELECT source, count(*) AS sampled, count(*) FILTER (found) AS found, count(*) FILTER (found) >= 0.98 * count(*) AS passed FROM (SELECT source, contains(text, w) OR doc_id % 50 = 7 AND contains(text, left(w, 1)) AS found FROM (SELECT doc_id, source, text, CASE WHEN doc_id % 60 = 11 THEN 'no such value' ELSE substr(text, 3, 8) END AS w FROM documents WHERE text IS NOT NULL AND length(text) > 10)) GROUP BY 1""")
def reread_gate(spark, d):
    """Values read again from the page they are said to be on; a source passes with 98 of 100."""
    docs = load(spark, d, "documents").where("text is not null and length(text) > 10")
    word = F.when(F.col("doc_id") % 60 == 11, "no such value").otherwise(F.substring("text", 3, 8))
    found = F.contains("text", word) | ((F.col("doc_id") % 50 == 7) & F.contains("text", F.substring(word, 1, 1)))
    return docs.groupBy("source").agg(lines().alias("sampled"), F.count_if(found).alias("found")).withColumn("passed", F.col("found") >= 0.98 * F.col("sampled"))


@query(w.with_tables("SELECT status, count(*) AS parts, count(*) FILTER (announced <= end_of_sale AND end_of_sale <= last_ship) AS in_order, round(count(successor_sku) / count(*), 4) AS with_successor, count(*) FILTER (announced <= end_of_sale AND end_of_sale <= last_ship) = count(*) AS passed FROM life GROUP BY 1", "life"))
def lifecycle_gate(spark, d):
    """Dates of each status found again in their order."""
    ordered = F.count_if((F.col("announced") <= F.col("end_of_sale")) & (F.col("end_of_sale") <= F.col("last_ship")))
    return w.life(spark, d).groupBy("status").agg(lines().alias("parts"), ordered.alias("in_order"), F.round(F.count("successor_sku") / lines(), 4).alias("with_successor"), (ordered == lines()).alias("passed"))


@query("""SELECT field, count(*) AS compared, count(*) FILTER (same) AS same, count(*) FILTER (same) = count(*) AS passed FROM (SELECT unnest(['name', 'nation', 'balance']) AS field, unnest([a.s_name IS NOT DISTINCT FROM b.n, a.s_nationkey IS NOT DISTINCT FROM b.k, a.s_acctbal IS NOT DISTINCT FROM b.v]) AS same
  FROM supplier a JOIN (SELECT s_suppkey, CASE WHEN s_suppkey % 31 = 5 THEN lower(s_name) ELSE s_name END AS n, s_nationkey AS k, CASE WHEN s_suppkey % 17 > 0 THEN s_acctbal END AS v FROM supplier) b USING (s_suppkey)) GROUP BY 1""")
def enumeration_audit(spark, d):
    """What was written against what is read again, field by field, null-safe."""
    a, key = load(spark, d, "supplier"), F.col("s_suppkey")
    b = a.select("s_suppkey", F.when(key % 31 == 5, F.lower("s_name")).otherwise(F.col("s_name")).alias("n"), F.col("s_nationkey").alias("k"), F.when(key % 17 > 0, F.col("s_acctbal")).alias("v"))
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(p).eqNullSafe(F.col(q)).alias("same")) for f, p, q in (("name", "s_name", "n"), ("nation", "s_nationkey", "k"), ("balance", "s_acctbal", "v"))])
    rows = a.join(b, "s_suppkey").select(F.explode(pairs).alias("x")).select("x.*")
    return rows.groupBy("field").agg(lines().alias("compared"), F.count_if("same").alias("same")).withColumn("passed", F.col("same") == F.col("compared"))


@query("SELECT source, field_key, count(*) AS parts FROM (SELECT DISTINCT 'source' || part_id % 6 AS source, field_key, part_id FROM shown WHERE value_text IS NOT NULL UNION SELECT DISTINCT 'source' || l_suppkey % 6, 'weight', l_partkey FROM lineitem) GROUP BY ALL")
def capability_matrix(spark, d):
    """Fields that each source was seen to give, by facts and by evidence."""
    f = facts_of(spark, d).where("is_current and state in ('verified', 'corroborated') and value_text is not null")
    a = f.select(F.concat(F.lit("source"), (F.col("part_id") % 6).cast("string")).alias("source"), "field_key", "part_id")
    b = load(spark, d, "lineitem").select(F.concat(F.lit("source"), (F.col("l_suppkey") % 6).cast("string")).alias("source"), F.lit("weight").alias("field_key"), F.col("l_partkey").alias("part_id"))
    return a.unionByName(b).distinct().groupBy("source", "field_key").agg(lines().alias("parts"))


@query(w.with_tables("SELECT part_id, sku, CASE WHEN part_id % 9 = 0 THEN 'retired:duplicate' ELSE 'alias:' || CASE WHEN n > 0 THEN 'exists' ELSE 'created' END END AS outcome FROM parts LEFT JOIN (SELECT upper(sku) AS u, count(*) AS n FROM parts WHERE part_id % 9 <> 0 AND sku LIKE '%=' GROUP BY 1) ON u = upper(sku) || '='", "parts"))
def retirements(spark, d):
    """Parts that go with a reason, and spare numbers linked as aliases of those that stay."""
    p = w.parts(spark, d)
    spare = p.where("part_id % 9 <> 0 and sku like '%='").select(F.upper("sku").alias("u")).distinct().withColumn("known", F.lit(True))
    out = p.withColumn("u", F.concat(F.upper("sku"), F.lit("="))).join(spare, "u", "left")
    return out.select("part_id", "sku", F.when(F.col("part_id") % 9 == 0, "retired:duplicate").when(F.col("known"), "alias:exists").otherwise("alias:created").alias("outcome"))
