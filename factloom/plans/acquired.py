"""Pages acquired and applied as one run, and the same in SQL.

Every event is an entry of a page of four: what some source says of a part, which it names in one of eight ways.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import applied as x, labels
from ..sources import commits
from ..sources.checkpoints import saved, shared_folder
from ..sources.tables import load
from .merging import ROWS_SQL, effects_sql
from .normalize import FIELDS
from .queries import query
from .warehouse import SKU_SQL, sku

OWN_SQL = f"CASE WHEN p_partkey % 10 = 3 THEN lower({SKU_SQL}) ELSE {SKU_SQL} END"
CATALOGUE_SQL = f"""
mine AS (SELECT p_partkey AS part_id, p_brand AS vendor, p_type AS category, {OWN_SQL} AS sku FROM part UNION ALL SELECT p_partkey + 1000000, 'Other', p_type, {OWN_SQL} FROM part WHERE p_partkey % 40 = 7),
known AS (SELECT p_partkey AS part_id, 'vendor_alias' AS kind, 'ALT-' || p_partkey AS value FROM part WHERE p_partkey % 3 = 0)
"""
ENTRIES_SQL = f"""{CATALOGUE_SQL.strip()},
entries AS (SELECT event_id AS entry_id, event_id % 8 AS turn, 'source' || user_id % 6 AS source, user_id % 6 < 2 AS is_vendor, CASE WHEN user_id % 6 < 2 THEN 1 + user_id % 2 WHEN user_id % 6 < 4 THEN 3 ELSE 4 END::INT AS tier, 'https://shop.example/' || event_id // 4 AS page_url, ts, event_type, p_partkey, user_id, value,
    CASE WHEN event_id % 8 = 0 THEN p_partkey END AS anchor_id, CASE WHEN event_id % 8 = 1 THEN p_brand END AS vendor, p_type AS category,
    CASE event_id % 8 WHEN 1 THEN CASE WHEN p_partkey % 10 = 3 THEN upper(s) ELSE lower(s) END WHEN 2 THEN CASE WHEN s LIKE '%=' THEN left(s, length(s) - 1) ELSE s || '=' END WHEN 3 THEN 'alt-' || p_partkey WHEN 4 THEN 'PG-' || p_partkey WHEN 5 THEN 'ZZ-' || event_id ELSE s END AS sku, s
  FROM (SELECT *, {OWN_SQL} AS s FROM events JOIN part ON p_partkey = (user_id * 13 + event_id) % (SELECT count(*) FROM part)) WHERE event_id % 8 <> 7),
hits AS (
  SELECT entry_id, CASE WHEN m.sku = e.sku THEN 1 ELSE 2 END AS rank, part_id FROM entries e JOIN mine m ON upper(m.sku) = upper(e.sku) AND (e.vendor IS NULL OR e.vendor = m.vendor) WHERE anchor_id IS NULL
  UNION ALL SELECT entry_id, CASE WHEN m.sku = f THEN 3 ELSE 4 END, part_id FROM (SELECT *, CASE WHEN sku LIKE '%=' THEN left(sku, length(sku) - 1) ELSE sku || '=' END AS f FROM entries) e JOIN mine m ON upper(m.sku) = upper(f) AND (e.vendor IS NULL OR e.vendor = m.vendor) WHERE anchor_id IS NULL
  UNION ALL SELECT entry_id, 5, part_id FROM entries e JOIN known k ON upper(k.value) = upper(e.sku) WHERE anchor_id IS NULL
  UNION ALL SELECT entry_id, 6, part_id FROM entries e JOIN mine m ON turn = 4 AND upper(m.sku) = upper(e.s)),
best AS (SELECT entry_id, rank, count(DISTINCT part_id) AS n, min(part_id) AS part_id FROM hits h WHERE rank = (SELECT min(rank) FROM hits i WHERE i.entry_id = h.entry_id) GROUP BY ALL),
who AS (SELECT e.*, CASE WHEN anchor_id IS NOT NULL OR n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'unknown' END AS outcome, CASE WHEN anchor_id IS NOT NULL THEN 'exact' ELSE ['exact', 'case', 'spare', 'spare', 'alias', 'variant'][rank] END AS step, CASE WHEN anchor_id IS NOT NULL THEN anchor_id WHEN n = 1 THEN part_id END AS part_id FROM entries e LEFT JOIN best USING (entry_id)),
found AS (SELECT w.*, (SELECT any_value(m.sku) FROM mine m WHERE m.part_id = w.part_id) AS part_sku FROM who w WHERE outcome = 'matched'),
facts AS (SELECT *, unnest([0, 1, 2, 3]) AS place, unnest(['Net weight', 'Power draw (W)', category || ' Colour', 'General notes']) AS label, unnest([round(value, 1)::VARCHAR || ' kg', user_id::VARCHAR, 'red', 'general-notes']) AS raw FROM found WHERE event_type <> 'error'),
mapped AS (SELECT * EXCLUDE (outcome), CASE place WHEN 3 THEN 'section' WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' ELSE CASE WHEN category = 'PROMO' THEN 'sentinel' ELSE 'unmapped' END END AS outcome, CASE place WHEN 0 THEN 'weight' WHEN 1 THEN 'power_max' END AS field FROM facts),
readings AS (SELECT part_id AS user_id, field AS event_type, ts, entry_id AS event_id, CASE place WHEN 0 THEN round(value, 1) ELSE user_id END::DOUBLE AS num, NULL::VARCHAR[] AS items, NULL::VARCHAR AS text, CASE place WHEN 0 THEN 'kg' ELSE 'W' END AS unit, tier, page_url AS doc, NULL::VARCHAR AS revision,
  '1.0' AS reader, 0 AS version, strftime(ts, '%Y-%m-%d') AS read_on, raw FROM mapped WHERE outcome = 'ok')
"""


def catalogue(spark, d) -> tuple[DataFrame, DataFrame]:
    p, key = load(spark, d, "part"), F.col("p_partkey")
    own = F.when(key % 10 == 3, F.lower(sku())).otherwise(sku())
    mine = p.select(key.alias("part_id"), F.col("p_brand").alias("vendor"), F.col("p_type").alias("category"), own.alias("sku"))
    twins = mine.where("part_id % 40 = 7").select((F.col("part_id") + 1000000).alias("part_id"), F.lit("Other").alias("vendor"), "category", "sku")
    known = p.where("p_partkey % 3 = 0").select(key.alias("part_id"), F.lit("vendor_alias").alias("kind"), F.concat(F.lit("ALT-"), key.cast("string")).alias("value"))
    return mine.unionByName(twins).hint("merge"), known  # a union drops the hint of its parts


def entries(spark, d) -> DataFrame:
    p = load(spark, d, "part")
    p = p.select("p_partkey", "p_brand", "p_type", F.when(F.col("p_partkey") % 10 == 3, F.lower(sku())).otherwise(sku()).alias("s"))
    i, turn, kind, s = F.col("event_id"), F.col("event_id") % 8, F.col("event_type"), F.col("s")
    source = F.col("user_id") % 6
    e = load(spark, d, "events").withColumn("p_partkey", (F.col("user_id") * 13 + i) % p.count()).join(p, "p_partkey")

    def text(*parts) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])

    def items(fields: str, *rows: list, when: Column | None = None) -> Column:
        names = fields.split()
        array = F.array(*[F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows])
        return array if when is None else F.when(when, array)

    written = F.when(turn == 1, F.when(F.col("p_partkey") % 10 == 3, F.upper(s)).otherwise(F.lower(s))).when(turn == 2, x.flipped(s)).when(turn == 3, text("alt-", F.col("p_partkey"))).when(turn == 4, text("PG-", F.col("p_partkey"))).when(turn == 5, text("ZZ-", i)).otherwise(s)
    day = F.date_format("ts", "yyyy-MM-dd")
    later = F.when(i % 2 == 0, F.date_format(F.col("ts") + F.expr("interval 100 days"), "yyyy-MM-dd")).otherwise("N/A")
    return e.select(
        i.alias("entry_id"), text("source", source).alias("source"), F.when(source < 2, "vendor").when(source < 4, "distributor").otherwise("aggregator").alias("source_kind"), F.when(source < 2, source % 2 + 1).when(source < 4, 3).otherwise(4).cast("int").alias("tier"),
        text("https://shop.example/", F.floor(i / 4)).alias("page_url"), F.col("ts").alias("fetched_at"), F.when(turn == 0, F.col("p_partkey")).alias("anchor_id"), F.when(turn == 1, F.col("p_brand")).alias("vendor"), written.alias("sku"), F.when(turn == 7, "family").alias("scope"), (i % 2 == 0).alias("not_listed"),
        items("label value", ["Net weight", text(F.round("value", 1), " kg")], ["Power draw (W)", F.col("user_id").cast("string")], [text(F.col("p_type"), " Colour"), "red"], ["General notes", "general-notes"], when=kind != "error").alias("facts"),
        items("kind value", ["variant_sku", s], ["gtin", text("0", F.col("p_partkey"))], ["nickname", "x"], when=turn == 4).alias("aliases"), items("url role", [text("https://img.example/", F.col("p_partkey"), ".png"), F.lit(None).cast("string")], when=kind == "view").alias("images"),
        items("kind sku", ["successor", text("Z-", F.col("p_partkey") % 50)], ["compatible", F.lower(s)], ["friend", "x"], when=kind == "purchase").alias("relations"),
        F.when(kind == "click", F.struct(day.alias("announced"), later.alias("end_of_sale"), F.lit(None).cast("string").alias("last_ship"), F.lit("soon").alias("end_of_support"))).alias("lifecycle"),
    )


def dictionary(spark) -> DataFrame:
    rows = [("weight", "weight", None, 2), ("gross weight", "__ignored", None, 1), ("power draw", "power_max", None, 1), ("draw", "__ignored", None, 0), ("power", "note", None, 0), ("colour", "__colour", "PROMO", 1)]
    return spark.createDataFrame(rows, "alias string, field string, section string, rank int")


RULES = {k: FIELDS[k] for k in ("weight", "power_max", "note")}


def run_tables(spark, d, *only: str) -> dict[str, DataFrame]:
    parts, known = catalogue(spark, d)
    return x.applied(saved(entries(spark, d)), parts, known, dictionary(spark), RULES, only=only or x.TABLES)


def pages(spark, d) -> DataFrame:
    """The text of every page as it stands now: of four entries in a row."""
    stated = entries(spark, d).where("facts is not null").select("page_url", "entry_id", F.transform("facts", lambda f: F.concat_ws(": ", f["label"], f["value"])).alias("lines"))
    return stated.groupBy("page_url").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entry_id", "lines"))), lambda e: F.array_join(e["lines"], "\n")), "\n").alias("text"))


@query(f"WITH {ENTRIES_SQL.strip()} SELECT entry_id, outcome, step, part_id FROM who")
def acquired_resolution(spark, d):
    parts, known = catalogue(spark, d)
    return x.resolved(entries(spark, d).where("coalesce(scope, '') <> 'family'"), parts, known).select("entry_id", "outcome", "step", "part_id")


@query(f"WITH {ENTRIES_SQL.strip()} SELECT label, outcome, field, count(*) AS n FROM mapped GROUP BY ALL")
def acquired_labels(spark, d):
    parts, known = catalogue(spark, d)
    own = saved(entries(spark, d).where("coalesce(scope, '') <> 'family'"))
    found = saved(x.resolved(own, parts, known).where("outcome = 'matched'").select("entry_id", "part_id").join(own, "entry_id").join(parts.select("part_id", "category"), "part_id"))
    field = F.when(~F.startswith("field", F.lit("__")) & (F.col("outcome") != "section"), F.col("field"))
    return x.mapped_entries(found, dictionary(spark), RULES).groupBy("label", "outcome", field.alias("field")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH RECURSIVE {effects_sql(ENTRIES_SQL.strip(), gap='false')}, {ROWS_SQL} SELECT user_id AS part_id, event_type AS field, seq::BIGINT AS seq, since AS entry_id, v.num AS num, v.tier AS tier, v.doc AS doc, v.state AS state FROM f")
def acquired_facts(spark, d):
    return run_tables(spark, d, "facts")["facts"].select("part_id", "field", "seq", F.col("since.entry_id").alias("entry_id"), "num", "tier", "doc", "state")


@query(f"""WITH {ENTRIES_SQL.strip()} SELECT part_id, kind, min_by(value, (tier, entry_id)) AS value, min(tier) AS tier FROM (SELECT part_id, part_sku, tier, entry_id, unnest(['variant_sku', 'gtin', 'variant_sku']) AS kind, unnest([s, '0' || p_partkey, CASE WHEN step = 'variant' THEN sku END]) AS value FROM found WHERE turn = 4) WHERE upper(value) <> upper(part_sku) GROUP BY part_id, kind, upper(value)""")
def acquired_aliases(spark, d):
    return run_tables(spark, d, "aliases")["aliases"].select("part_id", "kind", "value", "tier")


@query(f"WITH {ENTRIES_SQL.strip()} SELECT part_id, 'https://img.example/' || p_partkey || '.png' AS url, min(tier) FILTER (is_vendor) AS tier, count(DISTINCT source) AS sources FROM found WHERE event_type = 'view' GROUP BY 1, 2")
def acquired_images(spark, d):
    """Candidates from every source, and the tier of those that a vendor's page assigns."""
    t = run_tables(spark, d, "candidates", "images")
    return t["candidates"].join(t["images"].select("part_id", "url", "tier"), ["part_id", "url"], "left").select("part_id", "url", "tier", "sources")


@query(f"""WITH {ENTRIES_SQL.strip()}, one AS (SELECT upper(sku) AS k, min(part_id) AS id FROM mine GROUP BY 1 HAVING count(*) = 1)
  SELECT part_id, kind, upper(to_sku) AS to_key, min(tier) AS tier, any_value(id) AS to_id FROM (SELECT part_id, tier, unnest(['successor', 'compatible']) AS kind, unnest(['Z-' || p_partkey % 50, lower(s)]) AS to_sku FROM found WHERE event_type = 'purchase') LEFT JOIN one ON k = upper(to_sku) WHERE id IS NULL OR id <> part_id GROUP BY ALL""")
def acquired_relations(spark, d):
    return run_tables(spark, d, "relations")["relations"].select("part_id", "kind", "to_key", "tier", "to_id")


@query(f"""WITH {ENTRIES_SQL.strip()} SELECT part_id, tier, entry_id, strftime(ts, '%Y-%m-%d') AS announced, CASE WHEN entry_id % 2 = 0 THEN strftime(ts + INTERVAL 100 DAY, '%Y-%m-%d') END AS end_of_sale, CASE WHEN entry_id % 2 = 0 THEN 'eol_announced' ELSE 'active' END AS status
  FROM found WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY part_id ORDER BY tier, entry_id) = 1""")
def acquired_lifecycles(spark, d):
    return run_tables(spark, d, "lifecycles")["lifecycles"].select("part_id", "tier", "entry_id", "announced", "end_of_sale", "status")


@query(f"WITH {ENTRIES_SQL.strip()} SELECT entry_id, part_id, source, CASE WHEN event_type <> 'error' THEN 'facts_found' WHEN entry_id % 2 = 0 THEN 'not_listed' ELSE 'no_facts' END AS outcome, CASE WHEN event_type <> 'error' THEN 2 ELSE 0 END::BIGINT AS n_facts FROM found")
def acquired_checks(spark, d):
    return run_tables(spark, d, "checks")["checks"].select("entry_id", "part_id", "source", "outcome", "n_facts")


@query(f"WITH {ENTRIES_SQL.strip()} SELECT label, count(*) AS n, count(DISTINCT category) AS sections, 'red' AS samples FROM mapped WHERE outcome = 'unmapped' GROUP BY 1")
def acquired_unmapped(spark, d):
    return run_tables(spark, d, "unmapped")["unmapped"].withColumn("samples", F.array_join("samples", ","))


@query(f"""WITH {ENTRIES_SQL.strip()} SELECT 'checks' AS name, count(*) AS n FROM found UNION ALL SELECT 'resolution', count(*) FROM who UNION ALL SELECT 'written', count(*) FROM mapped WHERE outcome = 'ok' UNION ALL SELECT 'lifecycles', count(DISTINCT part_id) FROM found WHERE event_type = 'click'""")
def acquired_commit(spark, d):
    """The run as a whole: staged, judged against its pages, committed, and read through the pointer."""
    base = f"{shared_folder(spark)}/acquired-{uuid.uuid4().hex}"
    tables = run_tables(spark, d)
    golden = entries(spark, d).where("anchor_id is not null and facts is not null").select("entry_id", F.lit("weight").alias("field"))
    x.apply_run(spark, base, tables, pages(spark, d), golden)
    named = [commits.read(spark, base, t).select(F.lit(t).alias("name")) for t in ("checks", "resolution", "written", "lifecycles")]
    out = named[0]
    for more in named[1:]:
        out = out.unionByName(more)
    return out.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


#: What labels may end in, and the field that it names; the rest are made from brands.
ENDINGS = [("net weight", "weight"), ("weight", "weight"), ("power draw", "power_max"), ("draw", "__ignored"), ("operating temp range", "temp_operating"), ("operating temp", "temp_operating"), ("noise", "acoustic_noise"), ("uptime", "mtbf"), ("remarks", "note"), ("legend", "__legend")]
DICTIONARY_SQL = f"""
endings(ending, field) AS (VALUES {', '.join(str(e) for e in ENDINGS)}),
aliases AS (SELECT ending AS alias, field, NULL AS section, 9 AS rank FROM endings UNION ALL SELECT DISTINCT p_brand || ' ' || ending, field, NULL, 5 FROM part, endings UNION ALL SELECT DISTINCT p_brand || ' weight', 'power_max', p_type, 6 FROM part WHERE p_size % 2 = 0 UNION ALL SELECT split_part(p_name, ' ', 1), 'note', NULL, 9 FROM part GROUP BY 1),
labels AS (SELECT p_partkey, p_type AS section, p_name || ' ' || p_brand || ' ' || ['Net weight', 'weight (kg)', 'POWER-DRAW', 'draw', 'operating temp range', 'operating / temp', 'noise level', 'uptime', 'finish', 'legend', 'temp range'][1 + p_partkey % 11] AS label FROM part)
"""


@query(f"""WITH {DICTIONARY_SQL.strip()}, w AS (SELECT *, ' ' || trim(regexp_replace(lower(label), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ' AS l FROM labels), a AS (SELECT *, ' ' || trim(regexp_replace(lower(alias), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ' AS k FROM aliases),
  b AS (SELECT p_partkey, min_by(field, (-len(string_split(trim(k), ' ')), a.section IS NULL, rank, instr(l, k), field)) AS field FROM w JOIN a ON contains(l, k) AND (a.section IS NULL OR a.section = w.section) GROUP BY 1) SELECT p_partkey, label, labels.section, b.field FROM labels LEFT JOIN b USING (p_partkey)""")
def dictionary_labels(spark, d):
    """Labels by several hundred aliases from tables: the longest, then the section's own, then by rank."""
    p = load(spark, d, "part")
    endings = spark.createDataFrame(ENDINGS, "ending string, field string")
    brands = p.select("p_brand").distinct()
    none = F.lit(None).cast("string")
    aliases = endings.select(F.col("ending").alias("alias"), "field", none.alias("section"), F.lit(9).alias("rank"))
    aliases = aliases.unionByName(brands.crossJoin(F.broadcast(endings)).select(F.concat_ws(" ", "p_brand", "ending").alias("alias"), "field", none.alias("section"), F.lit(5).alias("rank")))
    aliases = aliases.unionByName(p.where("p_size % 2 = 0").select(F.concat("p_brand", F.lit(" weight")).alias("alias"), F.lit("power_max").alias("field"), F.col("p_type").alias("section"), F.lit(6).alias("rank")).distinct())
    aliases = aliases.unionByName(p.select(F.split("p_name", " ")[0].alias("alias"), F.lit("note").alias("field"), none.alias("section"), F.lit(9).alias("rank")).distinct())
    words = F.array(*[F.lit(w) for w in ("Net weight", "weight (kg)", "POWER-DRAW", "draw", "operating temp range", "operating / temp", "noise level", "uptime", "finish", "legend", "temp range")])
    rows = p.select("p_partkey", F.col("p_type").alias("section"), F.concat_ws(" ", "p_name", "p_brand", F.element_at(words, (F.col("p_partkey") % 11 + 1).cast("int"))).alias("label"))
    return rows.join(labels.mapped_labels(rows, aliases), ["label", "section"]).select("p_partkey", "label", "section", "field")
