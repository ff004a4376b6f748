"""Queries of merging and write-side rules over the test tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.effects import Effects, merge_effects
from ..operators.merging import merge_readings, unsourced
from ..sources.tables import load
from .queries import query

READINGS_SQL = """
readings AS (SELECT user_id, event_type, ts, event_id, CASE WHEN event_type NOT IN ('view', 'signup') THEN round(value) END AS num,
  CASE WHEN event_type = 'view' THEN ['a' || event_id % 3, ['B', 'b '][1 + event_id % 2] || event_id % 2] END AS items, CASE WHEN event_type = 'signup' THEN repeat('word' || user_id % 3 || ' ', 40)[:[158, 159, 160, 200, 90][1 + event_id % 5]] END AS text,
  CASE event_type WHEN 'purchase' THEN 'mm' WHEN 'click' THEN 'dB' END AS unit, (event_id % 5)::INT AS tier, CASE WHEN event_id % 11 <> 0 THEN (event_id % 4)::VARCHAR END AS doc, CASE WHEN event_id % 3 = 0 THEN 'r' || event_id % 2 END AS revision,
  '1.' || (event_id % 12) AS reader, event_id % 12 AS version, strftime(ts, '%Y-%m-%d') AS read_on, CASE WHEN event_id % 7 > 0 THEN (event_id % 2)::VARCHAR END AS raw FROM events)
"""


def readings(spark, d) -> DataFrame:
    e = load(spark, d, "events")
    i, kind = F.col("event_id"), F.col("event_type")

    def turn(n, *xs):
        return F.element_at(F.array(*[F.lit(x) for x in xs]), (i % n + 1).cast("int"))

    items = F.array(F.concat(F.lit("a"), (i % 3).cast("string")), F.concat(turn(2, "B", "b "), (i % 2).cast("string")))
    text = F.substring(F.repeat(F.concat(F.lit("word"), (F.col("user_id") % 3).cast("string"), F.lit(" ")), 40), F.lit(1), turn(5, 158, 159, 160, 200, 90))
    return e.select(
        "user_id", "event_type", "ts", "event_id", F.when(~kind.isin("view", "signup"), F.round("value")).alias("num"), F.when(kind == "view", items).alias("items"), F.when(kind == "signup", text).alias("text"),
        F.when(kind == "purchase", "mm").when(kind == "click", "dB").alias("unit"), (i % 5).cast("int").alias("tier"), F.when(i % 11 != 0, (i % 4).cast("string")).alias("doc"), F.when(i % 3 == 0, F.concat(F.lit("r"), (i % 2).cast("string"))).alias("revision"),
        F.concat(F.lit("1."), (i % 12).cast("string")).alias("reader"), F.date_format("ts", "yyyy-MM-dd").alias("read_on"), F.when(i % 7 > 0, (i % 2).cast("string")).alias("raw"),
    )


CUT_SQL = "(short <> long AND length(short) BETWEEN 158 AND 160 AND length(rtrim(regexp_replace(short, '\\S*$', ''))) >= 96 AND starts_with(long, rtrim(regexp_replace(short, '\\S*$', ''))))"


@query(f"""WITH RECURSIVE {READINGS_SQL}, e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM readings),
m AS (SELECT user_id, event_type, r, num, items, text, unit, tier, doc, revision, version, read_on, raw, CASE WHEN tier <= 2 THEN 'verified' ELSE 'unverified' END AS state, 0 AS n_agree, 0 AS n_conflict, 'insert' AS action, NULL::VARCHAR AS rule FROM e WHERE r = 1
  UNION ALL SELECT user_id, event_type, r, CASE WHEN takes THEN n_num ELSE num END, CASE WHEN action = 'list_union' THEN list_transform(list_sort(list_transform(list_distinct(list_transform(items || n_items, lambda x: trim(lower(x)))), lambda k: list_position(list_transform(items || n_items, lambda x: trim(lower(x))), k))), lambda p: (items || n_items)[p]) WHEN takes THEN n_items ELSE items END,
    CASE WHEN takes THEN n_text ELSE text END, CASE WHEN takes THEN n_unit ELSE unit END, CASE WHEN takes THEN n_tier ELSE tier END, CASE WHEN takes THEN n_doc ELSE doc END, CASE WHEN takes THEN n_revision ELSE revision END, CASE WHEN takes THEN n_version ELSE version END,
    CASE WHEN takes THEN n_read_on ELSE read_on END, CASE WHEN takes THEN n_raw ELSE raw END,
    CASE WHEN action = 'corroborate' THEN 'corroborated' WHEN starts_with(action, 'conflict') THEN 'conflict' WHEN takes THEN CASE WHEN n_tier <= 2 THEN 'verified' ELSE 'unverified' END ELSE state END,
    n_agree + (action IN ('corroborate', 'agree_same_doc'))::INT, n_conflict + (starts_with(action, 'conflict') OR action IN ('protected', 'revision_change', 'supersede'))::INT, action, CASE WHEN action = 'supersede' THEN 'same_doc_reextraction' WHEN action IN ('corroborate', 'agree_same_doc') THEN agreed END
  FROM (SELECT *, action IN ('revision_change', 'supersede', 'conflict_lower_tier_wins') AS takes FROM (SELECT *, CASE WHEN tier = 0 AND agreed IS NULL THEN 'protected' WHEN agreed IS NOT NULL AND doc IS DISTINCT FROM n_doc AND tier <= 2 AND n_tier <= 2 THEN 'corroborate' WHEN agreed IS NOT NULL THEN 'agree_same_doc'
      WHEN doc = n_doc AND revision <> n_revision THEN 'revision_change' WHEN doc = n_doc AND tier = n_tier AND (version < n_version OR version = n_version AND read_on < n_read_on) AND raw = n_raw THEN 'supersede'
      WHEN doc = n_doc AND tier = n_tier AND items IS NOT NULL THEN 'list_union' WHEN n_tier < tier THEN 'conflict_lower_tier_wins' WHEN n_tier > tier THEN 'conflict_higher_tier_rejected' ELSE 'conflict_held' END AS action
    FROM (SELECT *, CASE WHEN abs(num - n_num) < 1e-6 OR items = n_items OR text = n_text THEN 'exact' WHEN coalesce(unit, n_unit) = 'mm' AND num * n_num > 0 AND abs(num - n_num) <= 0.02 * greatest(abs(num), abs(n_num)) THEN 'numeric_tolerance'
        WHEN list_sort(list_distinct(list_transform(items, lambda x: trim(lower(x))))) = list_sort(list_distinct(list_transform(n_items, lambda x: trim(lower(x))))) THEN 'set_equal' WHEN text IS NOT NULL AND {CUT_SQL} THEN 'prefix_truncated' END AS agreed
      FROM (SELECT m.user_id, m.event_type, e.r, m.num, m.items, m.text, m.unit, m.tier, m.doc, m.revision, m.version, m.read_on, m.raw, m.state, m.n_agree, m.n_conflict, e.num AS n_num, e.items AS n_items, e.text AS n_text, e.unit AS n_unit, e.tier AS n_tier, e.doc AS n_doc, e.revision AS n_revision, e.version AS n_version,
          e.read_on AS n_read_on, e.raw AS n_raw, CASE WHEN length(m.text) <= length(e.text) THEN m.text ELSE e.text END AS short, CASE WHEN length(m.text) <= length(e.text) THEN e.text ELSE m.text END AS long
        FROM m JOIN e ON e.user_id = m.user_id AND e.event_type = m.event_type AND e.r = m.r + 1)))))
SELECT user_id, event_type, r AS n, num, array_to_string(items, ',') AS items, length(text) AS text_length, tier, doc, state, n_agree::BIGINT AS n_agree, n_conflict::BIGINT AS n_conflict, action AS last_action, rule AS last_rule FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY r DESC) AS last FROM m) WHERE last = 1""")
def merge_fold(spark, d):
    out = merge_readings(readings(spark, d), ["user_id", "event_type"], ["ts", "event_id"])
    return out.withColumn("items", F.array_join("items", ",")).withColumn("text_length", F.length("text").cast("long")).drop("text")


@query(f"WITH {READINGS_SQL} SELECT event_id FROM readings WHERE tier > 0 AND tier <= 2 AND doc IS NULL")
def unsourced_facts(spark, d):
    r = readings(spark, d).withColumn("state", F.when(F.col("tier") <= 2, "verified").otherwise("unverified"))
    return r.where(unsourced(F.col("state"), F.col("tier"), F.col("doc"))).select("event_id")


# What a merge writes: every thirteenth event states a gap; all others are readings

def effects_sql(readings_sql: str, gap: str) -> str:
    """The fold over `readings`, one reading after the other; gap: a condition that makes a reading state a gap."""
    return f"""{readings_sql}, e AS (SELECT * REPLACE (CASE WHEN NOT ({gap}) THEN num END AS num, CASE WHEN NOT ({gap}) THEN items END AS items, CASE WHEN NOT ({gap}) THEN text END AS text), ({gap}) OR coalesce(num IS NULL AND items IS NULL AND text IS NULL, true) AS gap,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM readings),
m AS (SELECT user_id, event_type, r, event_id, ts, CASE WHEN gap THEN 'gap_stored' WHEN tier BETWEEN 1 AND 2 AND doc IS NULL THEN 'refused_no_document' ELSE 'insert' END AS action, NULL::VARCHAR AS rule, false AS withheld,
    CASE WHEN gap OR tier BETWEEN 1 AND 2 AND doc IS NULL THEN 0 ELSE 1 END AS seq, gap AS has_gap, num, items, text, unit, tier, doc, revision, version, read_on, raw, CASE WHEN tier <= 2 THEN 'verified' ELSE 'unverified' END AS state, []::VARCHAR[] AS docs,
    NULL::DOUBLE AS k_num, NULL::VARCHAR[] AS k_items, NULL::VARCHAR AS k_text, NULL::DOUBLE AS j_num, NULL::VARCHAR[] AS j_items, NULL::VARCHAR AS j_text, NULL::VARCHAR AS reason FROM e WHERE r = 1
  UNION ALL SELECT user_id, event_type, r, event_id, ts, act, CASE WHEN act = 'supersede' THEN 'same_doc_reextraction' WHEN act IN ('corroborate', 'agree_same_doc') THEN agreed WHEN act = 'list_union' THEN covers END, act = 'corroborate' AND tier > 0 AND doc IS NULL,
    seq + (act IN ('insert', 'revision_change', 'supersede', 'list_union'))::INT, has_gap OR act = 'gap_stored',
    CASE WHEN takes THEN n_num ELSE num END, CASE WHEN act = 'list_union' THEN list_transform(list_sort(list_transform(list_distinct(list_transform(items || n_items, lambda x: trim(lower(x)))), lambda k: list_position(list_transform(items || n_items, lambda x: trim(lower(x))), k))), lambda p: (items || n_items)[p]) WHEN takes THEN n_items ELSE items END,
    CASE WHEN takes THEN n_text ELSE text END, CASE WHEN takes THEN n_unit ELSE unit END, CASE WHEN takes THEN n_tier ELSE tier END, CASE WHEN takes THEN n_doc ELSE doc END, CASE WHEN takes THEN n_revision ELSE revision END, CASE WHEN takes THEN n_version ELSE version END, CASE WHEN takes THEN n_read_on ELSE read_on END,
    CASE WHEN takes THEN n_raw WHEN act = 'list_union' AND covers <> 'list_superset' THEN left(coalesce(raw, '') || ' ; ' || coalesce(n_raw, ''), 2000) ELSE raw END,
    CASE WHEN act = 'corroborate' AND (tier = 0 OR doc IS NOT NULL) THEN 'corroborated' WHEN starts_with(act, 'conflict') THEN 'conflict' WHEN takes THEN CASE WHEN n_tier <= 2 THEN 'verified' ELSE 'unverified' END ELSE state END,
    CASE WHEN takes OR act = 'list_union' THEN [] WHEN act = 'corroborate' THEN list_append(docs, coalesce(n_doc, '-')) ELSE docs END,
    CASE WHEN wins THEN n_num ELSE num END, CASE WHEN wins THEN n_items ELSE items END, CASE WHEN wins THEN n_text ELSE text END, CASE WHEN wins THEN num ELSE n_num END, CASE WHEN wins THEN items ELSE n_items END, CASE WHEN wins THEN text ELSE n_text END,
    CASE act WHEN 'protected' THEN 'operator-reviewed value is protected (tier 0)' WHEN 'conflict_lower_tier_wins' THEN 'lower tier wins (' || n_tier || ' < ' || tier || ') but sources disagree' WHEN 'conflict_higher_tier_rejected' THEN 'higher tier rejected (' || n_tier || ' > ' || tier || ') and sources disagree'
      WHEN 'conflict_held' THEN 'same-tier sources disagree; field held' WHEN 'revision_change' THEN 'REVISION_CHANGE ' || revision || ' -> ' || n_revision WHEN 'supersede' THEN 'SAME_DOC_REEXTRACTION norm_v 1.' || version || ' -> 1.' || n_version || ' on ' || doc END
  FROM (SELECT *, act IN ('insert', 'revision_change', 'supersede') AS takes, act IN ('revision_change', 'supersede', 'conflict_lower_tier_wins') AS wins,
      CASE WHEN len(list_filter(list_transform(n_items, lambda x: trim(lower(x))), lambda x: NOT list_contains(list_transform(items, lambda y: trim(lower(y))), x))) = 0 THEN 'list_superset' WHEN len(list_filter(list_transform(items, lambda x: trim(lower(x))), lambda x: NOT list_contains(list_transform(n_items, lambda y: trim(lower(y))), x))) = 0 THEN 'list_subset' ELSE 'list_overlap' END AS covers
    FROM (SELECT *, CASE WHEN gap THEN CASE WHEN seq > 0 THEN 'gap_refused' WHEN has_gap THEN 'gap_known' ELSE 'gap_stored' END WHEN seq = 0 AND n_tier BETWEEN 1 AND 2 AND n_doc IS NULL THEN 'refused_no_document' WHEN seq = 0 THEN 'insert'
        WHEN tier = 0 AND agreed IS NULL THEN 'protected' WHEN agreed IS NOT NULL AND doc IS DISTINCT FROM n_doc AND tier <= 2 AND n_tier <= 2 AND NOT list_contains(docs, coalesce(n_doc, '-')) THEN 'corroborate' WHEN agreed IS NOT NULL THEN 'agree_same_doc'
        WHEN doc = n_doc AND revision <> n_revision THEN 'revision_change' WHEN doc = n_doc AND tier = n_tier AND (version < n_version OR version = n_version AND read_on < n_read_on) AND raw = n_raw THEN 'supersede'
        WHEN doc = n_doc AND tier = n_tier AND items IS NOT NULL THEN 'list_union' WHEN n_tier < tier THEN 'conflict_lower_tier_wins' WHEN n_tier > tier THEN 'conflict_higher_tier_rejected' ELSE 'conflict_held' END AS act
      FROM (SELECT *, CASE WHEN abs(num - n_num) < 1e-6 OR items = n_items OR text = n_text THEN 'exact' WHEN coalesce(unit, n_unit) NOT IN ('°C', '°F', 'dBm', 'dB') AND num * n_num > 0 AND abs(num - n_num) <= 0.02 * greatest(abs(num), abs(n_num)) THEN 'numeric_tolerance'
          WHEN list_sort(list_distinct(list_transform(items, lambda x: trim(lower(x))))) = list_sort(list_distinct(list_transform(n_items, lambda x: trim(lower(x))))) THEN 'set_equal' WHEN text IS NOT NULL AND {CUT_SQL} THEN 'prefix_truncated' END AS agreed
        FROM (SELECT m.user_id, m.event_type, e.r, e.event_id, e.ts, e.gap, m.seq, m.has_gap, m.docs, m.num, m.items, m.text, m.unit, m.tier, m.doc, m.revision, m.version, m.read_on, m.raw, m.state, e.num AS n_num, e.items AS n_items, e.text AS n_text, e.unit AS n_unit, e.tier AS n_tier, e.doc AS n_doc, e.revision AS n_revision,
            e.version AS n_version, e.read_on AS n_read_on, e.raw AS n_raw, CASE WHEN length(m.text) <= length(e.text) THEN m.text ELSE e.text END AS short, CASE WHEN length(m.text) <= length(e.text) THEN e.text ELSE m.text END AS long
          FROM m JOIN e ON e.user_id = m.user_id AND e.event_type = m.event_type AND e.r = m.r + 1)))))
"""


EFFECTS_SQL = effects_sql(READINGS_SQL.strip(), "event_id % 13 = 0")
ROWS_SQL = """f AS (SELECT user_id, event_type, seq, min_by(event_id, r) AS since, arg_max(struct_pack(num := num, items := items, text := text, tier := tier, doc := doc, raw := raw, state := state), r) AS v FROM m WHERE seq > 0 GROUP BY ALL
  UNION ALL SELECT user_id, event_type, 0, event_id, struct_pack(num := NULL, items := NULL, text := NULL, tier := NULL, doc := NULL, raw := NULL, state := 'gap_confirmed') FROM m WHERE action = 'gap_stored')"""


def effects(spark, d) -> Effects:
    gap = F.col("event_id") % 13 == 0
    stated = readings(spark, d)
    return merge_effects(stated.withColumns({c: F.when(~gap, F.col(c)) for c in ("num", "items", "text")}), ["user_id", "event_type"], ["ts", "event_id"])


def shown(value: str, *names: str) -> list:
    """A value as a number, a joined list and the length of a text."""
    return [F.col(f"{value}.num").alias(names[0]), F.array_join(f"{value}.items", ",").alias(names[1]), F.length(f"{value}.text").cast("long").alias(names[2])]


@query(f"WITH RECURSIVE {EFFECTS_SQL.strip()} SELECT event_id, action, rule, CASE WHEN action IN ('gap_known', 'gap_refused', 'refused_no_document') THEN NULL ELSE seq END::BIGINT AS seq, withheld FROM m")
def merge_actions(spark, d):
    return effects(spark, d).actions.select("at.event_id", "action", "rule", "seq", "withheld")


@query(f"WITH RECURSIVE {EFFECTS_SQL.strip()}, {ROWS_SQL} SELECT user_id, event_type, seq::BIGINT AS seq, since, v.num AS num, array_to_string(v.items, ',') AS items, length(v.text) AS text_length, v.tier AS tier, v.doc AS doc, v.raw AS raw, v.state AS state, lead(seq) OVER w::BIGINT AS superseded_by, lead(since) OVER w AS until FROM f WINDOW w AS (PARTITION BY user_id, event_type ORDER BY seq)")
def merge_history(spark, d):
    f = effects(spark, d).facts
    return f.select("user_id", "event_type", "seq", F.col("since.event_id").alias("since"), "num", F.array_join("items", ",").alias("items"), F.length("text").cast("long").alias("text_length"), "tier", "doc", "raw", "state", "superseded_by", F.col("until.event_id").alias("until"))


@query(f"WITH RECURSIVE {EFFECTS_SQL.strip()}, {ROWS_SQL} SELECT user_id, event_type, v.num AS num, array_to_string(v.items, ',') AS items, length(v.text) AS text_length, v.tier AS tier, v.doc AS doc, v.state AS state FROM f QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY seq DESC) = 1")
def merge_current(spark, d):
    return effects(spark, d).facts.where("until is null").select("user_id", "event_type", "num", F.array_join("items", ",").alias("items"), F.length("text").cast("long").alias("text_length"), "tier", "doc", "state")


@query(f"WITH RECURSIVE {EFFECTS_SQL.strip()} SELECT event_id, k_num AS kept_num, array_to_string(k_items, ',') AS kept_items, length(k_text) AS kept_length, j_num AS rejected_num, array_to_string(j_items, ',') AS rejected_items, length(j_text) AS rejected_length, reason, CASE action WHEN 'supersede' THEN 'rule:same_doc_reextraction' WHEN 'revision_change' THEN action END AS resolution FROM m WHERE reason IS NOT NULL")
def merge_conflicts(spark, d):
    c = effects(spark, d).conflicts
    return c.select("at.event_id", *shown("kept", "kept_num", "kept_items", "kept_length"), *shown("rejected", "rejected_num", "rejected_items", "rejected_length"), "reason", "resolution")


@query(f"WITH RECURSIVE {EFFECTS_SQL.strip()} SELECT m.user_id, m.event_type, m.seq::BIGINT AS seq, CASE WHEN action = 'corroborate' THEN e.doc ELSE m.doc END AS doc, m.event_id, CASE WHEN action = 'corroborate' THEN e.raw ELSE m.raw END AS raw FROM m JOIN e USING (event_id) WHERE action IN ('insert', 'revision_change', 'supersede', 'list_union', 'corroborate')")
def merge_evidence(spark, d):
    return effects(spark, d).evidence.select("user_id", "event_type", "seq", "doc", "at.event_id", "raw")
