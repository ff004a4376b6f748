"""Problems of a dictionary made from the tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dictionary as x
from ..sources.tables import load
from .queries import query

DICTIONARY_SQL = """
fields AS (SELECT 'f' || p_partkey - p_partkey % 50 // 49 AS key, CASE WHEN p_partkey % 30 = 1 THEN 'zz' ELSE ['n', 'e', 's'][1 + p_partkey % 3] END AS kind, CASE WHEN p_size % 3 > 0 THEN 'kg' END AS unit, CASE WHEN p_size % 2 = 0 THEN p_size END AS low, CASE WHEN p_size % 2 = 0 THEN p_partkey % 60 END AS high, CASE WHEN p_size % 4 = 0 THEN [] WHEN p_size % 4 > 1 THEN ['a'] END AS domain, CASE WHEN p_size = 7 THEN ' ' ELSE p_name END AS label FROM part),
aliases AS (SELECT CASE WHEN s_suppkey % 9 = 0 THEN '--' ELSE 'Name ' || s_suppkey // 2 END AS alias, CASE WHEN s_suppkey % 5 = 0 THEN '__skip' WHEN s_suppkey % 7 = 0 THEN 'lost' || s_suppkey ELSE 'f' || s_suppkey END AS field, NULL::VARCHAR AS section, s_nationkey % 2 AS rank FROM supplier),
profiles AS (SELECT DISTINCT p_type AS category, CASE WHEN p_partkey % 41 = 0 THEN 'gone' ELSE 'f' || p_partkey END AS field FROM part),
conditions AS (SELECT p_type AS category, 'f' || p_partkey AS field, 'f' || p_partkey + p_size AS depends_on FROM part WHERE p_size < 6)
"""


def tables(spark, d):
    p, k, size = load(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    named = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    kind = F.when(k % 30 == 1, "zz").otherwise(F.element_at(F.array(F.lit("n"), F.lit("e"), F.lit("s")), (k % 3 + 1).cast("int")))
    even = size % 2 == 0
    fields = p.select(named("f", k - F.floor(k % 50 / 49)).alias("key"), kind.alias("kind"), F.when(size % 3 > 0, "kg").alias("unit"), F.when(even, size).cast("double").alias("low"), F.when(even, k % 60).cast("double").alias("high"), F.when(size % 4 == 0, F.array().cast("array<string>")).when(size % 4 > 1, F.array(F.lit("a"))).alias("domain"), F.when(size == 7, " ").otherwise(F.col("p_name")).alias("label"))
    s = F.col("s_suppkey")
    alias = F.when(s % 9 == 0, "--").otherwise(named("Name ", F.floor(s / 2)))
    field = F.when(s % 5 == 0, "__skip").when(s % 7 == 0, named("lost", s)).otherwise(named("f", s))
    aliases = load(spark, d, "supplier").select(alias.alias("alias"), field.alias("field"), F.lit(None).cast("string").alias("section"), (F.col("s_nationkey") % 2).alias("rank"))
    profiles = p.select(F.col("p_type").alias("category"), F.when(k % 41 == 0, "gone").otherwise(named("f", k)).alias("field")).distinct()
    conditions = p.where("p_size < 6").select(F.col("p_type").alias("category"), named("f", k).alias("field"), named("f", k + size).alias("depends_on"))
    return fields, aliases, profiles, conditions


@query(f"""WITH {DICTIONARY_SQL.strip()} SELECT 'field' AS place, key AS item, 'stated more than once' AS problem FROM fields GROUP BY key HAVING count(*) > 1
  UNION SELECT 'field', key, 'unknown type' FROM fields WHERE kind = 'zz' UNION SELECT 'field', key, 'no label' FROM fields WHERE trim(label) = '' UNION SELECT 'field', key, 'choice without a domain' FROM fields WHERE kind = 'e' AND coalesce(len(domain), 0) = 0
  UNION SELECT 'field', key, 'number without unit and band' FROM fields WHERE kind = 'n' AND unit IS NULL AND low IS NULL UNION SELECT 'field', key, 'band without values' FROM fields WHERE low >= high
  UNION SELECT 'alias', alias, 'field not in the dictionary' FROM aliases WHERE NOT starts_with(field, '__') AND field NOT IN (SELECT key FROM fields) UNION SELECT 'alias', lower(alias), 'several fields at one rank' FROM aliases GROUP BY lower(alias), rank HAVING count(DISTINCT field) > 1 UNION SELECT 'alias', alias, 'no word' FROM aliases WHERE alias = '--'
  UNION SELECT 'profile', category || '/' || field, 'field not in the dictionary' FROM profiles WHERE field NOT IN (SELECT key FROM fields) UNION SELECT 'condition', category || '/' || field, 'field not in the profile' FROM conditions c WHERE NOT EXISTS (SELECT 1 FROM profiles p WHERE p.category = c.category AND p.field = c.field)
  UNION SELECT 'condition', category || '/' || field || '/' || depends_on, 'depends on a field that the profile lacks' FROM conditions c WHERE NOT EXISTS (SELECT 1 FROM profiles p WHERE p.category = c.category AND p.field = c.depends_on)""")
def dictionary_problems(spark, d):
    return x.problems(*tables(spark, d))
