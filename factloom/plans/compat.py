"""Records of a compatibility matrix made from orders and their lines, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compat as x
from ..sources.tables import load
from .identity import REFUSAL_SQL, TRIMMED_SQL
from .queries import query

HOSTS = ("example.org", "www.example.org")

#: Every order is a record: platforms, optics, and orders in work, which are neither; its lines are the numbers it names.
RECORDS_SQL = f"""lines AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 13 = 0 THEN 'XX.XX' WHEN l_partkey % 17 = 0 THEN '10GBASE-SR' WHEN l_partkey % 190 = 0 THEN 'Mar-' || l_partkey % 28 ELSE 'O-' || l_partkey || '-' || l_linestatus END AS token,
  CASE WHEN l_suppkey % 9 = 1 THEN 'http://' WHEN l_suppkey % 9 > 6 THEN 'https://WWW.' ELSE 'https://' END || CASE WHEN l_suppkey % 10 = 3 THEN 'exampleXorg/' ELSE 'example.org/' END AS url, l_returnflag = 'R' AS is_module FROM lineitem),
judged AS (SELECT *, {REFUSAL_SQL} AS refusal, token = 'XX.XX' AS unknown, starts_with(lower(url), 'https://example.org/') OR starts_with(lower(url), 'https://www.example.org/') AS here FROM (SELECT *, {TRIMMED_SQL} FROM lines)),
own AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, token, url) = 1),
records AS (SELECT o_orderkey, o_custkey % 7 AS load, CASE o_orderstatus WHEN 'F' THEN 'platform-compat' WHEN 'O' THEN 'transceiver' ELSE 'other' END AS type, CASE WHEN o_orderkey % 31 = 0 THEN 'a b' ELSE 'Q' || o_orderkey + 10 END AS query, CASE o_orderkey % 5 WHEN 0 THEN 'Y' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN '' WHEN 3 THEN NULL ELSE CASE WHEN o_orderkey % 9 = 0 THEN 'soon' ELSE 'no' END END AS ends FROM orders),
found AS (SELECT o_orderkey, 'unknown type "other"' AS problem FROM records WHERE type = 'other' UNION SELECT o_orderkey, 'family_query "a b" is no query' FROM records WHERE type = 'platform-compat' AND query = 'a b' UNION SELECT o_orderkey, 'end_of_sale "soon" is neither a date nor a flag' FROM records WHERE type = 'transceiver' AND ends = 'soon'
  UNION SELECT o_orderkey, 'no compatible optic' FROM records r WHERE type = 'platform-compat' AND NOT EXISTS (SELECT 1 FROM judged WHERE l_orderkey = o_orderkey AND NOT is_module)
  UNION SELECT o_orderkey, CASE WHEN type = 'transceiver' THEN 'equivalent' WHEN is_module THEN 'module' ELSE 'optic' END || ' "' || token || '" is no part number' FROM records JOIN judged ON l_orderkey = o_orderkey WHERE type <> 'other' AND refusal IS NOT NULL AND NOT (unknown AND NOT (type = 'platform-compat' AND is_module))
  UNION SELECT o_orderkey, 'sku "' || coalesce(token, '') || '" is no part number' FROM records LEFT JOIN own ON l_orderkey = o_orderkey WHERE type = 'transceiver' AND (token IS NULL OR refusal IS NOT NULL AND NOT unknown)
  UNION SELECT o_orderkey, 'datasheet ' || url || ' is elsewhere' FROM records JOIN own ON l_orderkey = o_orderkey WHERE type = 'transceiver' AND NOT here
  UNION SELECT o_orderkey, 'source ' || url || ' is elsewhere' FROM records JOIN judged ON l_orderkey = o_orderkey WHERE type = 'platform-compat' AND NOT is_module AND NOT here)"""


def records(spark, d):
    k, p, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    named = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    token = F.when(p % 13 == 0, "XX.XX").when(p % 17 == 0, "10GBASE-SR").when(p % 190 == 0, named("Mar-", p % 28)).otherwise(named("O-", p, "-", F.col("l_linestatus")))
    url = F.concat(F.when(s % 9 == 1, "http://").when(s % 9 > 6, "https://WWW.").otherwise("https://"), F.when(s % 10 == 3, "exampleXorg/").otherwise("example.org/"))
    module = F.col("l_returnflag") == "R"
    lines = load(spark, d, "lineitem").select(k.alias("o_orderkey"), "l_linenumber", token.alias("sku"), url.alias("source_url"), module.alias("module"))
    entry = F.struct("sku", "source_url")
    held = lines.groupBy("o_orderkey").agg(
        F.collect_list(F.when(~F.col("module"), entry)).alias("optics"), F.collect_list(F.when(F.col("module"), F.col("sku"))).alias("modules"),
        F.collect_list(entry).alias("equivalents"), F.min(F.struct("l_linenumber", "sku", "source_url")).alias("own"),
    )
    o = load(spark, d, "orders")
    key = F.col("o_orderkey")
    ends = F.when(key % 5 == 0, "Y").when(key % 5 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(key % 5 == 2, "").when(key % 5 == 4, F.when(key % 9 == 0, "soon").otherwise("no"))
    kind = F.when(F.col("o_orderstatus") == "F", "platform-compat").when(F.col("o_orderstatus") == "O", "transceiver").otherwise("other")
    return o.join(held, "o_orderkey", "left").select(
        "o_orderkey", (F.col("o_custkey") % 7).alias("load"), kind.alias("type"), F.col("own.sku").alias("sku"), F.when(key % 31 == 0, "a b").otherwise(named("Q", key + 10)).alias("family_query"),
        F.col("own.source_url").alias("datasheet_url"), ends.alias("end_of_sale"), "modules", F.col("optics").alias("compatible_optics"), F.col("equivalents").alias("compat"),
    )


@query(f"WITH {RECORDS_SQL} SELECT o_orderkey, type, string_agg(problem, '; ' ORDER BY problem) AS problems FROM found JOIN records USING (o_orderkey) GROUP BY 1, 2")
def compatibility_problems(spark, d):
    return x.problems(records(spark, d), HOSTS).where(F.size("problems") > 0).select("o_orderkey", "type", F.array_join("problems", "; ").alias("problems"))


@query(f"""WITH {RECORDS_SQL}, f AS (SELECT o_orderkey, bool_or(problem = 'no compatible optic') AS empty FROM found GROUP BY 1)
SELECT load, checked, precision, recall, CASE WHEN precision >= 0.7 AND recall = 1 THEN 'pass' ELSE 'fail' END AS verdict FROM (SELECT load, count(*) AS checked, round(count(*) FILTER (f.o_orderkey IS NULL) / count(*), 4) AS precision, round(count(*) FILTER (NOT coalesce(empty, false)) / count(*), 4) AS recall FROM records LEFT JOIN f USING (o_orderkey) GROUP BY 1)""")
def compatibility_gate(spark, d):
    return x.gate(x.problems(records(spark, d), HOSTS), ["load"], 0.7)


@query(f"""WITH {RECORDS_SQL} SELECT CASE WHEN problem LIKE '%is elsewhere' THEN split_part(problem, ' ', 1) || ' is elsewhere' ELSE regexp_replace(problem, '"[^"]*"', '""') END AS problem, count(*) AS n FROM found GROUP BY 1""")
def compatibility_problem_counts(spark, d):
    return x.problem_counts(x.problems(records(spark, d), HOSTS))
