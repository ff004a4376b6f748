"""A product warehouse derived from the test tables, as DataFrames and as SQL.  Every fifth part has no life cycle, so that its
absence can be asked for.

parts, life cycles, relations, checks, evidence, conflicts, images, runs and documents of a catalogue: every row is taken
from a row of the given tables, so all of them grow with those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..sources.tables import load

SKU_SQL = "p_type || '-' || p_partkey || CASE WHEN p_size % 5 = 0 THEN '=' ELSE '' END"

PARTS_SQL = f"""
parts AS (SELECT p_partkey AS part_id, p_brand AS vendor, p_type AS category, split_part(p_name, ' ', 1) AS family, CASE WHEN p_partkey % 10 = 3 THEN lower({SKU_SQL}) ELSE {SKU_SQL} END AS sku, p_name AS name,
  CASE WHEN p_size % 6 = 0 THEN 'license' WHEN p_size % 6 = 1 THEN 'accessory' ELSE 'hardware' END AS class, upper({SKU_SQL}) AS sku_norm FROM part)
"""
LIFE_SQL = f"""
life AS (SELECT l_partkey AS part_id, min(l_shipdate)::DATE AS announced, max(l_shipdate)::DATE AS end_of_sale, (max(l_shipdate) + INTERVAL 90 DAY)::DATE AS last_ship, (max(l_shipdate) + INTERVAL 5 YEAR)::DATE AS end_of_support,
  CASE WHEN max(l_shipdate) < TIMESTAMP '2001-06-01' THEN 'end_of_sale' ELSE 'announced' END AS status, CASE l_partkey % 3 WHEN 0 THEN (SELECT {SKU_SQL} FROM part WHERE p_partkey = l_partkey + 7) WHEN 1 THEN 'NX-' || l_partkey END AS successor_sku
  FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY l_partkey)
"""
RELATIONS_SQL = """
relations AS (SELECT from_id, to_id, kind, min(tier) AS tier FROM (SELECT l_partkey AS from_id, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS to_id, CASE l_returnflag WHEN 'R' THEN 'successor' WHEN 'A' THEN 'predecessor' ELSE 'compatible' END AS kind, (l_suppkey % 5)::INT AS tier FROM lineitem)
  WHERE to_id IS NOT NULL AND to_id <> from_id GROUP BY ALL)
"""
EVIDENCE_SQL = "evidence AS (SELECT l_partkey AS part_id, 'weight' AS field_key, (l_suppkey % 5)::INT AS tier, l_orderkey AS doc_id, l_quantity AS value, l_shipdate AS seen_at FROM lineitem)"
CHECKS_SQL = "checks AS (SELECT l_partkey AS part_id, 'source' || l_suppkey % 6 AS source, CASE WHEN l_returnflag = 'N' THEN 'not_listed' ELSE 'ok' END AS outcome, max(l_shipdate) AS checked_at, count(*) AS times FROM lineitem GROUP BY ALL)"
RUNS_SQL = "runs AS (SELECT o_orderkey AS run_id, o_orderpriority AS kind, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_orderdate AS started_at FROM orders)"
WAREHOUSE = {"parts": PARTS_SQL, "life": LIFE_SQL, "relations": RELATIONS_SQL, "evidence": EVIDENCE_SQL, "checks": CHECKS_SQL, "runs": RUNS_SQL}


def with_tables(sql: str, *names: str) -> str:
    """SQL over these tables of the warehouse; what begins with a comma adds tables of its own."""
    return f"WITH {', '.join(WAREHOUSE[n].strip() for n in names)} {sql}"


def sku() -> Column:
    return F.concat(F.col("p_type"), F.lit("-"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 5 == 0, "=").otherwise(""))


def parts(spark: SparkSession, d: str) -> DataFrame:
    own = F.when(F.col("p_partkey") % 10 == 3, F.lower(sku())).otherwise(sku())
    kind = F.when(F.col("p_size") % 6 == 0, "license").when(F.col("p_size") % 6 == 1, "accessory").otherwise("hardware")
    return load(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_brand").alias("vendor"), F.col("p_type").alias("category"), F.split("p_name", " ")[0].alias("family"), own.alias("sku"), F.col("p_name").alias("name"), kind.alias("class"), F.upper(sku()).alias("sku_norm"))


def life(spark: SparkSession, d: str) -> DataFrame:
    last = F.max("l_shipdate")
    dated = load(spark, d, "lineitem").where("l_partkey % 5 <> 0").groupBy(F.col("l_partkey").alias("part_id")).agg(F.to_date(F.min("l_shipdate")).alias("announced"), last.alias("last"))
    later = load(spark, d, "part").select((F.col("p_partkey") - 7).alias("part_id"), sku().alias("later"))
    out = dated.join(later, "part_id", "left")
    turn = F.col("part_id") % 3
    return out.select(
        "part_id", "announced", F.to_date("last").alias("end_of_sale"), F.to_date(F.col("last") + F.expr("interval 90 days")).alias("last_ship"), F.to_date(F.col("last") + F.expr("interval 5 years")).alias("end_of_support"),
        F.when(F.col("last") < F.lit("2001-06-01").cast("timestamp_ntz"), "end_of_sale").otherwise("announced").alias("status"), F.when(turn == 0, F.col("later")).when(turn == 1, F.concat(F.lit("NX-"), F.col("part_id").cast("string"))).alias("successor_sku"),
    )


def relations(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    kind = F.when(F.col("l_returnflag") == "R", "successor").when(F.col("l_returnflag") == "A", "predecessor").otherwise("compatible")
    lines = load(spark, d, "lineitem").select(F.col("l_partkey").alias("from_id"), F.lead("l_partkey").over(w).alias("to_id"), kind.alias("kind"), (F.col("l_suppkey") % 5).cast("int").alias("tier"))
    return lines.where("to_id is not null and to_id <> from_id").groupBy("from_id", "to_id", "kind").agg(F.min("tier").alias("tier"))


def evidence(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select(F.col("l_partkey").alias("part_id"), F.lit("weight").alias("field_key"), (F.col("l_suppkey") % 5).cast("int").alias("tier"), F.col("l_orderkey").alias("doc_id"), F.col("l_quantity").alias("value"), F.col("l_shipdate").alias("seen_at"))


def checks(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.col("l_returnflag") == "N", "not_listed").otherwise("ok")
    lines = load(spark, d, "lineitem").select(F.col("l_partkey").alias("part_id"), F.concat(F.lit("source"), (F.col("l_suppkey") % 6).cast("string")).alias("source"), outcome.alias("outcome"), "l_shipdate")
    return lines.groupBy("part_id", "source", "outcome").agg(F.max("l_shipdate").alias("checked_at"), F.count(F.lit(1)).alias("times"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("kind"), status.alias("status"), F.col("o_orderdate").alias("started_at"))
