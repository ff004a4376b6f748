"""Files of every kind that the sources read, written from the tables into the shared folder and read back, and the same in SQL.

A file holds a block of rows, of a fixed number of keys, so that files grow in number and not in size.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.text import canonical_json
from ..sources import tables
from ..sources.checkpoints import shared_folder
from ..sources.tables import load
from .queries import query

BLOCK = 100


def blocks(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("block", F.floor(F.col(key) / BLOCK))


def written(documents: DataFrame) -> str:
    """The folder with a JSON file for each row, its block in the path."""
    path = f"{shared_folder(documents.sparkSession)}/files-{uuid.uuid4().hex}"
    documents.repartition("block").write.partitionBy("block").json(path)
    return path


def said(*parts):
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


# Extracts: a record for each label of each part, and one for the document

def extract(spark, d):
    p, k = blocks(load(spark, d, "part"), "p_partkey"), F.col("p_partkey")
    record = lambda label, value: F.struct(said("AX-", k).alias("sku"), F.lit(label).alias("label"), value.cast("string").alias("value"), said("t1:r", k % BLOCK).alias("locator"), F.when(F.lit(False), True).alias("__doc__"), F.lit(None).cast("string").alias("source_url"), F.lit(None).cast("array<string>").alias("pid_list"))
    facts = p.select("block", F.explode(F.array(record("Brand", F.col("p_brand")), record("Size", F.when(k % 3 > 0, F.col("p_size"))))).alias("r"))
    whole = p.groupBy("block").agg(F.sort_array(F.collect_list(said("AX-", k))).alias("pid_list"))  # at most BLOCK
    none = [F.lit(None).cast("string").alias(c) for c in ("sku", "label", "value", "locator")]
    documents = whole.select("block", F.struct(*none, F.lit(True).alias("__doc__"), said("https://example.org/", F.col("block")).alias("source_url"), "pid_list").alias("r"))
    out = facts.unionByName(documents).groupBy("block").agg(F.collect_list("r").alias("records"))  # at most 2 * BLOCK + 1
    return written(out.withColumn("source", said("s", F.col("block") % 4)))


@query("SELECT 's' || p_partkey // 100 % 4 AS source, 'AX-' || p_partkey AS sku, label, CASE label WHEN 'Brand' THEN p_brand WHEN 'Size' THEN CASE WHEN p_partkey % 3 > 0 THEN p_size::VARCHAR END END AS value, 't1:r' || p_partkey % 100 AS locator FROM part, (VALUES ('Brand'), ('Size')) t(label)")
def extract_facts(spark, d):
    return tables.read_extract(spark, extract(spark, d))[1].select("source", "sku", "label", "value", "locator")


@query("SELECT 's' || p_partkey // 100 % 4 AS source, 'https://example.org/' || p_partkey // 100 AS source_url, string_agg('AX-' || p_partkey, ' ' ORDER BY 'AX-' || p_partkey) AS pids FROM part GROUP BY p_partkey // 100")
def extract_documents(spark, d):
    return tables.read_extract(spark, extract(spark, d))[0].select("source", "source_url", F.array_join("pid_list", " ").alias("pids"))


# Acquired pages: one supplier is the page's own, the others of its block are named by it

ITEM = "name: string, balance: double, nation: bigint"


@query("SELECT 'https://example.org/' || s_suppkey // 10 AS url, s_name AS name, s_acctbal AS balance, s_nationkey AS nation FROM supplier")
def acquired_items(spark, d):
    s = load(spark, d, "supplier").withColumn("block", F.floor(F.col("s_suppkey") / 10))
    item = F.struct(F.col("s_name").alias("name"), F.col("s_acctbal").cast("double").alias("balance"), F.col("s_nationkey").cast("long").alias("nation"))
    held = s.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", item.alias("i")))).alias("all"))  # at most 10
    first, others = F.col("all")[0]["i"], F.transform(F.slice("all", 2, 10), lambda x: x["i"])
    result = F.struct(*[first[c].alias(c) for c in ("name", "balance", "nation")], F.when(F.size("all") > 1, others).alias("others"))
    url = said("https://example.org/", F.col("block"))
    path = written(held.select("block", F.lit("s").alias("source"), url.alias("url"), url.alias("final_url"), F.lit("2024-01-01").alias("fetched_at"), result.alias("result")))
    schema = T.StructType.fromDDL(f"source string, url string, final_url string, fetched_at string, result struct<{ITEM}, others: array<struct<{ITEM}>>>")
    return tables.read_pages(spark, path, schema).select("url", "name", "balance", "nation")


# Lists of numbers, the first row of each counts

@query("SELECT user_id, event_type, min(event_id) AS first_id, arg_min(value, event_id) AS value, count(*) AS n_seen FROM events GROUP BY 1, 2")
def listed_first(spark, d):
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    rows = load(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("first_id"), F.col("value").cast("double").alias("value"))
    tables.write_report(rows.repartitionByRange("first_id").sortWithinPartitions("first_id"), path)
    return tables.read_first(spark, path, ["user_id", "event_type"], "user_id long, event_type string, first_id long, value double")


# Bulletins and matrices

@query("""SELECT 'E' || o_orderkey AS doc_id, strftime(o_orderdate, '%Y-%m-%d') AS end_of_sale_date, 'A-' || l_partkey AS pid, CASE WHEN l_suppkey % 2 = 0 THEN 'B-' || l_suppkey END AS successor FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey""")
def bulletins_read(spark, d):
    named = F.struct(said("A-", F.col("l_partkey")).alias("pid"), F.when(F.col("l_suppkey") % 2 == 0, said("B-", F.col("l_suppkey"))).alias("successor"))
    lines = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(named).alias("affected_pids"))
    dates = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("end_of_sale_date"))
    o = load(spark, d, "orders").join(lines, "o_orderkey", "left").select("o_orderkey", F.struct(F.lit("v").alias("vendor"), said("E", F.col("o_orderkey")).alias("doc_id"), "affected_pids", dates.alias("lifecycle")).alias("r"))
    path = written(o.groupBy(F.floor(F.col("o_orderkey") / (100 * BLOCK)).alias("block")).agg(F.collect_list("r").alias("records")))
    return tables.read_bulletins(spark, path).select("doc_id", "end_of_sale_date", "pid", "successor")


def matrix(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    optics = F.when(size % 3 > 0, F.transform(F.sequence(F.lit(1), (size % 3).cast("int")), lambda i: F.struct(said("O-", k, "-", i).alias("sku"))))
    pairs = F.when(size % 4 > 0, F.transform(F.sequence(F.lit(1), (size % 4).cast("int")), lambda i: F.struct(said("X-", k, "-", i).alias("sku"), F.lit("equivalent").alias("relation"))))
    platform = k % 2 == 0
    record = F.struct(F.col("p_brand").alias("vendor"), F.when(platform, "platform-compat").otherwise("transceiver").alias("type"), F.when(platform, said("Q", k)).alias("family_query"), F.when(~platform, said("AX-", k)).alias("sku"), F.when(platform, optics).alias("compatible_optics"), F.when(~platform, pairs).alias("compat"))
    return tables.read_compatibility(spark, written(blocks(load(spark, d, "part"), "p_partkey").groupBy("block").agg(F.collect_list(record).alias("records"))))


@query("SELECT p_brand AS vendor, 'Q' || p_partkey AS family_query, 'O-' || p_partkey || '-' || i AS optic FROM (SELECT *, unnest(range(1, 1 + p_size % 3)) AS i FROM part WHERE p_partkey % 2 = 0)")
def platforms_read(spark, d):
    return matrix(spark, d)[0].select("vendor", "family_query", "optic")


@query("SELECT p_brand AS vendor, 'AX-' || p_partkey AS sku, CASE WHEN i > 0 THEN 'X-' || p_partkey || '-' || i END AS target, CASE WHEN i > 0 THEN 'equivalent' END AS relation FROM (SELECT *, unnest(CASE WHEN p_size % 4 = 0 THEN [0] ELSE range(1, 1 + p_size % 4) END) AS i FROM part WHERE p_partkey % 2 = 1)")
def optics_read(spark, d):
    return matrix(spark, d)[1].select("vendor", "sku", "target", "relation")


# Contents

@query("""SELECT p_partkey // 100 AS block, length(x) AS length, sha256(x) AS sha256 FROM (SELECT p_partkey // 100 AS p, string_agg('"' || p_name || '"', ',' ORDER BY p_partkey) AS y, min(p_partkey) AS p_partkey FROM part GROUP BY 1), (SELECT 1) t(one), LATERAL (SELECT '{"names":[' || y || ']}' || chr(10)) u(x)""")
def file_hashes(spark, d):
    named = F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"])  # at most BLOCK
    path = written(blocks(load(spark, d, "part"), "p_partkey").groupBy("block").agg(named.alias("names")))
    return tables.content_hashes(spark, f"{path}/*/*.json").select(F.regexp_extract("path", "block=([0-9]+)", 1).cast("long").alias("block"), "length", "sha256")


@query("""SELECT event_id, '{"a":{"x":[' || user_id || ',2,1],"y":"' || event_type || '"},"k":' || regexp_extract(props, '([0-9]+)', 1) || '}' AS canonical FROM events""")
def canonical_values(spark, d):
    """Objects whose keys stand in another order on every second row."""
    k, y = said('"k": ', F.regexp_extract("props", "([0-9]+)", 1)), said('"y": "', F.col("event_type"), '"')
    x = said('"x":[', F.col("user_id"), ", 2,1 ]")
    a = F.when(F.col("event_id") % 2 == 0, said('"a": {', y, ", ", x, "}")).otherwise(said('"a":{', x, ",", y, "}"))
    text = F.when(F.col("event_id") % 3 == 0, said("{", a, ",", k, "}")).otherwise(said("{", k, " , ", a, "}"))
    return load(spark, d, "events").select("event_id", canonical_json(text).alias("canonical"))
