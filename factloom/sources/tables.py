"""Tables and files: Parquet tables, facts in entity-attribute-value form, JSON extracts, content hashes, snapshots."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

RENDERED = ("verified", "corroborated")


#: Tables of few bytes a row, with their keys.
NARROW = {"part": "p_partkey", "customer": "c_custkey", "supplier": "s_suppkey"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(table, NARROW[name]) if name in NARROW else table


def spread(rows: DataFrame, *key: str) -> DataFrame:
    """The same rows, dealt out by key over all tasks, for joins by shuffle only.

    A million narrow rows are a file of some megabytes.  One or two tasks read it, and would do all that is made of its rows;
    and Spark, which goes by the length of the file, would send them to the driver for a broadcast.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key).hint("merge")


def fact(position: int, key: str, kind: str, text: Column, num=None, low=None, high=None, flag=None, string=None, items=None) -> Column:
    """One attribute of an entity as a struct; kind is n, nr, b, e, s or ls."""

    def typed(x, t: str) -> Column:
        return (F.lit(None) if x is None else x).cast(t)

    return F.struct(
        F.lit(position).alias("position"),
        F.lit(key).alias("field_key"),
        F.lit(kind).alias("field_type"),
        text.cast("string").alias("value_text"),
        typed(num, "double").alias("value_num"),
        typed(low, "double").alias("value_min"),
        typed(high, "double").alias("value_max"),
        typed(flag, "boolean").alias("value_bool"),
        typed(string, "string").alias("value_str"),
        typed(items, "array<string>").alias("value_list"),
    )


def unpivot(entities: DataFrame, part_id: str, facts: list[Column]) -> DataFrame:
    """A row for each fact of each entity; entities are read once."""
    exploded = entities.select(F.col(part_id).alias("part_id"), F.explode(F.array(*facts)).alias("f"))
    return exploded.select("part_id", "f.*")


def part_facts(part: DataFrame) -> DataFrame:
    """The part table as facts with provenance; states, tiers and supersession follow from the keys by fixed rules."""
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    top = (F.col("p_size") + F.col("p_partkey") % 10).cast("double")
    words = F.split("p_name", " ")
    facts = unpivot(
        part,
        "p_partkey",
        [
            fact(1, "brand", "e", F.col("p_brand"), string=F.col("p_brand")),
            fact(2, "type", "e", F.col("p_type"), string=F.col("p_type")),
            fact(3, "size", "n", size, num=size),
            fact(4, "price", "n", price, num=price),
            fact(5, "title", "s", F.col("p_name"), string=F.col("p_name")),
            fact(6, "words", "ls", F.concat(F.lit('["'), F.array_join(words, '","'), F.lit('"]')), items=words),
            fact(7, "span", "nr", F.concat(F.lit('{"max":'), top.cast("string"), F.lit(',"min":'), size.cast("string"), F.lit("}")), low=size, high=top),
            fact(8, "large", "b", F.col("p_size") > 25, flag=F.col("p_size") > 25),
        ],
    )
    turn = (F.col("part_id") + 3 * F.col("position")) % 7
    state = F.when(turn == 0, "unverified").when(turn == 1, "conflict").when(turn == 2, "corroborated").when(turn == 3, "gap_unattempted").otherwise("verified")
    facts = facts.withColumns(
        {
            "state": state,
            "tier": ((F.col("part_id") + F.col("position")) % 5).cast("int"),
            "is_current": (F.col("part_id") + F.col("position")) % 11 != 0,
        }
    )
    gap = F.col("state") == "gap_unattempted"
    values = [c for c in facts.columns if c.startswith("value_")]
    return facts.withColumns({c: F.when(~gap, F.col(c)) for c in values})


def current(facts: DataFrame) -> DataFrame:
    return facts.where("is_current")


def rendered(facts: DataFrame) -> DataFrame:
    """Current facts whose state readers see."""
    return current(facts).where(F.col("state").isin(*RENDERED))


def doc_id(url: Column) -> Column:
    """Identity of a document: the first 16 hex digits of its address's SHA-1."""
    return F.substring(F.sha1(url), 1, 16)


EXTRACT = (
    "source string, generated_at string, records array<struct<sku string, family_scope string, label string, value string, "
    "shape string, locator string, source_url string, __doc__ boolean, pid_list array<string>>>"
)


def read_extract(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """An extract file's documents and facts."""
    rows = spark.read.schema(EXTRACT).option("multiLine", True).json(path).select("source", F.explode("records").alias("r")).select("source", "r.*")
    is_doc = F.coalesce(F.col("__doc__"), F.lit(False))
    return rows.where(is_doc), rows.where(~is_doc)


def read_pages(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Acquired pages from all JSON files below path, the page's own result and those of others it names."""
    pages = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True).json(path)
    others = F.coalesce(F.col("result.others"), F.array())
    own = F.struct(*[F.col(f"result.{f.name}").alias(f.name) for f in schema["result"].dataType["others"].dataType.elementType])
    return pages.select("source", "url", "final_url", "fetched_at", F.explode(F.concat(F.array(own), others)).alias("item")).select("source", "url", "final_url", "fetched_at", "item.*")


def read_first(spark: SparkSession, path: str, key: list[str], schema: str) -> DataFrame:
    """Line-delimited JSON, of each key the first row, and how many rows it had."""
    rows = spark.read.schema(schema).json(path).withColumn("_at", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    columns = [c for c in rows.columns if c not in (*key, "_at")]
    return rows.groupBy(*key).agg(*[F.min_by(c, "_at").alias(c) for c in columns], F.count(F.lit(1)).alias("n_seen"))


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Path, length and SHA-256 of every file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_snapshot(df: DataFrame, base: str, stats: dict | None = None) -> str:
    """Write a whole new version beside the others, then point to it; readers see the old or the new one, never half."""
    spark = df.sparkSession
    version = uuid.uuid4().hex
    df.write.parquet(f"{base}/versions/{version}")
    pointer = spark.createDataFrame([(version, json.dumps(stats or {}))], "version string, stats string")
    pointer.withColumn("written_at", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{base}/manifest")
    return version


def read_snapshot(spark: SparkSession, base: str) -> DataFrame:
    manifest = spark.read.schema("version string, stats string, written_at timestamp").json(f"{base}/manifest")
    last = manifest.orderBy(F.desc("written_at")).first()
    return spark.read.parquet(f"{base}/versions/{last['version']}")


BULLETINS = (
    "records array<struct<vendor string, family_match string, doc_id string, source_url string, verified_at string, affected_pids array<struct<pid string, successor string>>, "
    "lifecycle struct<announce_date string, end_of_sale_date string, last_ship_date string, end_of_sw_maint string, end_of_vuln_support string, last_day_of_support string, status string>>>"
)
COMPATIBILITY = (
    "records array<struct<vendor string, type string, sku string, family_query string, product_family string, datasheet_url string, end_of_sale string, modules array<string>, "
    "compatible_optics array<struct<sku string, source_url string>>, compat array<struct<sku string, relation string, source_url string, note string>>>>"
)


def read_bulletins(spark: SparkSession, path: str) -> DataFrame:
    """A row for each number that a bulletin replaces, with the bulletin's dates."""
    rows = spark.read.schema(BULLETINS).option("multiLine", True).json(path).select(F.explode("records").alias("b"))
    return rows.select("b.vendor", "b.doc_id", "b.source_url", "b.lifecycle.*", F.explode_outer("b.affected_pids").alias("x")).select("*", "x.*").drop("x")


def read_compatibility(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Platforms with each optic that they take, and optics with each number that they go with."""
    rows = spark.read.schema(COMPATIBILITY).option("multiLine", True).json(path).select(F.explode("records").alias("r")).select("r.*")
    platforms = rows.where("type = 'platform-compat'").select("vendor", "family_query", "modules", F.explode("compatible_optics").alias("o")).select("vendor", "family_query", "modules", F.col("o.sku").alias("optic"), "o.source_url")
    optics = rows.where("type = 'transceiver'").select("vendor", "sku", "end_of_sale", F.explode_outer("compat").alias("c")).select("vendor", "sku", "end_of_sale", F.col("c.sku").alias("target"), "c.relation")
    return platforms, optics


def read_config(spark: SparkSession, path: str, *required: str) -> dict:
    """A small configuration file as a dict; a missing key is named in the error."""
    text = spark.read.option("wholetext", True).text(path).first()["value"]  # one file, one row
    config = json.loads(text)
    missing = [k for k in required if k not in config]
    if missing:
        raise KeyError(f"configuration {path} lacks {', '.join(missing)}")
    return config
