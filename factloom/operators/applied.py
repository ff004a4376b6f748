"""Acquired pages applied as one run: whose part an entry is about, what its labels mean, and all tables that follow from it.

An entry says what a page states of one number: facts as label and value, other names, images, relations, dates.  Everything
is worked out by joins over all entries at once; nothing is written before the gate has read the staged rows again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.normalize import Field
from ..sources import commits
from ..sources.checkpoints import saved
from .effects import merge_effects
from .labels import mapped, unmapped_report

# Kinds of other names, those that name a part, kinds of relations, and the dates of a life cycle.
ALIAS_KINDS = ("gtin", "upc", "ean", "legacy_sku", "variant_sku", "vendor_alias", "distributor_sku")
NAMING_KINDS = ("variant_sku", "legacy_sku", "vendor_alias", "distributor_sku")
RELATION_KINDS = ("successor", "predecessor", "compatible", "module_of", "hosts_module", "supports_transceiver", "bundle_contains", "license_for", "accessory_for", "equivalent")
DATES = ("announced", "end_of_sale", "last_ship", "end_of_support")
STEPS = ("exact", "case", "spare", "spare", "alias", "variant")
#: The share of re-read facts that a run must find on their pages.
LEAST_PRECISION = 0.98

ENTRY = (
    "entry_id long, source string, source_kind string, tier int, page_url string, fetched_at timestamp_ntz, anchor_id long, vendor string, sku string, scope string, not_listed boolean, "
    "facts array<struct<label: string, value: string>>, aliases array<struct<kind: string, value: string>>, images array<struct<url: string, role: string>>, relations array<struct<kind: string, sku: string>>, "
    f"lifecycle struct<{', '.join(f'{d}: string' for d in DATES)}>"
)


MERGED = ("facts", "evidence", "conflicts")
READ = (*MERGED, "checks", "written", "unmapped")
TABLES = ("resolution", *READ, "aliases", "images", "candidates", "relations", "lifecycles")


def flipped(sku: Column) -> Column:
    """A number with the sign of a spare part, or without the one it has."""
    return F.when(F.endswith(sku, F.lit("=")), F.substring(sku, F.lit(1), F.length(sku) - 1)).otherwise(F.concat(sku, F.lit("=")))


def spare_key(sku: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(sku), r"\s+", ""), "=+$", "")


def resolved(entries: DataFrame, parts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entries with outcome (matched, ambiguous, unknown), step, part_id and via (the name that matched, with its kind).

    The part that the queue names counts if its number differs in case or the spare sign only.  Otherwise the ladder: the
    number as written, in other case, with or without the spare sign (as written before other case), a known other name, a
    name that the page itself gives for this entry.  The first step with any part decides, and two parts there decide nothing.
    parts: part_id, vendor, sku; aliases: part_id, kind, value.
    """
    anchors = parts.select(F.col("part_id").alias("anchor_id"), F.col("sku").alias("anchor_sku"), F.col("vendor").alias("anchor_vendor"))
    asked = entries.select("entry_id", "anchor_id", "vendor", "sku", "aliases").join(anchors, "anchor_id", "left")
    same = F.upper("anchor_sku") == F.upper("sku")
    anchored = F.when(F.col("anchor_sku") == F.col("sku"), "exact").when(same, "case").when(spare_key(F.col("anchor_sku")) == spare_key(F.col("sku")), "spare")
    asked = asked.withColumns({"anchored": anchored, "vendor": F.coalesce("anchor_vendor", "vendor")})
    sure = asked.where("anchored is not null").select("entry_id", F.lit("matched").alias("outcome"), F.col("anchored").alias("step"), F.col("anchor_id").alias("part_id"), F.lit(None).cast("string").alias("via_kind"))

    def name(rank: int, text: Column, table: str, kind: Column) -> Column:
        return F.struct(F.lit(rank).alias("rank"), text.alias("name"), F.lit(table).alias("table"), kind.alias("kind"))

    none = F.lit(None).cast("string")
    own = F.array(name(1, F.col("sku"), "parts", none), name(3, flipped(F.col("sku")), "parts", none), name(5, F.col("sku"), "aliases", none))
    given = F.filter("aliases", lambda a: a["kind"].isin(*NAMING_KINDS) & (F.trim(a["value"]) != "") & (F.upper(F.trim(a["value"])) != F.upper("sku")))
    names = F.concat(own, F.coalesce(F.transform(given, lambda a: name(6, F.trim(a["value"]), "parts", a["kind"])), F.array().cast("array<struct<rank: int, name: string, table: string, kind: string>>")))
    looked = asked.where("anchored is null and sku is not null").select("entry_id", "vendor", F.explode(names).alias("n")).select("entry_id", F.col("vendor").alias("asked"), "n.*").withColumn("key", F.upper("name"))
    known = parts.select("part_id", "vendor", F.col("sku").alias("spelt"), F.lit("parts").alias("table"), F.upper("sku").alias("key"))
    other = aliases.where(F.col("kind").isin(*NAMING_KINDS)).join(parts.select("part_id", "vendor"), "part_id").select("part_id", "vendor", F.col("value").alias("spelt"), F.lit("aliases").alias("table"), F.upper("value").alias("key"))
    hits = looked.join(known.unionByName(other).hint("merge"), ["key", "table"]).where("asked is null or asked = vendor")
    rank = F.col("rank") + F.when(F.col("rank").isin(1, 3) & (F.col("name") != F.col("spelt")), 1).otherwise(0)
    counted = hits.withColumn("rank", rank).groupBy("entry_id", "rank").agg(F.countDistinct("part_id").alias("n"), F.min("part_id").alias("part_id"), F.min("kind").alias("via_kind"))
    best = counted.groupBy("entry_id").agg(F.min(F.struct("rank", "n", "part_id", "via_kind")).alias("b"))
    one = F.col("b.n") == 1
    rest = asked.where("anchored is null").select("entry_id").join(best, "entry_id", "left").select(
        "entry_id", F.when(F.col("b").isNull(), "unknown").when(one, "matched").otherwise("ambiguous").alias("outcome"), F.when(F.col("b").isNotNull(), F.element_at(F.array(*[F.lit(s) for s in STEPS]), F.col("b.rank"))).alias("step"), F.when(one, F.col("b.part_id")).alias("part_id"), F.when(one, F.col("b.via_kind")).alias("via_kind"),
    )
    return sure.unionByName(rest)


def mapped_entries(entries: DataFrame, dictionary: DataFrame, fields: dict[str, Field]) -> DataFrame:
    """A row for each fact of each matched entry, with field, outcome and typed value."""
    rows = entries.select("entry_id", "part_id", "source", "tier", "page_url", "fetched_at", F.col("category").alias("section"), F.posexplode("facts").alias("place", "f")).select("*", F.col("f.label").alias("label"), F.col("f.value").alias("raw")).drop("f")
    return mapped(rows, dictionary, fields)


def readings_of(facts: DataFrame, fields: dict[str, Field], reader: str) -> DataFrame:
    """Mapped facts as readings that merging takes."""
    unit = reduce(lambda acc, f: acc.when(F.col("field") == f.key, F.lit(f.unit)), fields.values(), F.when(F.lit(False), F.lit("")))
    span = F.when(F.col("v.low").isNotNull(), F.concat_ws("..", F.col("v.low"), F.col("v.high")))
    text = F.coalesce("v.text", span, F.col("v.flag").cast("string"))
    return facts.where("outcome = 'ok'").select(
        "part_id", "field", "fetched_at", "entry_id", "place", F.col("v.num").alias("num"), F.col("v.items").alias("items"), F.when(F.col("v.num").isNull() & F.col("v.items").isNull(), text).alias("text"), unit.alias("unit"), "tier",
        F.col("page_url").alias("doc"), F.lit(None).cast("string").alias("revision"), F.lit(reader).alias("reader"), F.date_format("fetched_at", "yyyy-MM-dd").alias("read_on"), "raw",
    )


def lower_tier(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of each key the row of the lowest tier, then of the first entry."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min(F.struct("tier", "entry_id", *[c for c in rest if c not in ("tier", "entry_id")])).alias("x")).select(*key, "x.*")


def applied(entries: DataFrame, parts: DataFrame, aliases: DataFrame, dictionary: DataFrame, fields: dict[str, Field], reader: str = "1.0", only: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """All tables of a run, or some of them; what none of those needs is not worked out.

    entries: as ENTRY; parts: part_id, vendor, category, sku; aliases: part_id, kind, value; dictionary: as in `mapped_labels`.
    Entries about a whole family, and those without a number, are left to other readers.  A null list counts as empty.
    """
    named = entries.where("coalesce(scope, '') <> 'family' and sku is not null")
    who = saved(resolved(named, parts, aliases))
    found = who.where("outcome = 'matched'").drop("outcome").join(named, "entry_id").join(parts.select("part_id", "category", F.col("sku").alias("part_sku")), "part_id")
    found = saved(found)
    out = {"resolution": who}
    if set(only) & set(READ):
        facts = saved(mapped_entries(found, dictionary, fields))
        good = facts.where("outcome = 'ok'")
        mapped_fields = good.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n_facts"), F.array_sort(F.collect_set("field")).alias("fields"))
        n = F.coalesce("n_facts", F.lit(0))
        outcome = F.when(n > 0, "facts_found").when(F.col("not_listed"), "not_listed").otherwise("no_facts")
        checks = found.select("entry_id", "part_id", "source", "page_url", "not_listed").join(mapped_fields, "entry_id", "left")
        out["checks"] = checks.select("entry_id", "part_id", "source", "page_url", outcome.alias("outcome"), n.alias("n_facts"), F.coalesce("fields", F.array().cast("array<string>")).alias("fields"))
        out |= {"written": good.select("entry_id", "place", "source", "page_url", "label", "raw", "field"), "unmapped": unmapped_report(facts)}
        if set(only) & set(MERGED):
            told = merge_effects(readings_of(facts, fields, reader), ["part_id", "field"], ["fetched_at", "entry_id", "place"])
            out |= {t: getattr(told, t) for t in MERGED}

    said = found.select("part_id", "part_sku", "tier", "entry_id", "page_url", F.explode("aliases").alias("a")).select("*", "a.*").drop("a").where(F.col("kind").isin(*ALIAS_KINDS))
    taught = found.where("step = 'variant'").select("part_id", "part_sku", "tier", "entry_id", "page_url", F.col("via_kind").alias("kind"), F.col("sku").alias("value"))
    other = said.unionByName(taught).withColumn("value", F.trim("value")).where(F.upper("value") != F.upper("part_sku"))
    other = lower_tier(other.withColumn("value_key", F.upper("value")).drop("part_sku"), ["part_id", "kind", "value_key"])

    pictures = found.select("part_id", "source", "source_kind", "tier", "entry_id", "page_url", F.explode("images").alias("i")).select("*", "i.*").drop("i").where("coalesce(url, '') <> ''")
    images = lower_tier(pictures.where("source_kind = 'vendor'").select("part_id", "url", F.coalesce("role", F.lit("gallery")).alias("role"), "tier", "entry_id", "page_url"), ["part_id", "url"])
    candidates = pictures.groupBy("part_id", "url").agg(F.min("entry_id").alias("entry_id"), F.countDistinct("source").alias("sources"))

    target = parts.groupBy(F.upper("sku").alias("to_key")).agg(F.count(F.lit(1)).alias("n"), F.min("part_id").alias("to_id")).where("n = 1").drop("n")
    linked = found.select("part_id", "tier", "entry_id", "page_url", F.explode("relations").alias("r")).select("part_id", "tier", "entry_id", "page_url", F.col("r.kind").alias("kind"), F.col("r.sku").alias("to_sku"))
    linked = linked.where(F.col("kind").isin(*RELATION_KINDS)).withColumn("to_key", F.upper("to_sku")).join(target, "to_key", "left")
    relations = lower_tier(linked.where("to_id is null or to_id <> part_id"), ["part_id", "kind", "to_key"])

    day = {d: F.when(F.col(f"lifecycle.{d}").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.col(f"lifecycle.{d}")) for d in DATES}
    dated = found.where(F.coalesce(*day.values()).isNotNull())
    status = F.when(F.coalesce(day["end_of_sale"], day["end_of_support"]).isNotNull(), "eol_announced").otherwise("active")
    lifecycles = lower_tier(dated.select("part_id", "tier", "entry_id", "page_url", status.alias("status"), *[c.alias(d) for d, c in day.items()]), ["part_id"])

    out |= {"aliases": other, "images": images, "candidates": candidates, "relations": relations, "lifecycles": lifecycles}
    return {t: out[t] for t in only}


def folded(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def reread(written: DataFrame, pages: DataFrame, per_source: int) -> DataFrame:
    """Of each source a sample of what was written, dealt by hash, and whether value and label stand on the page now.

    pages: page_url, text.  A page that is not there leaves `found` null.
    """
    from .rules import top_per_group

    dice = F.xxhash64("entry_id", "place", "field")
    sample = top_per_group(written.withColumn("dice", dice), "source", [F.col("dice"), F.col("entry_id"), F.col("place")], per_source)
    text = folded(F.col("text"))
    label = folded(F.element_at(F.split("label", ">"), -1))
    return sample.join(pages, "page_url", "left").select("source", "entry_id", "place", "label", "raw", (F.contains(text, folded(F.col("raw"))) & F.contains(text, label)).alias("found"))


def run_gate(pages: DataFrame, golden: DataFrame, per_source: int = 60):
    """A gate for `commit`: precision by reading the pages again, recall by facts that a run must find.

    golden: entry_id, field.  What cannot be read again counts for nothing; if nothing can, precision is 0.
    """

    def gate(staged: dict[str, DataFrame]) -> dict:
        seen = reread(staged["written"], pages, per_source).agg(F.count("found").alias("n"), F.count_if("found").alias("hits")).first()
        some = not staged["written"].isEmpty()
        want = golden.select("entry_id", "field").distinct()
        asked = want.count()
        got = want.join(staged["written"].select("entry_id", "field").distinct(), ["entry_id", "field"], "left_semi").count()
        precision = seen["hits"] / seen["n"] if seen["n"] else float(not some)
        recall = got / asked if asked else 1.0
        return {"precision": round(precision, 4), "recall": round(recall, 4), "sampled": seen["n"], "passed": precision >= LEAST_PRECISION and recall == 1.0}

    return gate


def apply_run(spark: SparkSession, base: str, tables: dict[str, DataFrame], pages: DataFrame, golden: DataFrame, per_source: int = 60) -> commits.Version:
    """Stage the tables, judge them, and make them the next version of base; see `commits.commit`."""
    return commits.commit(tables, base, run_gate(pages, golden, per_source))
