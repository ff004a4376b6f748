"""Upkeep of a fact table: runs and their rollback, retraction, tiers, dictionary changes, collisions, plans."""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


@contextmanager
def run(spark: SparkSession, manifest: str, kind: str) -> Iterator[dict]:
    """One run as a row of the manifest.  A run whose kind starts with apply- closes as succeeded only with a gate that
    has precision, recall and passed; whatever it wrote under its id counts only if it succeeded."""
    state: dict = {"kind": kind, "started_at": datetime.datetime.now(datetime.UTC).isoformat(), "gate": None, "stats": None}
    try:
        yield state
        gate = state["gate"] or {}
        if kind.startswith("apply-") and not (gate.get("passed") is True and {"precision", "recall"} <= set(gate)):
            raise ValueError(f"{kind} cannot succeed without a passed gate")
        state["status"] = "succeeded"
    except BaseException:
        state["status"] = "failed"
        raise
    finally:
        row = (state["kind"], state["status"], state["started_at"], str(state["gate"]), str(state["stats"]))
        spark.createDataFrame([row], "kind string, status string, started_at string, gate string, stats string").write.mode("append").json(manifest)


def succeeded(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of succeeded runs, and rows of none."""
    bad = runs.where("status <> 'succeeded'").select("run_id")
    return rows.join(bad, "run_id", "left_anti")


def rolled_back(facts: DataFrame, run_id: int) -> DataFrame:
    """Facts without those of a run; what they superseded is current again."""
    own = facts.where(F.col("run_id") == run_id).select(F.col("id").alias("superseded_by"), F.lit(True).alias("_gone"))
    left = facts.where(F.coalesce(F.col("run_id") != run_id, F.lit(True))).join(own, "superseded_by", "left")
    return left.withColumn("superseded_by", F.when(~F.coalesce("_gone", F.lit(False)), F.col("superseded_by"))).drop("_gone")


def retracted(facts: DataFrame, bad: Column, to: str = "gap_unattempted") -> DataFrame:
    """Current facts that must go, replaced by a gap; the old rows stay as history."""
    if to not in ("gap_unattempted", "not_applicable"):
        raise ValueError(to)
    hit = F.col("is_current") & bad
    old = facts.withColumn("is_current", F.col("is_current") & ~F.coalesce(hit, F.lit(False)))
    new = facts.where(hit).withColumns({"state": F.lit(to), "value_text": F.lit(None).cast("string")})
    return old.unionByName(new)


def restamped(facts: DataFrame, kinds: DataFrame, tiers: dict[tuple[str, str], int]) -> DataFrame:
    """Tiers recomputed from document kind and method; pairs without a rule are an error, not a guess."""
    rules = F.broadcast(facts.sparkSession.createDataFrame([(k, m, t) for (k, m), t in tiers.items()], "doc_kind string, method string, new_tier int"))
    out = facts.join(kinds, "doc_id", "left").join(rules, ["doc_kind", "method"], "left")
    tier = F.coalesce("new_tier", F.when(F.col("doc_kind").isNull(), F.col("tier")))
    checked = F.when(tier.isNull(), F.raise_error(F.concat(F.lit("no tier for "), "doc_kind", F.lit(" "), "method")).cast("int")).otherwise(tier)
    return out.withColumn("tier", checked).drop("new_tier", "doc_kind")


def changes(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """What a sync would do to each key: added, changed, same, orphan.  Nulls compare as equal."""
    o, n = old.alias("o"), new.alias("n")
    on = reduce(lambda a, b: a & b, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key])
    same = reduce(lambda a, b: a & b, [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in columns])
    what = F.when(F.col(f"o.{key[0]}").isNull(), "added").when(F.col(f"n.{key[0]}").isNull(), "orphan").when(same, "same").otherwise("changed")
    return o.join(n, on, "full_outer").select(*[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in key], what.alias("change"))


def collisions(offers: DataFrame, key: list[str], value: str, doc: str) -> DataFrame:
    """Offers for the same key in one load: single, repeat (all equal), same_doc (one document, several values), compete."""
    g = offers.groupBy(*key).agg(F.count(F.lit(1)).alias("offers"), F.countDistinct(value).alias("values"), F.countDistinct(doc).alias("docs"))
    what = F.when(F.col("offers") == 1, "single").when(F.col("values") == 1, "repeat").when(F.col("docs") == 1, "same_doc").otherwise("compete")
    return g.select(*key, "offers", what.alias("outcome"))


def enumerated(listed: DataFrame, parts: DataFrame, categories: DataFrame) -> DataFrame:
    """Listed numbers against known parts: refused, existing, case_variant, unmapped_category or new."""
    exact = parts.select("sku", F.lit(True).alias("_exact")).distinct()
    folded = parts.select(F.upper("sku").alias("_up"), F.lit(True).alias("_folded")).distinct()
    known = categories.select("category", F.lit(True).alias("_mapped")).distinct()
    out = listed.withColumn("_up", F.upper("sku")).join(exact, "sku", "left").join(folded, "_up", "left").join(known, "category", "left")
    what = F.when(F.col("refused"), "refused").when(F.col("_exact"), "existing").when(F.col("_folded"), "case_variant").when(F.col("_mapped").isNull(), "unmapped_category").otherwise("new")
    return out.select("sku", "category", what.alias("outcome"))


def promoted(unknown: DataFrame, least_pages: int = 2) -> DataFrame:
    """Unknown numbers worth a part: seen on several pages, or on one of the vendor; with the category most seen, ties to
    the lowest, and only if it is named."""
    seen = unknown.groupBy("sku").agg(F.countDistinct("page_id").alias("pages"), F.bool_or("vendor_page").alias("vendor"))
    named = unknown.where("category is not null").groupBy("sku", "category").agg(F.count(F.lit(1)).alias("n"))
    best = named.groupBy("sku").agg(F.min_by("category", F.struct(-F.col("n"), F.col("category"))).alias("category"))
    return seen.where((F.col("pages") >= least_pages) | F.col("vendor")).join(best, "sku", "left").select("sku", "pages", F.coalesce("category", F.lit("unknown")).alias("category"))


def planned(gaps: DataFrame, sources: DataFrame, checks: DataFrame, queue: DataFrame, per_source: int) -> DataFrame:
    """Next tasks of each source: gaps it could close, not checked and not queued yet, the widest gaps first."""
    able = gaps.join(sources, "field_key").groupBy("part_id", "source", "tier").agg(F.count(F.lit(1)).alias("fields"))
    fresh = able.join(checks, ["part_id", "source"], "left_anti").join(queue, ["part_id", "source"], "left_anti")
    w = Window.partitionBy("source").orderBy(F.desc("fields"), "part_id")
    out = fresh.withColumns({"turn": F.row_number().over(w), "priority": 50 + 10 * F.col("tier")}).where(F.col("turn") <= per_source)
    return out.select("source", "part_id", "fields", "priority")


def may_inherit(kind: Column, in_document: Column, in_scope: Column, exception: Column) -> Column:
    """Whether a family's fact counts for a member: never for class B, always for A, for C unless the member has its own."""
    return (
        F.when(kind == "B", "never").when(in_document, "document_names_it").when(~in_scope, "out_of_scope").when(kind == "A", "family_wide").when((kind == "C") & ~exception, "no_exception").otherwise("refused")
    )


def model_tokens(text: Column) -> Column:
    """Words with a digit, in upper case, without punctuation."""
    return F.array_distinct(F.filter(F.transform(F.split(text, r"[^A-Za-z0-9-]+"), F.upper), lambda w: w.rlike("[0-9]")))


def family_matches(a: Column, b: Column) -> Column:
    """Whether two names share a model token; null if either has none."""
    x, y = model_tokens(a), model_tokens(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.arrays_overlap(x, y))
