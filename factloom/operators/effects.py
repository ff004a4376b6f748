"""What merging writes: facts with their history, evidence, conflicts, and what became of every reading.

A fact is never changed in place.  A reading from the document that the fact stands on may bring a new row, which supersedes
the one before; a reading from any other document leaves the row as it is, and only adds evidence or a conflict.  That splits
the work:

1. The first reading that may be stored founds a field's fact (an aggregate).
2. Only later readings of the founding document can make rows.  They alone are gone through in order, one row in hand.
3. Every reading meets the row that was current when it came, by a join on the key and a range of times, and what it does
   there is a column expression.  Keys that hold a large share of all readings are spread over SPREAD parts of their times; rows
   go to each part, and what the parts find (first evidence of a document, last change of state) joins by minimum and maximum.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.checkpoints import saved
from .merging import CUT, NO_TOLERANCE, READING, TOLERANCE, agreement, folded, one_cell, union

#: Parts of a key that holds more than 1 / SHARE of all readings; so fewer than SHARE keys are spread.
SPREAD = 64
SHARE = 256
#: A united list keeps this much of both sources' text.
RAW = 2000
ROW = ("num", "items", "text", "unit", "tier", "doc", "revision", "reader", "read_on", "raw")


class Effects(NamedTuple):
    actions: DataFrame
    facts: DataFrame
    evidence: DataFrame
    conflicts: DataFrame


def version_of(reader: str | None) -> list[int]:
    """A reader's version as numbers, without zeros at the end."""
    parts = [int(x) if x.isdigit() else 0 for x in (reader or "").split(".")]
    while parts and not parts[-1]:
        parts.pop()
    return parts


def later(held: dict, new: dict) -> bool:
    """Whether new is strictly the later reading: by the reader's version, else by date."""
    x, y = version_of(held["reader"]), version_of(new["reader"])
    return x < y if x != y else bool(held["read_on"] and new["read_on"] and held["read_on"] < new["read_on"])


def overlap(held: list[str], new: list[str]) -> str:
    a, b = ({folded(x) for x in side} for side in (held, new))
    return "list_superset" if b <= a else "list_subset" if a <= b else "list_overlap"


def next_row(held: dict, new: dict) -> tuple[dict, str, str | None] | None:
    """The row that a reading of the same document puts in place of the one held, with action and rule, if it does."""
    if agreement(held, new) or held["tier"] == 0:
        return None
    if held["revision"] and new["revision"] and held["revision"] != new["revision"]:
        return new, "revision_change", None
    if held["tier"] != new["tier"]:
        return None
    if later(held, new) and one_cell(held, new):
        return new, "supersede", "same_doc_reextraction"
    if held["items"] is None or new["items"] is None:
        return None
    rule = overlap(held["items"], new["items"])
    raw = held["raw"] if rule == "list_superset" else f"{held['raw'] or ''} ; {new['raw'] or ''}"[:RAW]
    return held | {"items": union(held["items"], new["items"]), "raw": raw}, "list_union", rule


def rows_in_order(own: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The rows that one document's readings make of each field: seq from 1, since, until, and what made them."""
    kinds = dict(own.dtypes)
    since, until = [f"since_{c}" for c in order], [f"until_{c}" for c in order]
    names = [*key, "seq", *since, *until, *ROW, "made_by", "made_rule"]
    kinds |= {"seq": "long", "made_by": "string", "made_rule": "string"} | {f"{side}_{c}": kinds[c] for c in order for side in ("since", "until")}
    # by a hash of its own: where rows come from a join on the key, Spark takes repartition(*key) for done and leaves it out, and
    # may then make the join a broadcast, so that a key's rows stay in many tasks
    dealt = own.select(*key, *order, *ROW).repartition(F.xxhash64(*key)).sortWithinPartitions(*key, *order)
    k_, o_ = len(key), len(order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: tuple | None = None
        held: dict = {}
        seq, began, made = 0, (), ("insert", None)

        def row(ended) -> tuple:
            return (*now, seq, *began, *ended, *(held[c] for c in ROW), *made)

        for pdf in batches:
            done: list[tuple] = []
            columns = [pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in pdf.columns]
            for values in zip(*columns, strict=True):
                k, at, new = values[:k_], values[k_ : k_ + o_], dict(zip(ROW, values[k_ + o_ :], strict=True))
                new["items"] = None if new["items"] is None else list(new["items"])
                change = next_row(held, new) if k == now else (new, "insert", None)
                if change is None:
                    continue
                if now is not None:
                    done.append(row(at if k == now else (None,) * o_))
                seq, now = (seq + 1 if k == now else 1), k
                held, made, began = change[0], change[1:], at
            if done:
                yield pd.DataFrame(done, columns=names)
        if now is not None:
            yield pd.DataFrame([row((None,) * o_)], columns=names)

    made = dealt.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in names))
    times = [F.struct(*[F.col(f"{side}_{c}").alias(c) for c in order]) for side in ("since", "until")]
    return made.select(*key, "seq", times[0].alias("since"), F.when(F.col(until[0]).isNotNull(), times[1]).alias("until"), *ROW, "made_by", "made_rule")


def cut_text(a: Column, b: Column) -> Column:
    """Whether the shorter text is the longer one as a reader cuts it, but for its last word."""
    short, long = (F.when(F.length(a) <= F.length(b), x).otherwise(y) for x, y in ((a, b), (b, a)))
    head = F.rtrim(F.regexp_replace(short, r"\S*$", ""))
    return (a != b) & F.length(short).between(CUT - 2, CUT) & (F.length(head) >= 0.6 * CUT) & F.startswith(long, head)


def fold(items: Column) -> Column:
    return F.array_distinct(F.transform(items, lambda x: F.regexp_replace(F.trim(F.lower(x)), r"\s+", " ")))


def agreed(a, b) -> Column:
    """The rule by which two readings are one fact, or null.  a, b: columns of a reading by name."""
    x, y, unit = a("num"), b("num"), F.coalesce(a("unit"), b("unit"))
    near = (x * y > 0) & (F.abs(x - y) <= TOLERANCE * F.greatest(F.abs(x), F.abs(y))) & ~unit.isin(*NO_TOLERANCE)
    one_set = F.array_sort(fold(a("items"))) == F.array_sort(fold(b("items")))
    numbers = F.when(F.abs(x - y) < 1e-6, "exact").when(near, "numeric_tolerance")
    lists = F.when(a("items") == b("items"), "exact").when(one_set, "set_equal")
    texts = F.when(a("text") == b("text"), "exact").when(cut_text(a("text"), b("text")), "prefix_truncated")
    both = [a(c).isNotNull() & b(c).isNotNull() for c in ("num", "items", "text")]
    return F.when(both[0], numbers).when(both[1], lists).when(both[2], texts)


def version(reader: Column) -> Column:
    short = F.regexp_replace(F.coalesce(reader, F.lit("")), r"(^|\.)[0.]*$", "")
    number = lambda x: F.when(x.rlike("^[0-9]+$"), x).otherwise("0").cast("long")
    return F.when(short == "", F.array().cast("array<long>")).otherwise(F.transform(F.split(short, r"\."), number))


def decided(a, b) -> tuple[Column, Column]:
    """What a reading b does to the row a, and by which rule.  The order of the questions is part of the result."""
    rule, known = agreed(a, b), agreed(a, b).isNotNull()
    same_doc, one_tier = F.coalesce(a("doc") == b("doc"), F.lit(False)), a("tier") == b("tier")
    va, vb = version(a("reader")), version(b("reader"))
    newer = F.when(va != vb, va < vb).otherwise(F.coalesce(a("read_on") < b("read_on"), F.lit(False)))
    said = (a("raw") != "") & (b("raw") != "")
    one = F.coalesce(said & ((a("raw") == b("raw")) | cut_text(a("raw"), b("raw"))), F.lit(False))
    revised = F.coalesce((a("revision") != "") & (b("revision") != "") & (a("revision") != b("revision")), F.lit(False))
    lists = a("items").isNotNull() & b("items").isNotNull()
    held, new = fold(a("items")), fold(b("items"))
    covers = F.when(F.size(F.array_except(new, held)) == 0, "list_superset").when(F.size(F.array_except(held, new)) == 0, "list_subset").otherwise("list_overlap")
    action = (
        F.when((a("tier") == 0) & ~known, "protected")
        .when(known & ~a("doc").eqNullSafe(b("doc")) & (F.greatest(a("tier"), b("tier")) <= 2), "corroborate")
        .when(known, "agree_same_doc")
        .when(same_doc & revised, "revision_change")
        .when(same_doc & one_tier & newer & one, "supersede")
        .when(same_doc & one_tier & lists, "list_union")
        .when(a("tier") > b("tier"), "conflict_lower_tier_wins")
        .when(a("tier") < b("tier"), "conflict_higher_tier_rejected")
        .otherwise("conflict_held")
    )
    by = F.when(action.isin("corroborate", "agree_same_doc"), rule).when(action == "supersede", "same_doc_reextraction").when(action == "list_union", covers)
    return action, by


def reason() -> Column:
    """Why a reading was not taken, or took another's place.  Fixed values."""
    tiers = [F.col("tier").cast("string"), F.col("held_tier").cast("string")]
    return (
        F.when(F.col("action") == "protected", "operator-reviewed value is protected (tier 0)")
        .when(F.col("action") == "conflict_lower_tier_wins", F.concat(F.lit("lower tier wins ("), tiers[0], F.lit(" < "), tiers[1], F.lit(") but sources disagree")))
        .when(F.col("action") == "conflict_higher_tier_rejected", F.concat(F.lit("higher tier rejected ("), tiers[0], F.lit(" > "), tiers[1], F.lit(") and sources disagree")))
        .when(F.col("action") == "conflict_held", "same-tier sources disagree; field held")
        .when(F.col("action") == "revision_change", F.concat(F.lit("REVISION_CHANGE "), "old", F.lit(" -> "), "new"))
        .when(F.col("action") == "supersede", F.concat(F.lit("SAME_DOC_REEXTRACTION norm_v "), F.coalesce("old_reader", F.lit("?")), F.lit(" -> "), F.coalesce("new_reader", F.lit("?")), F.lit(" on "), "doc"))
    )


def merge_effects(readings: DataFrame, key: list[str], order: list[str]) -> Effects:
    """Merge all readings of each field, and write what that leads to.

    readings: key, order (together they tell readings apart), the columns of READING, and, if it has it, refused: why a
    reading may not be stored (null if it may).  A reading without num, items and text states a gap.  Readings with a null in
    key or tier are left out.  Returns

    actions    key, at (order as a struct), action, rule, seq (of the row it met or made; null if none), withheld
    facts      key, seq, since, until, the columns of a reading, state, superseded_by; seq 0 is a gap; until is null in current rows
    evidence   key, seq, doc, at, raw: the reading that made a row, and the first of each other document that agrees with it
    conflicts  key, seq, at, kept and rejected (num, items, text), reason, resolution (null: open)

    A gap is stored before any value and gives way to the first one; later gaps do nothing.  A first value must name its
    document unless it has tier 0 or is not trusted (tier over 2).  A row without one keeps its state though others agree.
    """
    refused = F.col("refused") if "refused" in readings.columns else F.lit(None).cast("string")
    has = F.coalesce(F.col("num").isNotNull() | F.col("items").isNotNull() | F.col("text").isNotNull(), F.lit(False))
    stated = readings.dropna(subset=[*key, "tier"]).select(*key, F.struct(*order).alias("at"), *READING, refused.alias("refused"), has.alias("has"))
    values = stated.where("has and refused is null")
    bare = F.col("tier").between(1, 2) & (F.coalesce(F.trim("doc"), F.lit("")) == "")
    founders = values.where(~bare).groupBy(*key).agg(F.min_by(F.struct("at", "doc"), "at").alias("f")).select(*key, F.col("f.at").alias("first"), F.col("f.doc").alias("founder"))
    founders = saved(founders)
    own = values.join(founders, key).where("at = first or (doc = founder and at > first)").select(*key, "at.*", *ROW)
    rows = saved(rows_in_order(own, key, order))

    # every reading meets the row that was current before it
    total = values.count()
    hot = F.broadcast(values.groupBy(*key).agg((F.count(F.lit(1)) * SHARE > total).alias("hot")).where("hot"))
    met = values.join(hot, key, "left").withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64("at"), F.lit(SPREAD)).cast("int")).otherwise(0)).alias("b")
    parts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    spread = rows.join(hot, key, "left").withColumn("part", F.explode(parts)).alias("a")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*key, "part")]
    same += [F.col("a.since") < F.col("b.at"), F.col("a.until").isNull() | (F.col("b.at") <= F.col("a.until"))]
    action, rule = decided(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}"))
    there = F.col("a.seq").isNotNull()
    value = {side: F.struct(*[F.col(f"{side}.{c}").alias(c) for c in ("num", "items", "text")]) for side in ("a", "b")}
    looked = met.join(spread, reduce(and_, same), "left").select(
        *[F.col(f"b.{c}").alias(c) for c in (*key, "at", "doc", "raw", "tier")], F.col("a.seq").alias("seq"), F.when(there, action).alias("action"), F.when(there, rule).alias("rule"), value["a"].alias("held"), value["b"].alias("stated"),
        F.col("a.tier").alias("held_tier"), F.col("a.doc").alias("held_doc"), F.col("a.revision").alias("old"), F.col("b.revision").alias("new"), F.col("a.reader").alias("old_reader"), F.col("b.reader").alias("new_reader"),
    ).join(founders.select(*key, "first"), key, "left")
    nothing = F.when(F.col("at") == F.col("first"), "insert").otherwise("refused_no_document")
    looked = saved(looked.withColumn("action", F.coalesce("action", nothing)))

    # of each document that agrees with a row the first reading is evidence
    doc = F.coalesce("doc", F.lit("\0"))
    firsts = looked.where("action = 'corroborate'").groupBy(*key, "seq", doc.alias("of")).agg(F.min("at").alias("at"), F.min_by("raw", "at").alias("raw"))
    firsts = saved(firsts)
    seen = firsts.select(*key, "seq", "of", "at", F.lit(True).alias("is_first"))
    looked = looked.withColumn("of", doc).join(seen, [*key, "seq", "of", "at"], "left")
    again = (F.col("action") == "corroborate") & F.col("is_first").isNull()
    looked = looked.withColumns({"action": F.when(again, "agree_same_doc").otherwise(F.col("action")), "withheld": (F.col("action") == "corroborate") & ~again & (F.col("held_tier") > 0) & F.col("held_doc").isNull()})
    makes = F.col("action").isin("insert", "revision_change", "supersede", "list_union")
    looked = saved(looked.withColumn("row", F.coalesce("seq", F.lit(0)) + F.when(makes, 1).otherwise(0)))

    # gaps: the first one is stored if no value came before it
    gaps = stated.where(~F.col("has")).join(founders, key, "left")
    gap_rows = gaps.groupBy(*key).agg(F.min("at").alias("since"), F.first("first").alias("first")).where("first is null or since < first")
    gap_facts = gap_rows.select(*key, F.lit(0).cast("long").alias("seq"), "since", F.col("first").alias("until"), *[F.lit(None).cast(t).alias(c) for c, t in readings.select(*ROW).dtypes], F.lit("gap_confirmed").alias("state"))
    gap_action = F.when(F.col("at") == F.col("since"), "gap_stored").when(F.col("first").isNull() | (F.col("at") < F.col("first")), "gap_known").otherwise("gap_refused")
    gap_actions = gaps.select(*key, "at", "first").join(gap_rows.select(*key, "since"), key, "left").select(*key, "at", gap_action.alias("action"))

    # the last event that changed a row's state
    turned = F.when((F.col("action") == "corroborate") & ~F.col("withheld"), "corroborated").when(F.startswith("action", F.lit("conflict")), "conflict")
    states = looked.select(*key, "seq", "at", turned.alias("turned")).where("turned is not null").groupBy(*key, "seq").agg(F.max_by("turned", "at").alias("turned"))
    own_state = F.when(F.col("made_by") != "list_union", F.when(F.col("tier") <= 2, "verified").otherwise("unverified"))  # a union goes on in the state before
    state = F.last(F.coalesce("turned", own_state), ignorenulls=True).over(Window.partitionBy(*key).orderBy("seq"))
    facts = rows.join(states, [*key, "seq"], "left").select(*key, "seq", "since", "until", *ROW, state.alias("state"))
    facts = facts.unionByName(gap_facts).withColumn("superseded_by", F.when(F.col("until").isNotNull(), F.col("seq") + 1))

    evidence = rows.select(*key, "seq", "doc", F.col("since").alias("at"), "raw").unionByName(firsts.select(*key, "seq", F.nullif("of", F.lit("\0")).alias("doc"), "at", "raw"))
    newer = F.col("action").isin("revision_change", "supersede")
    told = newer | (F.col("action") == "protected") | F.startswith("action", F.lit("conflict"))
    stated_wins = newer | (F.col("action") == "conflict_lower_tier_wins")
    resolution = F.when(F.col("action") == "supersede", F.concat(F.lit("rule:"), "rule")).when(newer, F.col("action"))
    conflicts = looked.where(told).select(*key, "seq", "at", F.when(stated_wins, F.col("stated")).otherwise(F.col("held")).alias("kept"), F.when(stated_wins, F.col("held")).otherwise(F.col("stated")).alias("rejected"), reason().alias("reason"), resolution.alias("resolution"))

    done = looked.select(*key, "at", "action", "rule", F.when(F.col("row") > 0, F.col("row")).alias("seq"), "withheld")
    idle = gap_actions.select(*key, "at", "action", F.lit(None).cast("string").alias("rule"), F.when(F.col("action") == "gap_stored", 0).cast("long").alias("seq"), F.lit(False).alias("withheld"))
    barred = stated.where("has and refused is not null").select(*key, "at", F.lit("refused").alias("action"), F.col("refused").alias("rule"), F.lit(None).cast("long").alias("seq"), F.lit(False).alias("withheld"))
    return Effects(done.withColumn("withheld", F.coalesce("withheld", F.lit(False))).unionByName(idle).unionByName(barred), facts, evidence, conflicts)
