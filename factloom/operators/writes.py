"""Write-side decisions as expressions and joins: retirements, twins, promotions, bulletins, edges, replays, scopes, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import let
from ..functions.text import first_of
from ..sources.checkpoints import saved

# Ranks of states without a value, limits of promotions, replays and alarms.
GAP_RANK = {"gap_unattempted": 0, "gap_confirmed": 1, "not_applicable": 2}
LEAST_SHARE, LEAST_PARTS = 0.6, 30
ALARM_MAGNITUDE = 1000
PLACEHOLDERS = ("n/a", "tbd", "none", "-")


def fabricated_verdict() -> Column:
    """Why a longer number that is a shorter one and a digit stays, or the rule that retires it.  Columns: reviewed,
    independent, pdf_docs, shared_pdf, chained, series."""
    return first_of(
        [
            (F.col("reviewed"), "long_operator_reviewed"),
            (F.col("independent") > 0, "long_has_independent_evidence"),
            (F.col("pdf_docs") == 0, "long_no_pdf_evidence"),
            (F.col("pdf_docs") > 1, "long_multiple_pdfs"),
            (~F.col("shared_pdf"), "base_not_named_by_that_pdf"),
            (F.col("chained"), "footnote_chain"),
            (F.col("series") > 2, "numeric_series"),
        ],
        "retire:pdf_footnote_digit",
    )


def survivors(rows: DataFrame, group: list[str]) -> DataFrame:
    """The one of each group of twins that stays: reviewed, then in upper case, then with most facts, then the first."""
    order = F.struct(~F.col("reviewed"), F.col("sku") != F.upper("sku"), -F.col("n_facts"), F.col("id"))
    return rows.groupBy(*group).agg(F.min_by("id", order).alias("survivor"), F.count(F.lit(1)).alias("members"))


def twin_fact(held: Column, lost: Column) -> Column:
    """What becomes of a retired twin's fact, by the states of the survivor's (null: none) and its own."""

    def rank(s: Column) -> Column:
        return F.try_element_at(F.create_map(*[x for k, v in GAP_RANK.items() for x in (F.lit(k), F.lit(v))]), s)

    gap = rank(lost).isNotNull()
    return first_of(
        [
            (held.isNull() & gap, "gap_moved"),
            (held.isNull(), "moved_uncontested"),
            (gap & rank(held).isNotNull() & (rank(lost) > rank(held)), "gap_promoted"),
            (gap & rank(held).isNotNull(), "gap_parked_under_gap"),
            (gap, "gap_parked_under_value"),
        ],
        "merged",
    )


def promotion_reason() -> Column:
    """Why a field is not asked for in a category, or promote.  Properties of the field come first, then the profile, then the
    evidence.  Columns: type, sentinel, identity, unit, band, current, hand_written, in_generated, parts, denom."""
    uncheckable = (F.col("type") == "n") & F.col("unit").isNull() & ~F.col("band")
    share = F.when(F.col("denom") > 0, F.col("parts") / F.col("denom")).otherwise(0.0)
    return first_of(
        [
            (F.col("type").isNull(), "not-in-dictionary"),
            (F.col("sentinel"), "sentinel"),
            (F.col("type") == "struct", "struct"),
            (F.col("identity"), "identity"),
            (uncheckable, "unit-less-number"),
            (F.col("current").isin("req", "cond"), "already-required"),
            (F.col("current") == "na", "not-applicable"),
            (F.col("hand_written"), "hand-written"),
            (~F.col("in_generated"), "absent-from-generated-profile"),
            (F.col("denom") < LEAST_PARTS, "below-min-parts"),
            (share < LEAST_SHARE, "below-min-share"),
        ],
        "promote",
    )


def full_pid(text: Column) -> Column:
    """A number as bulletins are looked up by, its grade kept; null if it is none."""

    def bare(p: Column) -> Column:
        b = F.regexp_replace(F.regexp_replace(p, r"/K9(\+\+)?$", ""), "[+=]+$", "")
        return F.regexp_replace(F.regexp_replace(b, "^(WS-C|WSC|WS-|WS|C1-)", ""), "^C(?=[0-9])", "")

    fit = lambda p, b: (F.length(p) >= 5) & ~F.contains(p, F.lit(" ")) & F.contains(b, F.lit("-")) & b.rlike("[0-9]{3,4}")
    return let(F.upper(F.trim(text)), lambda p: let(bare(p), lambda b: F.when(fit(p, b), b)))


def core_of(full: Column) -> Column:
    """A full number without the grade at its end."""
    fit = lambda c: F.contains(c, F.lit("-")) & c.rlike("[0-9]{3,4}") & (F.length(c) >= 5)
    return let(F.regexp_replace(full, "-([ESLA])$", ""), lambda c: F.when(fit(c), c))


def core_pid(text: Column) -> Column:
    """The same as `full_pid` without the grade at its end."""
    return core_of(full_pid(text))


def numbered(bulletins: DataFrame, number: Column, name: str) -> DataFrame:
    """Bulletins with a number worked out of their own, without those that have none.  An explode, as a filter on the number
    would be pushed below it and work it out again."""
    return bulletins.select("*", F.explode(F.array_compact(F.array(number))).alias(name))


def listed_numbers(bulletins: DataFrame) -> DataFrame:
    """Every number that bulletins list, by its exact grade, once: full, exact (the first successor named), b (its best bulletin)
    and at (what that one is best by).  bulletins: bulletin_id, pid, successor, n_dates, end_of_sale.

    Numbers are worked out once and dealt out by number, so that their rows are ordered once and not before the shuffle too."""
    parts = int(bulletins.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = numbered(bulletins.select("bulletin_id", "pid", "successor", "n_dates", "end_of_sale"), full_pid(F.col("pid")), "full").repartition(parts, "full")
    order = F.struct("n_dates", F.coalesce("end_of_sale", F.lit("")).alias("day"), (-F.col("bulletin_id")).alias("id"), F.col("pid").alias("pid"))
    best = F.max(F.struct(order.alias("at"), F.struct("bulletin_id", "successor", "end_of_sale").alias("b")))
    exact = F.min(F.when(F.col("successor").isNotNull(), F.struct("bulletin_id", "pid", "successor")))
    return rows.groupBy("full").agg(best.alias("best"), exact.alias("exact")).select("full", F.col("exact.successor").alias("exact"), "best.b", "best.at")


def best_bulletins(numbers: DataFrame) -> DataFrame:
    """Of each core number the bulletin with most dates, then the latest end of sale, then the first.  numbers: as
    `listed_numbers`."""
    return numbered(numbers, core_of(F.col("full")), "core").groupBy("core").agg(F.max(F.struct("at", "b")).alias("x")).select("core", "x.b.*")


def bulletin_successors(parts: DataFrame, bulletins: DataFrame) -> DataFrame:
    """Each part's bulletin and successor: that of its exact grade, none where the bulletins list the grade without one, else
    the core's."""
    numbers = saved(listed_numbers(bulletins))
    exact = numbers.select("full", "exact", F.lit(True).alias("listed")).hint("merge")
    own = parts.withColumns({"core": core_pid(F.col("sku")), "full": full_pid(F.col("sku"))})
    out = own.join(best_bulletins(numbers).hint("merge"), "core").join(exact, "full", "left")
    return out.withColumn("successor", F.when(F.col("exact").isNotNull(), F.col("exact")).when(F.col("listed").isNull(), F.col("successor")))


def compatibility(platforms: DataFrame, optics: DataFrame, group: str) -> DataFrame:
    """Edges both ways between the platforms and the optics that one record names, without placeholders."""
    named = optics.where(~F.lower("sku").isin(*PLACEHOLDERS)).dropDuplicates([group, "sku"])
    pairs = platforms.dropDuplicates([group, "id"]).join(named.withColumnsRenamed({"id": "optic_id", "sku": "optic"}), group)
    forth = pairs.select(F.col("id").alias("from_id"), F.col("optic").alias("to_sku"), F.lit("supports_transceiver").alias("kind"))
    back = pairs.where("optic_id is not null").select(F.col("optic_id").alias("from_id"), F.col("sku").alias("to_sku"), F.lit("compatible").alias("kind"))
    return forth.unionByName(back).distinct()


def magnitude(old: Column, new: Column) -> Column:
    """By what factor a number changed; from or to zero counts as a million."""
    a, b = F.abs(old), F.abs(new)
    return F.when(old == new, 1.0).when((a == 0) | (b == 0), 1e6).otherwise(F.greatest(a / b, b / a))


def sign_flip(old: Column, new: Column) -> Column:
    return (old != new) & ((old < 0) != (new < 0))


def permuted(old: Column, new: Column, tolerance: float = 0.005) -> Column:
    """Whether two arrays hold the same numbers, within a tolerance, in other places."""

    def near(x: Column, y: Column) -> Column:
        scale = F.greatest(F.abs(x), F.abs(y))
        return (x == y) | ((scale > 0) & (F.abs(x - y) / scale <= tolerance))

    pairs = F.zip_with(F.array_sort(old), F.array_sort(new), near)
    moved = F.zip_with(old, new, lambda x, y: ~near(x, y))
    return (F.size(old) == F.size(new)) & (F.size(old) > 1) & F.forall(pairs, lambda x: x) & F.exists(moved, lambda x: x)


def replay(raw: Column, value: Column, again: Column, reason: Column, tier: Column) -> Column:
    """What reading a fact's raw text again comes to; a reviewed fact is protected from a change."""
    outcome = first_of(
        [
            ((F.trim(F.coalesce(raw, F.lit(""))) == "") & value.isNull(), "unrecoverable:GAP_ROW_NEVER_NORMALISED"),
            (F.trim(F.coalesce(raw, F.lit(""))) == "", "unrecoverable:RAW_LOST_VALUE_PRESENT"),
            (reason.isNotNull(), "refused"),
            (F.abs(value - again) < 1e-6, "same"),
        ],
        "changed",
    )
    return F.when(outcome.isin("refused", "changed") & (tier == 0), "protected").otherwise(outcome)


def remerge(agreement: Column, described: Column, applicable: Column, fact: Column, rejected: Column, action: Column, raw: Column) -> Column:
    """What becomes of an open conflict: retract, agree, rewrite, reapply, open or skip."""
    return first_of(
        [
            (fact.isNull(), "skip:no_current_fact"),
            (~described, "retract:gap_unattempted"),
            (~applicable, "retract:not_applicable"),
            (rejected.isNull(), "skip:no_rejected_value"),
            (agreement.isNotNull(), "agree"),
            (action.isin("agree_same_doc", "corroborate"), "open:drift"),
            (action.isin("supersede", "list_union", "revision_change") & (F.coalesce(raw, F.lit("")) != ""), "rewrite"),
            (action.isin("supersede", "list_union", "revision_change"), "reapply"),
        ],
        "open",
    )


def model_tokens(family: Column) -> Column:
    """Words of a family that hold a digit, each joined with a follower of at most two characters."""
    words = F.filter(F.split(F.upper(family), "[^A-Z0-9]+"), lambda w: w != "")
    glued = F.transform(words, lambda w, i: F.concat(w, F.when(F.length(F.coalesce(F.get(words, i + 1), F.lit("xxx"))) <= 2, F.get(words, i + 1)).otherwise("")))
    return F.filter(glued, lambda w: w.rlike("[0-9]"))


def family_matches(a: Column, b: Column) -> Column:
    """Whether two families name a common model; null where either names none."""
    return F.when((F.size(model_tokens(a)) > 0) & (F.size(model_tokens(b)) > 0), F.arrays_overlap(model_tokens(a), model_tokens(b)))


def scope(label: Column, own: Column, known: Column) -> Column:
    """What a labelled value is about: the document, its own number, numbers named in the label, or unresolved."""
    named = F.filter(F.regexp_extract_all(F.upper(label), F.lit(r"([A-Z][A-Z0-9]*-[A-Z0-9-]+)"), 1), lambda x: F.array_contains(known, x))
    kind = F.when(F.contains(F.lower(label), F.lit("all models")), "document").when(F.contains(F.upper(label), F.upper(own)), "own").when(F.size(named) > 0, "named").otherwise("unresolved")
    return F.struct(kind.alias("kind"), F.array_join(F.array_sort(F.array_distinct(F.when(kind == "named", named).otherwise(F.array().cast("array<string>")))), ",").alias("skus"))


LOCATOR = r"^(?:p([0-9]+):)?t([0-9]+):r([0-9]+)(?::c([0-9]+))?$"


def locator(text: Column) -> Column:
    """struct(page, table, row, cell) of a place in a document; null if it is none; the first cell if none is named."""

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(text, LOCATOR, i), F.lit("")).cast("int")

    return F.when(text.rlike(LOCATOR), F.struct(part(1).alias("page"), part(2).alias("tbl"), part(3).alias("row"), F.coalesce(part(4), F.lit(1)).alias("cell")))


def suspects(facts: DataFrame, defects: DataFrame) -> DataFrame:
    """Facts from a table in which a reader reported a defect.  Both: doc, place."""
    def placed(rows: DataFrame) -> DataFrame:
        at = locator(F.col("place"))
        return rows.withColumns({"page": F.coalesce(at["page"], F.lit(-1)), "tbl": at["tbl"]})

    return placed(facts).join(placed(defects).where("tbl is not null").select("doc", "page", "tbl").distinct(), ["doc", "page", "tbl"], "left_semi").drop("page", "tbl")


def census(facts: DataFrame, profile: DataFrame) -> DataFrame:
    """Values and gaps of fields that a category's profile does not hold.  facts: category, field_key, value_text."""
    out = facts.join(profile, ["category", "field_key"], "left_anti")
    return out.groupBy("category", "field_key").agg(F.count("value_text").alias("live"), F.count_if(F.col("value_text").isNull()).alias("gaps"))


def majority(rows: DataFrame, group: str, choice: str, at: str) -> DataFrame:
    """The most frequent choice of each group; of equally frequent ones that seen first."""
    n = rows.groupBy(group, choice).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"))
    return n.groupBy(group).agg(F.min_by(choice, F.struct(-F.col("n"), "first")).alias(choice), F.max("n").alias("n"))


def proportional_sample(rows: DataFrame, group: str, key: str, flagged: str, want: int, seed: str) -> DataFrame:
    """One row of each group first, flagged groups ahead, then each group's share of what is wanted, flagged rows ahead, in an
    order that a hash fixes.  Groups are aggregated; only their quotas are ranked together."""
    dice = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(flagged), dice, key)))
    groups = rows.groupBy(group).agg(F.count(F.lit(1)).alias("size"), F.max(flagged).alias("any_flag"))
    total = groups.agg(F.sum("size").alias("total"))
    order = Window.orderBy(F.desc("any_flag"), F.md5(F.concat(F.lit(seed), F.col(group).cast("string"))), group)
    quotas = groups.crossJoin(F.broadcast(total)).withColumn("place", F.row_number().over(order))
    share = F.greatest(F.lit(1), F.least(F.col("size"), F.round(F.col("size") / F.col("total") * F.least(F.lit(want), F.col("total"))).cast("long")))
    quotas = quotas.where(F.col("place") <= want).select(group, share.alias("quota"))
    return ranked.join(quotas, group).where("nth <= quota").drop("nth", "quota")


def every_nth(rows: DataFrame, key: str, step: int, parts: int = 64) -> DataFrame:
    """Every step-th row in the order of the key: rows are numbered within ranges, and ranges by the sizes of those before.
    Ranges come from samples, so what is numbered is written once: worked out twice, the sizes could be those of other ranges."""
    ranged = saved(rows.repartitionByRange(parts, key).sortWithinPartitions(key).withColumn("_id", F.monotonically_increasing_id()))
    ranged = ranged.withColumns({"_part": F.shiftright("_id", 33), "_n": F.col("_id").bitwiseAND((1 << 33) - 1)})
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size")).withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0))).select("_part", "_start")
    return ranged.join(F.broadcast(starts), "_part").where((F.col("_n") + F.col("_start")) % step == 0).drop("_id", "_part", "_n", "_start")


def proposal_refusal(name: Column, pattern: Column, taken: Column, hits: Column) -> Column:
    """Why a proposed field name and pattern are not taken over."""
    return first_of(
        [
            (~name.rlike("^[a-z][a-z0-9]*(_[a-z0-9]+)*$"), "not_snake_case"),
            (pattern.rlike(r"[\x00-\x1f]"), "control_character"),
            (F.contains(pattern, F.lit("\\b")), "word_boundary"),
            (taken, "duplicate"),
            (F.length(F.regexp_replace(pattern, r"[^A-Za-z0-9]", "")) < 3, "too_broad"),
            (hits == 0, "no_hits"),
        ]
    )


def joined_fragments(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """List items that one label was given in several rows, in their order, as one value; single rows stay as they are."""
    out = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "value"))).alias("v"), F.bool_and(F.col("value").rlike("^[•*-] ")).alias("marked"))
    texts = F.transform("v", lambda x: F.regexp_replace(x["value"], "^[•*-] ", ""))
    folded = (F.size("v") > 1) & F.col("marked")
    return out.select(*keys, F.size("v").cast("long").alias("n"), F.when(folded, F.array_join(texts, "; ")).otherwise(F.element_at("v", 1)["value"]).alias("value"))


def passed(share: Column, least: float) -> Column:
    return F.coalesce(share >= least, F.lit(False))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)
