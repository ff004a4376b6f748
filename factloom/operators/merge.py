"""Write-side algebra: whole new states computed from old ones and incoming rows, never in-place updates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def history(readings: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Supersession: each reading with the id and time of the one that replaced it; the last of a key is current."""
    w = Window.partitionBy(*key).orderBy(*order)
    return readings.withColumns({"superseded_by": F.lead(order[-1]).over(w), "superseded_at": F.lead(order[0]).over(w)}).withColumn("is_current", F.col("superseded_by").isNull())


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in the order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def step(state: Column, r: Column) -> Column:
    """One reading merged into a state struct(value, tier, doc, at, n_agree, n_conflict, action)."""

    def to(value, tier, doc, at, agree, conflict, action: str) -> Column:
        names = ("value", "tier", "doc", "at", "n_agree", "n_conflict", "action")
        cells = (value, tier, doc, at, state["n_agree"] + agree, state["n_conflict"] + conflict, F.lit(action))
        return F.struct(*[c.alias(n) for n, c in zip(names, cells, strict=True)])

    own = (state["value"], state["tier"], state["doc"], state["at"])
    new = (r["value"], r["tier"], r["doc"], r["at"])
    same = F.abs(state["value"] - r["value"]) <= 1e-6
    same_doc = state["doc"] == r["doc"]
    return (
        F.when(state["value"].isNull(), to(*new, 0, 0, "insert"))
        .when((state["tier"] == 0) & ~same & (r["tier"] > 0), to(*own, 0, 0, "protected"))
        .when(same & same_doc, to(*own, 0, 0, "agree"))
        .when(same, to(state["value"], F.least(state["tier"], r["tier"]), state["doc"], state["at"], 1, 0, "corroborate"))
        .when(same_doc & (r["at"] > state["at"]), to(*new, 0, 0, "supersede"))
        .when(r["tier"] < state["tier"], to(*new, 0, 1, "conflict_lower_tier_kept"))
        .otherwise(to(*own, 0, 1, "conflict_held"))
    )


def fold(readings: DataFrame, key: list[str], value: str, tier: str, doc: str, at: str, tie: str) -> DataFrame:
    """Merge competing readings of each key in order of time.

    The order matters: protection of tier 0 comes before agreement, agreement before a re-read of the same document,
    and that before tiers.  A fold over a key's ordered readings, in one expression.
    """
    item = F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"), F.col(value).cast("double").alias("value"), F.col(tier).cast("int").alias("tier"), F.col(doc).cast("string").alias("doc"))
    first = F.struct(
        F.lit(None).cast("double").alias("value"),
        F.lit(None).cast("int").alias("tier"),
        F.lit(None).cast("string").alias("doc"),
        F.lit(None).cast(dict(readings.dtypes)[at]).alias("at"),
        F.lit(0).alias("n_agree"),
        F.lit(0).alias("n_conflict"),
        F.lit("").alias("action"),
    )
    grouped = readings.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    merged = grouped.select(*key, F.size("_items").alias("n"), F.aggregate("_items", first, step).alias("m"))
    state = F.when(F.col("m.n_conflict") > 0, "conflict").when(F.col("m.n_agree") > 0, "corroborated").otherwise("verified")
    return merged.select(*key, "n", "m.value", "m.tier", "m.doc", "m.n_agree", "m.n_conflict", F.col("m.action").alias("last_action"), state.alias("state"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], rules: dict[str, str]) -> DataFrame:
    """Full outer merge of two tables with unique keys.

    rules: for each column fill (keep what is there), force (new unless null), greatest or least.
    """
    o, n = old.alias("o"), new.alias("n")
    on = reduce(lambda a, b: a & b, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key])
    how = {
        "fill": lambda a, b: F.coalesce(a, b),
        "force": lambda a, b: F.coalesce(b, a),
        "greatest": F.greatest,
        "least": F.least,
    }
    change = F.when(F.col(f"o.{key[0]}").isNull(), "inserted").when(F.col(f"n.{key[0]}").isNull(), "untouched").otherwise("merged")
    return o.join(n, on, "full_outer").select(*[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in key], *[how[r](F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) for c, r in rules.items()], change.alias("change"))


def lower_tier_wins(rows: DataFrame, key: list[str], columns: list[str], tier: str = "tier", tie: str = "id") -> DataFrame:
    """Of each key every column from the lowest tier that fills it, and that tier."""
    order = F.struct(F.col(tier), F.col(tie))
    return rows.groupBy(*key).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns], F.min(tier).alias(tier))


def newer_wins(a: DataFrame, b: DataFrame, key: str, at: str, tier: str, columns: list[str]) -> DataFrame:
    """Of two readings of each key the later one, or that of the lower tier on the same day; it never blanks a value."""
    x, y = a.alias("x"), b.alias("y")
    second = F.col(f"x.{key}").isNull() | (F.col(f"y.{at}") > F.col(f"x.{at}")) | ((F.col(f"y.{at}") == F.col(f"x.{at}")) & (F.col(f"y.{tier}") < F.col(f"x.{tier}")))
    second = F.coalesce(second, F.lit(False))
    return x.join(y, F.col(f"x.{key}") == F.col(f"y.{key}"), "full_outer").select(
        F.coalesce(f"x.{key}", f"y.{key}").alias(key), *[F.when(second, F.coalesce(f"y.{c}", f"x.{c}")).otherwise(F.coalesce(f"x.{c}", f"y.{c}")).alias(c) for c in [at, tier, *columns]]
    )


def unique_slugs(new: DataFrame, taken: DataFrame, base: str, order: str) -> DataFrame:
    """Slugs base, base-2, base-3 ... for new rows, going on from those taken(base, n)."""
    w = Window.partitionBy(base).orderBy(order)
    nth = F.row_number().over(w) + F.coalesce(F.col("n"), F.lit(0))
    return new.join(taken, base, "left").withColumn("slug", F.when(nth == 1, F.col(base)).otherwise(F.concat_ws("-", F.col(base), nth))).drop("n")


def touched(parents: DataFrame, key: str, at: str, *children: DataFrame) -> DataFrame:
    """Each parent's time of change: the greatest of its own and its children's."""
    changes = reduce(lambda a, b: a.unionByName(b), [c.select(key, F.col(at).alias("_at")) for c in children]).groupBy(key).agg(F.max("_at").alias("_at"))
    return parents.join(changes, key, "left").withColumn(at, F.greatest(at, "_at")).drop("_at")


def resolve(tokens: DataFrame, parts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Tokens to parts by a ladder: exact, case, spare sign, alias.  The first step with a hit decides; more than one
    part there is ambiguous and stays unresolved."""
    up = F.upper("token")
    by_case = parts.select(F.upper("sku").alias("k"), F.col("part_id").alias("hit"))
    steps = [
        tokens.join(parts.select(F.col("sku").alias("token"), F.col("part_id").alias("hit")), "token").select("token", "hit", F.lit(1).alias("step")),
        tokens.withColumn("k", up).join(by_case, "k").select("token", "hit", F.lit(2).alias("step")),
        tokens.withColumn("k", F.when(F.endswith("token", F.lit("=")), F.rtrim(up, F.lit("="))).otherwise(F.concat(up, F.lit("=")))).join(by_case, "k").select("token", "hit", F.lit(3).alias("step")),
        tokens.withColumn("k", up).join(aliases.select(F.upper("value").alias("k"), F.col("part_id").alias("hit")), "k").select("token", "hit", F.lit(4).alias("step")),
    ]
    hits = reduce(lambda a, b: a.unionByName(b), steps).distinct()
    counted = hits.groupBy("token", "step").agg(F.count(F.lit(1)).alias("n"), F.min("hit").alias("hit"))
    best = counted.groupBy("token").agg(F.min(F.struct("step", "n", "hit")).alias("b"))
    out = tokens.join(best, "token", "left")
    outcome = F.when(F.col("b").isNull(), "unknown").when(F.col("b.n") > 1, "ambiguous").otherwise("resolved")
    return out.select("token", outcome.alias("outcome"), F.col("b.step").alias("step"), F.when(F.col("b.n") == 1, F.col("b.hit")).alias("part_id"))


def case_groups(names: DataFrame, column: str, key: str) -> DataFrame:
    """Names that differ only in case: the folded name, members, and the one to keep (the smallest key)."""
    return names.groupBy(F.lower(column).alias("folded")).agg(F.count(F.lit(1)).alias("members"), F.min(key).alias("keep"), F.countDistinct(column).alias("spellings")).where("spellings > 1")


def suffix_pairs(names: DataFrame, column: str, key: str, suffix: str) -> DataFrame:
    """Pairs of rows of which one's name is the other's with a suffix."""
    stem = names.where(F.endswith(column, F.lit(suffix))).select(F.col(key).alias("variant"), F.expr(f"left({column}, length({column}) - {len(suffix)})").alias("stem"))
    return stem.join(names.select(F.col(key).alias("base"), F.col(column).alias("stem")), "stem")


def cut_pairs(names: DataFrame, column: str, key: str) -> DataFrame:
    """Pairs of rows of which one's name is the other's without its last character: likely made up by cutting."""
    cut = names.select(F.col(key).alias("longer"), F.expr(f"left({column}, length({column}) - 1)").alias("name"))
    return cut.join(names.select(F.col(key).alias("shorter"), F.col(column).alias("name")), "name")


def reparent(rows: DataFrame, moves: DataFrame, parent: str, key: list[str]) -> DataFrame:
    """Rows of merged parents moved to the one kept; rows that the kept one has already are dropped."""
    moved = rows.join(moves, rows[parent] == moves["from_id"], "left").withColumn("_own", F.col("to_id").isNull()).withColumn(parent, F.coalesce("to_id", parent)).drop("from_id", "to_id")
    return latest(moved, [parent, *key], [F.desc("_own")]).drop("_own")
