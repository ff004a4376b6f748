"""Mixing sources by temperature.

Source token shares are raised to an exponent and normalised; the exponent is found by repeated section until the
weights meet a target entropy or a limit on repetition.  The weights are realised within a token budget by block
permutations: a source's documents are dealt by hash into blocks, blocks and documents within them are permuted by seed,
and the source gives whole epochs of its permutation and the part of one more that its budget allows.  Sums run over
blocks first and then within a block, so no task sees a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import hidden, ready, saved

#: Least number of blocks of a source, and documents of a block.
BLOCKS, BLOCK_ROWS = 512, 50_000


def totals(sized: DataFrame) -> DataFrame:
    """tokens of each source; null is a source of its own."""
    return sized.groupBy("source").agg(F.sum("tokens").alias("total")).where("total > 0")


def sections(shares: DataFrame, low: float, high: float, ways: int = 32) -> list[tuple[float, float, float]]:
    """(exponent, entropy in nats, greatest repetition over least) at evenly spaced exponents; a row each, whatever the sources."""
    exponents = [low + (high - low) * i / ways for i in range(ways + 1)]
    grid = shares.select("p", F.explode(F.array(*[F.lit(float(x)) for x in exponents])).alias("a"))
    w, r = F.pow("p", F.col("a")), F.pow("p", F.col("a") - 1)
    rows = grid.groupBy("a").agg(F.sum(w).alias("z"), F.sum(w * F.log(w)).alias("zlog"), (F.max(r) / F.min(r)).alias("spread")).collect()
    return sorted((x["a"], math.log(x["z"]) - x["zlog"] / x["z"], x["spread"]) for x in rows)


def exponent(shares: DataFrame, entropy: float | None, most_repeats: float | None, rounds: int = 6) -> float:
    """The largest exponent up to 1 with at least this entropy, or the smallest from 0 with at most this repetition."""
    low, high = 0.0, 1.0
    for _ in range(rounds):
        rows = sections(shares, low, high)
        if entropy is not None:
            fits = [a for a, h, _ in rows if h >= entropy]
            if not fits:
                return 0.0
            low = fits[-1]
        else:
            fits = [a for a, _, s in rows if s <= most_repeats]
            if not fits:
                return 1.0
            high = fits[0]
        if entropy is not None:
            high = min(high, next((a for a, _, _ in rows if a > low), low))
        else:
            low = max(low, next((a for a, _, _ in reversed(rows) if a < high), high))
        if low == high:
            break
    return low if entropy is not None else high


def keyed(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def mixed(
    documents: DataFrame,
    tokens: Column | None = None,
    entropy: float | None = None,
    most_repeats: float | None = 2.0,
    budget: int | None = None,
    budget_ratio: float | None = None,
    seed: int = 17,
    blocks: int | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """How often each document is drawn, and where.

    Returns doc_id, source, n_tokens, exponent, weight (of its source), repeats (the source's budget over its tokens),
    copies (whole epochs, and one more where the document is within the part of the last), place (tokens before it in its
    source's permutation), position (the place over the source's drawn tokens: copy c, from 0, comes at position + c /
    repeats, and in the order of positions all sources are mixed at their weights throughout) and the columns named by keep.
    tokens: what to count, else words.  entropy: target in nats; else most_repeats limits the most repeated source over
    the least.  budget: tokens to draw in all, or budget_ratio: over those of the corpus; with neither the least repeated
    source is drawn exactly once, so that no document is left out.  Null sources are a source of their own.  Texts without
    tokens, null ones among them, are drawn as often as whole epochs are.  Null doc_ids are drawn like others; so are
    repeated rows, each on its own, but with keep those that share doc_id, text and source have their copies evened out.
    A column to keep that is named like one of the result is refused.  An empty table gives an empty result.
    """
    ready(documents.sparkSession)
    if tokens is None:
        tokens = F.size(F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    keep = tuple(c for c in keep if c not in ("doc_id", "source"))
    names = hidden(keep, ("n_tokens", "exponent", "weight", "repeats", "copies", "place", "position"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", tokens.cast("long").alias("tokens"), F.xxhash64("text").alias("text_hash"))
    docs = saved(docs)
    blocks = blocks or max(BLOCKS, math.ceil(docs.count() / BLOCK_ROWS))
    docs = docs.withColumn("block", F.pmod(keyed(seed, "doc_id", "text_hash"), F.lit(blocks)).cast("int"))

    by_source = totals(docs)
    whole = by_source.agg(F.sum("total").alias("all")).first()["all"] or 0
    shares = saved(by_source.withColumn("p", F.col("total") / F.lit(float(whole or 1))))
    a = exponent(shares, entropy, None if entropy is not None else most_repeats) if whole else 1.0
    raised = shares.withColumn("w", F.pow("p", F.lit(a)))
    z, least = raised.agg(F.sum("w"), F.min(F.col("w") / F.col("p"))).first() if whole else (1.0, 1.0)
    if budget is None and budget_ratio is not None:
        budget = round(budget_ratio * whole)
    drawn = float(budget) if budget is not None else whole * (z or 1.0) / (least or 1.0)
    plan = raised.select("source", (F.col("w") / z).alias("weight"), (F.col("w") / z * drawn / F.col("total")).alias("repeats"))
    plan = plan.withColumn("repeats", F.round("repeats", 9)).withColumn("epochs", F.floor("repeats"))
    plan = plan.join(shares.select("source", "total"), plan["source"].eqNullSafe(shares["source"])).select(plan["source"], "weight", "repeats", "epochs", "total", F.round((F.col("repeats") - F.col("epochs")) * F.col("total")).alias("part"))

    sums = docs.groupBy("source", "block").agg(F.sum("tokens").alias("n"))
    permuted = Window.partitionBy("source").orderBy(keyed(seed + 1, "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "block", F.coalesce(F.sum("n").over(permuted), F.lit(0)).alias("start"))
    plan = starts.join(plan, starts["source"].eqNullSafe(plan["source"]), "left").select(starts["source"], "block", "start", "weight", "repeats", "epochs", "total", "part")

    inner = Window.partitionBy("source", "block").orderBy(keyed(seed + 2, "doc_id", "text_hash"), "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("before", F.coalesce(F.sum("tokens").over(inner), F.lit(0)))
    d, p = placed.alias("d"), plan.alias("p")
    joined = d.join(p, F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.block") == F.col("p.block")))
    place = F.col("start") + F.col("before")
    extra = place + F.col("tokens") <= F.coalesce(F.col("part"), F.lit(0))
    out = joined.select(
        "d.doc_id",
        "d.source",
        F.col("tokens").alias("n_tokens"),
        F.lit(a).alias("exponent"),
        F.coalesce("weight", F.lit(0.0)).alias("weight"),
        F.coalesce("repeats", F.lit(1.0)).alias("repeats"),
        (F.coalesce("epochs", F.lit(1)) + F.when(extra & (F.col("tokens") > 0), 1).otherwise(0)).cast("long").alias("copies"),
        place.cast("long").alias("place"),
        F.coalesce(place / F.greatest(F.col("total") * F.col("repeats"), F.lit(1.0)), F.lit(0.0)).alias("position"),
        "text_hash",
    )
    if not keep:
        return out.drop("text_hash")
    figures = ("n_tokens", "exponent", "weight", "repeats", "place", "position")
    once = out.groupBy("doc_id", "text_hash", "source").agg(*[F.min(c).alias(c) for c in figures], F.round(F.avg("copies")).cast("long").alias("copies"))
    full = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64("text").alias("hash"), *[F.col(c).alias(n) for c, n in names.items()])
    f, o = full.alias("f"), once.alias("o")
    same = F.col("f.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("f.hash") == F.col("o.text_hash")) & F.col("f.source").eqNullSafe(F.col("o.source"))
    return f.join(o, same).select("f.doc_id", "f.source", "n_tokens", "exponent", "weight", "repeats", "copies", "place", "position", *[F.col(f"f.{n}").alias(c) for c, n in names.items()])
