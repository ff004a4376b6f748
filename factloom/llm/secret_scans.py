"""Secret scans: spans by pattern, and ownership frequency over the corpus.  DataFrame functions only.

1. Every text is scanned for three base kinds, and for long strings of letters and digits of any other form.
2. What could be a secret (the value of a span) is held as a hash.  Over the corpus the distinct repositories and owners
   that hold each hash are counted, in partial sums at every step: (hash, owner, repository), (hash, owner), hash.
3. A value that many owners or repositories hold is a copied example.  One that a single owner holds, and that looks drawn
   at random, is live.  Other strings become spans only if they are live; base spans stay whatever their verdict.

The commonest hashes, fewer than HOT of them whatever the corpus, meet their rows by broadcast; all others by a shuffled
join, in which no hash has more than one row in HOT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import kept_table, saved

#: Base kinds and their patterns, in the order in which they are listed.  Fixed values; the least lengths are in `spans`.
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"AKIA[A-Z0-9]+"),
    ("hex", r"[0-9a-f]+"),
]
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: Other strings: 20 characters or more of an alphabet of keys, with upper and lower case and a digit.
OTHER = r"[A-Za-z0-9+/_-]{20,}={0,2}"
MIXED = r"(?=.*[A-Z])(?=.*[a-z])(?=.*[0-9])"
#: Parts of values that are written to be replaced.
STAND_INS = r"(?i)example|sample|dummy|placeholder|changeme|your|insert|redacted|xxxx|0000|1234|abcd"

#: A block of matches whose lengths are summed at once.
BLOCK = 512
#: More hashes than this are never broadcast.
HOT = 1 << 16

SPAN = "array<struct<start: int, stop: int, kind: int, value: string>>"


def let(value: Column, body) -> Column:
    """body of a value that is worked out once, though body names it more than once or in a loop."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + x)


def sums(steps: Column) -> Column:
    """Running sums: of whole blocks, and within the block."""

    def blocks(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0)), F.lit(BLOCK)), lambda at: total(F.slice(s, at + 1, F.lit(BLOCK))))

    def sum_at(s: Column, whole: Column, i: Column) -> Column:
        done = F.floor(i / BLOCK).cast("int")
        return total(F.slice(whole, F.lit(1), done)) + total(F.slice(s, done * BLOCK + 1, i - done * BLOCK + 1))

    return let(steps, lambda s: let(blocks(s), lambda whole: F.transform(s, lambda _, i: sum_at(s, whole, i))))


def matches(text: Column, pattern: str, kind: int, value) -> Column:
    """Leftmost matches that do not overlap: where they start and stop (code points), their kind and value."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def places(hit: Column, gap: Column) -> Column:
        steps = F.transform(hit, lambda x, i: F.element_at(gap, i + 1) + F.when(i > 0, F.length(F.get(hit, i - 1))).otherwise(0))
        one = lambda x, i, start: F.struct(start.alias("start"), (start + F.length(x)).alias("stop"), F.lit(kind).alias("kind"), value(x).alias("value"))
        return let(sums(steps), lambda start: F.transform(hit, lambda x, i: one(x, i, F.element_at(start, i + 1))))

    return let(hits, lambda hit: let(gaps, lambda gap: places(hit, gap)))


def spans(text: Column) -> Column:
    """Base spans of a text, by start, then kind as listed."""
    none = F.array().cast(SPAN)
    assign, access, hexadecimal = (p for _, p in BASE)
    value = lambda x: F.regexp_extract(x, assign, 2)
    found = [
        F.when(text.rlike(assign), F.filter(matches(text, assign, 0, value), lambda s: F.length(s["value"]) >= LEAST["assign"])).otherwise(none),
        *(  # a run of these characters is one match, so the least length may stand in the pattern
            F.when(text.rlike(p), matches(text, p, kind, lambda x: x)).otherwise(none)
            for kind, p in ((1, access.replace("+", f"{{{LEAST['access'] - 4},}}")), (2, hexadecimal.replace("+", f"{{{LEAST['hex']},}}")))
        ),
    ]
    return F.array_sort(F.concat(*found))


def others(text: Column, base: Column) -> Column:
    """Strings of any other form that could be secrets and touch no base span."""
    free = lambda s: ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
    found = F.filter(matches(text, OTHER, len(BASE), lambda x: x), lambda s: s["value"].rlike(MIXED) & free(s))
    return F.when(text.rlike(OTHER), found).otherwise(F.array().cast(SPAN))


def random_looking(value: Column) -> Column:
    """No stand-in, and two characters drawn from the value are the same at most once in eight times."""

    def equal(v: Column) -> Column:
        n = lambda c: (F.length(v) - F.length(F.replace(v, c, F.lit("")))).cast("long")
        pairs = F.aggregate(F.array_distinct(F.split(v, "")), F.lit(0).cast("long"), lambda acc, c: acc + F.when(c == "", 0).otherwise(n(c) * (n(c) - 1)))
        return 8 * pairs <= F.length(v).cast("long") * (F.length(v) - 1)

    return ~value.rlike(STAND_INS) & let(value, equal)


def ownership(values: DataFrame, owners: int, copies: int) -> DataFrame:
    """Of each hash: rows, repositories and owners that hold it, and whether it is specific to an owner or copied."""
    each = values.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("rows"))
    each = each.groupBy("hash", "owner").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("repositories"))
    each = each.groupBy("hash").agg(F.sum("rows").alias("rows"), F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"))
    copied = (F.col("owners") >= owners) | (F.col("repositories") >= copies)
    return each.withColumns({"copied": copied, "specific": (F.col("owners") == 1) & ~copied})


def secret_scan(documents: DataFrame, repository: str = "doc_id", owner: str = "source", owners: int = 3, copies: int = 10) -> DataFrame:
    """Find secrets in every text, and tell copied examples from those of one owner by how often the corpus holds them.

    Returns doc_id, n_assign, n_access, n_hex, base and spans (arrays of start, stop, kind, in code points, stop excluded, by
    start, then kind), live (spans whose value a single owner holds in fewer than `copies` repositories, and that looks
    random), copied (spans whose value `owners` owners or `copies` repositories hold), n_repositories and n_owners (of the
    text's most widely held value; 0 if it has none).  Kinds: assign, access, hex, and other: strings of another form, which
    become spans only if live.

    repository, owner: columns that name them; a repository is one of its owner's, so that equal names of two owners are two;
    a null is one repository or owner of its own.  A null text counts as empty.
    Null doc_ids and repeated rows are scanned like others; an equal repeated row adds no repository.  An empty table gives
    an empty result.  Only doc_id, text and the two columns are read.  Values leave a task as hashes (128 bits) only.
    """
    text = F.col("text")
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), of(repository).alias("repository"), of(owner).alias("owner"), F.coalesce(text, F.lit("")).alias("text"))
    docs = docs.withColumn("base", spans(text))
    held = F.transform(
        F.concat("base", others(text, F.col("base"))),
        lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"), F.unhex(F.md5(s["value"])).alias("hash"), random_looking(s["value"]).alias("random")),
    )
    docs = kept_table(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "repository", "owner", held.alias("held")), "secrets")
    values = docs.select("row", "repository", "owner", F.explode("held").alias("s")).select("row", "repository", "owner", "s.*")
    counts = saved(ownership(values, owners, copies))
    rows = counts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("all")).first()["all"]
    common = F.col("rows") * HOT > F.lit(rows)  # of fewer than HOT hashes
    hot = F.broadcast(counts.where(common).drop("rows"))
    judged = values.join(hot, "hash").unionByName(values.join(hot.select("hash"), "hash", "left_anti").join(counts.where(~common).drop("rows"), "hash"))
    span = F.struct("start", "stop", "kind", (F.col("specific") & F.col("random")).alias("live"), "copied")
    judged = judged.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("judged"), F.max("repositories").alias("n_repositories"), F.max("owners").alias("n_owners"))
    out = docs.select("row", "doc_id").join(judged, "row", "left")
    all_ = F.coalesce("judged", F.array().cast("array<struct<start: int, stop: int, kind: int, live: boolean, copied: boolean>>"))
    names = F.array(*[F.lit(k) for k, _ in BASE], F.lit("other"))

    def of_kind(kind: int) -> Column:
        return F.filter(all_, lambda s: s["kind"] == kind)

    def listed(where) -> Column:
        return F.transform(F.filter(all_, where), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.element_at(names, s["kind"] + 1).alias("kind")))

    return out.select(
        "doc_id",
        *[F.size(of_kind(i)).cast("long").alias(f"n_{k}") for i, (k, _) in enumerate(BASE)],
        listed(lambda s: s["kind"] < len(BASE)).alias("base"),
        listed(lambda s: (s["kind"] < len(BASE)) | s["live"]).alias("spans"),
        listed(lambda s: s["live"]).alias("live"),
        listed(lambda s: s["copied"]).alias("copied"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_repositories", "n_owners")],
    )


def spelt(spans: str) -> Column:
    """kind:start:stop of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
