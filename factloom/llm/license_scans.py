"""License scans: ordered signature rules behind a keyword prefilter, with DataFrame functions only.

A text is normalised once to lower-case words joined by single spaces.  Only texts with some rule's keyword are looked
at further, and there only the rules whose keyword is present are matched.  A detection is an interval of words with
the rule's priority.  A detection that lies within a longer one of at least its priority is suppressed; of equal
intervals the higher priority stays, then the earlier rule.  The base phrases count wherever they stand.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .license_rules import BASE, rules

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words whose starts a piece of a long text covers, and words beside it; no rule matches over MARGIN words.
ZONE, MARGIN = 512, 64
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal(text: Column) -> Column:
    """Words in lower case (A-Z only), joined by one space."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.trim(F.regexp_replace(lower, NOT_WORD, " "))


def spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + x)


def places(padded: Column, rule: Column) -> Column:
    """Word intervals of a rule's matches in a text with a space at either end."""
    pattern = F.concat(F.lit("(?<= )(?:"), rule["pattern"], F.lit(")(?= )"))
    matches = F.transform(F.regexp_extract_all(padded, pattern, F.lit(0)), spaces)
    gaps = F.transform(F.split(padded, pattern, -1), spaces)

    def place(inner: Column, i: Column) -> Column:
        first = total(F.slice(gaps, F.lit(1), i + 1)) + total(F.slice(matches, F.lit(1), i)) - 1
        return F.struct(first.alias("first"), (first + inner).alias("last"), rule["rank"].alias("rank"), rule["label"].alias("label"), rule["priority"].alias("priority"))

    return F.transform(matches, place)


def table(rows: list[tuple[str, int, str, str]]) -> Column:
    """The rules as an array of structs, from one literal that is folded into a constant."""
    text = json.dumps([dict(rank=i, label=a, priority=p, keyword=k, pattern=r) for i, (a, p, k, r) in enumerate(rows)])
    return F.from_json(F.lit(text), "array<struct<rank: int, label: string, priority: int, keyword: string, pattern: string>>")


def suppressed(s: Column, t: Column) -> Column:
    """Whether t's interval holds s's and outranks it."""
    holds = (t["first"] <= s["first"]) & (t["last"] >= s["last"])
    longer = (t["last"] - t["first"]) > (s["last"] - s["first"])
    ahead = (t["priority"] > s["priority"]) | ((t["priority"] == s["priority"]) & (t["rank"] < s["rank"]))
    return holds & F.when(longer, t["priority"] >= s["priority"]).otherwise(ahead)


def let(value: Column, body) -> Column:
    """body of a value that is worked out once, though body names it more than once or in a loop."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pieces_of(words: Column, n: Column) -> Column:
    """A text's words in pieces of ZONE starts each, with MARGIN words before and behind: at (the first word), low and high
    (the starts that count) and text (with a space at either end)."""

    def piece(arr: Column, low: Column) -> Column:
        at = F.greatest(low - MARGIN, F.lit(0))
        text = F.array_join(F.slice(arr, at + 1, low - at + ZONE + MARGIN), " ")
        return F.struct(at.alias("at"), low.alias("low"), (low + ZONE).alias("high"), F.concat(F.lit(" "), text, F.lit(" ")).alias("text"))

    long = let(F.split(words, " "), lambda arr: F.transform(F.sequence(F.lit(0), n - 1, F.lit(ZONE)), lambda low: piece(arr, low)))
    short = F.struct(F.lit(0).alias("at"), F.lit(0).alias("low"), n.alias("high"), F.concat(F.lit(" "), words, F.lit(" ")).alias("text"))
    return F.when(n <= ZONE, F.array(short)).otherwise(long)


def scanned(piece: Column, rows: list, base: list) -> Column:
    """The base places and the detections kept of a piece, by their place in the whole text."""
    text = piece["text"]

    def inside(x: Column) -> Column:
        return (x["first"] + piece["at"] >= piece["low"]) & (x["first"] + piece["at"] < piece["high"])

    def moved(x: Column) -> Column:
        return F.struct((x["first"] + piece["at"]).alias("first"), x["label"].alias("label"), x["priority"].alias("priority"))

    stated = F.flatten(F.transform(table(base), lambda r: places(text, r)))
    tried = F.filter(table(rows), lambda r: F.contains(text, r["keyword"]))
    found = F.flatten(F.transform(tried, lambda r: places(text, r)))
    kept = let(found, lambda f: F.filter(f, lambda s: inside(s) & ~F.exists(f, lambda t: suppressed(s, t))))
    return F.struct(F.transform(F.filter(stated, inside), moved).alias("base"), F.transform(kept, moved).alias("kept"))


def license_scan(documents: DataFrame) -> DataFrame:
    """Scan every text for license notices.

    Returns doc_id, n_words, n_base (places of base phrases), first_word and last_word (the smallest and largest word at
    which one starts; null if there is none), base_labels, labels (distinct, sorted, comma-joined; empty if there are
    none), score (the highest priority kept, over 100; 0 if there is none) and n_kept (detections that stay).  A null
    text counts as empty: no words, no labels.  A text of over ZONE words is scanned in pieces that overlap by more than
    the longest match, so work is in proportion to its length.  Null doc_ids and repeated rows are scanned like others.
    An empty table gives an empty result.  Only doc_id and text are read.
    """
    rows = rules()
    base = [(label, 50, "", phrase) for label, phrase in BASE]
    words = F.col("words")

    def gate(text: Column) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(text, F.lit(k)) for k in gates(rows)])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), normal(F.col("text")).alias("words"))
    n_words = F.when(words == "", 0).otherwise(spaces(words) + 1)
    docs = docs.select("doc_id", n_words.alias("n_words"), F.when(gate(words), words).alias("words"))
    found = F.filter(pieces_of(words, F.col("n_words")), lambda p: (F.col("n_words") <= ZONE) | gate(p["text"]))
    found = F.transform(found, lambda p: scanned(p, rows, base))
    docs = docs.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.when(words.isNotNull(), found).alias("found"))
    docs = docs.select("doc_id", "n_words", F.flatten(F.col("found.base")).alias("base"), F.flatten(F.col("found.kept")).alias("kept"))

    def joined(*spans: str) -> Column:
        labels = F.concat(*[F.coalesce(F.transform(s, lambda x: x["label"]), F.array().cast("array<string>")) for s in spans])
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    first = F.transform("base", lambda x: x["first"])
    return docs.select(
        "doc_id",
        "n_words",
        F.when(F.col("base").isNull(), 0).otherwise(F.size("base")).cast("long").alias("n_base"),
        F.array_min(first).cast("long").alias("first_word"),
        F.array_max(first).cast("long").alias("last_word"),
        joined("base").alias("base_labels"),
        joined("base", "kept").alias("labels"),
        (F.coalesce(F.array_max(F.transform("kept", lambda x: x["priority"])), F.lit(0)) / F.lit(100.0)).alias("score"),
        F.when(F.col("kept").isNull(), 0).otherwise(F.size("kept")).cast("long").alias("n_kept"),
    )


def gates(rows: list[tuple[str, int, str, str]]) -> list[str]:
    """The fewest words that every keyword or base phrase contains one of, for one cheap look at each text."""
    phrases = [k for _, _, k, _ in rows] + [p for _, p in BASE]
    out: list[str] = []
    for word in ("licen", "copyright", "gpl", "bsd", "cc by", "apache", "creative commons", "public domain", "openssl", "permission"):
        out.append(word)
    return out + sorted({p for p in phrases if not any(w in p for w in out)})
