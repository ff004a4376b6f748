"""Quality rules from a suffix array of each text's words.

The suffixes of the words of many texts are sorted at once by prefix doubling; a text's number is part of the first
key, so suffixes of different texts never compare equal and each text gets its own array.  A round doubles the compared
length and sorts only suffixes that are still tied, so texts without long repeats cost few rounds.  Longest common
prefixes of neighbours then give, for each word, the longest repeat that starts there: the intervals of the array whose
common prefix is at least `least` words are the maximal repeated substrings, and their places are the spans whose
union and greatest length the rules limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import Words, hidden, pieces

SYMBOL = np.zeros(256, dtype=np.int64)
SYMBOL[list(b"#*$%&|<>")] = 1


def suffix_order(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes sorted within each text, and the ranks after each doubling (equal rank: equal that far)."""
    n = len(hashes)
    _, word = np.unique(hashes, return_inverse=True)
    o = np.lexsort((word, text))
    rank = ranked(o, text[o], word[o])
    ranks = [rank]
    span = 1
    while True:
        tied = ties(o, rank)
        if not len(tied):
            return o, ranks
        own = o[tied]
        ahead = own + span
        inside = (ahead < n) & (text[np.minimum(ahead, n - 1)] == text[own])
        then = np.where(inside, rank[np.minimum(ahead, n - 1)], -1)
        again = np.lexsort((then, rank[own]))
        own, then = own[again], then[again]
        old = rank[own]
        o[tied] = own
        new = np.ones(len(own), dtype=bool)
        new[1:] = (old[1:] != old[:-1]) | (then[1:] != then[:-1])
        rank = rank.copy()
        rank[own] = tied[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
        ranks.append(rank)
        span *= 2


def ranked(o: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For each suffix the place of the first one equal to it; keys are in order o."""
    new = np.ones(len(o), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    rank = np.empty(len(o), dtype=np.int64)
    rank[o] = np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))
    return rank


def ties(o: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places in o whose suffix has the rank of a neighbour."""
    same = rank[o[1:]] == rank[o[:-1]]
    tied = np.zeros(len(o), dtype=bool)
    tied[1:] |= same
    tied[:-1] |= same
    return np.flatnonzero(tied)


def longest_repeats(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each word, the number of words of the longest sequence that starts there and occurs in its text again."""
    n = len(hashes)
    if n < 2:
        return np.zeros(n, dtype=np.int64)
    o, ranks = suffix_order(hashes, text)
    common = np.zeros(n - 1, dtype=np.int64)  # of neighbours in o
    left, right = o[:-1].copy(), o[1:].copy()
    live = np.flatnonzero(ranks[0][left] == ranks[0][right])
    a, b = left[live], right[live]
    for power in range(len(ranks) - 1, -1, -1):  # compare 2 ** power words at a time, longest first
        ok = (a < n) & (b < n)
        ok[ok] = ranks[power][a[ok]] == ranks[power][b[ok]]
        ok[ok] = (text[a[ok]] == text[left[live[ok]]]) & (text[b[ok]] == text[right[live[ok]]])
        step = ok.astype(np.int64) << power
        common[live] += step
        a, b = a + step, b + step
    longest = np.zeros(n, dtype=np.int64)
    longest[o[1:]] = common
    longest[o[:-1]] = np.maximum(longest[o[:-1]], common)
    return longest


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in a span."""
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths, -1)
    return np.cumsum(edges[:n]) > 0


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def duplicate_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x and not x.isspace() or x.strip(" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


RULES = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_covered_words", pa.int64()), ("longest_repeat", pa.int64())]
)


def judged(window: int, least: int, most_covered: float, most_longest: int, min_words: int, most_repeated: int, keep: list[str]):
    """Arrow function: the figures and verdict of each text; keep: further columns to return."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=1 << 20):
            texts = batch.column("text")
            words = Words(texts)
            of, first, n = words.of(), words.first, words.counts.astype(np.int64)
            longest = longest_repeats(words.hashes(), of)
            total = len(longest)

            at = np.flatnonzero(longest >= window)
            repeated = sums(covered(at, np.full(len(at), window), total), first)
            at = np.flatnonzero(longest >= least)
            spanned = sums(covered(at, longest[at], total), first)
            top = np.zeros(batch.num_rows, dtype=np.int64)
            np.maximum.at(top, of[at], longest[at])

            data, starts = words.data, words.at
            inside = np.zeros(len(data) + 1, dtype=np.int64)
            inside[words.starts] += 1
            inside[words.ends] -= 1
            chars = sums(((data & 0xC0) != 0x80) & (np.cumsum(inside[:-1]) > 0), starts) if len(data) else np.zeros(batch.num_rows, dtype=np.int64)
            symbols = sums(SYMBOL[data], starts) if len(data) else np.zeros(batch.num_rows, dtype=np.int64)

            lines = np.array([duplicate_lines(x or "") for x in texts.to_pylist()], dtype=np.int64)
            failed = (n < min_words) | (100 * repeated > most_repeated * n)
            good = ~failed & (spanned <= most_covered * n) & (top <= most_longest)
            ids = batch.column("doc_id").cast(pa.int64())
            columns = [ids, *(pa.array(x) for x in (n, chars, symbols, lines, repeated, failed, good, spanned, top))]
            names = [*RULES.names, *keep]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c) for c in keep)], names=names)

    return run


def repetition_rules(
    documents: DataFrame,
    window: int = 8,
    least: int = 5,
    most_covered: float = 0.4,
    most_longest: int = 200,
    min_words: int = 20,
    most_repeated: int = 30,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Judge every text by how much of it repeats.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (words in windows of `window` words that
    the text has twice or more), base_failed (under min_words words, or over most_repeated percent such words), kept,
    n_covered_words (words in repeats of `least` words or more) and longest_repeat (words; 0 if there is no such
    repeat).  A text is kept if it does not fail the base rules, at most the share most_covered of its words is covered
    and no repeat is over most_longest words.  A null text has no words and fails.  Null doc_ids and repeated rows are
    judged like others, each on its own.  An empty table gives an empty result.  keep: further columns to hand through; one
    that is named like a column of the result is refused.
    """
    keep = tuple(c for c in keep if c != "doc_id")
    names = hidden(tuple(c for c in keep if c != "text"), tuple(RULES.names[1:]))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).alias(n) for c, n in names.items()])
    held = [names.get(c, c) for c in keep]
    out = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_covered_words long, longest_repeat long"
    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*held).schema)
    return docs.mapInArrow(judged(window, least, most_covered, most_longest, min_words, most_repeated, held), out + more).withColumnsRenamed({n: c for c, n in names.items()})
