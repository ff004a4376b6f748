"""Periodic runs of words, by seeds and diagonals.

A run is a stretch of consecutive words with smallest period q, at least `exponent` periods and `least` words long, that
no neighbouring word extends.  Laid over itself q words further on it agrees for at least max(least, exponent * q) - q
words, so some k-gram no longer than that agrees as well.

1. Lags are taken in scales: each scale's k-grams are as long as the overlap that its smallest lag guarantees, and no lag
   of the scale is longer than a k-gram.  There are as many scales as the logarithm of the longest text.
2. The k-grams of each text are indexed by sorting their hashes.  Of the pairs of places with one k-gram only neighbours
   are needed: where a k-gram is at least as long as the period, its next place in the run is just one period on.  A text
   thus has fewer pairs in a scale than words, however often a word is repeated.
3. A pair is a seed on the diagonal of its lag.  Seeds are extended from left to right by comparing words, doubling the
   stretch each time; a table with the furthest place covered on each lag lets all further seeds of a run pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import Words, grams, mix, pieces

Run = tuple[int, int, int]


def scales(longest: int, exponent: int, least: int) -> Iterator[tuple[int, int, int]]:
    """Smallest lag, largest lag and length of the k-grams, for texts of up to `longest` words."""
    low = 1
    while max(least, exponent * low) <= longest:
        turn = least // exponent  # the overlap falls up to here and rises from then on
        k = min(max(least, exponent * q) - q for q in {low, max(low, turn), max(low, turn + 1)})
        yield low, k, k
        low = k + 1


def seeds(hashes: np.ndarray, ends: np.ndarray, salt: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of k-grams, and how far on the next place of the same k-gram in the same text is.

    ends: for each word the end of its text; salt: for each word a number of its text.
    """
    at = np.flatnonzero(np.arange(len(hashes)) + k <= ends)
    if not len(at):
        return at, at
    key = mix(grams(hashes, k)[at] ^ salt[at])
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    member = np.zeros(len(key), dtype=bool)
    member[order[1:][same]] = True
    member[order[:-1][same]] = True
    at, key = at[member], key[member]
    order = np.lexsort((at, key))
    at, key = at[order], key[order]
    pair = (key[1:] == key[:-1]) & (ends[at[1:]] == ends[at[:-1]])
    first, lag = at[:-1][pair], np.diff(at)[pair]
    order = np.argsort(first)
    return first[order], lag[order]


def stretch(hashes: np.ndarray, at: int, lag: int, end: int) -> int:
    """How far words from `at` on, before `end`, agree with those `lag` further on."""
    width = 32
    while at + lag < end:
        size = min(width, end - lag - at)
        differs = hashes[at : at + size] != hashes[at + lag : at + lag + size]
        if differs.any():
            return at + int(differs.argmax())
        at += size
        width *= 2
    return at


def found(hashes: np.ndarray, first: np.ndarray, exponent: int, least: int) -> list[list[Run]]:
    """The runs (start, length, period) of each text, by start, then period; first: of the texts' words, and their end."""
    counts = np.diff(first)
    out: list[list[Run]] = [[] for _ in counts]
    for low, high, k in scales(int(counts.max(initial=0)), exponent, least):
        long = np.flatnonzero(counts >= max(least, exponent * low))
        words = np.flatnonzero(np.repeat(counts >= max(least, exponent * low), counts))
        if len(words) == 0:
            continue
        own, size = hashes[words], counts[long]
        starts = np.cumsum(size) - size
        of = np.repeat(np.arange(len(long)), size)
        ends = (starts + size)[of]
        place, lag = seeds(own, ends, mix(of.astype(np.uint64), 3), k)
        fits = (lag >= low) & (lag <= high)
        place, lag = place[fits], lag[fits]
        order = np.lexsort((place, lag))
        follows = np.zeros(len(place), dtype=bool)  # the seed a word before lies on the same diagonal and covers this one
        follows[1:] = (np.diff(lag[order]) == 0) & (np.diff(place[order]) == 1)
        heads = np.sort(order[~follows])
        covered: dict[int, int] = {}
        for a, q, doc in zip(place[heads].tolist(), lag[heads].tolist(), of[place[heads]].tolist(), strict=True):
            if covered.get(q, 0) >= a + k:
                continue
            end = int(ends[a])
            b = stretch(own, a + k, q, end)
            covered[q] = b
            length = b + q - a
            if length >= max(least, exponent * q):
                out[long[doc]].append((a - int(starts[doc]), length, q))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def strongest(runs: list[Run]) -> Run:
    """The run with the greatest exact exponent; of equal ones the first, then that of the smallest period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words joined by one space, without those that some run holds after its first period."""
    if runs:
        gone = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]
    return b" ".join(words)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("strongest", RUN), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])
NAMES = ("start", "length", "period")


def scanned(exponent: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = Words(batch.column("text"))
            runs = found(texts.hashes(), texts.first, exponent, least)
            raw = texts.data.tobytes()
            short = [collapsed(raw[a:b].split(), own) for a, b, own in zip(texts.at[:-1].tolist(), texts.at[1:].tolist(), runs, strict=True)]
            columns = [
                batch.column("doc_id").cast(pa.int64()),
                pa.array(texts.counts, type=pa.int64()),
                pa.array([dict(zip(NAMES, strongest(r), strict=True)) if r else None for r in runs], type=RUN),
                pa.array([[dict(zip(NAMES, x, strict=True)) for x in r] for r in runs], type=pa.list_(RUN)),
                pa.array(short, type=pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=OUT)

    return run


def periodic_runs(documents: DataFrame, exponent: int = 4, least: int = 6) -> DataFrame:
    """Find all periodic runs of words in every text, and the text with each run reduced to its first period.

    Returns doc_id, n_words, strongest (the run with the greatest exponent; ties: smallest start, then period; null where
    there is none), runs (start, length and period in words, by start, then period; may be empty) and collapsed (the words
    left, joined by one space).  A word goes if any run holds it after that run's first period.

    Words are separated by ASCII white space.  A null, empty or blank text has no words, no runs and an empty collapsed text.
    Null doc_ids and repeated rows are judged like others, each row by itself; an empty table gives an empty result.  Only
    doc_id and text are read.  Texts of any length are held whole, one task each; the work is n log n.
    """
    if exponent < 2 or least < exponent:
        raise ValueError("a run has two periods at least, and as many words as periods")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    one = "struct<start: long, length: long, period: long>"
    return docs.mapInArrow(scanned(exponent, least), f"doc_id long, n_words long, strongest {one}, runs array<{one}>, collapsed string")
