"""Token counts by prefix dynamic programming.

The tokenizer drops white space and never merges across it, so the exact count of a text's prefix is the count of the
prefix up to the last chunk (run of characters without white space) plus the count of the part of the chunk in it:

    count(text[:end of chunk i]) = count(text[:end of chunk i - 1]) + count(chunk i)

`Prefixes` stores these sums for a text, and answers at once how many tokens any prefix has and how long the longest
prefix within a budget is.  A chunk's own count comes from the library, once for each distinct chunk a worker meets
(a bounded memo); parts of a chunk are encoded only where an answer falls inside one.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import BLANK, pieces

CHUNK = re.compile(f"[^{BLANK}]+")
#: str.split() takes these four as white space too, the tokenizer does not.
NOT_BLANK = re.compile("[\x1c-\x1f]")
#: Some 100 MB.
MEMO = 1_200_000


class Counter:
    """Counts of chunks, from the library, kept up to MEMO of them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    def learn(self, chunks: set[str]) -> None:
        """Make all of these chunks known; forget the others where there are too many."""
        new = list(chunks - self.known.keys())
        if len(self.known) + len(new) > MEMO:
            self.known.clear()
            new = list(chunks)
        for i in range(0, len(new), 2048):
            part = new[i : i + 2048]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([0, *(len(c) + 1 for c in part)])
            counts = np.diff(np.searchsorted([a for a, _ in got.offsets], starts))
            self.known.update(zip(part, counts.tolist(), strict=True))

    def counts(self, chunks: list[str]) -> list[int]:
        try:
            return [self.known[c] for c in chunks]
        except KeyError:
            self.learn(set(chunks))
            return [self.known[c] for c in chunks]

    def count(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One for each tokenizer file and worker process; kept between tasks."""
    if path not in _counters:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _counters[path] = Counter(path)
    return _counters[path]


def chunks_of(text: str) -> list[str]:
    return CHUNK.findall(text) if NOT_BLANK.search(text) else text.split()


class Prefixes:
    """Exact token counts of all prefixes of a text."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter = text, counter
        spans = [m.span() for m in CHUNK.finditer(text)]
        self.starts = [a for a, _ in spans]
        self.ends = [b for _, b in spans]
        self.sums = np.cumsum([0, *counter.counts([text[a:b] for a, b in spans])]).tolist()

    @property
    def total(self) -> int:
        return self.sums[-1]

    def tokens(self, chars: int) -> int:
        """Tokens of text[:chars]."""
        i = bisect_right(self.ends, chars)
        if i == len(self.ends) or chars <= self.starts[i]:
            return self.sums[i]
        return self.sums[i] + self.counter.count(self.text[self.starts[i] : chars])

    def within(self, budget: int) -> int:
        """Characters of a longest prefix of at most budget tokens.

        A part of a word can have more tokens than the word, so every end inside the chunk where the budget runs out
        is tried; in a chunk of over 64 characters only those near the end that bisection finds.
        """
        if self.total <= budget:
            return len(self.text)
        i = bisect_right(self.sums, budget) - 1  # the first i chunks fit, one more does not
        room, a, b = budget - self.sums[i], self.starts[i], self.ends[i]
        best = a
        lo, hi = a, b
        while hi - lo > 64:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.counter.count(self.text[a:mid]) <= room else (lo, mid)
        for end in range(lo + 1, hi):
            if self.counter.count(self.text[a:end]) <= room:
                best = end
        return max(best, lo)


FIELDS = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("limit_chars", pa.int64())]


def counted(path: str, limit: int, chars: bool):
    schema = pa.schema([*FIELDS, ("prefix_tokens", pa.list_(pa.int32())), *([("prefix_chars", pa.list_(pa.int32()))] if chars else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in pieces(batches, most=4 << 20):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            chunks = [chunks_of(x) for x in texts]
            count.learn(set().union(*chunks))
            ends = np.cumsum([0, *map(len, chunks)])
            each = np.fromiter((n for own in chunks for n in count.counts(own)), dtype=np.int64, count=ends[-1])
            sums = np.concatenate([[0], np.cumsum(each)])  # the prefix sums of all texts in a row
            total = sums[ends[1:]] - sums[ends[:-1]]
            prefix = (sums[1:] - np.repeat(sums[ends[:-1]], np.diff(ends))).astype(np.int32)
            long = [Prefixes(x, count) if chars or n > limit else None for x, n in zip(texts, total.tolist(), strict=True)]
            columns = [
                batch.column("doc_id").cast(pa.int64()),
                pa.array([len(x.encode()) for x in texts], type=pa.int64()),
                pa.array(total, type=pa.int64()),
                pa.array(total > limit),
                pa.array([p.within(limit) if p else len(x) for p, x in zip(long, texts, strict=True)], type=pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(prefix)),
            ]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array([p.ends for p in long], type=pa.list_(pa.int32()))] if chars else []), schema=schema)

    return run


def token_counts(documents: DataFrame, tokenizer: str, limit: int = 2048, prefixes: bool = False) -> DataFrame:
    """Count the tokens of every text and of its prefixes.

    Returns doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), limit_chars (the characters of the longest prefix of
    at most `limit` tokens) and prefix_tokens, the stored table: the tokens up to the end of each chunk; with `prefixes`
    also prefix_chars, the characters up to there.  A null text counts as empty: 0 bytes, 0 tokens, an empty table.  A null
    doc_id is returned as it is, repeated rows each give a row, an empty table gives an empty result; only doc_id and text
    are read.  tokenizer: path of the tokenizer's file on every executor; it must drop white space.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, limit_chars long, prefix_tokens array<int>"
    return docs.mapInArrow(counted(tokenizer, limit, prefixes), out + ", prefix_chars array<int>" * prefixes)


def within_budget(counts: DataFrame, budget: int) -> DataFrame:
    """From the stored table, without encoding again: how many whole chunks of each text fit a budget of tokens, the tokens
    that they take, and, where prefix_chars is stored, the characters up to there."""
    fits = F.size(F.filter("prefix_tokens", lambda x: x <= budget))
    at = [F.when(fits > 0, F.element_at(c, fits)).otherwise(0).cast("long").alias(n) for c, n in (("prefix_tokens", "tokens"), ("prefix_chars", "chars")) if c in counts.columns]
    return counts.select("doc_id", fits.cast("long").alias("chunks"), *at)
