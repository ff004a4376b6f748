"""Alignment of the tokens that two tokenizers make of one text, and how often ids are linked in the corpus.

Both token lists spell the same bytes.  The byte offsets where a token of either ends form two ascending lists; those in
both cut the text into groups, and all tokens of a group are linked with one another.

1. Galloping intersection: the shorter list drives.  From where its anchor (every STRIDE-th end, found by bisection) lies
   in the longer list, each end strides on in doubling steps and then bisects the last one, all ends of a batch at once.
   Common indices slice the groups, and differences of ranks are the numbers of tokens that overlap in them.
2. A document's distinct linked pairs of ids are counted over the corpus with partial sums in every task.
3. The counts go back to the documents: of the commonest pairs, at most HOT of them whatever the corpus, by broadcast; of
   all others, none of which is in more than a small share of the documents, by a shuffled join.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .best_fit_packing import Encoder
from .shared import kept_table, pieces, saved

#: Ends of the driving list for each one that is looked up in the whole of the other.
STRIDE = 16
#: Links written out at a time; groups with more than LARGE are written as distinct ids with their numbers.
LINKS = 1 << 21
LARGE = 4096
#: Pairs that are broadcast, at most.
HOT = 1 << 17


class Plain(Encoder):
    """Ids of texts in which the strings of special tokens are plain text."""

    def __init__(self, path: str, ranks: str | None, pattern: str | None):
        super().__init__(path, ranks, pattern)
        self.tokenizer.encode_special_tokens = True
        self.special = re.compile("(?!)")


def byte_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary, whose file spells every byte as one printable character."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    spelt = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    entries = file["model"]["vocab"] | {x["content"]: x["id"] for x in file.get("added_tokens") or []}
    out = [b""] * (max(entries.values()) + 1)
    for token, i in entries.items():
        out[i] = bytes(spelt[c] for c in token) if all(c in spelt for c in token) else token.encode()
    return out


def piece_tokens(model) -> list[bytes]:
    """The bytes of each id of a piece vocabulary: its piece, with the mark of a space as a space; <0xHH> is one byte."""
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]


class Side:
    """A vocabulary: each id's bytes, how many they are, and its number in decimal before each separator."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.spelt = [f"{i}{s}" for i in range(len(tokens)) for s in ",|;"]

    def spells(self, ids: list[int], data: bytes) -> bool:
        return b"".join(map(self.tokens.__getitem__, ids)) == data


class Both:
    """The two tokenizers."""

    def __init__(self, path: str, ranks: str | None, pattern: str | None, model: str):
        import sentencepiece

        self.encoder = Plain(path, ranks, pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        self.a, self.b = Side(byte_tokens(path)), Side(piece_tokens(self.model))

    def ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of the texts on either side; none of texts that are empty or that one side spells otherwise."""
        of_a = [self.encoder.encode(" " + x).tolist() if x else [] for x in texts]
        of_b = self.model.encode(texts, num_threads=1) if texts else []
        for i, x in enumerate(texts):
            data = b" " + x.encode()
            if not x or not self.a.spells(of_a[i], data) or not self.b.spells(of_b[i], data):
                of_a[i] = of_b[i] = []
        return of_a, of_b


_both: dict[tuple, Both] = {}


def both(*files: str | None) -> Both:
    """One for each pair of tokenizers and worker process; kept between tasks."""
    if files not in _both:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _both[files] = Both(*files)
    return _both[files]


def gallop(drive: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each of the ascending values of drive the first place in target with no smaller value; the last value of target
    is none smaller than any of drive."""
    n, last = len(drive), len(target) - 1
    low = np.repeat(np.searchsorted(target, drive[::STRIDE]), STRIDE)[:n]
    high, step = low.copy(), 1
    behind = np.flatnonzero(target[high] < drive)
    while len(behind):
        low[behind] = high[behind] + 1
        high[behind] = np.minimum(high[behind] + step, last)
        behind = behind[target[high[behind]] < drive[behind]]
        step *= 2
    unsure = np.flatnonzero(low < high)
    while len(unsure):
        middle = (low[unsure] + high[unsure]) // 2
        below = target[middle] < drive[unsure]
        low[unsure[below]] = middle[below] + 1
        high[unsure[~below]] = middle[~below]
        unsure = unsure[low[unsure] < high[unsure]]
    return low


def common(a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices in a and in b of the ends that both hold; first_*: where each text's ends begin, and the end of all."""
    n_a, n_b = np.diff(first_a), np.diff(first_b)
    out_a, out_b = [], []
    for side, x, y, n, out_x, out_y in ((n_a <= n_b, a, b, n_a, out_a, out_b), (n_a > n_b, b, a, n_b, out_b, out_a)):
        drive = np.flatnonzero(np.repeat(side, n))
        if len(drive):
            place = gallop(x[drive], y)
            met = y[place] == x[drive]
            out_x.append(drive[met])
            out_y.append(place[met])
    if not out_a:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.sort(np.concatenate(out_a)), np.sort(np.concatenate(out_b))


class Aligned:
    """Groups of some texts: ids of either side in a row, where each group begins on either side, and whose it is."""

    def __init__(self, of_a: list[list[int]], of_b: list[list[int]], both: Both):
        self.n_a, self.n_b = (np.array([len(x) for x in ids], dtype=np.int64) for ids in (of_a, of_b))
        self.a, self.b = (np.fromiter((i for x in ids for i in x), dtype=np.int64, count=int(n.sum())) for ids, n in ((of_a, self.n_a), (of_b, self.n_b)))
        first_a, first_b = (np.concatenate([[0], np.cumsum(n)]) for n in (self.n_a, self.n_b))
        ends_a, ends_b = np.cumsum(both.a.sizes[self.a]), np.cumsum(both.b.sizes[self.b])
        at_a, at_b = common(ends_a, ends_b, first_a, first_b)
        self.from_a, self.from_b = (np.concatenate([[0], x + 1]) for x in (at_a, at_b))
        self.in_a, self.in_b = np.diff(self.from_a), np.diff(self.from_b)
        self.links = self.in_a * self.in_b
        self.first = np.searchsorted(self.from_a[:-1], first_a)  # of each text's groups
        sums = np.concatenate([[0], np.cumsum(self.links)])
        self.n_links = sums[self.first[1:]] - sums[self.first[:-1]]

    def spelt(self, both: Both) -> list[str]:
        """Each text's groups: a1,a2|b1;a3|b2,b3"""
        n = len(self.links)
        group_a, group_b = np.repeat(np.arange(n), self.in_a), np.repeat(np.arange(n), self.in_b)
        mark_a, mark_b = np.zeros(len(self.a), dtype=np.int64), np.zeros(len(self.b), dtype=np.int64)
        mark_a[self.from_a[1:] - 1] = 1
        mark_b[self.from_b[1:] - 1] = 2
        row = np.empty(len(self.a) + len(self.b), dtype=object)
        row[np.arange(len(self.a)) + self.from_b[group_a]] = list(map(both.a.spelt.__getitem__, (3 * self.a + mark_a).tolist()))
        row[np.arange(len(self.b)) + self.from_a[group_b + 1]] = list(map(both.b.spelt.__getitem__, (3 * self.b + mark_b).tolist()))
        ends = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)]).tolist()
        row = row.tolist()
        return ["".join(row[x:y])[:-1] for x, y in zip(ends, ends[1:], strict=False)]

    def pairs(self, low: int, high: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the texts from low to high: (text, pair) as one number each, distinct and ascending, and how often it is linked;
        a pair is a * width + b."""
        groups = np.arange(self.first[low], self.first[high])
        text = np.repeat(np.arange(low, high), np.diff(self.first[low : high + 1]))
        large = self.links[groups] > LARGE
        g, t = groups[~large], text[~large]
        each = np.repeat(np.arange(len(g)), self.links[g])
        i = np.arange(len(each)) - np.repeat(np.cumsum(self.links[g]) - self.links[g], self.links[g])
        wide = self.in_b[g][each]
        pair = self.a[self.from_a[g][each] + i // wide] * width + self.b[self.from_b[g][each] + i % wide]
        keys, n = [t[each] * self.span + pair], [np.ones(len(pair), dtype=np.int64)]
        for g, t in zip(groups[large].tolist(), text[large].tolist(), strict=True):
            (a, times_a), (b, times_b) = (np.unique(x, return_counts=True) for x in (self.a[self.from_a[g] : self.from_a[g + 1]], self.b[self.from_b[g] : self.from_b[g + 1]]))
            keys.append(t * self.span + np.add.outer(a * width, b).ravel())
            n.append(np.multiply.outer(times_a, times_b).ravel())
        keys, n = np.concatenate(keys), np.concatenate(n)
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
        sums = np.add.reduceat(n, heads) if len(heads) else n
        return keys[heads] // self.span, keys[heads] % self.span, sums

    #: More than any pair.
    span = 1 << 40


OUT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])


def grouped(files: tuple[str | None, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = both(*files)
        width = len(tools.b.tokens)
        for batch in pieces(batches, most=1 << 20):
            texts = Aligned(*tools.ids([x or "" for x in batch.column("text").to_pylist()]), tools)
            n, at = len(texts.n_a), 0
            spelt = texts.spelt(tools)
            sums = np.cumsum(texts.n_links)
            while at < n:  # texts whose links fit into memory together, one at least
                done = sums[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(sums, done + LINKS, side="right")))
                text, pair, times = texts.pairs(at, to, width)
                cuts = pa.array(np.searchsorted(text, np.arange(at, to + 1)), type=pa.int32())
                columns = [
                    batch.column("doc_id").slice(at, to - at).cast(pa.int64()),
                    *(pa.array(x[at:to]) for x in (texts.n_a, texts.n_b, np.diff(texts.first), texts.n_links)),
                    pa.array(spelt[at:to], type=pa.string()),
                    pa.ListArray.from_arrays(cuts, pa.array(pair)),
                    pa.ListArray.from_arrays(cuts, pa.array(times)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=OUT)
                at = to

    return run


def aligned(documents: DataFrame, tokenizer: str, model: str, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """Align the tokens of a byte-level tokenizer (A, of " " + text) with those of a piece model (B, of the text).

    Returns doc_id, n_a, n_b (tokens), n_groups, n_links (pairs of tokens that share a group), groups (ids in order, as
    a1,a2|b1;a3|b2,b3), pairs (distinct linked ids, as a * (ids of B) + b, ascending) and times (how often each is linked).

    tokenizer, model: paths of the files on every executor; ranks and pattern: the same vocabulary as tokenizer for a
    second, faster library.  Strings of special tokens are plain text.  A text that is null or empty, or that either side
    spells with other bytes, has no tokens: zeros and empties.  Null doc_ids and repeated rows are taken like others, an
    empty table gives an empty result; only doc_id and text are read.  A text is held whole in one task.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(grouped((tokenizer, ranks, pattern, model)), "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>")


def pair_counts(links: DataFrame, width: int) -> DataFrame:
    """Of each pair: held (how many rows of links hold it) and best (whether no pair with its A id is held by more)."""
    counts = saved(links.groupBy("pair").agg(F.count(F.lit(1)).alias("held")).withColumn("a", F.expr(f"pair div {width}L")))
    most = counts.groupBy("a").agg(F.max("held").alias("most"))
    return saved(counts.join(most, "a").select("pair", "held", (F.col("held") == F.col("most")).alias("best")))


def commonest(counts: DataFrame, most: int = HOT) -> tuple[Column, bool]:
    """A condition that at most `most` pairs fulfil, those held most often, and whether any pair does not.  It is a power of
    two that `held` reaches, from a histogram of 64 rows at most."""
    bits = F.length(F.bin("held"))
    rows = {r["bits"]: r["n"] for r in counts.groupBy(bits.alias("bits")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, taken = 64, 0
    while least > 1 and taken + rows.get(least - 1, 0) <= most:
        least -= 1
        taken += rows.get(least, 0)
    return bits >= least, taken < sum(rows.values())


def alignment_scores(documents: DataFrame, tokenizer: str, model: str, ranks: str | None = None, pattern: str | None = None, most: int = HOT) -> DataFrame:
    """What `aligned` counts, and how common each document's links are in the corpus.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is held by as many documents as any pair with the
    same A id), count_sum (over links, how many documents hold the pair) and groups_sha256 (empty where there are no tokens).
    Each row counts as a document, repeated ones too.  Odd rows: as in `aligned`.
    """
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=model).get_piece_size()
    rows = aligned(documents, tokenizer, model, ranks, pattern)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    rows = kept_table(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times"), "alignment")
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    counts = pair_counts(links.select("pair"), width)
    common, more = commonest(counts, most)
    hot = F.broadcast(counts.where(common))

    def summed(met: DataFrame) -> DataFrame:
        return met.groupBy("row").agg(F.sum(F.col("times") * F.col("held")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))

    sums = summed(links.join(hot, "pair"))
    if more:
        rest = links.join(hot.select("pair"), "pair", "left_anti").join(counts.where(~common), "pair")
        sums = sums.unionByName(summed(rest)).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    filled = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return rows.drop("pairs", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *filled, "groups_sha256")
