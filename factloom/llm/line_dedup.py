"""Line dedup by pairwise alignment.

1. A text becomes the hashes of its lines; texts themselves go no further until lines are deleted.
2. Documents that overlap are found through the least runs of lines that could go: from each line forwards and back,
   the shortest run with `least_words` words.  Each run's hash names its first holder, the smallest doc_id, and every
   later holder is paired with it: one pair a holder, however many hold the run, and never all pairs of its holders.  A
   rare run thereby pairs just the documents that overlap; one that a third of all documents hold costs one pair each.
3. Every pair is aligned with patience diff; the earlier document's lines travel once for up to PAIRS later ones.  Lines
   that both documents hold exactly once anchor the alignment, in the longest increasing chain; the gaps between are
   aligned likewise, and a gap without such lines by its common start and end or its longest common block.  Equal lines
   in a row make common blocks.
4. Aligned blocks of at least `least_words` words are deleted from the later document, and so are its least runs that
   the earlier one holds out of order.  Only a run that the later document repeats, that one earlier document alone
   holds, and less often, goes no more often than the alignment places it.

Any common block of enough words is a union of such least runs, and each of them meets its first holder; so all goes that
an alignment with any earlier document takes, though a document meets the first holders only.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import hidden, mix, ready, saved, segments


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def words(line: Column) -> Column:
    """Number of words: runs of characters other than ASCII white space."""
    return F.size(F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda x: x != ""))


def patience(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Common blocks (start in a, start in b, length) of a patience alignment.

    Lines that occur once on both sides anchor it, in the longest increasing chain; then the gaps between anchors are
    aligned likewise, on what occurs once in the gap.  A gap without anchors gives its common start and end, and where
    it has neither, its longest common block.
    """
    met: list[tuple[int, int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        low_a, top_a, low_b, top_b = gaps.pop()
        if low_a == top_a or low_b == top_b:
            continue
        x, y = a[low_a:top_a], b[low_b:top_b]
        if set(x).isdisjoint(y):
            continue
        blocks = [(i, j, 1) for i, j in anchors(x, y)] or ends(x, y) or [longest_block(x, y)]
        end_a, end_b = low_a, low_b
        for i, j, n in blocks:
            i, j = i + low_a, j + low_b
            met.append((i, j, n))
            gaps.append((end_a, i, end_b, j))
            end_a, end_b = i + n, j + n
        gaps.append((end_a, top_a, end_b, top_b))
    out: list[tuple[int, int, int]] = []
    for i, j, n in sorted(met):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return out


def anchors(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Longest increasing chain of places of the lines that both sides hold exactly once."""
    in_a, in_b = Counter(a), Counter(b)
    at = {x: i for i, x in enumerate(a) if in_a[x] == 1}
    pairs = [(at[x], j) for j, x in enumerate(b) if in_b[x] == 1 and x in at]  # by place in b
    tails: list[int] = []  # ends of the best increasing chains of each length
    ends: list[int] = []
    before = [-1] * len(pairs)
    for p, (i, _) in enumerate(pairs):
        k = bisect_left(tails, i)
        before[p] = ends[k - 1] if k else -1
        tails[k : k + 1] = [i]
        ends[k : k + 1] = [p]
    chain: list[tuple[int, int]] = []
    p = ends[-1] if ends else -1
    while p >= 0:
        chain.append(pairs[p])
        p = before[p]
    return chain[::-1]


def ends(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Common start and common end, where there are any."""
    most = min(len(a), len(b))
    n = next((k for k in range(most) if a[k] != b[k]), most)
    m = next((k for k in range(most - n) if a[-1 - k] != b[-1 - k]), most - n)
    return [x for x in ((0, 0, n), (len(a) - m, len(b) - m, m)) if x[2]]


def longest_block(a: list[int], b: list[int]) -> tuple[int, int, int]:
    """The longest block of lines common to both, by a suffix automaton of a: in proportion to their lengths."""
    nexts: list[dict[int, int]] = [{}]
    link, size, end = [-1], [0], [0]
    last = 0
    for i, x in enumerate(a):
        new, p = len(nexts), last
        nexts.append({})
        link.append(0)
        size.append(size[last] + 1)
        end.append(i + 1)
        while p >= 0 and x not in nexts[p]:
            nexts[p][x] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][x]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                end.append(end[q])
                while p >= 0 and nexts[p].get(x) == q:
                    nexts[p][x] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    best = (0, 0, 0)
    state = n = 0
    for j, x in enumerate(b):
        while state and x not in nexts[state]:
            state = link[state]
            n = size[state]
        if x in nexts[state]:
            state, n = nexts[state][x], n + 1
        if n > best[2]:
            best = (end[state] - n, j + 1 - n, n)
    return best


def least_runs(lines: np.ndarray, n: np.ndarray, at: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents, starts, ends and hashes of the shortest runs of at least least_words words from each line on and up to it.

    lines, n: hashes and words of all lines; at: where each document begins, and the end.
    """
    total = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(n, out=total[1:])
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    i = np.arange(len(n))
    ends = np.searchsorted(total, total[:-1] + least_words, side="left")
    starts = np.searchsorted(total, total[1:] - least_words, side="right") - 1
    ahead, back = ends <= at[1:][doc], starts >= at[:-1][doc]
    doc, starts, ends = np.concatenate([doc[ahead], doc[back]]), np.concatenate([i[ahead], starts[back]]), np.concatenate([ends[ahead], i[back] + 1])
    hashes = segments(mix(lines.view(np.uint64)), starts, ends) + ((ends - starts).astype(np.uint64) << np.uint64(3))
    return doc, starts, ends, mix(hashes, 41)


def with_runs(least_words: int):
    """Arrow function: adds the hashes of each document's least runs, and of those that it repeats."""

    def listed(doc: np.ndarray, hashes: np.ndarray, n: int) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), type=pa.int32()), pa.array(hashes.view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("lines")
            at = lists.offsets.to_numpy().astype(np.int64)
            doc, start, _, hashes = least_runs(lists.flatten().to_numpy(), batch.column("n_words").flatten().to_numpy(), at - at[0], least_words)
            o = np.lexsort((start, hashes, doc))
            doc, hashes, start = doc[o], hashes[o], start[o]
            new, again = np.ones(len(o), dtype=bool), np.zeros(len(o), dtype=bool)
            new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
            again[1:] = ~new[1:] & (start[1:] != start[:-1])
            again[1:] &= ~(again[:-1] & ~new[1:])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, listed(doc[new], hashes[new], n), listed(doc[again], hashes[again], n)], names=[*batch.schema.names, "runs", "repeated"])

    return run


def held_anywhere(a: list[int], b: list[int], n: list[int], alone: list[int], least_words: int) -> np.ndarray:
    """Lines of b, with n words each, inside least runs that a holds too, in whatever order.

    alone: hashes of runs that only a holds, and b more than once: they count if a holds them as often as b.
    """
    count = dict(zip(b, n, strict=True))  # lines that b lacks may count as 0: no run of b has them
    both = np.array([*a, *b], dtype=np.int64)
    doc, starts, ends, hashes = least_runs(both, np.array([count.get(x, 0) for x in a] + n, dtype=np.int64), np.array([0, len(a), len(both)]), least_words)
    common = (doc == 1) & np.isin(hashes, hashes[doc == 0])
    for x in np.array(alone, dtype=np.int64).view(np.uint64):
        of_a, of_b = (len(np.unique(starts[(doc == d) & (hashes == x)])) for d in (0, 1))
        if 0 < of_a < of_b:
            common &= hashes != x
    edges = np.bincount(starts[common], minlength=len(both) + 1) - np.bincount(ends[common], minlength=len(both) + 1)
    return np.flatnonzero(np.cumsum(edges)[len(a) : len(both)] > 0)


def aligned(least_words: int):
    """Arrow function over rows sorted by earlier document: its own lines first (`leads`), then those of each later one.

    For each later document the lines to delete; only one earlier document is held at a time.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("gone", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        known: set[int] = set()
        for batch in batches:
            out: list[tuple] = []
            for leads, doc, text, b, n, alone in zip(*(batch.column(c).to_pylist() for c in ("leads", "doc_id", "text_hash", "lines", "n_words", "alone")), strict=True):
                if leads:
                    a, known = b, set(b)
                    continue
                gone: set[int] = set()
                for _, start, length in patience(a, b):
                    if sum(n[start : start + length]) >= least_words:
                        gone.update(range(start, start + length))
                if any(x in known for i, x in enumerate(b) if i not in gone):  # the alignment leaves some over
                    gone.update(held_anywhere(a, b, n, alone or [], least_words).tolist())
                if gone:
                    out.append((doc, text, sorted(gone)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], type=f.type) for i, f in enumerate(schema)], schema=schema)

    return run


#: Pairs of one earlier document that a task's group holds; more of them are dealt out, each group with its lines once.
PAIRS = 64


def line_dedup(documents: DataFrame, least_words: int = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """Delete from every document the blocks of consecutive lines that it shares with any earlier one.

    Returns doc_id, n_lines (lines with a word), n_removed (deleted lines with a word), text (the lines left, joined by
    newlines; unchanged and null where it was null if none is deleted) and the columns named by keep.  Lines are split at
    newlines and compared whole; lines without a word go with a block around them.  A block goes wherever the earlier
    document holds it; of a block that one earlier document alone holds, and less often, the copies that the alignment
    does not place stay.  Documents are judged on the input: a block goes even if the earlier document loses it to one before.  Null texts have no
    lines.  Rows without a doc_id pair with none and stay as they are; rows that share a doc_id are not aligned with each
    other.  A column to keep that is named like one of the result is refused.  An empty table gives an empty
    result.
    """
    ready(documents.sparkSession)
    names = hidden(tuple(c for c in keep if c not in ("doc_id", "text")), ("n_lines", "n_removed"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).alias(n) for c, n in names.items()]).withColumn("text_hash", F.xxhash64("text"))
    held = docs.where("doc_id is not null and text is not null").select("doc_id", "text_hash", lines(F.col("text")).alias("l"))
    held = held.select("doc_id", "text_hash", F.transform("l", lambda x: F.xxhash64(x)).alias("lines"), F.transform("l", words).alias("n_words"))
    held = held.dropDuplicates(["doc_id", "text_hash"])
    held = saved(held.mapInArrow(with_runs(least_words), "doc_id long, text_hash long, lines array<long>, n_words array<int>, runs array<long>, repeated array<long>"))

    by_run = held.select("doc_id", "text_hash", F.explode("runs").alias("run"))
    firsts = by_run.groupBy("run").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id < last").select("run", "first")
    firsts = saved(firsts)  # a join right above an aggregate could not be split where a run is very common
    pairs = by_run.join(firsts, "run").where("first.doc_id < doc_id").select(F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"), "doc_id", "text_hash").distinct()

    again = saved(held.select("doc_id", "text_hash", F.explode("repeated").alias("run")))
    known = saved(again.select("run").distinct().join(firsts, "run").select("run", F.col("first.doc_id").alias("first_id")))
    later = saved(by_run.join(known, "run").where("first_id < doc_id").select("run", "first_id", "doc_id"))  # nor one right below an aggregate by its key
    seconds = saved(later.groupBy("run", "first_id").agg(F.min("doc_id").alias("second_id")))
    alone = again.join(seconds, "run").where("first_id < doc_id and second_id >= doc_id").groupBy("doc_id", "text_hash").agg(F.collect_list("run").alias("alone"))

    held = held.drop("runs", "repeated").join(saved(alone), ["doc_id", "text_hash"], "left")
    pairs = saved(pairs)
    counts = pairs.groupBy("first_id", "first_hash").agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("parts"))
    counts = saved(counts)
    later = pairs.join(counts, ["first_id", "first_hash"]).withColumn("part", F.pmod(F.xxhash64("doc_id", "text_hash"), F.col("parts")).cast("int"))
    later = later.join(held, ["doc_id", "text_hash"]).select("first_id", "first_hash", "part", F.lit(False).alias("leads"), "doc_id", "text_hash", "lines", "n_words", "alone")
    firsts = counts.withColumnsRenamed({"first_id": "doc_id", "first_hash": "text_hash"}).join(held, ["doc_id", "text_hash"])
    firsts = firsts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    firsts = firsts.select(F.col("doc_id").alias("first_id"), F.col("text_hash").alias("first_hash"), "part", F.lit(True).alias("leads"), "doc_id", "text_hash", "lines", F.lit(None).cast("array<int>").alias("n_words"), F.lit(None).cast("array<long>").alias("alone"))
    both = later.unionByName(firsts).repartition("first_id", "first_hash", "part").sortWithinPartitions("first_id", "first_hash", "part", F.desc("leads"))
    gone = both.mapInArrow(aligned(least_words), "doc_id long, text_hash long, gone array<int>")
    gone = gone.groupBy("doc_id", "text_hash").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))

    out = docs.join(gone, ["doc_id", "text_hash"], "left")
    all_lines = lines(F.col("text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("gone"))
    left_over = F.transform(F.array(all_lines), lambda own: F.transform(stay, lambda i: F.get(own, i)))[0]  # split once
    count = F.size(F.filter(all_lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    out = out.select("doc_id", *names.values(), F.col("text").alias("was"), count.alias("n_lines"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left_over, "\n")).alias("text"))
    left_count = F.size(F.filter(lines(F.col("text")), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return out.select("doc_id", *[F.col(n).alias(c) for c, n in names.items()], "n_lines", (F.col("n_lines") - left_count).alias("n_removed"), "text")
