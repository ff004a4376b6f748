"""Bulk-synchronous best-fit packing of token sequences.

1. Texts become pieces of at most `capacity` tokens in one pass; a piece is a few numbers, the text goes no further.
2. Pieces are range-sorted by (length, doc_id, piece).  A piece's rank within its length is its place in its partition
   plus the counts of the partitions before: no task sees more than its range, and a length that a third of all pieces
   share is split over many.
3. Rounds over the lengths, longest first.  In a round every piece of one length and every open gap take part: the
   gaps are sorted, each piece's successor is the smallest gap that holds it, and pieces and gaps are matched by rank
   (the i-th piece takes the i-th place), so that no two pieces want one place.  Then the gaps shrink and the next
   round begins.  Pieces of one length are alike, and so are equal gaps; a round therefore moves runs (first rank,
   number of sequences), of which there are never more than a few times `capacity`.  `sweeps` works on those runs.
4. A piece finds its run by length and rank, and with it its sequence and offset.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .shared import pieces, saved

#: Texts of these characters only are split alike by every version of the Unicode tables.
SETTLED = re.compile("[\x00-\u024f\u2010-\u2027\u2030-\u203a\u20ac]*")
#: The second library's pattern backtracks over white space, one stack frame a character.
WIDE = re.compile(r"\s{1000}")


class Encoder:
    """Ids of texts, as the tokenizer's file has them.

    ranks: the same vocabulary for a second library, which is several times faster and has the same merges.  It gets
    the texts without special strings or very long white space whose characters both libraries surely split alike; the
    first gets all others.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast and SETTLED.fullmatch(text) and not WIDE.search(text) and not self.special.search(text):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")


_encoders: dict[tuple, Encoder] = {}


def encoder(*files: str | None) -> Encoder:
    """One for each tokenizer and worker process; kept between tasks."""
    if files not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _encoders[files] = Encoder(*files)
    return _encoders[files]


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def encoded(files: tuple[str | None, ...], capacity: int, end_id: int, keep_ids: bool):
    schema = PIECES.append(pa.field("ids", pa.binary())) if keep_ids else PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*files).encode
        end = int(end_id).to_bytes(4, "little")
        for batch in pieces(batches, most=4 << 20):
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode(text or "").tobytes() + end
                n = len(ids) // 4
                first = n % capacity or capacity  # only the first piece may be shorter
                cuts = [0, *range(first, n + 1, capacity)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = ids[4 * a : 4 * b]
                    out.append((doc, i, a, b - a, zlib.crc32(part), part))
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*out, strict=True), schema, strict=False)], schema=schema)

    return run


def sweeps(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit of `counts[length]` alike pieces of each length, as runs.

    A run (length, first rank, one past the last, pieces a sequence, first sequence, offset) says: the pieces of these
    ranks go to consecutive sequences, so many to each, from this offset on.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[int] = []  # sorted sizes of open gaps
    at: dict[int, list[tuple[int, int]]] = {}  # gap: runs of alike sequences, (first, number)
    opened = 0

    def keep(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in at:
                insort(gaps, gap)
                at[gap] = []
            at[gap].append((first, number))

    for length in sorted(counts, reverse=True):
        rank, end = 0, counts[length]
        while rank < end:
            i = bisect_left(gaps, length)  # the successor: the smallest gap that holds the piece
            if i < len(gaps):
                gap = gaps[i]
                first, number = at[gap].pop()
                if not at[gap]:
                    del at[gap], gaps[i]
            else:
                gap, first, number = capacity, opened, -(-(end - rank) // (capacity // length))
                opened += number
            each = gap // length
            full, rest = divmod(min(end - rank, each * number), each)
            used = each * full + rest
            runs.append((length, rank, rank + used, each, first, capacity - gap))
            keep(gap - each * length, first, full)
            keep(gap - rest * length, first + full, int(rest > 0))
            keep(gap, first + full + (rest > 0), number - full - (rest > 0))
            rank += used
    return runs


def by_bucket(runs: list[tuple[int, int, int, int, int, int]], counts: dict[int, int]) -> tuple[dict[int, int], list[tuple[int, ...]]]:
    """Runs by bucket of ranks, so that a piece is held against the few runs of its bucket: the width of a length's
    buckets, and a row (length, bucket, *run) for each bucket that a run meets, a few times as many as runs."""
    number = Counter(r[0] for r in runs)
    width = {x: max(1, n // (4 * number[x])) for x, n in counts.items()}
    return width, [(r[0], b, *r[1:]) for r in runs for b in range(r[1] // width[r[0]], (r[2] - 1) // width[r[0]] + 1)]


def pack(items: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` of 1 to capacity; order: what else sorts the rows."""
    spark = items.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = ["length", *order, "tie"]  # the tie splits rows that repeat over partitions; items are written, so it comes out alike again
    ordered = items.withColumn("tie", F.rand(7)).repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("tie")
    ordered = saved(ordered.withColumn("place", F.monotonically_increasing_id()))  # partition, place in it
    ordered = ordered.withColumn("part", F.shiftright("place", 33))
    ranges = ordered.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("least"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least")).select("length", "part", "base", "n")
    counts = {r["length"]: r["n"] for r in ranges.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    width, plan = by_bucket(sweeps(counts, capacity), counts)
    plan = spark.createDataFrame(plan, "length long, bucket long, low long, high long, each long, first long, at long")
    ranges = ranges.drop("n").join(F.broadcast(spark.createDataFrame(list(width.items()), "length long, width long")), "length")
    ranked = ordered.join(ranges, ["length", "part"]).withColumn("rank", F.col("place") + F.col("base"))
    ranked = ranked.withColumn("bucket", F.floor(F.col("rank") / F.col("width")))
    found = ranked.join(F.broadcast(plan), ["length", "bucket"]).where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    nth = F.col("rank") - F.col("low")
    return found.select(
        *items.columns,
        (F.col("first") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )


def best_fit_packing(
    documents: DataFrame,
    tokenizer: str,
    ranks: str | None = None,
    pattern: str | None = None,
    capacity: int = 1024,
    end_id: int = 2,
    keep_ids: bool = False,
) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens, as few as best fit, longest first, finds.

    A document is its text's ids and end_id; only those over capacity are cut, into pieces of capacity tokens of which
    the first may be shorter.  Returns a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset (and with keep_ids the ids as little-endian 32-bit bytes).  Null texts count as empty, so they are the end id
    alone.  Null doc_ids and repeated rows are packed like others.  An empty table gives an empty result.  Only doc_id
    and text are read.  tokenizer: path of the tokenizer's file on every executor.  ranks and pattern: the same
    vocabulary for the faster library, see Encoder.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    items = saved(docs.mapInArrow(encoded((tokenizer, ranks, pattern), capacity, end_id, keep_ids), out))
    return pack(items, capacity, ["doc_id", "piece", "ids_crc32"])
