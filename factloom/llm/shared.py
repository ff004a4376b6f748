"""Helpers that several operators use: checkpoints, and words of an Arrow batch as numpy arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import DataFrame

from ..sources.checkpoints import ready, saved, shared_folder

__all__ = ["BLANK", "SPACE", "Words", "grams", "ids_of", "kept_table", "mix", "pieces", "ready", "saved", "segments", "shared_folder", "spans", "utf8"]

#: ASCII white space; everything else belongs to a word.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: White space as the tokenizers' own patterns have it (the Unicode property White_Space), for a class in a pattern.
BLANK = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: Odd multiplier of `joined`; prime and base of `segments`.
STEP = 0x9E3779B97F4A7C15
PRIME = (1 << 61) - 1
BASE = 0x1B873593CC9E2D51 % PRIME

#: Masks for the first 0 to 8 bytes of a little-endian word.
FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
#: Spans longer than this are hashed one by one.
LONG = 64


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser, so that all bits depend on all bits."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes data[start:end]: eight bytes at a time, each mixed with all before; long ones by xxh3."""
    lengths = ends - starts
    out = mix(lengths.astype(np.uint64), 1)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(buffer=padded.data, dtype="<u8", shape=(len(data) + 1,), strides=(1,))
    for i in np.flatnonzero(lengths > LONG):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed=5)
    live = np.flatnonzero((lengths > 0) & (lengths <= LONG))
    done = 0
    while len(live):
        left = lengths[live] - done
        out[live] = mix(out[live] ^ (eight[starts[live] + done] & FIRST[np.minimum(left, 8)]))
        live = live[left > 8]
        done += 8
    return out


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(STEP) + b)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each place on, as far as there are k; built from halves, each mixed, so that no sum over
    words can cancel another."""
    n = max(0, len(hashes) - k + 1)
    out, done, power, width = None, 0, hashes, 1
    while True:
        if k & width:
            part = power[done : done + n]
            out = part if out is None else joined(out, part)
            done += width
        if 2 * width > k:
            return mix(out, k)
        power = joined(power[:-width], power[width:]) if len(power) > width else power[:0]
        width *= 2


def segments(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end] for each pair: polynomials modulo the prime 2 ** 61 - 1, from one list of sums.

    Powers fall from left to right, so equal segments have equal hashes wherever they are, and the work is in proportion to
    the values and pairs, however long the segments.
    """
    sums, power = [0], [1]
    for v in values.tolist():
        sums.append((sums[-1] * BASE + v) % PRIME)
    for _ in range(int((ends - starts).max()) if len(starts) else 0):
        power.append(power[-1] * BASE % PRIME)
    return np.array([(sums[b] - sums[a] * power[b - a]) % PRIME for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype=np.uint64)


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once as Parquet to a new folder of the shared one, which goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.parquet(path)


class Words:
    """Words of some texts: hashes, and where each text's words begin and end.

    data: all bytes; at: offsets of the texts in data; starts, ends: of the words in data; first: index of each
    text's first word, with one more at the end; of: the text of each word.
    """

    def __init__(self, texts: pa.Array):
        self.data, self.at = utf8(texts)
        n = len(self.data)
        space = SPACE[self.data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.at] = True
        before = edge.copy()
        before[1:n] |= space[: n - 1] if n else space
        after = edge.copy()
        after[:n] |= space
        self.starts = np.flatnonzero(~space & before[:n])
        self.ends = np.flatnonzero(~space & after[1:]) + 1
        self.first = np.searchsorted(self.starts, self.at)
        self.counts = np.diff(self.first)
        self.n = len(texts)

    def hashes(self) -> np.ndarray:
        return spans(self.data, self.starts, self.ends)

    def of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)

    def windows(self, k: int) -> np.ndarray:
        """Indexes of the words at which k words of one text begin."""
        last = np.repeat(self.first[1:], self.counts)
        i = np.arange(len(self.starts))
        return i[i + k <= last]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (null: none), and the offsets of each text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut to about `most` bytes of text each (one text at least), so that arrays beside it stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(column))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(at, at[a] + most, side="right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def ids_of(batch: pa.RecordBatch, column: str = "doc_id") -> tuple[np.ndarray, np.ndarray]:
    """Ids as integers, and which of them are null."""
    ids = batch.column(column)
    return ids.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False), np.asarray(ids.is_null())


def hidden(keep: tuple[str, ...], result: tuple[str, ...]) -> dict[str, str]:
    """Names under which columns are handed through, so that none meets a column of the operator's own; a column named like
    one of the result is refused, since both could not be told apart."""
    clash = sorted({c.lower() for c in keep} & {c.lower() for c in result})
    if clash:
        raise ValueError(f"columns to keep are named like columns of the result: {', '.join(clash)}")
    return {c: f"_keep_{i}" for i, c in enumerate(keep)}
