"""Substring dedup with a count-min prefilter.

Pass 1 sketches every window of `k` words of every text.  A window is represented by its minimiser, the smallest
hash of the `k - 5` word sequences in it: equal windows have equal minimisers, so the count of a minimiser's cell is
never below the number of occurrences of the window.  Each task sends sparse partial sketches (sorted cell gaps),
which are summed by cell range into `ROWS` rows of saturating counters; only "two or more" is kept, one bit a cell.
The sketch is sized from the corpus and bounded by `most_bits`; it is the only thing broadcast.  A corpus with too many
keys for one sketch is sketched in up to `most_slices` slices of its keys, one after the other.  Beyond that bound the
sketches let more windows through, and never lose one.

Pass 2 groups exactly the windows that all rows estimate as repeated, by a 96-bit fingerprint of the 64-bit hashes of their
words.  A task
first settles what it can alone: of the holders of a window it has seen, only the one with the smallest doc_id goes
on, so that a passage in a third of all texts costs one entry a task.  The group's smallest doc_id keeps its words.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import Words, grams, ids_of, mix, pieces, ready, saved

ROWS = 2
SHARDS = 16
SUB = 5


def keys_of(words: Words, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Window starts, and each window's minimiser."""
    at = words.windows(k)
    sub = max(1, k - SUB)
    width = k - sub + 1
    if not len(at):
        return at, np.zeros(0, dtype=np.uint64)
    low = grams(hashes, sub)
    done = 1
    while done < width:
        shift = min(done, width - done)
        low = np.minimum(low[:-shift], low[shift:])
        done += shift
    return at, low[at]


def cells_of(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(keys, row + 1) >> np.uint64(64 - bits)


def packed(cells: np.ndarray, base: int) -> bytes:
    """Sorted distinct cells as 16-bit gaps; 65535 means: go on by 65534 without a cell."""
    gaps = np.diff(cells.astype(np.int64), prepend=base - 1) - 1
    skips = gaps // 65534
    out = np.full(len(gaps) + int(skips.sum()), 65535, dtype="<u2")
    out[np.arange(len(gaps)) + np.cumsum(skips)] = gaps - 65534 * skips
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, dtype="<u2").astype(np.int64)
    steps = np.where(gaps == 65535, 65534, gaps + 1)
    return (np.cumsum(steps) - 1)[gaps != 65535]


def in_slice(keys: np.ndarray, part: int, parts: int) -> np.ndarray:
    return mix(keys, 77) % np.uint64(parts) == part if parts > 1 else np.ones(len(keys), dtype=bool)


def sketched(k: int, bits: int, part: int, parts: int, most: int = 2_000_000):
    """Arrow function: partial sketches of the texts of a task, by row and cell range."""

    def emit(keys: list[np.ndarray]) -> pa.RecordBatch:
        out: dict[str, list] = {"line": [], "shard": [], "once": [], "more": []}
        span = (1 << bits) // SHARDS
        all_keys = np.concatenate(keys)
        for row in range(ROWS):
            cells = np.sort(cells_of(all_keys, row, bits))
            new = np.flatnonzero(np.diff(cells, prepend=~cells[:1]) != 0)
            many = np.diff(new, append=len(cells)) > 1
            cells = cells[new]
            cuts = np.searchsorted(cells, np.arange(SHARDS + 1, dtype=np.uint64) * np.uint64(span))
            for s in range(SHARDS):
                own, twice = cells[cuts[s] : cuts[s + 1]], many[cuts[s] : cuts[s + 1]]
                if len(own):
                    out["line"].append(row)
                    out["shard"].append(s)
                    out["once"].append(packed(own[~twice], s * span))
                    out["more"].append(packed(own[twice], s * span))
        return pa.RecordBatch.from_pydict(out, schema=pa.schema([("line", pa.int32()), ("shard", pa.int32()), ("once", pa.binary()), ("more", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        n = 0
        for batch in pieces(batches):
            words = Words(batch.column("text"))
            at, keys = keys_of(words, words.hashes(), k)
            if not len(at):
                continue
            own = words.of()[at]
            runs = np.ones(len(at), dtype=bool)
            runs[1:] = (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])
            keys = keys[runs]
            kept.append(keys[in_slice(keys, part, parts)])
            n += len(kept[-1])
            if n >= most:
                yield emit(kept)
                kept, n = [], 0
        if n:
            yield emit(kept)

    return run


def summed(bits: int):
    """Adds the partial sketches of one cell range; gives the cells counted twice or more, as bits."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((1 << bits) // SHARDS, dtype=np.uint8)
        for once, more in zip(pdf["once"], pdf["more"], strict=True):
            a = unpacked(once)
            counts[a] = np.minimum(counts[a] + 1, 2)
            counts[unpacked(more)] = 2
        return pd.DataFrame({"line": pdf["line"].iloc[:1], "shard": pdf["shard"].iloc[:1], "bits": [np.packbits(counts > 1).tobytes()]})

    return run


def repeated_cells(docs: DataFrame, k: int, bits: int, part: int, parts: int) -> list[bytes]:
    """The merged sketch: for each row, a bit for each cell whose count is two or more (2 ** bits / 8 bytes)."""
    parts = docs.mapInArrow(sketched(k, bits, part, parts), "line int, shard int, once binary, more binary")
    merged = parts.groupBy("line", "shard").applyInPandas(summed(bits), "line int, shard int, bits binary")
    size = (1 << bits) // SHARDS // 8
    found = {(r["line"], r["shard"]): bytes(r["bits"]) for r in merged.collect()}  # 2 ** bits bits a row, whatever the corpus
    return [b"".join(found.get((row, s), bytes(size)) for s in range(SHARDS)) for row in range(ROWS)]


ENTRY = np.dtype([("a", "<u8"), ("b", "<u4"), ("doc", "<u4"), ("pos", "<u4")])


def candidates(k: int, bits: int, sketch, part: int, parts: int, shards: int, buckets: int, most: int = 1_000_000):
    """Arrow function: windows that the sketch estimates as repeated, settled within the task and dealt by minimiser.

    Rows without a bucket hold windows to group, as ENTRYs and the (doc_id, text_hash) they name.  Rows with one hold
    starts of windows already known to be repeats, for the texts of the bucket.
    """
    schema = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("docs", pa.binary()), ("starts", pa.binary())])

    def emit(got: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        columns = list(zip(*got, strict=True))
        got.clear()  # what is joined is let go at once
        joined = [np.concatenate(columns.pop(0)) for _ in range(6)]
        o = np.lexsort((joined[3], joined[2], joined[1]))
        key, a, b, doc, text, pos = (joined.pop(0)[o] for _ in range(6))
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        least = doc[np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))]
        first = doc == least
        out: dict[str, list] = {c: [] for c in schema.names}
        for bucket, docs, starts in by_bucket(doc[~first], text[~first], pos[~first], buckets):
            out["shard"].append(bucket % shards)
            out["bucket"].append(bucket)
            out["docs"].append(docs)
            out["starts"].append(starts)
        o = np.flatnonzero(first)
        shard = (mix(key[o], 99) % np.uint64(shards)).astype(np.int32)
        o = o[np.argsort(shard, kind="stable")]
        shard = np.sort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard, prepend=-1))
        for x, y in zip(cuts, [*cuts[1:], len(shard)], strict=True):
            own = o[x:y]
            pairs = np.stack([doc[own], text[own]], axis=1)
            table, which = np.unique(pairs, axis=0, return_inverse=True)
            entries = np.empty(len(own), dtype=ENTRY)
            entries["a"], entries["b"], entries["doc"], entries["pos"] = a[own], b[own], which.ravel(), pos[own]
            out["shard"].append(int(shard[x]))
            out["bucket"].append(None)
            out["docs"].append(table.astype("<i8").tobytes())
            out["starts"].append(entries.tobytes())
        yield pa.RecordBatch.from_pydict(out, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.frombuffer(x, dtype=np.uint8) for x in sketch.value]
        got: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in pieces(batches):
            ids, null = ids_of(batch)
            texts = batch.column("text_hash").to_numpy(zero_copy_only=False)
            words = Words(batch.column("text"))
            hashes = words.hashes()
            at, keys = keys_of(words, hashes, k)
            own = words.of()[at]
            seen = ~null[own] & in_slice(keys, part, parts)
            for row, table in enumerate(tables):
                cells = cells_of(keys[seen], row, bits)
                seen[seen] = (table[(cells >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (cells & np.uint64(7)).astype(np.uint8))) & 1 > 0
            at, keys, own = at[seen], keys[seen], own[seen]
            if len(at):
                a = grams(hashes, k)[at]
                b = (grams(mix(hashes, 3), k)[at] >> np.uint64(32)).astype(np.uint32)
                got.append((keys, a, b, ids[own], texts[own], (at - words.first[own]).astype(np.uint32)))
                n += len(at)
                if n >= most:
                    yield from emit(got)
                    n = 0
        if got:
            yield from emit(got)

    return run


def by_bucket(doc: np.ndarray, text: np.ndarray, pos: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Starts of repeats, for each bucket of texts: a table of (doc_id, text_hash, number), and all the starts."""
    if not len(doc):
        return
    bucket = (mix(doc.astype(np.int64).view(np.uint64), 5) % np.uint64(buckets)).astype(np.int64)
    o = np.lexsort((pos, text, doc, bucket))
    bucket, doc, text, pos = bucket[o], doc[o], text[o], pos[o].astype("<u4")
    cuts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])])
    table = np.stack([doc[cuts], text[cuts], np.diff(cuts, append=len(doc))], axis=1).astype("<i8")
    own = np.flatnonzero(np.diff(bucket[cuts], prepend=-1))
    for x, y in zip(own, [*own[1:], len(cuts)], strict=True):
        yield int(bucket[cuts[x]]), table[x:y].tobytes(), pos[cuts[x] : cuts[y] if y < len(cuts) else len(pos)].tobytes()


SETTLED = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("starts", pa.binary())])
REPEATS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("starts", pa.binary())])


def settled(buckets: int):
    """All tasks' windows of one shard: every holder but the smallest doc_id of a window loses it."""

    def run(group: pa.Table) -> pa.Table:
        done = group.filter(group["bucket"].is_valid()).select(SETTLED.names).cast(SETTLED)
        entries, docs = [], []
        for bucket, table, starts in zip(group["bucket"].to_pylist(), group["docs"].to_pylist(), group["starts"].to_pylist(), strict=True):
            if bucket is None:
                entries.append(np.frombuffer(starts, dtype=ENTRY))
                docs.append(np.frombuffer(table, dtype="<i8").reshape(-1, 2)[entries[-1]["doc"]])
        if not entries:
            return done
        e, docs = np.concatenate(entries), np.concatenate(docs)
        o = np.lexsort((docs[:, 0], e["b"], e["a"]))
        e, doc, text = e[o], docs[o, 0], docs[o, 1]
        new = np.ones(len(e), dtype=bool)
        new[1:] = (e["a"][1:] != e["a"][:-1]) | (e["b"][1:] != e["b"][:-1])
        later = doc > doc[np.maximum.accumulate(np.where(new, np.arange(len(e)), 0))]
        found = list(by_bucket(doc[later], text[later], e["pos"][later], buckets))
        more = [pa.array([x[i] for x in found], type=f.type) for i, f in enumerate(SETTLED)]
        return pa.concat_tables([done, pa.Table.from_arrays(more, schema=SETTLED)])

    return run


def of_text(group: pa.Table) -> pa.Table:
    """All shards' repeats of one bucket: the sorted starts of each text."""
    tables = [np.frombuffer(x, dtype="<i8").reshape(-1, 3) for x in group["docs"].to_pylist()]
    table = np.concatenate(tables)
    pos = np.concatenate([np.frombuffer(x, dtype="<u4") for x in group["starts"].to_pylist()])
    doc, text = np.repeat(table[:, 0], table[:, 2]), np.repeat(table[:, 1], table[:, 2])
    o = np.lexsort((pos, text, doc))
    doc, text, pos = doc[o], text[o], pos[o]
    cuts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])])
    starts = [pos[x:y].tobytes() for x, y in zip(cuts, [*cuts[1:], len(doc)], strict=True)]
    return pa.Table.from_arrays([pa.array(doc[cuts]), pa.array(text[cuts]), pa.array(starts, type=pa.binary())], schema=REPEATS)


def cut(k: int, keep_text: bool):
    """Arrow function: removes the covered words of each text."""
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema([*fields, ("kept", pa.string())] if keep_text else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=2 << 20):
            out: list[tuple] = []
            for doc, text, starts in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                words = (text or "").encode().split()
                n = len(words)
                if starts:
                    edges = np.zeros(n + 1, dtype=np.int64)
                    at = np.frombuffer(starts, dtype="<u4").astype(np.int64)
                    np.add.at(edges, at, 1)
                    np.add.at(edges, at + k, -1)
                    words = [w for w, gone in zip(words, np.cumsum(edges[:n]) > 0, strict=True) if not gone]
                kept = b" ".join(words)
                out.append((doc, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None))
            columns = list(zip(*out, strict=True))[: len(schema)]
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def substring_dedup(documents: DataFrame, k: int = 13, keep_text: bool = False, most_bits: int = 29, most_slices: int = 8) -> DataFrame:
    """Remove every word covered by a window of k words that also starts in a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed, kept_sha256 (and the kept text) for each row of documents.  A null or empty
    text has no words and no windows; so has a text of fewer than k words.  Rows with a null doc_id have no order:
    they neither lose words nor make others lose any.  Rows that share a doc_id do not affect each other.  Only the
    columns doc_id and text are read.  An empty table gives an empty result.
    """
    spark = ready(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = size // 4 + 2  # some five times the number of keys
    parts = min(most_slices, max(1, math.ceil(cells / (1 << most_bits))))
    bits = min(most_bits, max(min(16, most_bits), math.ceil(math.log2(cells / parts))))
    shards = max(32, math.ceil(size / (4 << 20)))
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    buckets = max(32, math.ceil(size / (8 << 20)))
    slices = []
    for part in range(parts):
        sketch = spark.sparkContext.broadcast(repeated_cells(docs.select("text"), k, bits, part, parts))
        slices.append(hashed.mapInArrow(candidates(k, bits, sketch, part, parts, shards, buckets), "shard int, bucket int, docs binary, starts binary"))
        if parts > 1:  # one sketch at a time is held
            slices[-1] = saved(slices[-1])
            sketch.unpersist()
    found = reduce(DataFrame.unionByName, slices)
    repeats = found.groupBy("shard").applyInArrow(settled(buckets), "bucket int, docs binary, starts binary")
    repeats = repeats.groupBy("bucket").applyInArrow(of_text, "doc_id long, text_hash long, starts binary")
    joined = hashed.join(repeats, ["doc_id", "text_hash"], "left").select("doc_id", "text", "starts")
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    return joined.mapInArrow(cut(k, keep_text), out)
