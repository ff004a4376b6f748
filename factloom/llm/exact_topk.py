"""Exact top-k by inner product with the threshold algorithm.

Vectors are dealt into blocks, and every block keeps one list for each dimension, sorted by that component.  Queries are
dealt into blocks too, and each block of queries goes to every block of vectors.  A query reads all lists downward from the end that its weight prefers, scores each newly seen vector
in full, and stops when the bound for unseen vectors, the sum of weight times the value read last, is below its kth
score: nothing unseen can then enter.  The blocks' answers are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .shared import ready

HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Lists:
    """The sorted lists of one block.  Equal vectors are held once, with their k + 1 smallest ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        o = np.argsort(ids, kind="stable")
        ids, vectors = ids[o], vectors[o]
        self.vectors, which = np.unique(vectors, axis=0, return_inverse=True)
        which = which.ravel()
        o = np.argsort(which, kind="stable")
        cuts = np.searchsorted(which[o], np.arange(len(self.vectors) + 1))
        self.ids = [ids[o[a : min(b, a + k + 1)]] for a, b in zip(cuts, cuts[1:], strict=False)]
        self.copies = np.array([len(x) for x in self.ids], dtype=np.int64)
        self.up = np.argsort(self.vectors, axis=0, kind="stable").T.copy()  # dimension, position
        self.n = len(self.vectors)

    def top(self, query: int, weights: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (score, id) of this block without the query itself: highest score, then smallest id."""
        dims = np.flatnonzero(weights)
        seen = np.zeros(self.n, dtype=bool)
        rows: list[np.ndarray] = []
        scores: list[np.ndarray] = []
        depth, step = 0, max(1, 2 * k)
        down = weights[dims] > 0
        while depth < self.n:
            to = min(self.n, depth + step)
            where = np.where(down[:, None], self.n - 1 - np.arange(depth, to), np.arange(depth, to))
            got = self.up[dims[:, None], where]
            fresh = np.zeros(self.n, dtype=bool)
            fresh[got] = True
            new = np.flatnonzero(fresh & ~seen)
            seen[new] = True
            if not len(dims):
                new = np.arange(self.n)
                to = self.n
            rows.append(new)
            scores.append(products(self.vectors[new], weights))
            depth, step = to, step * 2
            all_scores = np.concatenate(scores)
            have = self.copies[np.concatenate(rows)]
            if have.sum() > k:  # one may be the query itself
                o = np.argsort(-all_scores, kind="stable")
                kth = all_scores[o[np.searchsorted(np.cumsum(have[o]), k + 1)]]
                bound = int(products(self.vectors[got[:, -1], dims][None, :], weights[dims])[0]) if len(dims) else 0
                if kth > bound:
                    break
                best = all_scores >= kth
                rows, scores = [np.concatenate(rows)[best]], [all_scores[best]]
        every, found = np.concatenate(rows), np.concatenate(scores)
        most = np.argsort(-found, kind="stable")
        have = self.copies[every[most]]
        last = found[most[min(len(most) - 1, np.searchsorted(np.cumsum(have), k + 1))]]
        hits = [(-int(s), int(i)) for r, s in zip(every, found, strict=True) if s >= last for i in self.ids[r] if i != query]
        return [(-s, i) for s, i in sorted(hits)[:k]]


def products(vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Inner products of rows with weights; those beyond 64 bits become the largest or smallest 64-bit integer."""
    most = float(np.abs(vectors.astype(np.float64)).max(initial=0)) * float(np.abs(weights.astype(np.float64)).max(initial=0))
    if most * max(1, len(weights)) < 2.0**62:
        return vectors @ weights
    exact = vectors.astype(object) @ weights.astype(object)
    return np.array([min(max(x, -(2**63)), 2**63 - 1) for x in exact], dtype=np.int64)


def matrix(lists: pa.Array) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1).astype(np.int64)


def searched(k: int):
    """Arrow function over the (queries, candidates) of one pair of blocks and one width."""

    def run(key: tuple, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not candidates.num_rows or not queries.num_rows:
            return HITS.empty_table()
        lists = Lists(candidates["vec_id"].to_numpy(), matrix(candidates["x"]), k)
        out = [(q, i, s) for q, w in zip(queries["vec_id"].to_pylist(), matrix(queries["x"]), strict=True) for s, i in lists.top(q, w, k)]
        return pa.Table.from_arrays([pa.array([x[i] for x in out], type=pa.int64()) for i in range(3)], schema=HITS)

    return run


def scaled(embeddings: DataFrame, scale: int) -> DataFrame:
    """vec_id, width and integer components; vectors that are null or hold null or non-finite components are left out."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(True))
    ints = F.transform(x, lambda c: F.floor(c * F.lit(scale)).cast("long"))
    return embeddings.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.size(x).alias("width"), ints.alias("x"))


def exact_topk(embeddings: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, block_rows: int = 4096) -> DataFrame:
    """For each vector whose vec_id is divisible by `every`, the k other rows with the highest integer inner product.

    Components become floor(scale * x).  Returns query_id, rank (from 1), vec_id, score; ties go to the smaller
    vec_id; fewer than k rows if there are fewer.  Rows with a null id, a null or empty vector, or a null or
    non-finite component take no part.  Only vectors of the same width are compared.  Rows that repeat a vec_id are
    one candidate if their vectors are equal, and the best of them counts otherwise.  Components and scores beyond 64 bits
    become the nearest 64-bit integer.  Other columns are not read.
    """
    ready(embeddings.sparkSession)
    vectors = scaled(embeddings, scale)
    asked = F.col("vec_id") % every == 0
    n, n_asked = vectors.agg(F.count(F.lit(1)), F.count(F.when(asked, 1))).first()
    blocks, asked_blocks = (max(1, round(x / block_rows)) for x in (n, n_asked))

    def dealt(rows: DataFrame, own: str, salt: int, of: int, other: str, others: int) -> DataFrame:
        """Rows by their own block, once for each block of the other side."""
        return rows.withColumns({own: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(of)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(others - 1)))})

    candidates = dealt(vectors, "block", 41, blocks, "asked_block", asked_blocks)
    queries = dealt(vectors.where(asked).dropDuplicates(["vec_id", "x"]), "asked_block", 43, asked_blocks, "block", blocks)
    hits = (
        queries.groupBy("block", "asked_block", "width")
        .cogroup(candidates.groupBy("block", "asked_block", "width"))
        .applyInArrow(searched(k), "query_id long, vec_id long, score long")
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
