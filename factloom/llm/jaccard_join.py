"""N-gram Jaccard self-join with a MinHash LSH forest and exact verification.

1. One pass makes, for each text, a fingerprint of its words and a signature: `trees` labels of `deepest` MinHash values.
   Equal texts become one class; only its smallest doc_id goes on.
2. Each tree is a trie of labels; texts with the same prefix of a label meet in a node of it, found by grouping prefixes.
   The prefix starts at the full label and is shortened by one value at a time, until the recall reaches the target.  The
   recall is measured on the pairs met: a pair of similarity s meets with a known probability, so each one met stands for so
   many that are there.  At the length where even a corpus of pairs at the threshold would reach the target, shortening ends.
3. Within a node, texts are compared by their signatures only.  The first text of the node is a leader; texts very like it
   leave with a link to it, texts rather like it get a link and stay, and so on with the first of those that stay.  By the
   triangle inequality of the Jaccard distance a pair at the threshold is linked, at once or through a leader.  A node of
   many texts is dealt into parts, and then the parts' leaders meet.  A task emits a spanning forest: one link a text and
   node at most, never all pairs.
4. Linked texts form candidate sets.  Within a set all pairs are verified exactly, on the sets of shingle hashes, in blocks:
   a set of many texts becomes pairs of blocks, each a task's small matrix product.  Only counts of links and a spanning set
   of links leave a block, never all pairs.  Texts that merely share a passage meet in nodes by chance, but are told apart
   by their signatures before any set is formed.
5. Connected links form the near-duplicate classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .components import components
from .shared import Words, grams, ids_of, mix, pieces, ready, saved

#: Estimated similarity from which a text leaves a node for a leader, and those from which it is linked to a leader of its
#: part, and leaders of different parts are.  A pair at 0.8 is at most 0.15 + 0.2 (0.15 more for two leaders) away; the
#: rest is room for the error of the estimates, of which one standard deviation is 0.03.
LEAVE, LINK, LINK_PARTS = 0.85, 0.55, 0.42

#: Texts of a part of a node.
PART = 512


def prefix_length(threshold: float, trees: int, deepest: int, recall: float) -> int:
    """The longest prefix with which the expected recall of a pair at the threshold reaches the target."""
    for length in range(deepest, 0, -1):
        if 1 - (1 - threshold**length) ** trees >= recall:
            return length
    raise ValueError("too few trees for this recall")


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words (of all words, where there are fewer), and the text of each."""
    hashes = words.hashes()
    at = words.windows(k)
    values, text = grams(hashes, k)[at], words.of()[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        first = words.first[short]
        alone = np.zeros(len(short), dtype=np.uint64)
        for i in range(k - 1):
            more = words.counts[short] > i
            alone[more] = mix(alone[more] * np.uint64(3) + hashes[first[more] + i], 61)
        values, text = np.concatenate([values, alone]), np.concatenate([text, short])
        o = np.argsort(text, kind="stable")
        values, text = values[o], text[o]
    return values, text


SIGNED = pa.schema([(c, pa.int64()) for c in ("doc_id", "text_hash", "fp1", "fp2", "n_words")] + [("signature", pa.binary())])


def signed(k: int, trees: int, deepest: int):
    """Arrow function: fingerprint and signature of each text with words.

    A MinHash value is kept to 8 bits: unlike values then agree with a chance of 2 ** -8, which only adds candidates.
    """
    rng = np.random.Generator(np.random.PCG64(977))
    factors = rng.integers(1, 2**63, trees * deepest, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=1 << 20):
            words = Words(batch.column("text"))
            ids, null = ids_of(batch)
            values, text = shingles(words, k)
            some = np.flatnonzero((words.counts > 0) & ~null)
            at = np.searchsorted(text, np.arange(words.n + 1))
            values = np.concatenate([values[at[i] : at[i + 1]] for i in some]) if null.any() and len(some) else values
            begin = np.cumsum([0, *np.diff(at)[some]])[:-1]
            signature = np.empty((len(some), trees * deepest), dtype=np.uint8)
            for i, factor in enumerate(factors):
                x = values * factor
                if len(some):
                    signature[:, i] = mix(np.minimum.reduceat(x ^ (x >> np.uint64(32)), begin)) >> np.uint64(56)
            own = batch.column("text").take(pa.array(some)).to_pylist()
            fp = np.array([xxhash.xxh3_128_digest(b" ".join(t.encode().split())) for t in own], dtype="S16")
            fp = np.frombuffer(fp.tobytes(), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[some]),
                    batch.column("text_hash").take(pa.array(some)),
                    pa.array(fp[:, 0]),
                    pa.array(fp[:, 1]),
                    pa.array(words.counts[some].astype(np.int64)),
                    pa.array([x.tobytes() for x in signature], type=pa.binary()),
                ],
                schema=SIGNED,
            )

    return run


def node(tree: Column, length: int, deepest: int) -> Column:
    """The node of a tree that the first `length` values of its label lead to."""
    return F.xxhash64(tree, F.substring(F.col("signature"), tree * deepest + 1, F.lit(length)))


LED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("leader", pa.int64()), ("met", pa.float64()), ("there", pa.float64())])


def led(length: int, trees: int, threshold: float, link: float, leaders: bool):
    """Arrow function over rows sorted by group: links (a, b) of a spanning forest in each, the leaders of groups marked
    `many` if asked for, and one row of sums for the recall: pairs met at the threshold, and how many they stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["grp"]):
            cuts = starts(table, ["grp"])
            rep, times = table["rep"].to_numpy(), table["times"].to_numpy()
            signature = np.frombuffer(b"".join(table["signature"].to_pylist()), dtype=np.uint8).reshape(len(rep), -1)
            group = np.repeat(np.arange(len(cuts)), np.diff([*cuts, len(rep)]))
            root = np.arange(len(rep))
            left = np.arange(len(rep))  # not yet led; sorted by group
            made: list[tuple[np.ndarray, np.ndarray]] = []
            leads: list[np.ndarray] = []
            met = there = 0.0
            while len(left):
                new = np.ones(len(left), dtype=bool)
                new[1:] = group[left[1:]] != group[left[:-1]]
                hub = left[np.maximum.accumulate(np.where(new, np.arange(len(left)), 0))]
                leads.append(left[new])
                left, hub = left[~new], hub[~new]
                like = np.concatenate([(signature[left[i : i + 65536]] == signature[hub[i : i + 65536]]).mean(axis=1) for i in range(0, len(left), 65536)]) if len(left) else np.zeros(0)
                s = like[like >= threshold] ** length
                often = times[left[like >= threshold]] / s
                there += float(often.sum())
                met += float((often * (1 - (1 - s) ** trees)).sum())
                linked = np.flatnonzero((like >= link) & (root[left] != root[hub]))
                # one link for each tree of the forest that meets the hub's
                _, once = np.unique(root[left[linked]], return_index=True)
                x, h = left[linked[once]], hub[linked[once]]
                made.append((rep[x], rep[h]))
                to = np.arange(len(rep))
                to[root[x]] = root[h]
                root = to[root]
                left = left[like < LEAVE]
            a, b = (np.concatenate(x) for x in zip(*made, strict=True))
            yield links_of(a, b, met, there)
            if leaders:
                lead = np.concatenate(leads)
                lead = lead[np.asarray(table["many"])[lead]]
                empty = pa.nulls(len(lead), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(table["node"].to_numpy()[lead]), empty, pa.array(rep[lead]), *[pa.nulls(len(lead), pa.float64())] * 2], schema=LED)

    def links_of(a: np.ndarray, b: np.ndarray, met: float, there: float) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array([*a.tolist(), None], type=pa.int64()), pa.array([*b.tolist(), None], type=pa.int64()), pa.nulls(n + 1, pa.int64()), pa.array([None] * n + [met], type=pa.float64()), pa.array([None] * n + [there], type=pa.float64())],
            schema=LED,
        )

    return run


class Block:
    """Shingle sets of some texts."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, texts: pa.Array, k: int):
        self.ids, self.copies = ids, copies
        values, text = shingles(Words(texts), k)
        o = np.lexsort((values, text))
        values, text = values[o], text[o]
        new = np.ones(len(o), dtype=bool)
        new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
        self.grams, self.text = values[new], text[new]
        self.sizes = np.bincount(self.text, minlength=len(ids))


def overlaps(a: Block, b: Block, columns: int = 4096) -> np.ndarray:
    """Numbers of common shingles of all texts of a and b."""
    both = np.intersect1d(a.grams, b.grams) if a is not b else np.unique(a.grams[np.isin(a.grams, repeated(a.grams))])
    out = np.zeros((len(a.ids), len(b.ids)), dtype=np.float32)
    for i in range(0, len(both), columns):
        part = both[i : i + columns]
        out += incidence(a, part) @ incidence(b, part).T
    return out.astype(np.int64)


def repeated(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[1:][x[1:] == x[:-1]]


def incidence(block: Block, grams: np.ndarray) -> np.ndarray:
    at = np.searchsorted(grams, block.grams)
    at[at == len(grams)] = 0
    hit = grams[at] == block.grams
    out = np.zeros((len(block.ids), len(grams)), dtype=np.float32)
    out[block.text[hit], at[hit]] = 1
    return out


LINKS = pa.schema([("doc_id", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])


def verified(k: int, threshold: float):
    """Arrow function over rows sorted by set and pair of blocks: each text's number of links there, and the smallest
    text that links connect it with there.  Every pair of blocks of a set is compared once.
    """

    def links(left: Block, right: Block) -> Iterator[tuple[int, int, int]]:
        common = overlaps(left, right)
        union = left.sizes[:, None] + right.sizes[None, :] - common
        linked = common >= np.ceil(threshold * union - 1e-9)
        linked &= common > 0
        if left is right:
            np.fill_diagonal(linked, False)
        out: dict[int, int] = {}
        sides = [(left, right, linked)] if left is right else [(left, right, linked), (right, left, linked.T)]
        for own, other, m in sides:
            for i in np.flatnonzero(m.any(axis=1)):
                x = int(own.ids[i])
                out[x] = out.get(x, 0) + int((m[i] * other.copies).sum())
        roots: dict[int, int] = {}

        def root(x: int) -> int:
            while roots.setdefault(x, x) != x:
                roots[x] = roots[roots[x]]
                x = roots[x]
            return x

        for i, j in zip(*np.nonzero(linked), strict=True):
            a, b = root(int(left.ids[i])), root(int(right.ids[j]))
            if a != b:
                roots[max(a, b)] = min(a, b)
        for x, n in out.items():
            yield x, n, root(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["set", "low", "high"]):
            out: list[tuple[int, int, int]] = []
            for group in groups(table, ["set", "low", "high"]):
                side = np.asarray(group["block"]) == np.asarray(group["low"])
                blocks = []
                for rows in (side, ~side):
                    if rows.any():
                        part = group.filter(pa.array(rows))
                        blocks.append(Block(np.asarray(part["doc_id"]), np.asarray(part["copies"]), part["text"].combine_chunks(), k))
                if len(blocks) == 2 or group["low"][0].as_py() == group["high"][0].as_py():
                    out += links(blocks[0], blocks[-1])
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], type=pa.int64()) for i in range(3)], schema=LINKS)

    return run


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows that are sorted by the keys, cut only between different keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        cuts = starts(table, keys)
        last = int(cuts[-1])
        if last:
            yield table.slice(0, last)
        held = table.slice(last).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        x = table[k].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def groups(table: pa.Table, keys: list[str]) -> Iterator[pa.Table]:
    cuts = starts(table, keys)
    for a, b in zip(cuts, [*cuts[1:], table.num_rows], strict=True):
        yield table.slice(a, b - a)


def proposed(classes: DataFrame, length: int, trees: int, deepest: int, threshold: float) -> tuple[DataFrame, float]:
    """Links (a, b) between representatives that meet in nodes of prefixes of this length, and the recall estimated.

    Nodes with the same texts, as alike texts have in most trees, are looked at once.  Signatures join only the texts that
    meet others.
    """
    each = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    met = classes.select("rep", "signature", each).select("rep", node(F.col("tree"), length, deepest).alias("node"))
    texts = (F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(9))).alias("y"))
    nodes = met.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *texts).where("n > 1")
    nodes = nodes.groupBy("n", "x", "y").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("times")).select("node", "n", "times")
    nodes = saved(nodes)  # written, so that a join with a hot node can be split
    parts = F.ceil(F.col("n") / PART).cast("int")
    dealt = met.join(nodes, "node").select("node", "rep", "times", (parts > 1).alias("many"), F.xxhash64("node", F.pmod(F.xxhash64("rep"), parts)).alias("grp"))
    signatures = classes.select("rep", "signature")
    dealt = dealt.join(signatures, "rep").repartition("grp").sortWithinPartitions("grp", "rep")
    types = "a long, b long, leader long, met double, there double"
    found = saved(dealt.mapInArrow(led(length, trees, threshold, LINK, True), types))
    out = found.where("b is not null").select("a", "b")

    hot = found.where("leader is not null").select(F.col("a").alias("node"), F.col("leader").alias("rep"))
    counts = hot.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    hot = hot.join(counts, "node").withColumn("part", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("parts")))
    hot = in_blocks(hot, "node", "part", "parts").join(signatures, "rep")
    hot = hot.select("node", "rep", "signature", F.lit(0).cast("long").alias("times"), F.lit(False).alias("many"), F.xxhash64("node", "low", "high").alias("grp"))
    hot = hot.repartition("grp").sortWithinPartitions("grp", "rep")
    more = hot.mapInArrow(led(length, trees, threshold, LINK_PARTS, False), types).where("b is not null").select("a", "b")

    sums = found.agg(F.sum("met"), F.sum("there")).first()
    return out.union(more), (sums[0] / sums[1] if sums[1] else 1.0)


def in_blocks(rows: DataFrame, group: str, block: str, blocks: str) -> DataFrame:
    """Every row once for each block of its group, with the pair (low, high) of its own block and that one."""
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)))
    return rows.withColumns({"low": F.least(block, "other"), "high": F.greatest(block, "other")}).drop("other")


def jaccard_join(documents: DataFrame, k: int = 5, threshold: float = 0.8, trees: int = 24, deepest: int = 6, recall: float = 0.9999, block_rows: int = 256) -> DataFrame:
    """Join documents whose sets of k-word shingles have a Jaccard similarity of threshold or more.

    Returns a row for each row of documents with a doc_id: doc_id, class_id (the smallest doc_id it is connected with by
    links; its own if there is none), n_links (other documents at the threshold or above, equal texts among them) and
    n_copies (documents with the same words, itself among them).  A text of fewer than k words has one shingle, all its
    words.  Null, empty and blank texts have no shingles and no links.  Rows without a doc_id are left out; rows that
    repeat a doc_id with the same words count as copies, and with other words as texts that share a class and links.
    An empty table gives an empty result.  Only doc_id and text are read.  recall: expected share of the links found.
    block_rows: texts of a block in a small candidate set; large sets have larger blocks, up to 16 times as many.
    """
    ready(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).where("doc_id is not null")
    labels = saved(docs.mapInArrow(signed(k, trees, deepest), "doc_id long, text_hash long, fp1 long, fp2 long, n_words long, signature binary"))
    classes = labels.groupBy("fp1", "fp2").agg(F.min(F.struct("doc_id", "text_hash")).alias("of"), F.count(F.lit(1)).alias("copies"), F.first("n_words").alias("n_words"), F.first("signature").alias("signature"))
    classes = saved(classes.select("fp1", "fp2", F.col("of.doc_id").alias("rep"), F.col("of.text_hash").alias("text_hash"), "copies", "n_words", "signature"))

    shortest = prefix_length(threshold, trees, deepest, recall)
    for length in range(deepest, shortest - 1, -1):
        links, estimate = proposed(classes, length, trees, deepest, threshold)
        if estimate >= recall:
            break
    sets = saved(components(links).withColumnsRenamed({"id": "rep", "component": "set"}))

    members = sets.join(classes.select("rep", "text_hash", "copies", "n_words"), "rep")
    sizes = members.groupBy("set").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words"))
    rows = F.least(F.greatest(F.ceil(F.col("n") / 16), F.lit(block_rows)), F.lit(16 * block_rows))
    blocks = F.greatest(F.ceil(F.col("n") / rows), F.ceil(F.col("words") / (1 << 20))).cast("int")  # a million words a block
    members = members.join(sizes.select("set", blocks.alias("blocks")), "set").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    texts = docs.join(members.withColumnRenamed("rep", "doc_id"), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    dealt = in_blocks(texts, "set", "block", "blocks").select("set", "low", "high", "block", "doc_id", "copies", "text")
    dealt = dealt.repartition("set", "low", "high").sortWithinPartitions("set", "low", "high")
    found = saved(dealt.mapInArrow(verified(k, threshold), "doc_id long, links long, to long"))

    near = components(found.select(F.col("doc_id").alias("a"), F.col("to").alias("b"))).withColumnsRenamed({"id": "rep", "component": "class_id"})
    linked = found.groupBy(F.col("doc_id").alias("rep")).agg(F.sum("links").alias("links"))
    classes = classes.select("rep", "fp1", "fp2", "copies").join(linked, "rep", "left").join(near, "rep", "left")
    classes = saved(classes.select("fp1", "fp2", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies")))
    rows = labels.select("doc_id", "fp1", "fp2").join(classes, ["fp1", "fp2"]).select("doc_id", "class_id", "n_links", "n_copies")
    blank = docs.where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return rows.unionByName(blank.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies")))
