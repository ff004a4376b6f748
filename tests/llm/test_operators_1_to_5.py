import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from cases import odd_rows, words

from factloom.llm import sharding
from factloom.llm.best_fit_packing import best_fit_packing, by_bucket, sweeps
from factloom.llm.exact_topk import exact_topk
from factloom.llm.queries import ORACLE_SQL, QUERIES, byte_bpe, tokenizer
from factloom.llm.substring_dedup import packed, substring_dedup, unpacked
from factloom.llm.token_counts import Prefixes, counter, token_counts, within_budget


def pairs(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(name, spark, sf_dir, duck, compared):
    compared(QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLE_SQL[name]).df())


def repeats(rows, k=13):
    least = {}
    for i, text in rows:
        w = words(text)
        for p in range(len(w) - k + 1 if i is not None else 0):
            s = tuple(w[p : p + k])
            least[s] = min(least.get(s, i), i)
    out = []
    for i, text in rows:
        w = words(text)
        gone = {q for p in range(len(w) - k + 1 if i is not None else 0) if least[tuple(w[p : p + k])] < i for q in range(p, p + k)}
        kept = b" ".join(x for q, x in enumerate(w) if q not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_substrings_of_odd_rows(odd):
    rows = [r[:2] for r in odd_rows()]
    assert pairs(substring_dedup(odd), "doc_id", "n_words", "n_removed", "kept_sha256") == repeats(rows)
    assert pairs(substring_dedup(odd, k=3), "doc_id", "n_words", "n_removed", "kept_sha256") == repeats(rows, 3)


def test_substrings_with_a_full_sketch(odd):
    """A sketch far too small lets everything through, and loses nothing."""
    assert pairs(substring_dedup(odd, most_bits=8), "doc_id", "n_removed") == [(a, c) for a, _, c, _ in repeats([r[:2] for r in odd_rows()])]


def test_sketch_cells_round_trip():
    cells = np.unique(np.random.default_rng(1).integers(1000, 9_000_000, 500)).astype(np.uint64)
    assert (unpacked(packed(cells, 1000)) == cells.astype(np.int64) - 1000).all()


def test_nothing(none):
    assert substring_dedup(none).count() == 0
    assert token_counts(none, tokenizer("word_bpe_49k.json")).count() == 0
    assert best_fit_packing(none, **byte_bpe()).count() == 0
    assert sharding.sharded(none).count() == 0


def test_token_counts(odd, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    for df in (odd, documents):
        rows = df.select("doc_id", "text").collect()
        want = sorted(((i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 2048) for i, x in rows), key=repr)
        assert pairs(token_counts(df, tokenizer("word_bpe_49k.json")), "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_every_prefix_is_exact():
    count = counter(tokenizer("word_bpe_49k.json"))
    for text in ("It's a test,  of é <|endoftext|>x y\x1cz 123 \U0001f642!", "", "   ", "supercalifragilistic"):
        p = Prefixes(text, count)
        exact = [count.count(text[:i]) for i in range(len(text) + 1)]
        assert [p.tokens(i) for i in range(len(text) + 1)] == exact
        for budget in range(max(exact) + 1):
            assert p.within(budget) == max(i for i, n in enumerate(exact) if n <= budget)


def test_stored_prefixes(documents):
    r = token_counts(documents, tokenizer("word_bpe_49k.json"), limit=50, prefixes=True).where("over_limit").first()
    text = documents.where(f"doc_id = {r['doc_id']}").first()["text"]
    count = counter(tokenizer("word_bpe_49k.json"))
    assert all(count.count(text[:e]) == n for e, n in list(zip(r["prefix_chars"], r["prefix_tokens"], strict=True))[::25])
    assert count.count(text[: r["limit_chars"]]) <= 50 < r["n_tokens"]


def test_topk_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=6).round(2)]) for i in range(300)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, rows[0][1]), (400, None), (401, []), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (403, [float("nan")] * 6), (404, [float("inf")] * 6), (None, rows[1][1]), (500, [0.0] * 6), (600, [1.0, 2.0])]
    rows += [(700 + i, rows[5][1]) for i in range(40)]
    df = spark.createDataFrame([(i, v, 1, "z") for i, v in rows], "vec_id long, embedding array<double>, label int, x string")
    good = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in good:
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:10])]
    for block in (64, 4096):
        assert pairs(exact_topk(df, block_rows=block), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert exact_topk(df.limit(0)).count() == 0


def packs(rows, texts, capacity=1024):
    """Pieces against the library's ids, sequences without gaps or overlaps."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    want = defaultdict(int)
    total = 0
    for i, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(i, n, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes()))] += 1
    got = defaultdict(int)
    sequences = defaultdict(list)
    for r in rows:
        got[(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for spans in sequences.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences), -(-total // capacity)


def test_packing(odd, documents):
    packs(best_fit_packing(odd, **byte_bpe()).collect(), [r[:2] for r in odd_rows()])
    used, least = packs(best_fit_packing(documents, **byte_bpe()).collect(), documents.select("doc_id", "text").collect())
    assert used <= 1.05 * least


def test_sweeps_are_best_fit_decreasing():
    rng = np.random.default_rng(5)
    for capacity in (10, 64):
        counts = {int(x): int(n) for x, n in zip(rng.permutation(np.arange(1, capacity + 1))[:8], rng.integers(1, 40, 8), strict=True)}
        bins = []
        for x in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
            fits = [b for b in range(len(bins)) if bins[b] >= x]
            if fits:
                b = min(fits, key=lambda b: bins[b])
                bins[b] -= x
            else:
                bins.append(capacity - x)
        runs = sweeps(counts, capacity)
        assert 1 + max(first + -(-(high - low) // each) - 1 for _, low, high, each, first, _ in runs) == len(bins)
        assert sum(high - low for _, low, high, *_ in runs) == sum(counts.values())


def test_sharding(odd, documents):
    for df in (odd, documents):
        rows = sharding.sharded(df).collect()
        want = sorted(((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in df.collect()), key=repr)
        assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == want
        by = defaultdict(list)
        for r in rows:
            by[r["shard"]].append(r["slot"])
            assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 40
        assert all(sorted(x) == list(range(len(x))) for x in by.values())
    loads = defaultdict(int)
    for r in sharding.sharded(documents, shards=8).collect():
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) - min(loads.values()) < 0.05 * max(loads.values())


def test_map_versions(documents, spark):
    records = sharding.sized(documents, 16, 256)
    first = sharding.first_map(*sharding.slot_totals(records, 256), 4)
    more = sharding.grown(first)
    assert (first.version, more.version, more.shards) == (1, 2, 5)
    assert all(a == b or b == 4 for a, b in zip(first.shard, more.shard, strict=True))
    assert abs(more.loads()[4] - sum(more.loads()) / 5) < 0.2 * sum(more.loads()) / 5
    before = dict(pairs(sharding.sharded(documents, slots=256, slot_map=first), "doc_id", "shard"))
    after = dict(pairs(sharding.sharded(documents, slots=256, slot_map=more), "doc_id", "shard"))
    assert all(after[i] in (s, 4) for i, s in before.items())


def test_packing_of_white_space_and_of_many_alike_rows(spark):
    texts = [(1, " " * 1_000_001 + "a\n" * 50_000), (2, "x" * 300_000), *[(3, "")] * 700, *[(None, "one two three")] * 300, *[(i, "w " * (i % 61)) for i in range(4, 600)]]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    used, least = packs(best_fit_packing(df, **byte_bpe()).collect(), texts)
    assert used <= 1.02 * least


def test_runs_by_bucket_cover_every_rank_once():
    counts = {1: 5000, 7: 41, 30: 77, 64: 3}
    runs = sweeps(counts, 64)
    width, rows = by_bucket(runs, counts)
    for length, n in counts.items():
        for rank in range(n):
            assert sum(1 for x, bucket, low, high, *_ in rows if x == length and bucket == rank // width[length] and low <= rank < high) == 1
    assert len(rows) <= 6 * len(runs) + 4


def test_budgets_from_stored_prefixes(documents, odd):
    count = counter(tokenizer("word_bpe_49k.json"))
    for df in (odd, documents):
        stored = token_counts(df, tokenizer("word_bpe_49k.json"), prefixes=True)
        texts = {(r["doc_id"], r["chunks"]): r for r in within_budget(stored, 40).collect()}
        for r in df.where("doc_id % 3 = 1").collect():
            p = Prefixes(r["text"] or "", count)
            n = sum(1 for x in p.sums[1:] if x <= 40)
            got = texts[(r["doc_id"], n)]
            assert (got["tokens"], got["chars"]) == (p.sums[n], p.ends[n - 1] if n else 0)


def test_topk_in_blocks_of_queries_and_beyond_64_bits(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(400)] + [(400 + i, [x] * 4) for i, x in enumerate([3e12, -3e12, 2.9e12, 1e300, -1e300])]
    good = {i: [max(min(int(np.floor(1024 * x)), 2**63 - 1), -(2**63)) for x in v] for i, v in rows}
    want = []
    for q in good:
        if q % 2 == 0:
            scores = sorted((-max(min(sum(a * b for a, b in zip(good[q], v, strict=True)), 2**63 - 1), -(2**63)), i) for i, v in good.items() if i != q)
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:10])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert pairs(exact_topk(df, every=2, block_rows=64), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


def test_stored_map_is_read_and_edited(documents, spark, tmp_path):
    folder = str(tmp_path / "maps")
    first = dict(pairs(sharding.sharded(documents, shards=4, slots=256, maps=folder), "doc_id", "shard"))
    again = dict(pairs(sharding.sharded(documents.where("doc_id % 10 <> 3"), shards=4, slots=256, maps=folder, overhead=16), "doc_id", "shard"))
    version = sharding.latest(spark, folder).version
    moved = sum(first[i] != s for i, s in again.items())
    assert moved == 0 if version == 1 else moved < 0.3 * len(again)
    rows = sharding.sharded(documents, shards=5, slots=256, maps=folder).collect()
    assert {r["map_version"] for r in rows} == {version + 1} and {r["shard"] for r in rows} == set(range(5))
    assert sharding.sharded(documents, shards=5, slots=256, maps=folder).first()["map_version"] == version + 1
    assert spark.read.parquet(folder).select("version").distinct().count() == version + 1


def test_rebalancing_moves_few_slots():
    rng = np.random.default_rng(6)
    size = rng.integers(1, 1000, 400).tolist()
    old = sharding.first_map(size, [1] * 400, 8)
    assert sharding.rebalanced(old, size, [1] * 400).shard == old.shard
    grown = [x * 3 if s == 2 else x for x, s in zip(size, old.shard, strict=True)]
    new = sharding.rebalanced(old, grown, [1] * 400)
    assert new.version == 2 and max(new.loads()) <= 1.02 * sum(grown) / 8
    assert sum(a != b for a, b in zip(old.shard, new.shard, strict=True)) < 80


def test_sharding_of_repeated_rows(spark):
    """Two thousand identical rows spread like any others."""
    rows = [(None, "")] * 2000 + [(7, "seven words " * 20)] * 500 + [(i, "w " * (i % 50)) for i in range(3000)]
    out = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), shards=10).collect()
    assert len(out) == len(rows)
    loads, alike, by = defaultdict(int), defaultdict(int), defaultdict(list)
    for r in out:
        loads[r["shard"]] += r["size"]
        by[r["shard"]].append(r["slot"])
        alike[r["shard"]] += r["doc_id"] is None
    mean = sum(loads.values()) / 10
    assert all(abs(x - mean) <= 0.02 * mean for x in loads.values())
    assert len(alike) == 10 and max(alike.values()) < 400
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_maps_shrink_and_refuse(documents, spark, tmp_path):
    folder = f"{tmp_path}/maps"
    more = dict(pairs(sharding.sharded(documents, shards=9, slots=256, maps=folder), "doc_id", "shard"))
    assert set(more.values()) == set(range(9))
    less = dict(pairs(sharding.sharded(documents, shards=6, slots=256, maps=folder), "doc_id", "shard"))
    assert set(less.values()) == set(range(6))
    stay = [i for i, s in more.items() if s < 6]
    assert sum(less[i] == more[i] for i in stay) > 0.7 * len(stay)
    assert (sharding.latest(spark, folder).version, sharding.latest(spark, folder).shards) == (2, 6)
    with pytest.raises(ValueError, match="256 slots"):
        sharding.sharded(documents, shards=6, slots=128, maps=folder)
    (tmp_path / "lost" / "_new-run").mkdir(parents=True)  # what a lost run leaves
    assert sharding.latest(spark, f"{tmp_path}/lost") is None
    assert sharding.sharded(documents, shards=3, slots=64, maps=f"{tmp_path}/lost").count() == documents.count()
    assert sharding.latest(spark, f"{tmp_path}/lost").version == 1


def test_first_stored_version_counts(documents, spark, tmp_path):
    folder = f"{tmp_path}/maps"
    one = sharding.store_map(documents, folder, 4, slots=64)
    assert sharding.store_map(documents, folder, 5, slots=64) == one
    assert [p.name for p in (tmp_path / "maps").iterdir() if not p.name.startswith(".")] == ["version=1"]
