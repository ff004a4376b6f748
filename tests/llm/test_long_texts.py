"""Very long texts, and texts that sums over words or letters would take for equal."""

import numpy as np
import pytest
from cases import passage

from factloom.llm.best_fit_packing import best_fit_packing
from factloom.llm.jaccard_join import jaccard_join
from factloom.llm.license_scans import license_scan
from factloom.llm.line_dedup import line_dedup
from factloom.llm.queries import byte_bpe, tokenizer
from factloom.llm.repetition_rules import repetition_rules
from factloom.llm.shared import grams, segments, spans
from factloom.llm.sharding import sharded
from factloom.llm.source_mixing import mixed
from factloom.llm.substring_dedup import substring_dedup
from factloom.llm.token_counts import token_counts


def thue_morse(n, a, b):
    return [a if bin(i).count("1") % 2 == 0 else b for i in range(n)]


@pytest.fixture(scope="module")
def long(spark):
    words = passage(200_000, 7).split()
    texts = [
        (1, " ".join(words)),
        (2, " ".join(words[:50_000]) + "\n" + passage(40, 8)),
        (3, "\n".join(" ".join(words[i : i + 20]) for i in range(0, 100_000, 20))),
        (4, "\n".join(" ".join(words[i : i + 20]) for i in range(40, 60_000, 20))),
        (5, " " * 1_000_000 + "end"),
        (6, "x" * 1_000_000),
        (7, passage(40, 8)),
    ]
    return spark.createDataFrame([(i, t, f"s{i % 2}") for i, t in texts], "doc_id long, text string, source string").repartition(4).cache()


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_long_texts_are_whole(long):
    n = {i: len(t.split()) for i, t, _ in long.collect()}
    removed = by_id(substring_dedup(long), "n_words", "n_removed")
    assert {i: x for i, (x, _) in removed.items()} == n
    assert [removed[i][1] for i in range(1, 8)] == [0, 50_000, 100_000, 59_960, 0, 0, 40]
    rules = by_id(repetition_rules(long), "n_words", "n_repeat_words")
    assert {i: x for i, (x, _) in rules.items()} == n
    classes = by_id(jaccard_join(long), "class_id", "n_links")
    assert classes == {i: (i, 0) for i in (1, 3, 5, 6, 7)} | {2: (2, 1), 4: (2, 1)}  # 49,960 words of 60,000 in common
    lines = by_id(line_dedup(long), "n_lines", "n_removed")
    assert lines[4] == (2998, 2998) and lines[3] == (5000, 0) and lines[7] == (1, 1)
    assert by_id(license_scan(long), "n_words", "n_base")[5] == (1, 0)
    assert by_id(sharded(long), "size")[6] == (1_000_016,)
    assert len(by_id(mixed(long), "copies")) == 7


def test_long_texts_are_encoded(long):
    packed = best_fit_packing(long.where("doc_id in (5, 6)"), **byte_bpe()).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in packed}[5] == 1_000_001  # a blank each, but the last is of the word; and the end
    counts = by_id(token_counts(long.where("doc_id in (5, 7)"), tokenizer("word_bpe_49k.json")), "n_bytes", "n_tokens")
    assert counts[5] == (1_000_003, 1)


def test_hashes_of_words_and_texts_that_cancel_in_sums(spark):
    a, b = "".join(thue_morse(1024, "a", "b")), "".join(thue_morse(1024, "b", "a"))
    short = [("".join(thue_morse(64, "a", "b")), "".join(thue_morse(64, "b", "a")))]
    for x, y in [(a, b), *short]:
        data = np.frombuffer((x + y).encode(), dtype=np.uint8)
        h = spans(data, np.array([0, len(x)]), np.array([len(x), len(x) + len(y)]))
        assert h[0] != h[1]
    values = np.array([3, 2**40 + 11], dtype=np.uint64)
    both = values[np.array([0 if c == "a" else 1 for c in a + b])]
    starts, ends = np.array([0, 1024]), np.array([1024, 2048])
    assert len(set(segments(both, starts, ends).tolist())) == 2
    assert len(set(grams(both, 1024)[starts].tolist())) == 2
    texts = [(1, f"{a} one two three four"), (2, f"{b} one two three four"), (3, " ".join(thue_morse(4096, "u", "v"))), (4, " ".join(thue_morse(4096, "v", "u")))]
    got = by_id(jaccard_join(spark.createDataFrame(texts, "doc_id long, text string")), "n_copies", "n_links")
    assert got[1] == (1, 0) and got[2] == (1, 0) and got[3][0] == got[4][0] == 1


def test_spans_of_every_length():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    starts = rng.integers(0, 3900, 3000)
    ends = starts + rng.integers(0, 90, 3000)
    seen = {}
    for x, h in zip((data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)), spans(data, starts, ends).tolist(), strict=True):
        assert seen.setdefault(h, x) == x
    assert len(seen) == len({data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)})
