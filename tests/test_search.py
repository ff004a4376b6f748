"""Search by index, and parts named by vendor and number."""

import math
import random
import re

import pytest

from factloom.operators import search as x


def grams(text):
    return {f"  {w} "[i : i + 3] for w in re.split("[^a-z0-9]+", text.lower()) if w for i in range(len(w) + 1)}


def alike(a, b):
    a, b = grams(a or ""), grams(b or "")
    return len(a & b) / len(a | b) if a | b else 0.0


def test_search_by_hand(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abc1-") for _ in range(rnd.randint(1, 7)))
    items = [(i, word(), rnd.choice([None, f"{word()} {word()}"]), rnd.choice([None, word()])) for i in range(150)] + [(900, "Same-1", "x", None), (901, "same-1", "x", None), (902, "", "", "")]
    terms = [word() for _ in range(60)] + ["a", "ab", "SAME-1", "%", "", None, "a"]
    got = x.searched(spark.createDataFrame(items, "id long, sku string, name string, other string"), "id", "sku", "name", ["other"], spark.createDataFrame([(t,) for t in terms], "term string"), limit=None)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = {}
    for t in {t for t in terms if t}:
        for i, *texts in items:
            matched = next((n for n, c in enumerate(texts, 1) if t.lower() in (c or "").lower()), 0)
            if matched or alike(texts[0], t) >= 0.3:
                want[t, i] = (math.floor(1000 * (1.0 if texts[0].upper() == t.upper() else max(alike(texts[0], t), alike(texts[1], t))) + 0.5) / 1000, matched)
    assert {(r["term"], r["id"]): (r["score"], r["matched"]) for r in got.collect()} == want


def test_named_parts(spark):
    parts = spark.createDataFrame([(1, "a", "X-1"), (2, "b", "X-1"), (3, "a", "Y-2")], "part_id long, vendor string, sku string")
    refs = lambda *r: spark.createDataFrame([*r], "vendor string, sku string")
    assert x.named_parts(parts, refs(("b", "x-1"), ("a", "y-2"))) == [3, 2]
    with pytest.raises(KeyError, match="b:Y-2"):
        x.named_parts(parts, refs(("b", "y-2"), ("a", "x-1")))
    with pytest.raises(ValueError):
        x.named_parts(parts, refs(("a", "x-1"), ("a", "X-1")))
    with pytest.raises(ValueError):
        x.named_parts(parts, refs(("a", "x-1"), ("a", "Y-2")), most=1)


@pytest.mark.parametrize("limit", (1, 3))
def test_the_best_of_many_that_share_common_grams(spark, monkeypatch, limit):
    """All numbers and terms begin alike; each block takes a few of them, and no table of theirs is broadcast."""
    monkeypatch.setattr(x, "BLOCK", 4)
    items = [(i, f"promo-{i}", f"Promo {i % 7} rings") for i in range(60)]
    terms = [f"promo-{100 + 3 * i}" for i in range(20)] + ["rings", "o-1"]
    frame = spark.createDataFrame(items, "id long, sku string, name string")
    got = x.searched(frame, "id", "sku", "name", [], spark.createDataFrame([(t,) for t in terms], "term string"), limit=limit)
    want = set()
    for t in terms:
        rows = [(-max(alike(s, t), alike(n, t)), s, i) for i, s, n in items if t in s or t in n.lower() or alike(s, t) >= 0.3]
        want |= {(t, i, r) for r, (_, _, i) in enumerate(sorted(rows)[:limit], 1)}
    assert {(r["term"], r["id"], r["rank"]) for r in got.collect()} == want


def test_no_growing_table_of_a_search_is_broadcast(spark, sf_dir):
    import __spark_entry__

    plan = __spark_entry__.queries()["ranked_search"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") <= 2  # blocks of grams, for items and terms
