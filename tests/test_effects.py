"""What merging writes, against a reading-by-reading fold."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import effects as x
from factloom.operators.merging import agreement, cut_text, one_cell, union

SCHEMA = "k string, n long, num double, items array<string>, text string, unit string, tier int, doc string, revision string, reader string, read_on string, raw string, refused string"
READ = SCHEMA.replace(" double", "").replace(" array<string>", "").replace(" string", "").replace(" long", "").replace(" int", "").split(", ")


def fold(rows):
    """actions by n, facts by (k, seq), open and resolved conflicts by n, evidence."""
    actions, facts, conflicts, evidence = {}, {}, {}, set()
    for k in {r["k"] for r in rows}:
        seq, held, docs, gap = 0, None, set(), False
        for r in sorted((r for r in rows if r["k"] == k), key=lambda r: r["n"]):
            value = any(r[c] is not None for c in ("num", "items", "text"))
            if value and r["refused"]:
                actions[r["n"]] = "refused"
                continue
            if not value:
                actions[r["n"]] = "gap_refused" if held else "gap_known" if gap else "gap_stored"
                if actions[r["n"]] == "gap_stored":
                    gap, facts[k, 0] = True, "gap_confirmed"
                continue
            if held is None:
                if 1 <= r["tier"] <= 2 and not r["doc"]:
                    actions[r["n"]] = "refused_no_document"
                    continue
                act = "insert"
            else:
                same, one = held["doc"] is not None and held["doc"] == r["doc"], held["tier"] == r["tier"]
                rule = agreement(held, r)
                later = x.later(held, r)
                if held["tier"] == 0 and not rule:
                    act = "protected"
                elif rule:
                    act = "corroborate" if held["doc"] != r["doc"] and max(held["tier"], r["tier"]) <= 2 and r["doc"] not in docs else "agree_same_doc"
                elif same and held["revision"] and r["revision"] and held["revision"] != r["revision"]:
                    act = "revision_change"
                elif same and one and later and one_cell(held, r):
                    act = "supersede"
                elif same and one and held["items"] and r["items"]:
                    act = "list_union"
                else:
                    act = "conflict_" + ("lower_tier_wins" if r["tier"] < held["tier"] else "higher_tier_rejected" if r["tier"] > held["tier"] else "held")
            actions[r["n"]] = act
            state = held and held["state"]
            if act in ("insert", "revision_change", "supersede"):
                held, seq, docs, state = dict(r), seq + 1, set(), "verified" if r["tier"] <= 2 else "unverified"
                evidence.add((k, seq, r["doc"], r["n"]))
            elif act == "list_union":
                held, seq, docs = held | {"items": union(held["items"], r["items"]), "raw": held["raw"] if {i.lower() for i in r["items"]} <= {i.lower() for i in held["items"]} else f"{held['raw'] or ''} ; {r['raw'] or ''}"}, seq + 1, set()
                evidence.add((k, seq, held["doc"], r["n"]))
            elif act == "corroborate":
                docs.add(r["doc"])
                evidence.add((k, seq, r["doc"], r["n"]))
                state = state if held["tier"] > 0 and held["doc"] is None else "corroborated"
            elif act.startswith("conflict"):
                state = "conflict"
            if act.startswith("conflict") or act in ("protected", "revision_change", "supersede"):
                conflicts[r["n"]] = act in ("revision_change", "supersede")
            held["state"] = state
            facts[k, seq] = state
    return actions, facts, conflicts, evidence


def some_readings(n, seed):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        k = "hot" if rnd.random() < 0.34 else f"k{rnd.randrange(40)}"
        kind = rnd.choice(["num", "items", "gap"] if k == "hot" else ["num", "items", "text", "gap"]) if rnd.random() < 0.3 else "items" if hash_of(k) % 2 else "num"
        rows.append(dict(
            k=k, n=i, num=rnd.choice([100.0, 101.0, 150.0, 1.0]) if kind == "num" else None, items=rnd.sample(["a", "B", "c ", "b"], rnd.randint(1, 3)) if kind == "items" else None, text=("word " * 40)[: rnd.choice([158, 160, 200])] if kind == "text" else None,
            unit=rnd.choice([None, "mm", "dB"]), tier=rnd.choice([0] + [1] * 20 + [2, 3]) if i > 200 else rnd.choice([1, 1, 2, 3]), doc=rnd.choice(["d1", "d1", "d1", "d2", "d3", None]), revision=rnd.choice([None, None, "r1", "r2"]),
            reader=rnd.choice([None, "1.2", "1.10", "1.2.0", "x.3"]), read_on=rnd.choice([None, "2024-01-01", "2024-02-01"]), raw=rnd.choice([None, "", "cell", "cell", "other"]), refused=rnd.choice([None] * 9 + ["not this part"]),
        ))
    return rows


def hash_of(k):
    return sum(map(ord, k))


@pytest.mark.parametrize("seed, spread", [(1, True), (2, False), (3, True)])
def test_effects_by_fold(spark, monkeypatch, seed, spread):
    """One key with a third of all readings, spread over parts or not."""
    monkeypatch.setattr(x, "SHARE", 8 if spread else 1)
    monkeypatch.setattr(x, "SPREAD", 5)
    rows = some_readings(900, seed)
    actions, facts, conflicts, evidence = fold(rows)
    got = x.merge_effects(spark.createDataFrame([tuple(r[c] for c in READ) for r in rows], SCHEMA).repartition(7), ["k"], ["n"])
    assert {r["n"]: r["action"] for r in got.actions.select("at.n", "action").collect()} == actions
    assert {"insert", "corroborate", "agree_same_doc", "revision_change", "supersede", "list_union", "gap_refused", "refused", "conflict_held"} <= set(actions.values())
    found = got.facts.select("k", "seq", "state", F.col("until").isNull().alias("current"), "superseded_by").collect()
    assert {(r["k"], r["seq"]): r["state"] for r in found} == facts
    assert all(r["current"] == ((r["k"], r["seq"] + 1) not in facts) for r in found if r["seq"])
    assert {r["n"]: r["resolution"] is not None for r in got.conflicts.select("at.n", "resolution").collect()} == conflicts
    assert {tuple(r) for r in got.evidence.select("k", "seq", "doc", "at.n").collect()} == evidence


def test_effects_of_nothing(spark):
    none = x.merge_effects(spark.createDataFrame([], SCHEMA), ["k"], ["n"])
    assert all(df.count() == 0 for df in none)
    odd = [(None, 1, 5.0, *[None] * 3, 1, "d", *[None] * 5), ("k", 2, 5.0, *[None] * 3, None, "d", *[None] * 5)]
    assert all(df.count() == 0 for df in x.merge_effects(spark.createDataFrame(odd, SCHEMA), ["k"], ["n"]))


def test_cut_text_both_ways(spark):
    text = "word " * 60
    pairs = [(text[:n], text[:m]) for n in (100, 157, 158, 159, 160, 161) for m in (159, 160, 240)] + [("x" * 160, "x" * 200), (text[:96] + "y" * 64, text), (text[:94] + " " + "y" * 65, text)]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("cut", x.cut_text(F.col("a"), F.col("b")))
    assert [r["cut"] for r in df.collect()] == [cut_text(a, b) for a, b in pairs]
    assert cut_text(text[:160], text) and not cut_text(text[:157], text)


def test_a_key_is_one_tasks_though_its_founder_is_broadcast(spark):
    """A join on the key is planned as a shuffle, and becomes a broadcast when one side turns out to be small."""
    sizes = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "20k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k, None) for k in sizes}
    rows = spark.range(0, 4000, 1, 8).selectExpr(
        "id % 5 AS k", "id AS at", "cast(id DIV 400 AS double) AS num", "cast(null AS array<string>) AS items", "cast(null AS string) AS text", "'mm' AS unit", "1 AS tier",
        "'d' AS doc", "concat('r', id DIV 1000) AS revision", "'1' AS reader", "'2024-01-01' AS read_on", "'x' AS raw",
    )
    founded = spark.range(5).selectExpr("id AS k").repartition(3)
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        made = x.rows_in_order(rows.join(founded, "k"), ["k"], ["at"]).select("k", "seq", "until").collect()
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted((r["k"], r["seq"]) for r in made) == [(k, seq) for k in range(5) for seq in range(1, 5)]
    assert sum(r["until"] is None for r in made) == 5
