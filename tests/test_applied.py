"""Commits of several tables, the gate of a run, and labels through the dictionary."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.functions.normalize import Field
from factloom.operators import applied, labels
from factloom.sources import commits


def numbers(spark, n, name="n"):
    return spark.range(n).withColumnRenamed("id", name)


def good(staged):
    return {"passed": True, "rows": sum(df.count() for df in staged.values())}


def test_commit_all_or_nothing(spark, tmp_path):
    base = str(tmp_path / "store")
    first = commits.commit({"a": numbers(spark, 3), "b": numbers(spark, 4)}, base, good)
    assert (first.number, first.gate["rows"]) == (1, 7)
    with pytest.raises(commits.GateRefused):
        commits.commit({"a": numbers(spark, 30), "b": numbers(spark, 40)}, base, lambda s: {"passed": s["a"].count() < 30})
    assert [commits.read(spark, base, t).count() for t in "ab"] == [3, 4]
    assert commits.version(spark, base) == first
    assert commits.sweep(spark, base) == []  # a refused run leaves nothing

    second = commits.commit({"b": numbers(spark, 5)}, base, good)  # a stays as it was
    assert [commits.read(spark, base, t).count() for t in "ab"] == [3, 5]
    assert commits.read(spark, base, "b", 1).count() == 4 and second.number == 2
    with pytest.raises(KeyError):
        commits.read(spark, base, "c")


def test_commit_lost_run(spark, tmp_path):
    """A run that dies while staging, or after it, changes nothing; sweeping removes it."""
    base = str(tmp_path / "store")
    commits.commit({"a": numbers(spark, 3), "b": numbers(spark, 3)}, base, good)
    broken = numbers(spark, 3).withColumn("n", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        commits.commit({"a": numbers(spark, 9), "b": broken}, base, good)
    late = commits.stage({"a": numbers(spark, 9)}, base)
    assert [commits.read(spark, base, t).count() for t in "ab"] == [3, 3]
    gone = commits.sweep(spark, base)
    assert len(gone) == 2 and late in gone
    assert [commits.read(spark, base, t).count() for t in "ab"] == [3, 3]


def test_commit_of_two_runs(spark, tmp_path):
    base = str(tmp_path / "store")
    before = commits.version(spark, base)
    assert before.number == 0
    one, two = (commits.stage({"a": numbers(spark, n)}, base) for n in (1, 2))
    commits.point(spark, base, before, one, ["a"], {})
    with pytest.raises(commits.Overtaken):
        commits.point(spark, base, before, two, ["a"], {})
    assert commits.read(spark, base, "a").count() == 1
    assert commits.sweep(spark, base) == [two]


PARTS = [(1, "A", "x", "AB-1"), (2, "B", "x", "AB-1"), (3, "A", "x", "ab-2"), (4, "A", "x", "CD-3="), (5, "A", "x", "EF-4"), (6, "A", "x", "ef-4"), (7, "B", "y", "GH-5")]
FIELDS = {"weight": Field("weight", "n", "kg"), "note": Field("note", "s")}


def entry(i, sku, anchor=None, vendor=None, aliases=None, facts=(("Weight", "5 kg"),), **more):
    base = dict(entry_id=i, source="s", source_kind="vendor", tier=1, page_url=f"u{i}", fetched_at=None, anchor_id=anchor, vendor=vendor, sku=sku, scope=None, not_listed=None, facts=[*facts], aliases=aliases, images=None, relations=None, lifecycle=None)
    return tuple((base | more).values())


def parts_of(spark):
    return spark.createDataFrame(PARTS, "part_id long, vendor string, category string, sku string"), spark.createDataFrame([(7, "vendor_alias", "other-7"), (7, "gtin", "0123")], "part_id long, kind string, value string")


def test_resolution_ladder(spark):
    rows = [
        entry(1, "AB-1"), entry(2, "AB-1", vendor="A"), entry(3, "AB-2"), entry(4, "CD-3"), entry(5, "EF-4="), entry(6, "Ef-4"), entry(7, "OTHER-7"), entry(8, "0123"), entry(9, "zz", aliases=[("variant_sku", " gh-5 "), ("gtin", "AB-1")]),
        entry(10, "zz", aliases=[("gtin", "GH-5")]), entry(11, "ab-1", anchor=1), entry(12, "AB-1+", anchor=1), entry(13, "gh-5", anchor=1), entry(14, "zz", vendor="A", aliases=[("variant_sku", "GH-5")]), entry(15, "ef-4"),
    ]
    parts, aliases = parts_of(spark)
    got = {r["entry_id"]: (r["outcome"], r["step"], r["part_id"]) for r in applied.resolved(spark.createDataFrame(rows, applied.ENTRY), parts, aliases).collect()}
    assert got == {
        1: ("ambiguous", "exact", None), 2: ("matched", "exact", 1), 3: ("matched", "case", 3), 4: ("matched", "spare", 4), 5: ("matched", "spare", 5), 6: ("ambiguous", "case", None), 7: ("matched", "alias", 7), 8: ("unknown", None, None),
        9: ("matched", "variant", 7), 10: ("unknown", None, None), 11: ("matched", "case", 1), 12: ("unknown", None, None), 13: ("unknown", None, None), 14: ("unknown", None, None), 15: ("matched", "exact", 6),
    }


def run_of(spark, base, text, rows=None):
    parts, aliases = parts_of(spark)
    rows = rows or [entry(i, "GH-5", fetched_at=None, facts=[("Weight", f"{i} kg"), ("Odd", "?")]) for i in range(1, 6)]
    dictionary = spark.createDataFrame([("weight", "weight", None, 1)], "alias string, field string, section string, rank int")
    entries = spark.createDataFrame(rows, applied.ENTRY).withColumn("fetched_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    tables = applied.applied(entries, parts, aliases, dictionary, FIELDS)
    pages = spark.createDataFrame([(f"u{i}", text(i)) for i in range(1, 6)], "page_url string, text string")
    golden = spark.createDataFrame([(1, "weight")], "entry_id long, field string")
    return applied.apply_run(spark, base, tables, pages, golden)


def test_run_and_failing_gate(spark, tmp_path):
    base = str(tmp_path / "store")
    done = run_of(spark, base, lambda i: f"WEIGHT\n {i}  kg")
    assert done.gate == {"precision": 1.0, "recall": 1.0, "sampled": 5, "passed": True}
    assert set(done.tables) == set(applied.TABLES)
    before = {t: commits.read(spark, base, t).count() for t in done.tables}
    assert before["written"] == 5 and before["unmapped"] == 1 and before["checks"] == 5 and before["facts"] == 1
    with pytest.raises(commits.GateRefused, match='"precision": 0.8'):
        run_of(spark, base, lambda i: f"Weight {i + (i == 3)} kg", [entry(i, "GH-5", facts=[("Weight", f"{i} kg")]) for i in range(1, 6)] + [entry(9, "GH-5", facts=[])])
    with pytest.raises(commits.GateRefused):
        run_of(spark, base, lambda i: None)  # nothing can be read again
    assert commits.version(spark, base) == done
    assert {t: commits.read(spark, base, t).count() for t in done.tables} == before


def by_hand(label, section, aliases):
    split = lambda t: [w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()]
    w, best = split(label), None
    for alias, field, own, rank in aliases:
        a = split(alias)
        for i in range(len(w) - len(a) + 1):
            if a and w[i : i + len(a)] == a and own in (None, section):
                order = (-len(a), own is None, rank, i, field)
                best = min(best or order, order)
    return best and best[-1]


def test_labels_by_hand(spark):
    rnd = random.Random(2)
    some = ["max", "power", "draw", "weight", "net", "of", "a"]
    aliases = [(" ".join(rnd.choices(some, k=rnd.randint(1, 4))), f"f{i % 20}", rnd.choice([None, None, "x", "y"]), rnd.randint(0, 3)) for i in range(300)] + [("", "empty", None, 0)]
    rows = [(" ".join(rnd.choices([*some, "zz", "(W)", "-"], k=rnd.randint(0, 7))), rnd.choice(["x", "y", "z", None])) for _ in range(200)] + [(None, "x")]
    got = labels.mapped_labels(spark.createDataFrame(rows, "label string, section string"), spark.createDataFrame(aliases, "alias string, field string, section string, rank int")).collect()
    assert {(r["label"], r["section"]): r["field"] for r in got} == {(a, b): by_hand(a or "", b, aliases) for a, b in rows}
    assert sum(r["field"] is not None for r in got) > 100


def test_labels_outcomes(spark):
    rows = [("Weight", "s", "5 kg"), ("Weight", "s", "weight"), ("Colour", "s", "red"), ("Colour", "s", "blue"), ("Weight", "s", "many"), ("Legend", "s", "x"), ("Other", "s", "1"), (None, None, None)]
    dictionary = spark.createDataFrame([("weight", "weight", None, 1), ("legend", "__legend", None, 1), ("other", "unknown_field", None, 1)], "alias string, field string, section string, rank int")
    got = labels.mapped(spark.createDataFrame(rows, "label string, section string, raw string"), dictionary, FIELDS)
    assert sorted((r["label"] or "", r["raw"] or "", r["outcome"]) for r in got.collect()) == [
        ("", "", "unmapped"), ("Colour", "blue", "unmapped"), ("Colour", "red", "unmapped"), ("Legend", "x", "sentinel"), ("Other", "1", "no_rules"), ("Weight", "5 kg", "ok"), ("Weight", "many", "PARSE_FAIL"), ("Weight", "weight", "section"),
    ]
    report = {r["label"]: (r["n"], r["samples"]) for r in labels.unmapped_report(got).collect()}
    assert report["Colour"] == (2, ["blue", "red"])
    none = dictionary.limit(0)
    assert {r["outcome"] for r in labels.mapped(spark.createDataFrame(rows[:1], "label string, section string, raw string"), none, FIELDS).collect()} == {"unmapped"}
