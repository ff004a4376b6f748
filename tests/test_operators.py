"""Small cases of operators, refusals among them."""

import datetime

import pytest
from pyspark.sql import functions as F

from factloom.functions import numbers, text
from factloom.operators import coverage, extraction, filters, merge, monitor, paging
from factloom.sources import tables
from factloom.streaming import feeds


@pytest.mark.parametrize("term", ["=3", "size", "size=", "size?3", ""])
def test_terms_refused(term):
    with pytest.raises(ValueError):
        filters.parse_term(term)


@pytest.mark.parametrize(
    ("term", "kind"),
    [("ports=1", "struct"), ("brand>1", "e"), ("size~1", "n"), ("size=x", "n"), ("large=maybe", "b"), ("large>true", "b")],
)
def test_types_refused(term, kind, spark):
    with pytest.raises(ValueError):
        filters.predicate(filters.parse_term(term), kind)


def test_two_character_operators_first():
    assert [filters.parse_term(t).op for t in ("a>=1", "a!=1", "a<=1", "a>1")] == [">=", "!=", "<=", ">"]
    assert filters.split_terms(" a=1, ,b=2,") == ["a=1", "b=2"]


def test_strict_parameters_and_days():
    with pytest.raises(ValueError, match="limt"):
        filters.strict({"limt": 1}, ("limit",))
    assert filters.day("2024-02-29") == datetime.date(2024, 2, 29)
    with pytest.raises(ValueError):
        filters.day("2024-2-9")


def test_cursor_round_trip():
    assert paging.decode_cursor(paging.encode_cursor(["a", 1]), 2) == ["a", 1]
    for bad in ("x", paging.encode_cursor([1]), "!!"):
        with pytest.raises(ValueError):
            paging.decode_cursor(bad, 2)


def test_pages_cover_everything_once(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(25)], "k int, id long")
    seen, cursor = [], None
    while True:
        rows, cursor = paging.split_page(paging.page(df, [("k", True), ("id", False)], 7, cursor and paging.decode_cursor(cursor, 2)).collect(), 7, ["k", "id"])
        seen += [(r["k"], r["id"]) for r in rows]
        if cursor is None:
            break
    assert seen == sorted(((i % 3, i) for i in range(25)), key=lambda x: (-x[0], x[1]))


def values(spark, column, items):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, t string").orderBy("i").select(column).collect()]


def test_numbers(spark):
    assert values(spark, numbers.parse_number(F.col("t")), ["1,234.5", "1.234,5", "−3", "1,234,567", "x", None]) == [1234.5, 1234.5, -3.0, 1234567.0, None, None]
    assert values(spark, numbers.parse_number(F.col("t"), "de"), ["1.234", "1,5", "1.234,5", "12.34"]) == [1234.0, 1.5, 1234.5, 12.34]
    assert values(spark, numbers.convert(F.col("t"), "mm")["value"], ["2 in", "3 cm", "5", "4 kg", "x"]) == [50.8, 30.0, None, None, None]
    assert values(spark, numbers.convert(F.col("t"), "mm")["reason"], ["2 in", "5", "4 kg", "x"]) == [None, "UNIT_MISSING", "UNIT_UNKNOWN", "PARSE_FAIL"]
    assert values(spark, numbers.quantity(F.col("t"))["base_value"], ["212 °F", "5 GB", "5 Gb"]) == [100.0, 5e9, 5e9]
    assert values(spark, numbers.boolean(F.col("t")), ["not supported", "Yes", "maybe"]) == [False, True, None]
    assert values(spark, numbers.count_value(F.col("t")), ["16k", "2 million", "4 kg"]) == [16000.0, 2000000.0, None]
    assert values(spark, numbers.choice(F.col("t"), [("sfp", "sfp-plus")], ("copper",)), ["SFP+ cage", " Copper ", "wood"]) == ["sfp-plus", "copper", None]
    assert values(spark, numbers.number_range(F.col("t"))["high"], ["-5 to 40 °C", "7", "9 to 3"]) == [40.0, 7.0, None]


def test_text_rules(spark):
    assert values(spark, text.part_number_reason(F.col("t")), ["C9200L-24P", "a", "hello", "12345", "10GbPS", "v1.2"]) == [None, "too_short", "no_digit", "digits_only", "measurement", "version"]
    assert values(spark, text.description_reason(F.col("t")), [None, "", "n/a", "abc", "aaaaaaaaaa bbb", "A fine switch", "12 345 67"]) == ["missing", "empty", "void_value", "too_short", "repeated_filler", None, "not_prose"]
    assert values(spark, text.url_key(F.col("t")), ["https://A.com/x/x/200x200/P.png?w=3"]) == ["a.com/x/p.png"]
    assert values(spark, text.size_hint(F.col("t")), ["http://a/b?w=300", "http://a/640x480/b", "http://a"]) == [300, 640, None]
    assert values(spark, text.canonical_json(F.col("t")), ['{"b":1,"a":[2,1]}']) == ['{"a":[2,1],"b":1}']
    assert text.split_items("a, b (c, d); e and f") == ["a", "b (c, d)", "e", "f"]
    assert text.split_items("• one\n• two, three") == ["one", "two, three"]
    assert text.split_items("1,000 users") == ["1,000 users"]
    assert text.ports_of("24 x 1G RJ-45, 4 x 10G SFP+") == [{"typ": "RJ45", "speed": "1G", "n": 24}, {"typ": "SFP+", "speed": "10G", "n": 4}]
    assert text.ports_of("24 x 1G RJ45, some other ports") == []


def test_fold_keeps_its_order(spark):
    rows = [("a", 1, 1.0, 2, "d1"), ("a", 2, 1.0, 3, "d2"), ("a", 3, 2.0, 1, "d3"), ("b", 1, 5.0, 0, "d1"), ("b", 2, 6.0, 1, "d2"), ("c", 1, 1.0, 2, "d1"), ("c", 2, 3.0, 2, "d1"), ("d", 1, 1.0, 1, "d1"), ("d", 2, 2.0, 3, "d2")]
    df = spark.createDataFrame([(k, at, v, t, d, i) for i, (k, at, v, t, d) in enumerate(rows)], "k string, at int, v double, tier int, doc string, id long")
    got = {r["k"]: (r["value"], r["tier"], r["state"], r["last_action"]) for r in merge.fold(df, ["k"], "v", "tier", "doc", "at", "id").collect()}
    assert got == {"a": (2.0, 1, "conflict", "conflict_lower_tier_kept"), "b": (5.0, 0, "verified", "protected"), "c": (3.0, 2, "verified", "supersede"), "d": (1.0, 1, "conflict", "conflict_held")}


def test_newer_wins_never_blanks(spark):
    a = spark.createDataFrame([(1, 5, 1, "x", None), (2, 5, 1, "x", "y")], "k int, at int, tier int, p string, q string")
    b = spark.createDataFrame([(1, 6, 2, None, "z"), (3, 1, 1, "n", None)], "k int, at int, tier int, p string, q string")
    assert sorted(tuple(r) for r in merge.newer_wins(a, b, "k", "at", "tier", ["p", "q"]).collect()) == [(1, 6, 2, "x", "z"), (2, 5, 1, "x", "y"), (3, 1, 1, "n", None)]


def test_ambiguous_is_never_tie_broken(spark):
    parts = spark.createDataFrame([("AB1", 1), ("ab1", 2), ("C3=", 3)], "sku string, part_id long")
    aliases = spark.createDataFrame([], "value string, part_id long")
    tokens = spark.createDataFrame([("AB1",), ("Ab1",), ("c3",), ("zz",)], "token string")
    got = {r["token"]: (r["outcome"], r["part_id"]) for r in merge.resolve(tokens, parts, aliases).collect()}
    assert got == {"AB1": ("resolved", 1), "Ab1": ("ambiguous", None), "c3": ("resolved", 3), "zz": ("unknown", None)}


def test_reparent_drops_what_is_there(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y")], "part_id long, value string")
    moves = spark.createDataFrame([(2, 1)], "from_id long, to_id long")
    assert sorted(tuple(r) for r in merge.reparent(rows, moves, "part_id", ["value"]).collect()) == [(1, "x"), (1, "y")]


def test_never_fewer(spark):
    runs = spark.createDataFrame([("a", 1, 5), ("a", 2, 4), ("b", 1, 1)], "kind string, at int, n int")
    assert [r["at"] for r in coverage.never_fewer(runs, ["kind"], "at", "n").collect()] == [2]


def test_page_reader():
    html = "<table><tr><th colspan=2>Ports</th></tr><tr><td>Speed &amp; duplex</td><td> 1<br>G </td></tr></table><script>var x='<a href=q>'</script><img src=a.png alt=A>"
    assert [(r["kind"], r["label"], r["value"]) for r in extraction.read_page(html)] == [("table", "Ports > Speed & duplex", "1G"), ("image", "A", "a.png")]


def test_sources(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"source":"s","generated_at":"x","records":[{"__doc__":true,"source_url":"u"},{"sku":"A","label":"l","value":"v"}]}')
    docs, facts = tables.read_extract(spark, str(tmp_path / "e.json"))
    assert (docs.count(), facts.count()) == (1, 1)
    (tmp_path / "r.jsonl").write_text('{"k":1,"v":"a"}\n{"k":1,"v":"b"}\n{"k":2,"v":"c"}\n')
    assert sorted(tuple(r) for r in tables.read_first(spark, str(tmp_path / "r.jsonl"), ["k"], "k long, v string").collect()) == [(1, "a", 2), (2, "c", 1)]
    assert tables.content_hashes(spark, str(tmp_path / "r.jsonl")).count() == 1
    base = str(tmp_path / "snap")
    for n in (3, 5):
        tables.write_snapshot(spark.range(n), base, {"n": n})
        assert tables.read_snapshot(spark, base).count() == n


def test_streams(spark, sf_dir, tmp_path, compared):
    log = feeds.read_log(spark, sf_dir, "events.parquet")
    feeds.drained(feeds.windowed(log, "event_type", "6 hours"), f"{tmp_path}/w", f"{tmp_path}/wc")
    batch = feeds.windowed(tables.load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "event_type", "6 hours")
    got = spark.read.parquet(f"{tmp_path}/w")
    end = got.agg(F.max("window_start")).first()[0]
    assert got.count() > 0
    compared(got.toPandas(), batch.where(F.col("window_start") <= F.lit(end)).toPandas())
    seen = []
    q = feeds.change_feed(log, lambda df, i: seen.append(df.count()), f"{tmp_path}/cc")
    q.awaitTermination()
    assert sum(seen) == tables.load(spark, sf_dir, "events").count()
    feeds.drained(feeds.sessions(log, "user_id"), f"{tmp_path}/s", f"{tmp_path}/sc")
    assert spark.read.parquet(f"{tmp_path}/s").count() > 0


def test_streak(spark):
    log = spark.createDataFrame([("a", 1, "ok"), ("a", 2, "x"), ("a", 3, "x"), ("b", 1, "x"), ("c", 1, "ok")], "s string, at int, o string")
    assert dict(tuple(r) for r in monitor.streaks(log, "s", ["at"], F.col("o") != "ok").collect()) == {"a": 2, "b": 1, "c": 0}


def test_runs_need_a_gate(spark, tmp_path):
    from factloom.operators.maintenance import run

    manifest = str(tmp_path / "runs")
    with run(spark, manifest, "apply-extract") as r:
        r["gate"] = {"precision": 1.0, "recall": 0.9, "passed": True}
    with pytest.raises(ValueError, match="gate"), run(spark, manifest, "apply-extract"):
        pass
    with pytest.raises(KeyError), run(spark, manifest, "sweep"):
        raise KeyError("x")
    assert sorted(r["status"] for r in spark.read.json(manifest).collect()) == ["failed", "failed", "succeeded"]


def test_tiers_are_never_guessed(spark):
    from factloom.operators.maintenance import restamped

    facts = spark.createDataFrame([(1, "a", "ocr", 9)], "id long, doc_id string, method string, tier int")
    kinds = spark.createDataFrame([("a", "pdf")], "doc_id string, doc_kind string")
    with pytest.raises(Exception, match="no tier for pdf ocr"):
        restamped(facts, kinds, {("pdf", "table"): 1}).collect()


def test_walk_stops_at_cycles(spark):
    from factloom.operators.graph import walk

    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    got = {(r["node"], r["hops"]) for r in walk(edges, spark.createDataFrame([("a",)], "start string")).collect()}
    assert got == {("b", 1), ("c", 2)}


def test_grids():
    from factloom.operators.grids import page_facts

    spanned = "<table><tr><th>Feature</th><th>C9200-24</th><th>C9200-48</th></tr><tr><td>Speed</td><td colspan=2>1G</td></tr><tr><td rowspan=2>Power</td><td>5 W</td><td>6 W</td></tr><tr><td>7 W</td></tr></table>"
    assert [(r["subject"], r["label"], r["value"]) for r in page_facts(spanned)] == [
        ("C9200-24", "Speed", "1G"), ("C9200-48", "Speed", "1G"), ("C9200-24", "Power", "5 W"), ("C9200-48", "Power", "6 W"), ("C9200-24", "Power", "7 W"),
    ]
    assert page_facts("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>") == []
    assert page_facts(None) == [] and page_facts("<table><tr><td>unclosed") == []


def test_tool_definitions_are_refused(spark):
    from factloom.operators.tools import Facet, Tool, parameters, problems
    from factloom.plans.finders import TOOL
    from factloom.plans.queries import KINDS

    every = set(KINDS)
    assert problems(TOOL, KINDS, every) == []
    bad = Tool("Bad Tool", "ports=1,nope=2", (Facet("size", "select"), Facet("ports", "range"), Facet("x", "range"), Facet("type", "multi"), Facet("type", "multi")), ("brand", "brand", "y"), "brand", ({"zzz": "1"},))
    assert len(problems(bad, KINDS, every - {"type"})) >= 10
    assert parameters(TOOL, {"size_min": "3", "type": ["A", "B"]}, KINDS) == "size>=3,type=A,type=B"
    for given in ({"brand": ["a", "b"]}, {"size": "3"}, {"type": "a,b"}, {"size_min": "x"}):
        with pytest.raises(ValueError):
            parameters(TOOL, given, KINDS)


def test_bulletins_and_compatibility_files(spark, tmp_path):
    import json

    from factloom.sources import tables

    bulletin = {"records": [{"vendor": "v", "doc_id": "E1", "affected_pids": [{"pid": "A-1", "successor": "B-1"}, {"pid": "A-2", "successor": None}], "lifecycle": {"end_of_sale_date": "2020-01-01"}}, {"vendor": "v", "doc_id": "E2", "affected_pids": []}]}
    (tmp_path / "b.json").write_text(json.dumps(bulletin))
    rows = sorted((r["doc_id"], r["pid"], r["successor"], r["end_of_sale_date"]) for r in tables.read_bulletins(spark, str(tmp_path / "b.json")).where("pid is not null").collect())
    assert rows == [("E1", "A-1", "B-1", "2020-01-01"), ("E1", "A-2", None, "2020-01-01")]
    compat = {"records": [{"type": "platform-compat", "vendor": "v", "family_query": "F", "modules": ["M"], "compatible_optics": [{"sku": "O-1"}]}, {"type": "transceiver", "vendor": "v", "sku": "O-1", "compat": [{"sku": "X-1", "relation": "equivalent"}]}]}
    (tmp_path / "c.json").write_text(json.dumps(compat))
    platforms, optics = tables.read_compatibility(spark, str(tmp_path / "c.json"))
    assert platforms.select("family_query", "optic").first() == ("F", "O-1") and optics.select("sku", "target", "relation").first() == ("O-1", "X-1", "equivalent")
    (tmp_path / "k.json").write_text('{"a": 1}')
    assert tables.read_config(spark, str(tmp_path / "k.json"), "a") == {"a": 1}
    with pytest.raises(KeyError, match="b"):
        tables.read_config(spark, str(tmp_path / "k.json"), "a", "b")


def test_part_numbers_refused_and_kept(spark):
    from factloom.functions.identity import part_number_refusal

    cases = {
        None: "empty", "  ": "empty", "A,B-1": "bad_char", "A B-1": "whitespace", "10-2834-01": None, "1030033": None, "8201=": None, "2024-10-31=": "date", "9800-40": None, "2024-10": "quantity", "886VA": None, "850VA": "quantity", "1-JAN-2020": "date",
        "24x10G": "quantity", "1X100GBE=": None, "0.75K=": "quantity", "4-Port": "quantity", "1.Ports": "footnote", "802.3af": "standard", "10GBASE-SR": "standard", "17.9.4a": "version", "SFP+": "connector", "IPv6": "protocol", "CE-10GSFP-SR": "protocol",
        "CE-10GSFP-SR=": None, "#-123": "no_letter", "A1": "too_short", "Router": "bare_word", "4G-LTE-ANTM-D": None, "C9300-24T": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", part_number_refusal(F.col("t")).alias("r"))
    assert {r["t"]: r["r"] for r in df.collect()} == cases
    short = spark.createDataFrame([("UX",), ("U",), ("UXGX",)], "t string").select(part_number_refusal(F.col("t"), F.lit(True)).alias("r"))
    assert [r["r"] for r in short.collect()] == [None, "too_short", "bare_word"]


def test_merging_asks_in_order():
    from factloom.operators.merging import merged

    def reading(**kw):
        return dict(num=None, items=None, text=None, unit=None, tier=2, doc="d", revision=None, reader="1.0", read_on="2020-01-01", raw="r") | kw

    held = reading(num=10.0) | {"state": "verified"}
    assert merged(None, reading(num=1.0, tier=3))[0]["state"] == "unverified"
    assert merged(held | {"tier": 0}, reading(num=11.0, tier=1))[1] == "protected"
    assert merged(held | {"unit": "mm"}, reading(num=10.1, doc="e"))[1:] == ("corroborate", "numeric_tolerance")
    assert merged(held | {"unit": "dB"}, reading(num=10.1, doc="e"))[1] == "conflict_held"
    assert merged(held | {"revision": "a"}, reading(num=11.0, revision="b"))[1] == "revision_change"
    assert merged(held, reading(num=11.0, reader="1.10"))[1] == "supersede" and merged(held, reading(num=11.0, reader="0.9"))[1] == "conflict_held"
    lists = reading(items=["a", "B"]) | {"state": "verified"}
    assert merged(lists, reading(items=["b", "A "], doc="e"))[1:] == ("corroborate", "set_equal")
    state, action, _ = merged(lists, reading(items=["b", "c"]))
    assert action == "list_union" and state["items"] == ["a", "B", "c"]
    long = "word " * 40
    assert merged(reading(text=long[:160]) | {"state": "verified"}, reading(text=long))[1:] == ("agree_same_doc", "prefix_truncated")
    assert merged(held, reading(num=11.0, tier=1, doc="e"))[1] == "conflict_lower_tier_wins" and merged(held, reading(num=11.0, tier=4, doc="e"))[1] == "conflict_higher_tier_rejected"


def test_the_numbers_of_bulletins_are_read_once(spark):
    """One shuffle of the bulletins' rows serves exact and core numbers; nulls and ties have one result."""
    from factloom.operators import writes

    rows = [(1, "WS-C1000-1-E", "A", 2, "2020-01-01"), (2, "1000-1-E", None, 3, None), (3, "C1000-1", None, 1, "2021-01-01"), (4, None, "X", 4, "2022-01-01"), (1, "WS-C1000-1-E", "B", 2, "2020-01-01"), (5, "word", "Y", 4, None)]
    bulletins = spark.createDataFrame(rows, "bulletin_id long, pid string, successor string, n_dates int, end_of_sale string")
    parts = spark.createDataFrame([(1, "1000-1-E"), (2, "1000-1"), (3, "1000-1-L"), (4, "2000-1"), (5, None)], "part_id long, sku string")
    numbers = writes.listed_numbers(bulletins)
    assert sorted((r["full"], r["exact"], r["b"]["bulletin_id"]) for r in numbers.collect()) == [("1000-1", None, 3), ("1000-1-E", "A", 2)]
    got = writes.bulletin_successors(parts, bulletins).collect()
    assert sorted((r["part_id"], r["bulletin_id"], r["end_of_sale"], r["successor"]) for r in got) == [(1, 2, None, "A"), (2, 2, None, None), (3, 2, None, None)]
