"""Samples by place over many ranges, and chains of every part."""

import random

import pytest

from factloom.operators import chains as c, records
from factloom.operators.writes import every_nth
from factloom.plans.queries import QUERIES
from factloom.sources.tables import load


def test_every_nth_row_of_many(spark):
    """Ranges that are sampled anew when they are worked out again."""
    rows = spark.range(0, 300_000, 1, 37).selectExpr("id * 7919 % 1000003 AS k", "repeat('x', cast(id % 50 as int)) AS more")
    want = sorted(r["k"] for r in rows.select("k").collect())[::40]
    assert sorted(r["k"] for r in every_nth(rows, "k", 40).collect()) == want


def test_chains_start_from_every_part(spark, sf_dir):
    """Every third part has a successor by its life cycle, so that most parts begin a chain."""
    starts = QUERIES["successors_of_parts"](spark, sf_dir).select("start").distinct().count()
    assert starts > load(spark, sf_dir, "part").count() // 2


@pytest.mark.parametrize("n", (40, 150))
def test_chains_of_all_are_those_of_each(spark, monkeypatch, n):
    """Numbers in several spellings of an edge, ends in the middle, loops, parts that share a number, blocks of 64 starts."""
    monkeypatch.setattr(c, "BLOCK_BYTES", 1)
    monkeypatch.setattr(c, "PIECE", 64 * 7)
    rnd = random.Random(n)
    parts = spark.createDataFrame([(i * 3 - 50, f"N{min(i, n - 3)}") for i in range(n)], "part_id long, sku_norm string")
    edges = {}
    for _ in range(3 * n):
        a, b = rnd.randrange(n), rnd.randrange(n)
        edges[a * 3 - 50, rnd.choice((f"N{min(b, n - 3)}", f"N{min(b, n - 3)}", f"X{b % 9}"))] = (rnd.choice((b * 3 - 50, b * 3 - 50, None, 10_000)), rnd.choice((1, 2)))
    edges = spark.createDataFrame([(s, d, *e) for (s, d), e in edges.items()], "src long, dst string, dst_id long, via int")
    got = c.chains_of_all(edges, parts)
    want = records.chains(parts.select(parts["part_id"].alias("start"), "part_id"), edges, parts)
    rows = lambda df: sorted(tuple(r) for r in df.select("start", "dst", "hops", "via").collect())
    assert rows(got) == rows(want)
    assert got.dtypes == want.dtypes


def test_chains_of_all_write_nothing_of_what_they_reach(spark, monkeypatch):
    """What is saved on the way has a row an edge or a part, though each of 300 parts reaches all others."""
    most = []

    def counted(df):
        most.append(df.count())
        return df

    monkeypatch.setattr(c, "saved", counted)
    monkeypatch.setattr(records, "saved", counted)
    parts = spark.range(300).selectExpr("id AS part_id", "concat('N', id) AS sku_norm")
    edges = spark.range(300).selectExpr("id AS src", "explode(array((id * 7 + 1) % 300, (id * 7 + 2) % 300, (id + 11) % 300, (id * 13 + 5) % 300, (id * 17 + 9) % 300, (id * 29 + 3) % 300)) AS dst_id").distinct()
    edges = edges.selectExpr("src", "concat('N', dst_id) AS dst", "dst_id", "1 AS via")
    assert c.chains_of_all(edges, parts).count() > 60_000
    assert max(most) <= 1800
