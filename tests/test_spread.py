"""Narrow tables: dealt out over all tasks, and never broadcast, however small Spark takes them to be."""

import pytest

import __spark_entry__
from factloom.sources.tables import load

NAMES = ("completeness", "confirmed_gaps", "gap_categories", "part_gaps", "applicability_census")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", (*NAMES, "twin_facts"))
def test_no_growing_table_is_broadcast(name, spark, sf_dir):
    assert "BroadcastExchange" not in plan(__spark_entry__.queries()[name](spark, sf_dir))


def test_narrow_tables_are_dealt_out(spark, sf_dir):
    for name in ("part", "customer", "supplier"):
        assert load(spark, sf_dir, name).rdd.getNumPartitions() == 4
        assert load(spark, sf_dir, name).count() == spark.read.parquet(f"{sf_dir}/{name}.parquet").count()


def test_rows_are_dealt_out_before_they_are_made_longer(spark, sf_dir):
    """Tokens of every part are made and counted by all tasks, not by the one that reads the file."""
    assert "REPARTITION_BY_NUM" in plan(__spark_entry__.queries()["junk_sweep"](spark, sf_dir))


def test_no_catalogue_is_broadcast(spark, sf_dir):
    """A catalogue is a union, which drops the hints of what it is made of."""
    from factloom.operators import applied
    from factloom.plans import acquired

    parts, known = acquired.catalogue(spark, sf_dir)
    assert "BroadcastExchange" not in plan(applied.resolved(acquired.entries(spark, sf_dir), parts, known))
