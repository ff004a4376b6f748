"""Every query outside the llm subpackage against the same in SQL."""

import pytest

import factloom.plans.acquired
import factloom.plans.cells
import factloom.plans.compat
import factloom.plans.dictionary
import factloom.plans.files
import factloom.plans.finders
import factloom.plans.finding
import factloom.plans.grids
import factloom.plans.hygiene
import factloom.plans.identity
import factloom.plans.images
import factloom.plans.inherit
import factloom.plans.merging
import factloom.plans.more
import factloom.plans.normalize
import factloom.plans.records
import factloom.plans.replays
import factloom.plans.rereads
import factloom.plans.upkeep
import factloom.plans.watch
import factloom.plans.writes
import factloom.plans.streams  # noqa: F401  they register their queries
from factloom.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(name, spark, sf_dir, duck, compared):
    compared(QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_facet_counts_are_filter_counts(spark, sf_dir):
    """For every value of a field the filter finds as many parts as the facet says."""
    from pyspark.sql import functions as F

    from factloom.operators.filters import filtered
    from factloom.plans.queries import KINDS
    from factloom.sources.tables import load, part_facts, rendered

    part = load(spark, sf_dir, "part")
    facts = rendered(part_facts(part)).cache()
    parts = part.select(F.col("p_partkey").alias("part_id"))
    for r in QUERIES["facet_values"](spark, sf_dir).where("field_key = 'type'").collect():
        assert filtered(parts, facts, f"type={r['value']}", KINDS).count() == r["parts"]
