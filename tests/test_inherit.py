from pyspark.sql import functions as F

import __spark_entry__
from factloom.operators import inherit as x


def test_guards(spark):
    rows = [
        ("AX-1", "hardware", "switch", "Catalyst 2960S Switches", "catalyst-2960-s-series-switches", None), ("AX-1", "license", "switch", "Model 5", "model 5", "class:license"), ("cab-x=", "hardware", "switch", "Model 5", "model 5", "component:CAB-"),
        ("N9K-PAC-1200W", "hardware", "switch", "Model 5", "model 5", "component:-PAC-"), ("QSFP-40G", "hardware", "switch", "Model 5", "model 5", "component:SFP"), ("AX-1", "hardware", "transceiver", "Model 5", "model 5", "category:transceiver"),
        ("AX-1", "hardware", "switch", None, "model 5", "family:unknown"), ("AX-1", "hardware", "switch", "Cisco", "model 5", "family:unknown"), ("AX-1", "hardware", "switch", "Storage Networking", "mds-9700", "family:unknown"), ("AX-1", "hardware", "switch", "System 4000", "system-2000", "family:mismatch"),
        ("AX-1", "hardware", "switch", "Small Business", "small-business-wireless", None), ("AX-1", "hardware", "switch", "Small Business", "large campus", "family:mismatch"), ("AX-1", None, None, "C9300L", "c9300", "family:mismatch"),
    ]
    df = spark.createDataFrame(rows, "sku string, c string, cat string, a string, b string, want string")
    got = df.select("want", x.undescribed(F.col("sku"), F.col("c"), F.col("cat"), F.col("a"), F.col("b")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_lattice(spark):
    parts = spark.createDataFrame([(1, "AX-1", "hardware", "switch", "M 1"), (2, "AX-2", "hardware", "switch", "M 1"), (3, "AX-3", "hardware", "transceiver", "M 1")], "part_id long, sku string, class string, category string, family string")
    stated = spark.createDataFrame([("d", 0, 1, None, "w", 1.0), ("d", 1, None, "m-1", "w", 2.0), ("d", 2, None, "M 1", "w", 3.0), ("d", 1, None, "m-1", "c", 4.0), ("d", 0, 3, None, "flash", 5.0), ("e", 1, None, "m-1", "flash", 6.0), ("d", 1, None, "m 2", "a", 7.0)], "doc_id string, level int, part_id long, family string, field string, value double")
    listed = spark.createDataFrame([("d", 1), ("d", 2), ("d", 2), ("e", 1), ("e", 3)], "doc_id string, part_id long")
    values = x.inherited(stated, listed, parts, x.classes_of(spark, A="a w flash", C="c"))
    assert {(r["part_id"], r["field"]): (r["level"], r["value"]) for r in x.nearest(values).collect()} == {(1, "w"): (0, 1.0), (2, "w"): (1, 2.0), (1, "c"): (1, 4.0), (2, "c"): (1, 4.0), (1, "flash"): (1, 6.0)}
    assert {r["rule"]: r["n"] for r in x.refusals(values).collect()} == {"own_value": 2, "not_applicable:transceiver": 1, "category:transceiver": 1, "family:mismatch": 2}
    assert x.inherited(stated.limit(0), listed, parts, x.classes_of(spark, A="a")).count() == 0


def test_a_document_meets_a_part_once(spark, sf_dir):
    """What a document states is dealt out into fields after it has met its parts; names are not compared for each field."""
    for name in ("inherited_values", "inheritance_refusals"):
        lines = __spark_entry__.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().splitlines()
        dealt = [i for i, line in enumerate(lines) if "Generate explode(said" in line]
        assert len(dealt) == 1 and not any("arrays_overlap" in line for line in lines[: dealt[0]]), name
