"""Shape of records of a compatibility matrix, and the gate."""

import json

from factloom.operators import compat
from factloom.sources.tables import COMPATIBILITY
from pyspark.sql import functions as F

ON = "https://example.org/x"


def judged(spark, tmp_path, records):
    (tmp_path / "r.json").write_text(json.dumps({"records": records}))
    rows = spark.read.schema(COMPATIBILITY).option("multiLine", True).json(str(tmp_path)).select(F.explode("records").alias("r")).select("r.*")
    return compat.problems(rows, ("example.org",))


def test_problems(spark, tmp_path):
    records = [
        {"vendor": "1", "type": "platform-compat", "family_query": "C9300", "compatible_optics": [{"sku": "SFP-10G-SR", "source_url": ON}, {"sku": "XX.XX"}, {"sku": "GLC-TE", "source_url": ""}], "modules": ["C9300-NM-8X"]},
        {"vendor": "2", "type": "platform-compat", "family_query": "C9 300", "compatible_optics": [{"sku": "Transceiver", "source_url": "http://example.org/x"}], "modules": ["XX", None]},
        {"vendor": "3", "type": "platform-compat", "family_query": None, "compatible_optics": None},
        {"vendor": "4", "type": "transceiver", "sku": "GLC-TE", "datasheet_url": "", "end_of_sale": " Yes ", "compat": [{"sku": "GLC-T"}, {"sku": "X.XX"}]},
        {"vendor": "5", "type": "transceiver", "sku": None, "datasheet_url": "https://example.org.evil/", "end_of_sale": "soon", "compat": [{"sku": "Optics"}, {"sku": "Optics"}, {"sku": "XXX"}]},
        {"vendor": "6", "type": "transceiver", "sku": "GLC-SX", "end_of_sale": "on 2024-01-31", "compat": []},
        {"vendor": "7", "type": None}, {"vendor": "8", "type": "cable"},
    ]
    out = judged(spark, tmp_path, records)
    got = {r["vendor"]: (r["problems"], r["empty"]) for r in out.collect()}
    assert got == {
        "1": ([], False),
        "2": (['family_query "C9 300" is no query', 'module "" is no part number', 'module "XX" is no part number', 'optic "Transceiver" is no part number', "source http://example.org/x is elsewhere"], False),
        "3": (['family_query "" is no query', "no compatible optic"], True),
        "4": ([], False),
        "5": (["datasheet https://example.org.evil/ is elsewhere", 'end_of_sale "soon" is neither a date nor a flag', 'equivalent "Optics" is no part number', 'sku "" is no part number'], False),
        "6": ([], False), "7": (['unknown type ""'], False), "8": (['unknown type "cable"'], False),
    }
    counts = {r["problem"]: r["n"] for r in compat.problem_counts(out).collect()}
    assert counts['module "" is no part number'] == 2 and counts["datasheet is elsewhere"] == 1 and counts['unknown type ""'] == 2


def test_gate(spark, tmp_path):
    good = {"type": "transceiver", "sku": "GLC-TE"}
    rows = [good | {"vendor": "a"}] * 49 + [good | {"vendor": "a", "end_of_sale": "soon"}] + [good | {"vendor": "b"}] * 99 + [{"vendor": "b", "type": "platform-compat", "family_query": "C9300"}] + [good | {"vendor": "c"}, {"vendor": "c", "type": "x"}]
    out = judged(spark, tmp_path, rows)
    assert {tuple(r) for r in compat.gate(out, ["vendor"]).collect()} == {("a", 50, 0.98, 1.0, "pass"), ("b", 100, 0.99, 0.99, "fail"), ("c", 2, 0.5, 1.0, "fail")}
    assert compat.gate(out.limit(0), ["vendor"]).count() == 0
