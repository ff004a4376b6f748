"""Columns handed through operators, under whatever name."""

import pytest
from pyspark.sql import functions as F

from factloom.llm.line_dedup import line_dedup
from factloom.llm.repetition_rules import repetition_rules
from factloom.llm.source_mixing import mixed

#: Names of columns inside the operators, or of functions and aliases there.
INSIDE = ("text_hash", "hash", "gone", "was", "lines", "alone", "runs", "first_id", "part", "tokens", "block", "before", "start", "total", "epochs", "f", "o", "d", "p", "w", "l", "_keep_1")
PASSAGE = "one two three four five six seven eight nine ten eleven"


@pytest.fixture
def docs(spark):
    rows = [(1, f"{PASSAGE}\nx", "a"), (2, f"y\n{PASSAGE}\nz", "b"), (3, None, None), (None, "q", "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in INSIDE])


@pytest.mark.parametrize("operator", [line_dedup, repetition_rules, mixed])
def test_names_inside(docs, operator):
    out = operator(docs, keep=INSIDE)
    assert len(set(out.columns)) == len(out.columns) and set(INSIDE) <= set(out.columns)
    rows = out.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "2", "3", "None"]
    for r in rows:
        assert [r[c] for c in INSIDE] == [f"{c}{'-' if r['doc_id'] is None else r['doc_id']}" for c in INSIDE]
    plain = operator(docs)
    common = [c for c in plain.columns if c in out.columns]
    assert sorted(map(str, plain.select(*common).collect())) == sorted(map(str, out.select(*common).collect()))


@pytest.mark.parametrize(("operator", "name"), [(line_dedup, "n_removed"), (repetition_rules, "n_words"), (repetition_rules, "KEPT"), (mixed, "weight"), (mixed, "place")])
def test_names_of_the_result_are_refused(docs, operator, name):
    with pytest.raises(ValueError, match=name.lower()):
        operator(docs.withColumn(name, F.lit(1)), keep=(name,))
