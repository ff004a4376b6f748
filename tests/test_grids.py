"""Headers of two rows, rows that do not fit, and headers that hold a model."""

import pytest

from factloom.operators.grids import page_tables


def table(*rows):
    return "<table>" + "".join("<tr>" + "".join(f"<td {c[0]}>{c[1]}</td>" if isinstance(c, tuple) else f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


def read(*rows):
    out = page_tables(table(*rows))
    return [(f["subject"], f["label"], f["value"], f["locator"]) for f in out["facts"]], [(d["defect"], d["locator"]) for d in out["defects"]]


TWO = [[("rowspan=2", "Model"), ("colspan=2", "Ports"), ("rowspan=2", "Weight")], ["1G", "Copper"]]


def test_two_rows():
    facts, defects = read(*TWO, ["AX-1", "4", "8", "2 kg"])
    assert facts == [("AX-1", "Ports [Copper]", "8", "1:2:2"), ("AX-1", "Weight", "2 kg", "1:2:3")]
    assert defects == [("GROUP_HEADER_IS_CONDITION", "1:c1")]


@pytest.mark.parametrize(("row", "defect"), [(["AX-2", "4"], "TABLE_SPLIT_DETECTED"), (["AX-2", "4", "8"], "GRID_MISALIGNED"), (["AX-2", "4", "8", "9", "9"], "GRID_MISALIGNED")])
def test_rows_that_do_not_fit(row, defect):
    facts, defects = read(["Model", "Ports", "Rate", "Weight"], ["AX-1", "1", "2", "3"], row, ["no model", "x"])
    assert [f[0] for f in facts] == ["AX-1"] * 3 and defects == [(defect, "1:r2")]


def test_spans_fill_rows():
    facts, defects = read(["Model", "Ports", "Weight"], ["AX-1", ("rowspan=2", "4"), "1"], ["AX-2", "2"], ["AX-3", ("colspan=2", "5")])
    assert defects == [] and [f[:3] for f in facts] == [("AX-1", "Ports", "4"), ("AX-1", "Weight", "1"), ("AX-2", "Ports", "4"), ("AX-2", "Weight", "2"), ("AX-3", "Ports", "5"), ("AX-3", "Weight", "5")]


def test_column_that_tells_rows_apart():
    rows = [["Model", "Default or Upgrade", "Rate/Speed"], ["AX-1", "default", "1"], ["AX-1", "UPGRADE", "2"]]
    facts, defects = read(*rows)
    assert defects == [("ROW_DISCRIMINATOR_COLUMN", "1:c1")] and [f[1:3] for f in facts] == [("Rate/Speed", "1"), ("Rate/Speed", "2")]
    assert read(*rows, ["AX-2", "none", "3"])[1] == []


def test_header_that_is_a_model():
    assert read(["AX-1", "4"], ["AX-2", "5"], ["AX-3", "6"]) == ([], [("SCHEMA_MATCH_LOW", "1:r0")])
    assert page_tables("") == page_tables(None) == page_tables("<table></table><table><tr></tr></table>") == {"facts": [], "defects": []}
