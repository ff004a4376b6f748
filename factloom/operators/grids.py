"""Specification tables of pages as facts: rectangular expansion, and the two shapes that name their subjects.

Shape A has a model in each row and attributes in the header; shape B has attributes in the rows and models in the
header.  A table of neither shape gives nothing here (pairs and sections are read by `extraction`).
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

MODEL = re.compile(r"^(?=.*\d)[A-Z0-9][A-Z0-9+./-]{2,39}=?$")
MODEL_HEADER = re.compile(r"\b(model|product|part|sku|pid)\b", re.I)
#: A number with a unit.
AMOUNT = re.compile(r"^[0-9][0-9.,]*\s*[A-Za-z%°\"]{1,5}$")
SPEC_HEADER = re.compile(r"\b(speed|power|weight|size|voltage|temperature)\b", re.I)


#: Pages of plain tags and texts only: no references, comments, scripts or odd quotes, for which alone the parser is needed.
TAGS = "table|thead|tbody|tr|td|th|p|br|dl|dt|dd|a|img|h[1-6]|html|body|ul|ol|li|div|span|b|i"
VALUE = r"""'[^'"<>&]*'|"[^'"<>&]*"|[A-Za-z0-9]+"""
PLAIN = re.compile(rf"[^<&]*+(?:</?+(?:{TAGS})(?<!</br)(?:[ \t\n][a-z]+=(?:{VALUE}))*+>[^<&]*+)*+")
ATTRIBUTE = re.compile(rf"[ \t\n]([a-z]+)=({VALUE})")


def read_into(reader: HTMLParser, html: str) -> None:
    """What feed and close do.  Plain pages, cut at their tags, give the same calls in a fraction of the time."""
    if not PLAIN.fullmatch(html):
        reader.feed(html)
        reader.close()
        return
    text, *rest = html.split("<")
    if text:
        reader.handle_data(text)
    for piece in rest:
        tag, _, text = piece.partition(">")
        if tag[0] == "/":
            reader.handle_endtag(tag[1:].split(None, 1)[0])
        elif "=" in tag:
            name, _ = tag.split(None, 1)
            reader.handle_starttag(name, [(k, v.strip("'\"")) for k, v in ATTRIBUTE.findall(tag)])
        else:
            reader.handle_starttag(tag, [])
        if text:
            reader.handle_data(text)


class Tables(HTMLParser):
    """Rows of cells (text, rowspan, colspan) of each table; tables inside tables are read as text of the outer one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[tuple[str, int, int]]]] = []
        self.depth = 0
        self.cell: list[str] | None = None
        self.spans = (1, 1)

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        elif self.depth == 1 and tag == "tr":
            self.tables[-1].append([])
        elif self.depth == 1 and tag in ("td", "th") and self.tables[-1]:
            a = dict(attrs)
            self.spans = tuple(max(1, min(100, int(a[k]))) if str(a.get(k, "")).isdigit() else 1 for k in ("rowspan", "colspan"))
            self.cell = []
        elif tag == "br" and self.cell is not None:
            self.cell.append(" ")

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag == "table":
            self.depth = max(0, self.depth - 1)
        elif self.depth == 1 and tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append((" ".join("".join(self.cell).split()), *self.spans))
            self.cell = None


def expanded(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """The grid in which every spanned place holds the text of its cell."""
    grid: dict[tuple[int, int], str] = {}
    for r, row in enumerate(rows):
        c = 0
        for text, down, across in row:
            while (r, c) in grid:
                c += 1
            for i in range(down):
                for j in range(across):
                    grid.setdefault((r + i, c + j), text)
            c += across
    height = len(rows)
    width = max((c for r, c in grid if r < height), default=-1) + 1
    return [[grid.get((r, c), "") for c in range(width)] for r in range(height)]


def mostly_models(values: list[str], share: float = 0.6) -> bool:
    hits = sum(bool(MODEL.match(v)) for v in values)
    return hits >= 2 and hits >= share * len(values)


def widths(rows: list[list[tuple[str, int, int]]]) -> list[int]:
    """How many columns each row fills, with what spans down into it."""
    held: list[int] = [0] * len(rows)
    for r, row in enumerate(rows):
        for _, down, across in row:
            for i in range(r, min(r + down, len(rows))):
                held[i] += across
    return held


def alternatives(header: str) -> set[str]:
    """What a header like "Default or upgrade" offers; empty if it offers nothing."""
    words = {w.strip().lower() for w in re.split(r"\s+or\s+|/", header) if w.strip()}
    return words if len(words) > 1 and all(len(w) <= 24 for w in words) else set()


def headed(grid: list[list[str]], held: list[int], column: int) -> tuple[list[str | None], int, list[tuple[str, str]]]:
    """(label of each column, None where its cells say nothing of the row's model; first row below the header; defects).

    A header of two rows is one whose model cell spans down.  Its lower cell refines the upper one, unless it is an amount: then
    the upper one is the condition under which cells were measured, and what they measure is not named.  A column that holds
    only words of its own header tells rows of one model apart.
    """
    top = grid[0]
    start = 2 if len(grid) > 2 and top[column] and grid[1][column] == top[column] else 1
    labels: list[str | None] = [x or None for x in top]
    defects = []
    for c, low in enumerate(grid[1] if start == 2 else []):
        if top[c] and low and low != top[c]:
            amount = AMOUNT.match(low)
            labels[c] = None if amount else f"{top[c]} [{low}]"
            if amount:
                defects.append(("GROUP_HEADER_IS_CONDITION", f"c{c}"))
    models = [r for r, n in zip(grid[start:], held[start:], strict=True) if n == held[0] and MODEL.match(r[column])]
    for c, label in enumerate(labels):
        values = {r[c].lower() for r in models if r[c]}
        if label and c != column and values and values <= alternatives(top[c]):
            labels[c] = None
            defects.append(("ROW_DISCRIMINATOR_COLUMN", f"c{c}"))
    labels[column] = None
    return labels, start, defects


def grid_facts(grid: list[list[str]], held: list[int]) -> tuple[list[tuple[str, str, str, str, str]], list[tuple[str, str]]]:
    """((shape, subject, label, value, row:column), (defect, row or column)) of a grid whose rows fill so many columns.

    Rows of shape A that fill more or fewer columns than the header are left out, since their cells may stand below a wrong
    header; so is a whole table whose first row already holds a model where the header should name it.
    """
    if len(grid) < 2 or len(grid[0]) < 2:
        return [], []
    head, body = grid[0], grid[1:]
    column = next((c for c, h in enumerate(head) if MODEL_HEADER.search(h)), None)
    if column is None:
        column = next((c for c, h in enumerate(head) if not SPEC_HEADER.search(h) and mostly_models([r[c] for r in body])), None)
        if column is not None and MODEL.match(head[column]) and MODEL.match(head[0]):
            return [], [("SCHEMA_MATCH_LOW", "r0")]
    if column is not None and any(MODEL.match(r[column]) for r in body):
        labels, start, defects = headed(grid, held, column)
        facts = []
        for i, r in enumerate(grid[start:], start):
            if not MODEL.match(r[column]):
                continue
            if held[i] != held[0]:
                defects.append(("TABLE_SPLIT_DETECTED" if held[i] < held[0] - 1 else "GRID_MISALIGNED", f"r{i}"))
                continue
            facts += [("A", r[column], label, v, f"{i}:{c}") for c, (label, v) in enumerate(zip(labels, r, strict=True)) if label and v]
        return facts, defects
    if mostly_models(head[1:], 1.0) or (len(head) == 2 and MODEL.match(head[1])):
        return [("B", head[c], r[0], v, f"{i + 1}:{c}") for i, r in enumerate(body) if r[0] for c, v in enumerate(r) if c and v], []
    return [], []


def page_tables(html: str | None) -> dict:
    """Facts and defects of all tables of a page."""
    out: dict = {"facts": [], "defects": []}
    if not html:
        return out
    reader = Tables()
    read_into(reader, html)
    for n, rows in enumerate(reader.tables, 1):
        facts, defects = grid_facts(expanded(rows), widths(rows))
        out["facts"] += [{"shape": s, "subject": m, "label": label, "value": v, "locator": f"{n}:{at}"} for s, m, label, v, at in facts]
        out["defects"] += [{"defect": d, "locator": f"{n}:{at}"} for d, at in defects]
    return out


def page_facts(html: str | None) -> list[dict]:
    return page_tables(html)["facts"]


def texts(*names: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in names]))


@F.pandas_udf(T.StructType([T.StructField("facts", texts("shape", "subject", "label", "value", "locator")), T.StructField("defects", texts("defect", "locator"))]))
def read_tables(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([page_tables(x) for x in html], columns=["facts", "defects"])


def table_facts(pages: DataFrame, key: str, html: str) -> DataFrame:
    return pages.select(key, F.explode(read_tables(F.col(html)).getField("facts")).alias("f")).select(key, "f.*")


def table_defects(pages: DataFrame, key: str, html: str) -> DataFrame:
    """What was left out of the tables of pages, and where."""
    return pages.select(key, F.explode(read_tables(F.col(html)).getField("defects")).alias("d")).select(key, "d.*")
