"""Label and value pairs, links and images out of HTML; one parse of each page inside an Arrow batch."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .grids import read_into

VOID = {"area", "base", "br", "col", "hr", "img", "input", "link", "meta", "source", "wbr"}


class Page(HTMLParser):
    """Collects (kind, locator, label, value) rows."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, str, str, str]] = []
        self.cells: list[tuple[str, int]] | None = None
        self.text: list[str] | None = None
        self.table = self.row = 0
        self.section = ""
        self.term = ""
        self.span = 1
        self.href: str | None = None
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "table":
            self.table, self.row, self.section = self.table + 1, 0, ""
        elif tag == "tr":
            self.row, self.cells = self.row + 1, []
        elif tag in ("td", "th", "dt", "dd"):
            self.text = []
            self.span = int(a["colspan"]) if str(a.get("colspan", "")).isdigit() else 1
        elif tag == "a" and a.get("href"):
            self.href, self.text = a["href"], []
        elif tag == "img" and a.get("src"):
            self.rows.append(("image", "", a.get("alt") or "", a["src"]))

    def handle_data(self, data):
        if self.text is not None and not self.skip:
            self.text.append(data)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
            return
        text = " ".join("".join(self.text or []).split())
        if tag in ("td", "th") and self.cells is not None and self.text is not None:
            self.cells.append((text, self.span))
            self.text = None
        elif tag == "dt":
            self.term, self.text = text, None
        elif tag == "dd" and self.term:
            self.rows.append(("dl", "", self.term, text))
            self.text = None
        elif tag == "a" and self.href is not None:
            self.rows.append(("link", "", text, self.href))
            self.href = None
        elif tag == "tr" and self.cells is not None:
            if len(self.cells) == 1:
                self.section = self.cells[0][0]
            elif len(self.cells) == 2 and self.cells[0][0]:
                label = f"{self.section} > {self.cells[0][0]}" if self.section else self.cells[0][0]
                self.rows.append(("table", f"{self.table}:{self.row}", label, self.cells[1][0]))
            self.cells = None


def read_page(html: str | None) -> list[dict]:
    if not html:
        return []
    page = Page()
    read_into(page, html)
    return [dict(zip(("kind", "locator", "label", "value"), r, strict=True)) for r in page.rows]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "locator", "label", "value")])))
def page_rows(html: pd.Series) -> pd.Series:
    return html.map(read_page)


def extracted(pages: DataFrame, key: str, html: str, kinds: tuple[str, ...]) -> DataFrame:
    """A row for each pair, link or image of each page."""
    rows = pages.select(key, F.explode(page_rows(F.col(html))).alias("r")).select(key, "r.*")
    return rows.where(F.col("kind").isin(*kinds))


def colon_pairs(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of the form `Label: value` with a short label; not sentences, which end in a full stop."""
    lines = texts.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line", "x"))
    pattern = r"^\s*([^:.]{1,60}?)\s*:\s+(\S.*?)\s*$"
    hit = F.col("x").rlike(pattern) & ~F.rtrim("x").endswith(".")
    return lines.where(hit).select(key, F.col("line").cast("int").alias("line"), F.regexp_extract("x", pattern, 1).alias("label"), F.regexp_extract("x", pattern, 2).alias("value"))


def is_challenge(html):
    """Whether a page is a bot challenge: short, and its beginning says so."""
    return (F.length(html) < 40000) & F.substring(html, 1, 8000).rlike(r"(?i)just a moment|verify you are human|captcha|access denied")
