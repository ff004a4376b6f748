"""Plain pages give the parser's calls without the parser."""

import random
from html.parser import HTMLParser

import pytest

from factloom.operators import grids


class Calls(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.calls, self.fed = [], 0

    def feed(self, data):
        self.fed += 1
        super().feed(data)

    def handle_starttag(self, tag, attrs):
        self.calls.append(("start", tag, list(attrs)))

    def handle_endtag(self, tag):
        self.calls.append(("end", tag))

    def handle_data(self, data):
        if self.calls and self.calls[-1][0] == "data":
            data = self.calls.pop()[1] + data
        self.calls.append(("data", data))


def both(html):
    plain, whole = Calls(), Calls()
    grids.read_into(plain, html)
    whole.feed(html)
    whole.close()
    return plain, whole


@pytest.mark.parametrize("html", ["", "x", "a > b", "<table><tr><td colspan='3'>W</td><th rowspan=2>x\n</th></tr></table>z", "<p>a<br>b</p>", "<a href='/p/1?x=2'>more</a><img src=\"x.png\" alt=''>"])
def test_plain_pages_need_no_parser(html):
    plain, whole = both(html)
    assert plain.calls == whole.calls and not plain.fed


def test_any_page_gives_the_same_calls():
    rng = random.Random(7)
    bits = ["<", ">", "</", "/>", "&amp;", "&", "'", '"', "=", " ", "\n", "<!--", "-->", "<script>", "</script>", "<title>", "<TD>", "</br>", "<br/>", "<table>", "<td colspan='2'>", "<td colspan=2 >", "<td  a=b c='d'>", "<td a>", "</td >", "</td x=y>", "</table>", "text", "é", "<p>", "<th rowspan=\"2\">", "<a href='/x>y'>", "<td a=b\tc=d>", "<td a=b/>", "<td\x0ba=b>", "<td a=b>"]
    for _ in range(20000):
        html = "".join(rng.choice(bits) for _ in range(rng.randint(1, 8)))
        plain, whole = both(html)
        assert plain.calls == whole.calls, html
