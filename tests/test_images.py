"""Addresses of pictures, numbers in names of files, and decisions."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from factloom.operators import images


def one(spark, f, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("https://A.example/Thumb/x/X/MR45.JPG?width=3", "a.example/x/mr45.jpg"),
        ("http://u:p@a.example:81/webp/webp.jpg#f", "a.example/webp.jpg"),
        ("https://a.example/a%20b+c/%zz.png", "a.example/a b+c/%zz.png"),
        ("https://a.example/a/b/a/x.png", "a.example/a/b/a/x.png"),
        ("https://a.example/a/thumb/a/x.png", "a.example/a/x.png"),
        ("https://a.example/", None), ("https://a.example", None), ("data:image/png;base64,xx", None), ("/x.png", None), ("", None), (None, None),
    ],
)
def test_picture_key(spark, url, key):
    assert one(spark, images.picture_key, url) == key


@pytest.mark.parametrize(("url", "width"), [("http://a/x?w=99&width=1200", 1200), ("http://a/x?width=7&sw=44", 44), ("http://a/x?maxw=99", None), ("http://a/x?q=1#&w=99", None), ("http://a/x?w=123456", None), (None, None)])
def test_width_hint(spark, url, width):
    assert one(spark, images.width_hint, url) == width


def test_file_tokens(spark):
    assert set(one(spark, images.file_tokens, "a/ms120-24p front_b.v2.png")) == {"MS120-24P FRONT_B.V2", "MS120-24P", "MS120", "24P", "FRONT", "MS120-24P-MS120", "MS120-24P", "24P-FRONT", "FRONT-FRONT", "FRONT-B", "B-B", "B-V2", "V2-V2"}
    assert one(spark, images.file_tokens, "a/.png") == []
    assert one(spark, images.file_tokens, None) is None


@pytest.mark.parametrize(
    ("mine", "named", "kind"),
    [("MS210-24P", "MS210", "family"), ("MX64W", "MX64", "other"), ("C9200L-24P", "C9200", "other"), ("mr45-HW", "MR45=", "same"), ("MR46", "MR45", "other"), ("MR45-HW=", " mr-45 ", "same"), ("MS210", "MS210-24P", "other"), ("A", "", "other")],
)
def test_relation(spark, mine, named, kind):
    assert one(spark, images.relation, mine, named) == kind


def test_page_candidates(spark):
    rows = [
        (1, 1, " http://a/x.png?w=100 ", None, " "), (1, 2, "http://a/thumb/x.png?w=900", "primary", "first"), (1, 3, "http://a/png/x.png?w=900", "late", "second"),
        (1, 4, "http://a/y.png", None, None), (1, 5, "http://a/y.png?w=900", None, "y"), (1, 6, "http://a/logo.png", None, None), (1, 7, "x", None, None), (1, 8, "  ", None, None), (1, 9, None, None, None), (2, 1, "http://a/x.png?w=10", None, None),
    ]
    kept, refused = images.page_candidates(spark.createDataFrame(rows, "page long, position int, url string, role string, alt string"), "page")
    assert {tuple(r) for r in kept.collect()} == {
        (1, "a/x.png", "http://a/thumb/x.png?w=900", 900, "primary", "first"), (1, "a/y.png", "http://a/y.png", None, None, "y"), (2, "a/x.png", "http://a/x.png?w=10", 10, None, None)
    }
    assert {tuple(r) for r in refused.collect()} == {(1, "http://a/logo.png", "placeholder-url:logo"), (1, "x", "not-an-http-url")}


def test_decided(spark):
    names = {1: "MS210-24P", 2: "MR46", 3: "MR45"}
    urls = [(1, 1, "a/ms210.png"), (2, 2, "a/mr45.png"), (3, 1, "a/ms210 mr45.png"), (4, 2, "a/mr46_mr45.png"), *[(10 + i, i, "a/banner.png") for i in (1, 2, 3)], (20, 2, "a/logo_mr45.png"), (21, 2, None), *[(30 + i, 2, f"a/f{i}.png") for i in range(7)]]
    c = spark.createDataFrame([(i, p, "v", names[p], u, u) for i, p, u in urls], "id long, part_id long, vendor string, sku string, url string, url_key string")
    known = spark.createDataFrame([("v", "ms210"), ("v", "MS210-24P"), ("v", "MR45"), ("v", "MR46"), ("w", "BANNER")], "vendor string, sku string")
    fetched = [(1, 200, "png", "s", 300, 20), (2, 200, "png", "s", 900, 900), (4, 200, "png", "s", 900, 900), (30, None, None, None, None, None), (31, 404, None, None, None, None), (32, 200, None, "x", None, None), (33, 200, "png", "many", 900, 900), (34, 200, "png", "s", 299, 10), (35, 200, "png", "s", 900, 900)]
    pictures = spark.createDataFrame([(i, s) for s, n in (("many", 2), ("s", 1)) for i in range(n)] + [(0, "s")], "part_id long, sha256 string")
    out = images.decided(c, known, spark.createDataFrame(fetched, "id long, http int, format string, sha256 string, width int, height int"), pictures, most=2, most_content=2)
    assert {r["id"]: (r["status"], r["reason"]) for r in out.collect()} == {
        1: ("promoted", None), 2: ("rejected", "names-another-sku:MR45"), 3: ("rejected", "names-another-sku:MR45"), 4: ("promoted", None),
        11: ("rejected", "shared-across-parts:3"), 12: ("rejected", "shared-across-parts:3"), 13: ("rejected", "shared-across-parts:3"),
        20: ("rejected", "placeholder-url:logo"), 21: ("rejected", "not-an-http-url"), 30: ("failed", "fetch-error"), 31: ("failed", "http-404"), 32: ("rejected", "not-an-image"),
        33: ("rejected", "generic-content:2"), 34: ("rejected", "tiny-image:299x10"), 35: ("promoted", None), 36: ("waiting", None),
    }


def test_nothing(spark):
    c = spark.createDataFrame([], "id long, part_id long, vendor string, sku string, url string, url_key string")
    fetched = spark.createDataFrame([], "id long, http int, format string, sha256 string, width int, height int")
    assert images.decided(c, c.select("vendor", "sku"), fetched, spark.createDataFrame([], "part_id long, sha256 string")).count() == 0


def test_a_filter_works_the_key_of_an_address_out_once(spark, sf_dir):
    """A filter on the reason is pushed down to where the address is read; one decoding there, one for the columns."""
    for name in ("page_pictures", "refused_pictures", "pictures_of_others"):
        plan = __spark_entry__.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan()
        assert all(line.count("url_decode") <= 4 for line in plan.toString().splitlines()), name
