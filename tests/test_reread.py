from pyspark.sql import functions as F

from factloom.operators import furniture, paging, reread as x


def test_filled_reads_little(spark):
    rows = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    passed = []

    def keep(batch):
        passed.append(batch.count())
        return batch.where("k % 10 = 3")

    for limit in (1, 20, 499, 600):
        passed.clear()
        got = [tuple(r) for r in paging.filled(rows, [("v", True), ("k", False)], keep, limit, batch=30).collect()]
        want = sorted(((k, k % 7) for k in range(5000) if k % 10 == 3), key=lambda r: (-r[1], r[0]))[:limit]
        assert got == want
        assert sum(passed) <= max(30, 45 * limit)
    assert paging.filled(rows.limit(0), [("k", False)], keep, 5).count() == 0


def test_verdicts(spark):
    pages = spark.createDataFrame([(1, "<table><tr><td>A</td><td>1  Kg</td></tr><tr><td>B</td><td>2</td></tr></table>"), (2, None)], "page_id long, html string")
    facts = spark.createDataFrame([(1, 1, 0, 1, "1 kg"), (1, 1, 0, 1, "2"), (1, 1, 1, 1, "9"), (1, 2, 0, 0, "9"), (2, 1, 0, 1, "1 kg"), (3, 1, 0, 1, "1 kg"), (1, 1, 0, 1, None)], "page_id long, tbl int, r int, c int, raw string")
    got = sorted((r["page_id"], r["tbl"], r["raw"] or "", r["verdict"]) for r in x.reread(facts, pages).collect())
    assert got == [(1, 1, "", "wrong"), (1, 1, "1 kg", "same"), (1, 1, "2", "moved"), (1, 1, "9", "wrong"), (1, 2, "9", "vanished"), (2, 1, "1 kg", "vanished"), (3, 1, "1 kg", "vanished")]


def test_sample_is_the_same_each_time(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), "id")
    a, b = (sorted(tuple(r) for r in x.sampled(rows.repartition(n), "g", ["id"], 20, "s").collect()) for n in (2, 7))
    assert a == b and len(a) == 60
    assert a != sorted(tuple(r) for r in x.sampled(rows, "g", ["id"], 20, "t").collect())


def test_furniture(spark):
    pages = spark.createDataFrame([(i, "a") for i in range(10)] + [(i, "b") for i in range(10, 14)] + [(20, None)], "page_id long, site string")
    items = [(i, "/home") for i in range(14)] + [(0, "/home"), (20, "/home")] + [(i, "/half") for i in range(5)] + [(i, "/few") for i in range(4)] + [(10, "/x"), (11, "/x")] + [(0, None)]
    df = spark.createDataFrame(items, "page_id long, item string")
    got = {(r["site"], r["item"]): (r["pages"], r["of"]) for r in furniture.furniture(df, pages).collect()}
    assert got == {("a", "/home"): (10, 10), ("b", "/home"): (4, 4), ("a", "/half"): (5, 10)}
    left = sorted((r["page_id"], r["item"]) for r in furniture.without_furniture(df, pages).where("item is not null").collect())
    assert left == [(0, "/few"), (1, "/few"), (2, "/few"), (3, "/few"), (10, "/x"), (11, "/x"), (20, "/home")]
    urls = spark.createDataFrame([("https://www.x.org/a",), ("http://M.Shop.de:80/",), ("https://m.de/",), ("nothing",), (None,)], "u string")
    assert [r[0] for r in urls.select(furniture.site_of(F.col("u"))).collect()] == ["x.org", "shop.de", "m.de", "", None]
