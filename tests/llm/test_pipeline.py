"""The pipeline's stages against brute force, each on what the stage before left."""

from collections import Counter

import corpus_pipeline
from cases import passage
from test_operators_1_to_5 import packs
from test_operators_6_to_10 import classes_by_force, judged, lines_left

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def checked(spark, docs, sf_dir):
    rows = [tuple(r) for r in docs.select(*DOCUMENTS).collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name == "packing":
            packs(out.collect(), [r[:2] for r in rows])
            return
        assert out.columns == DOCUMENTS
        got = Counter(tuple(r) for r in out.collect())
        if name == "quality":
            assert got == Counter(r for r in rows if judged(r[1])[6])
        elif name == "line_dedup":
            left = lines_left([r[:2] for r in rows])
            want = Counter((i, t) for i, n, gone, t in left if not gone or gone < n)
            assert Counter({(r[0], r[1]): n for r, n in got.items()}) == want
            assert all(r[4] == len(r[1]) or r in rows for r in got)
        elif name == "near_duplicates":
            stay = {i for i, c, _ in classes_by_force([r[:2] for r in rows]) if i == c}
            assert got == Counter(r for r in set(rows) if r[0] in stay) + Counter(r for r in rows if r[0] is None)
        else:
            assert set(got) == set(rows) and max(got.values()) <= 2 * max(Counter(rows).values()) + 1
        docs = spark.createDataFrame(list(got.elements()), docs.select(*DOCUMENTS).schema)
        rows = list(got.elements())


def test_stages(spark, documents, sf_dir):
    checked(spark, documents, sf_dir)


def test_stages_on_odd_rows(spark, odd, sf_dir):
    checked(spark, odd, sf_dir)


def test_run_is_the_stages_in_order(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "mixing", "packing"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    odd.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_near_duplicates_keep_unlike_texts_of_one_id(spark):
    a, b, c = (passage(60, 40 + i) for i in range(3))
    rows = [(1, a), (2, a + " more"), (2, b), (2, b), (3, c), (3, c + " more"), (4, None), (4, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    third = [x for x in got if x[0] == 3]
    assert len(third) == 1 and third[0] in rows
    assert got == Counter([(1, a), (2, b), third[0], (4, None), (None, a)])
