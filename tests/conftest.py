import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(x):
    if x is None or type(x).__name__ in ("NaTType", "NAType") or x != x:
        return None
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if isinstance(x, bool) or type(x).__name__ in ("bool_", "bool"):
        return bool(x)
    if hasattr(x, "__iter__") and not isinstance(x, str):
        return tuple(cell(y) for y in x)
    if isinstance(x, str):
        return x
    return round(float(x), 6)


def rows_of(pdf):
    columns = sorted(pdf.columns)
    return columns, sorted((tuple(cell(x) for x in r) for r in pdf[columns].itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def compared():
    """Whether two pandas frames hold the same rows under the same names."""

    def same(a, b):
        (ca, ra), (cb, rb) = rows_of(a), rows_of(b)
        assert ca == cb
        assert len(ra) == len(rb)
        assert ra == rb

    return same
