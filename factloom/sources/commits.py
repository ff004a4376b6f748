"""One atomic commit of several tables.

A run stages its tables in a folder of its own.  Its gate looks at the staged rows, not at the plans that made them.  Then one
small file, the next in a row of numbered ones, names the version of every table; it comes into being by a rename that does
not replace.  Readers follow the last file, so they see all tables of a run or none; of two runs that began from one version
one is refused.  A run that is lost leaves a folder that no file names; `sweep` removes it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Gate = Callable[[dict[str, DataFrame]], dict]


class GateRefused(Exception):
    """The gate did not pass; nothing was committed."""


class Overtaken(Exception):
    """Another run committed first."""


@dataclass(frozen=True)
class Version:
    number: int
    tables: dict[str, str]
    gate: dict
    runs: tuple[str, ...]


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, base: str):
    return _path(spark, base).getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, path = _files(spark, folder), _path(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []


def version(spark: SparkSession, base: str, number: int | None = None) -> Version:
    """The last version, or an earlier one by number; version 0 has no tables."""
    numbers = [int(n.removesuffix(".json")) for n in _names(spark, f"{base}/versions") if n.endswith(".json")]
    at = max(numbers, default=0) if number is None else number
    if at == 0:
        return Version(0, {}, {}, ())
    if at not in numbers:
        raise ValueError(f"no version {at} in {base}")
    file = json.loads(spark.read.option("wholetext", True).text(f"{base}/versions/{at:012d}.json").first()["value"])
    return Version(at, file["tables"], file["gate"], tuple(file["runs"]))


def read(spark: SparkSession, base: str, table: str, number: int | None = None) -> DataFrame:
    tables = version(spark, base, number).tables
    if table not in tables:
        raise KeyError(f"no table {table} in {base}; there are {', '.join(sorted(tables)) or 'none'}")
    return spark.read.parquet(f"{base}/{tables[table]}")


def stage(tables: dict[str, DataFrame], base: str) -> str:
    """Write all tables of a run; gives its name."""
    run = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{base}/runs/{run}/{name}")
    return run


def staged(spark: SparkSession, base: str, run: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{base}/runs/{run}/{name}") for name in _names(spark, f"{base}/runs/{run}")}


def point(spark: SparkSession, base: str, before: Version, run: str, names: list[str], gate: dict) -> Version:
    """Make the staged tables the next version; tables that the run has not staged stay as they were."""
    tables = before.tables | {n: f"runs/{run}/{n}" for n in names}
    runs = sorted({t.split("/")[1] for t in tables.values()})
    number = before.number + 1
    waiting, file = (_path(spark, f"{base}/versions/{n}") for n in (f".{run}", f"{number:012d}.json"))
    fs = _files(spark, base)
    out = fs.create(waiting, True)
    out.write(json.dumps({"tables": tables, "gate": gate, "runs": runs}).encode())
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    never = spark.sparkContext._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(waiting), fs.makeQualified(file), never)
    except Exception as e:
        fs.delete(waiting, False)
        if fs.exists(file):
            raise Overtaken(f"version {number} of {base} was committed by another run") from e
        raise
    return Version(number, tables, gate, tuple(runs))


def commit(tables: dict[str, DataFrame], base: str, gate: Gate) -> Version:
    """Stage, judge, point.  gate: from the staged tables a small dict with `passed`; if it is false nothing changes."""
    spark = next(iter(tables.values())).sparkSession
    before = version(spark, base)
    run = stage(tables, base)
    verdict = gate(staged(spark, base, run))
    if not verdict.get("passed"):
        _files(spark, base).delete(_path(spark, f"{base}/runs/{run}"), True)
        raise GateRefused(json.dumps(verdict))
    return point(spark, base, before, run, list(tables), verdict)


def sweep(spark: SparkSession, base: str, keep: int = 1) -> list[str]:
    """Remove the folders of runs that none of the last `keep` versions names; not while a run is being staged."""
    last = version(spark, base).number
    named = {r for n in range(max(1, last - keep + 1), last + 1) for r in version(spark, base, n).runs}
    gone = [r for r in _names(spark, f"{base}/runs") if r not in named]
    for r in gone:
        _files(spark, base).delete(_path(spark, f"{base}/runs/{r}"), True)
    return gone
