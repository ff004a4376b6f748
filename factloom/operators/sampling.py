"""Deterministic samples by hash order, the same on every run and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def order_of(seed: str, key: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))


def stratified(rows: DataFrame, stratum: str, key: str, per: int, seed: str = "s") -> DataFrame:
    """`per` rows of each stratum."""
    w = Window.partitionBy(stratum).orderBy(order_of(seed, key), key)
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= per)


def uniform(rows: DataFrame, key: str, k: int, seed: str = "u") -> DataFrame:
    """k rows, each as likely as any other."""
    return rows.orderBy(order_of(seed, key), key).limit(k)


def bucketed(rows: DataFrame, key: str, step: int, seed: str = "b") -> DataFrame:
    """One row in `step`, by hash."""
    first = F.conv(F.substring(order_of(seed, key), 1, 8), 16, 10).cast("long")
    return rows.where(first % step == 0)
