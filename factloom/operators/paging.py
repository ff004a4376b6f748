"""Keyset pages: rows after a cursor, one more than the page to know whether another follows."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.checkpoints import saved


def encode_cursor(values: list) -> str:
    return base64.urlsafe_b64encode(json.dumps(values, separators=(",", ":"), default=str).encode()).decode().rstrip("=")


def decode_cursor(text: str, n: int) -> list:
    try:
        values = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    except Exception as e:
        raise ValueError("bad cursor") from e
    if not isinstance(values, list) or len(values) != n:
        raise ValueError("bad cursor")
    return values


def after(df: DataFrame, keys: list[tuple[str, bool]], values: list) -> Column:
    """Rows behind the cursor in the order of keys, (column, descending) each; the last key is unique."""
    types = dict(df.dtypes)
    terms = []
    for i, ((column, down), value) in enumerate(zip(keys, values, strict=True)):
        v = F.lit(value).cast(types[column])
        step = F.col(column) < v if down else F.col(column) > v
        equal = [F.col(c) == F.lit(x).cast(types[c]) for (c, _), x in zip(keys[:i], values[:i], strict=True)]
        terms.append(reduce(lambda a, b: a & b, [*equal, step]))
    return reduce(lambda a, b: a | b, terms)


def page(df: DataFrame, keys: list[tuple[str, bool]], limit: int, cursor: list | None = None) -> DataFrame:
    """The rows of one page and at most one more; planned as a bounded top-k, not as a sort."""
    if cursor is not None:
        df = df.where(after(df, keys, cursor))
    return df.orderBy(*[F.desc(c) if down else F.asc(c) for c, down in keys]).limit(limit + 1)


def filled(df: DataFrame, keys: list[tuple[str, bool]], keep: Callable[[DataFrame], DataFrame], limit: int, batch: int | None = None) -> DataFrame:
    """The first `limit` rows, in the order of keys, that a filter keeps; no more rows pass it than it takes to fill the page.

    Batches are taken by keyset, each twice as large as the one before, so that a filter that keeps few costs few rounds; only
    the last key of a batch and two counts come to the driver.  keep: from rows to those of them that stay, such as an anti join.
    """
    order = [F.desc(c) if down else F.asc(c) for c, down in keys]
    back = [F.asc(c) if down else F.desc(c) for c, down in keys]
    size, n, cursor, kept = batch or 2 * limit, 0, None, []
    while n < limit:
        rows = saved(page(df, keys, size - 1, cursor))
        last = rows.orderBy(*back).first()
        if last is None:
            break
        kept.append(saved(keep(rows)))
        n += kept[-1].count()
        if rows.count() < size:
            break
        size, cursor = 2 * size, [last[c] for c, _ in keys]
    if not kept:
        return df.limit(0)
    return reduce(DataFrame.unionByName, kept).orderBy(*order).limit(limit)


def split_page(rows: list, limit: int, keys: list[str]) -> tuple[list, str | None]:
    """A collected page's rows and the cursor of the next one."""
    if len(rows) <= limit:
        return rows, None
    return rows[:limit], encode_cursor([rows[limit - 1][k] for k in keys])


def missing_last(column: Column, down: bool = False) -> Column:
    """A sort key that puts nulls last in either direction."""
    return F.coalesce(column * (-1 if down else 1), F.lit(1e30))
