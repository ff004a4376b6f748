"""The filter language: `term(,term)*`, a term being key, operator and value; terms are ANDed.

Each term asks for a rendered fact of the entity; it becomes a semi join, so an entity without the fact never matches,
not even `!=`.  Types decide which operators are allowed and which typed column is compared, so that comparisons reach
the scan as plain predicates.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

OPERATORS = ("!=", ">=", "<=", "=", ">", "<", "~")
KEY = re.compile(r"[a-z0-9_]+")


@dataclass(frozen=True)
class Term:
    key: str
    op: str
    value: str


def split_terms(text: str) -> list[str]:
    return [t for t in (x.strip() for x in text.split(",")) if t]


def parse_term(text: str) -> Term:
    m = KEY.match(text)
    if not m:
        raise ValueError(f"filter term {text!r} has no key")
    rest = text[m.end() :].lstrip()
    op = next((o for o in OPERATORS if rest.startswith(o)), None)
    if op is None:
        raise ValueError(f"filter term {text!r} has no operator; use one of {' '.join(OPERATORS)}")
    value = rest[len(op) :].strip()
    if not value:
        raise ValueError(f"filter term {text!r} has no value")
    return Term(m.group(), op, value)


def number(term: Term) -> float:
    try:
        return float(term.value)
    except ValueError:
        raise ValueError(f"{term.key}: {term.value!r} is not a number") from None


def compared(column: Column, op: str, value: Column) -> Column:
    return {
        "=": column == value,
        "!=": column != value,
        ">": column > value,
        ">=": column >= value,
        "<": column < value,
        "<=": column <= value,
    }[op]


def predicate(term: Term, kind: str) -> Column:
    """What a fact of this type must satisfy."""
    if kind == "struct":
        raise ValueError(f"{term.key} is a structure and cannot be filtered")
    if term.op in (">", ">=", "<", "<=") and kind not in ("n", "nr"):
        raise ValueError(f"{term.key} has no order; {term.op} needs a number")
    if term.op == "~" and kind not in ("e", "s", "ls"):
        raise ValueError(f"{term.key} has no text; ~ needs text or a list")
    if kind == "n":
        return compared(F.col("value_num"), term.op, F.lit(number(term)))
    if kind == "nr":
        x = F.lit(number(term))
        if term.op in ("=", "!="):
            inside = (F.col("value_min") <= x) & (F.col("value_max") >= x)
            return inside if term.op == "=" else ~inside
        return compared(F.col("value_min" if term.op in (">", ">=") else "value_max"), term.op, x)
    if kind == "b":
        if term.value not in ("true", "false"):
            raise ValueError(f"{term.key} is true or false")
        return compared(F.col("value_bool"), term.op, F.lit(term.value == "true"))
    text = F.lit(term.value.lower())
    if kind == "ls":
        if term.op == "~":
            return F.exists("value_list", lambda x: F.contains(F.lower(x), text))
        held = F.array_contains("value_list", term.value)
        return held if term.op == "=" else ~held
    if term.op == "~":
        return F.contains(F.lower("value_str"), text)
    return compared(F.col("value_str"), term.op, F.lit(term.value))


def filtered(entities: DataFrame, facts: DataFrame, text: str, dictionary: dict[str, str], key: str = "part_id") -> DataFrame:
    """Entities for which every term of the filter holds.  facts: rendered ones; dictionary: type of each key."""
    for t in split_terms(text):
        term = parse_term(t)
        if term.key not in dictionary:
            raise ValueError(f"unknown field {term.key!r}")
        holds = facts.where((F.col("field_key") == term.key) & predicate(term, dictionary[term.key])).select(F.col("part_id").alias(key))
        entities = entities.join(holds, key, "left_semi")
    return entities


def one_of(column: str, text: str | None, known: tuple[str, ...], default: tuple[str, ...]) -> Column:
    """A comma list of known words as a predicate; none: the default; all: everything."""
    if text is None:
        words = default
    elif text == "all":
        words = known
    else:
        words = tuple(split_terms(text))
        bad = [w for w in words if w not in known]
        if bad:
            raise ValueError(f"unknown {column}: {', '.join(bad)}")
    return F.col(column).isin(*words)


def strict(given: dict, accepted: tuple[str, ...]) -> dict:
    """Refuse parameters that nothing reads."""
    bad = sorted(set(given) - set(accepted))
    if bad:
        raise ValueError(f"unknown parameter {', '.join(bad)}; accepted: {', '.join(accepted)}")
    return given


def day(text: str):
    """A strict YYYY-MM-DD as a date."""
    import datetime

    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        raise ValueError(f"{text!r} is not a date like 2024-01-31")
    return datetime.date.fromisoformat(text)
