"""Numbers with units out of text, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

#: unit: (dimension, factor to the dimension's base).  Exact spelling first, for bits and bytes; then lower case.
EXACT = {"Gb": ("rate", 1e9), "GB": ("bytes", 1e9), "Mb": ("rate", 1e6), "MB": ("bytes", 1e6), "KB": ("bytes", 1e3), "Kb": ("rate", 1e3), "B": ("bytes", 1.0)}
UNITS = {
    "mm": ("length", 1e-3), "cm": ("length", 1e-2), "m": ("length", 1.0), "km": ("length", 1e3), "in": ("length", 0.0254), "inch": ("length", 0.0254), "ft": ("length", 0.3048),
    "g": ("mass", 1e-3), "kg": ("mass", 1.0), "lb": ("mass", 0.45359237), "lbs": ("mass", 0.45359237), "oz": ("mass", 0.028349523125),
    "w": ("power", 1.0), "kw": ("power", 1e3), "mw": ("power", 1e-3), "v": ("voltage", 1.0), "kv": ("voltage", 1e3), "a": ("current", 1.0), "ma": ("current", 1e-3),
    "hz": ("frequency", 1.0), "khz": ("frequency", 1e3), "mhz": ("frequency", 1e6), "ghz": ("frequency", 1e9),
    "bps": ("rate", 1.0), "kbps": ("rate", 1e3), "mbps": ("rate", 1e6), "gbps": ("rate", 1e9), "tbps": ("rate", 1e12),
    "kib": ("bytes", 1024.0), "mib": ("bytes", 1048576.0), "gib": ("bytes", 1073741824.0),
    "ms": ("time", 1e-3), "s": ("time", 1.0), "sec": ("time", 1.0), "min": ("time", 60.0), "h": ("time", 3600.0),
    "db": ("level", 1.0), "dbm": ("level_mw", 1.0), "°c": ("temperature", 1.0), "°f": ("temperature_f", 1.0), "c": ("temperature", 1.0), "f": ("temperature_f", 1.0),
}
NUMBER = r"[-+]?[0-9][0-9.,]*"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value computed once, however often `then` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def signed(text: Column) -> Column:
    """Typographic minus signs before a digit become hyphens."""
    return F.regexp_replace(text, "^\\s*[−–‒](?=[0-9])", "-")


def parse_number(text: Column, locale: str = "en") -> Column:
    """A number of the locale, or null.

    en: commas group thousands; de: a comma is the decimal sign, and dots before three digits group.  Where both occur
    the last is the decimal sign; two or more commas always group.
    """
    return let(F.trim(signed(text)), lambda t: parsed(t, locale))


def parsed(t: Column, locale: str) -> Column:
    commas = F.length(t) - F.length(F.replace(t, F.lit(","), F.lit("")))
    dots = F.length(t) - F.length(F.replace(t, F.lit("."), F.lit("")))
    last_comma = F.length(t) - F.instr(F.reverse(t), ",") + 1
    last_dot = F.length(t) - F.instr(F.reverse(t), ".") + 1
    no_commas = F.replace(t, F.lit(","), F.lit(""))
    no_dots = F.replace(t, F.lit("."), F.lit(""))
    comma_decimal = F.replace(no_dots, F.lit(","), F.lit("."))
    if locale == "de":
        alone = F.when(commas == 1, comma_decimal).when(commas > 1, no_commas).when(t.rlike(r"^[-+]?[0-9]{1,3}(\.[0-9]{3})+$"), no_dots).otherwise(t)
    else:
        alone = F.when(dots > 1, no_dots).otherwise(no_commas)
    both = F.when(commas > 1, no_commas).when(last_comma > last_dot, comma_decimal).otherwise(no_commas)
    return F.when((commas > 0) & (dots > 0), both).otherwise(alone).try_cast("double")


def lookup(table: dict[str, tuple[str, float]], key: Column, i: int) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v[i]))]
    return F.try_element_at(F.create_map(*pairs), key)


def unit(token: Column, i: int) -> Column:
    return F.coalesce(lookup(EXACT, token, i), lookup(UNITS, F.lower(token), i))


def quantity(text: Column, locale: str = "en") -> Column:
    """The first number with its unit: struct(number, unit, dimension, base_value); parts that are not there are null."""
    number = parse_number(F.nullif(F.regexp_extract(signed(text), f"({NUMBER})", 1), F.lit("")), locale)
    token = F.nullif(F.regexp_extract(text, f"{NUMBER}\\s*([A-Za-z°]+)", 1), F.lit(""))

    def read(q: Column) -> Column:
        degrees_f = q["dimension"] == "temperature_f"
        base = F.when(degrees_f, F.round((q["number"] - 32) * 5 / 9, 1)).otherwise(F.round(q["number"] * q["factor"], 6))
        return F.struct(q["number"].alias("number"), q["unit"].alias("unit"), F.when(degrees_f, "temperature").otherwise(q["dimension"]).alias("dimension"), base.alias("base_value"))

    return let(F.struct(number.alias("number"), token.alias("unit"), unit(token, 0).alias("dimension"), unit(token, 1).alias("factor")), read)


def convert(text: Column, to: str, locale: str = "en") -> Column:
    """struct(ok, value, reason) of a quantity in the unit `to`: PARSE_FAIL, UNIT_MISSING or UNIT_UNKNOWN otherwise."""
    dimension, factor = EXACT.get(to) or UNITS[to.lower()]

    def read(q: Column) -> Column:
        reason = F.when(q["number"].isNull(), "PARSE_FAIL").when(q["unit"].isNull(), "UNIT_MISSING").when(q["dimension"].isNull() | (q["dimension"] != dimension), "UNIT_UNKNOWN")
        return F.struct(reason.isNull().alias("ok"), F.when(reason.isNull(), F.round(q["base_value"] / factor, 6)).alias("value"), reason.alias("reason"))

    return let(quantity(text, locale), read)


def in_band(value: Column, low: float, high: float) -> Column:
    return F.when(~value.between(low, high), "RANGE_VIOLATION")


def count_value(text: Column) -> Column:
    """Counts with magnitudes: 16k, 2 million; null for anything with a physical unit."""
    number = parse_number(F.nullif(F.regexp_extract(text, f"({NUMBER})", 1), F.lit("")))
    word = F.lower(F.regexp_extract(text, f"{NUMBER}\\s*([A-Za-z]*)", 1))
    factor = F.when(word.isin("", "entries", "ports", "users", "sessions"), 1.0).when(word.isin("k", "thousand"), 1e3).when(word.isin("m", "million"), 1e6)
    return F.round(number * factor, 6)


def boolean(text: Column) -> Column:
    """Negative words first, then positive ones, else null."""
    t = F.lower(text)
    return F.when(t.rlike(r"\b(no|not|none|without|false|n/a|nein)\b"), False).when(t.rlike(r"\b(yes|true|supported|included|with|ja)\b"), True)


def choice(text: Column, rules: list[tuple[str, str]], domain: tuple[str, ...]) -> Column:
    """The slug of the first rule that matches; else the text's own slug where the domain has it."""
    t = F.lower(F.trim(text))
    slug = F.regexp_replace(F.regexp_replace(t, "[^a-z0-9]+", "-"), "^-|-$", "")
    rule = reduce(lambda acc, r: acc.when(t.rlike(r[0]), r[1]), rules[1:], F.when(t.rlike(rules[0][0]), rules[0][1])) if rules else F.lit(None)
    return F.coalesce(rule, F.when(slug.isin(*domain), slug))


def number_range(text: Column, locale: str = "en") -> Column:
    """struct(low, high) of `a to b`, `a - b` or a single number; null where low is over high."""
    parts = F.regexp_extract_all(text, F.lit(r"((?<![0-9])[-+]?[0-9][0-9.,]*)"), 1)
    low = parse_number(F.try_element_at(parts, F.lit(1)), locale)
    high = F.coalesce(parse_number(F.try_element_at(parts, F.lit(2)), locale), low)
    return F.when(low <= high, F.struct(low.alias("low"), high.alias("high")))


def dimensions(text: Column) -> Column:
    """struct(h, w, d) in mm of `a x b x c unit`; the one unit counts for all axes."""
    sep = r"\s*(?:[A-Za-z.]+)?\s*[x×]\s*"
    pattern = f"({NUMBER}){sep}({NUMBER}){sep}({NUMBER})\\s*([A-Za-z]+)"
    factor = lookup(UNITS, F.lower(F.regexp_extract(text, pattern, 4)), 1) * 1000
    axes = [F.round(parse_number(F.regexp_extract(text, pattern, i)) * factor, 6) for i in (1, 2, 3)]
    return F.when(text.rlike(pattern), F.struct(*[a.alias(n) for a, n in zip(axes, "hwd", strict=True)]))
