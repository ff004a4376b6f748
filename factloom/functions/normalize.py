"""Typed values of fields out of raw text: units by dimension, hints from labels, and the reason where there is no value."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from . import numbers
from .identity import part_number_refusal
from .text import first_of, split_list

# Units in lower case by dimension, with their factors to the dimension's base.
UNITS = {
    "throughput": {"bit/s": 1, "bps": 1, "kbit/s": 1e3, "kbps": 1e3, "mbit/s": 1e6, "mbps": 1e6, "mb/s": 1e6, "gbit/s": 1e9, "gbps": 1e9, "gb/s": 1e9, "tbit/s": 1e12, "tbps": 1e12},
    "packetrate": {"pps": 1, "kpps": 1e3, "mpps": 1e6, "bpps": 1e9},
    "power": {"w": 1, "watt": 1, "watts": 1, "kw": 1e3, "kilowatt": 1e3, "kilowatts": 1e3, "mw": 1e-3},
    "apparentpower": {"va": 1, "kva": 1e3},
    "freq": {"hz": 1, "khz": 1e3, "mhz": 1e6, "ghz": 1e9, "thz": 1e12},
    "current": {"a": 1, "ma": 1e-3, "amp": 1, "amps": 1, "ka": 1e3},
    "transferrate": {"mt/s": 1e6, "gt/s": 1e9},
    "mass": {"gram": 1, "grams": 1, "kg": 1e3, "kilogram": 1e3, "kilograms": 1e3, "lb": 453.59237, "lbs": 453.59237, "pound": 453.59237, "pounds": 453.59237, "oz": 28.349523125, "ounce": 28.349523125, "ounces": 28.349523125},
    "length": {
        "nm": 1e-9, "mm": 1e-3, "millimeter": 1e-3, "millimeters": 1e-3, "cm": 1e-2, "centimeter": 1e-2, "centimeters": 1e-2, "metre": 1, "metres": 1, "meter": 1, "meters": 1, "km": 1e3, "kilometer": 1e3, "kilometers": 1e3,
        "in": 0.0254, "inch": 0.0254, "inches": 0.0254, '"': 0.0254, "”": 0.0254, "″": 0.0254, "ft": 0.3048, "feet": 0.3048, "foot": 0.3048,
    },
    "memory": {"b": 1, "byte": 1, "bytes": 1, "kb": 1024, "mb": 1048576, "gb": 1073741824, "tb": 1099511627776},
    "duration": {"ps": 1e-12, "ns": 1e-9, "µs": 1e-6, "us": 1e-6, "ms": 1e-3, "s": 1, "sek": 1, "h": 3600, "hr": 3600, "hrs": 3600, "hours": 3600, "std": 3600, "stunde": 3600, "stunden": 3600},
    "tempC": {"°c": 1, "celsius": 1},
    "tempF": {"°f": 1, "fahrenheit": 1},
    "percent": {"%": 1},
    "voltage": {"v": 1, "vac": 1, "vdc": 1, "kv": 1e3, "mv": 1e-3},
    "heat": {"btu": 1, "btu/h": 1, "btu/hr": 1, "btuh": 1, "btu/hour": 1},
    "db": {"db": 1}, "dba": {"db(a)": 1, "dba": 1}, "dbm": {"dbm": 1}, "dbi": {"dbi": 1}, "dbmv": {"dbmv": 1},
    "awg": {"awg": 1}, "ru": {"he": 1, "ru": 1, "u": 1}, "count": {"einträge": 1, "eintraege": 1, "entries": 1},
    "iops": {"iops": 1, "kiops": 1e3}, "resistance": {"ohm": 1, "ohms": 1, "kohm": 1e3}, "illuminance": {"lux": 1, "lx": 1}, "dispersion": {"ps/nm": 1},
    "angle": {"deg": 1, "degree": 1, "degrees": 1, "°": 1}, "grms": {"grms": 1}, "responsivity": {"v/mw": 1}, "noisedensity": {"pa/√hz": 1},
    "speed": {"km/h": 1, "kmh": 1, "kph": 1, "mph": 1.609344}, "persecond": {"cps": 1, "1/s": 1, "/s": 1}, "years": {"year": 1, "years": 1, "jahre": 1},
}
# Spellings of which only the case tells bits from bytes.
EXACT = {
    "byterate": {"B/s": 1, "Bps": 1, "Byte/s": 1, "kB/s": 1e3, "KB/s": 1e3, "kBps": 1e3, "KBps": 1e3, "MB/s": 1e6, "MBps": 1e6, "MByte/s": 1e6, "GB/s": 1e9, "GBps": 1e9, "GByte/s": 1e9, "TB/s": 1e12, "TBps": 1e12},
    "throughput": {"b/s": 1, "bps": 1, "kb/s": 1e3, "kbps": 1e3, "Mb/s": 1e6, "Mbps": 1e6, "Gb/s": 1e9, "Gbps": 1e9, "Tb/s": 1e12, "Tbps": 1e12},
}
# What a letter means where a dimension is expected.
LETTERS = {("g", "mass"): ("mass", 1), ("g", "throughput"): ("throughput", 1e9), ("m", "length"): ("length", 1), ("c", "tempC"): ("tempC", 1), ("f", "tempC"): ("tempF", 1), ("x", "zoom"): ("zoom", 1)}
# Canonical units that no table above spells so, and those that are words for counts.
CANONICAL = {"GB": ("memory", 1073741824), "MB": ("memory", 1048576), "TB": ("memory", 1099511627776), "m": ("length", 1), "g": ("mass", 1), "x": ("zoom", 1), "HE": ("ru", 1), "MB/s": ("byterate", 1e6)}
COUNTS = ("Einträge", "entries", "count", "Sessions", "Sitzungen", "Peers", "CPUs", "GPUs", "cores", "threads", "sockets", "ranks", "bays", "slots", "ports", "lines", "devices", "endpoints", "f-stop", "HE", "Byte", "AWG")
# Decimals kept, where not six.
DECIMALS = {"°C": 1}
# Units that labels name, the first that fits counts.
LABEL_UNITS = [
    (r"\bhours?\b|\(h\)", "h"), (r"\bkilograms?\b|\bkg\b", "kg"), (r"\bpounds?\b|\blbs?\b", "lb"), (r"centimet|\bcm\b", "cm"), (r"\binch(es)?\b", "in"), (r"P\(W\)|\bwatts?\b|\(W\)", "W"), ("BTU", "BTU/h"), (r"dB\(A\)", "dB(A)"), (r"\bMpps\b", "Mpps"),
    (r"\bGbps\b|\bGbit", "Gbit/s"), (r"\(\s*MT\s*/\s*s\s*\)", "MT/s"), (r"\(\s*GHz\s*\)", "GHz"), (r"\(\s*MHz\s*\)", "MHz"), (r"\(\s*GB\s*\)", "GB"), (r"\(\s*TB\s*\)", "TB"), (r"\(\s*MB\s*\)", "MB"), (r"\(\s*VA\s*\)", "VA"),
    (r"\(\s*V(\s*(rms|dc|ac))?\s*\)", "V"), (r"\(\s*A(\s*(rms|peak|dc|ac))?\s*\)", "A"), (r"\(\s*Hz\s*\)", "Hz"), (r"\(\s*ms\s*\)", "ms"), (r"\(\s*mm\s*\)", "mm"), (r"\bconnections?\s+per\s+second\b|\bconnections?\s*/\s*se?c\b|\(\s*CPS\s*\)", "1/s"),
]
# Words that say yes and no.
YES = r"(?i)^\s*(ja|yes|true|vorhanden|unterst(ü|ue)tzt|supported|standard|✓|x)\b"
NO = r"(?i)^\s*(nein|no|false|nicht|kein|keine|ohne|n/a|-)\b"

NUMBER = r"[-+−–]?[0-9][0-9.,]*"
TOKEN = r"[A-Za-zµ°%/()√\"”″]*"


@dataclass(frozen=True)
class Field:
    """kind: n, nr, b, e, s or ls; unit: canonical; band: plausible values; choices: (pattern, slug) in order; hint: what says yes."""

    key: str
    kind: str
    unit: str | None = None
    band: tuple[float, float] | None = None
    choices: tuple[tuple[str, str], ...] = ()
    domain: tuple[str, ...] = ()
    hint: str | None = None


def canonical(unit: str) -> tuple[str, float] | None:
    if unit in CANONICAL:
        return CANONICAL[unit]
    return next(((d, t[unit.lower()]) for d, t in UNITS.items() if unit.lower() in t), None)


def of_table(table: dict[str, dict[str, float]], token: Column) -> Column:
    """A unit's struct(dimension, factor); the table is one literal, which is folded into a constant once."""
    rows = {u: {"dimension": d, "factor": float(f)} for d, t in table.items() for u, f in t.items()}
    return F.try_element_at(F.from_json(F.lit(json.dumps(rows)), "map<string, struct<dimension: string, factor: double>>"), token)


def unit_of(token: Column, expected: str | None) -> Column:
    """struct(dimension, factor) of a unit: exact spelling, then a letter where its dimension is expected, then any case; one
    slash at the end does not count."""
    t = F.regexp_replace(token, r"\s+", "")
    low = F.lower(t)
    letters = [(k, v) for (k, d), v in LETTERS.items() if d == expected]
    out = of_table(UNITS, F.when(F.length(low) > 1, F.regexp_replace(low, "/$", "")).otherwise(low))  # no unit ends in a slash
    alone = low.isin("g", "m", "c", "f", "x")
    meant = F.lit(None).cast("struct<dimension:string,factor:double>")
    for k, (d, f) in letters:
        meant = F.when(low == k, F.struct(F.lit(d).alias("dimension"), F.lit(float(f)).alias("factor"))).otherwise(meant)
    return F.coalesce(of_table(EXACT, t), F.when(alone, meant).otherwise(out))


def magnitude(token: Column) -> Column:
    return F.when(token.isin("k", "K") | (F.lower(token) == "thousand"), 1e3).when((token == "M") | F.lower(token).isin("million", "millions"), 1e6)


def label_unit(label: Column) -> Column:
    return first_of([(label.rlike(f"(?i){p}"), u) for p, u in LABEL_UNITS])


def is_heading(label: Column, value: Column) -> Column:
    """Whether a value repeats its label, as a heading does."""
    folded = [F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]", "") for x in (label, value)]
    return (F.length(folded[0]) > 2) & (folded[0] == folded[1])


def plain(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), "[\u00a0\u2007\u202f]", " "), "[º˚]", "°")


def prepared(raw: Column, key: str) -> Column:
    """The text that counts: plain spaces and degree signs, the loudest of several levels, the watts of a budget, the metric
    value in brackets behind an imperial one."""
    def watts(s: Column) -> Column:
        return numbers.let(F.regexp_extract(s, r"(?i)([0-9][0-9.,]*)\s*W\b", 1), lambda w: F.when(w != "", F.concat(w, F.lit(" W"))).otherwise(s))

    def loudest(s: Column) -> Column:
        levels = F.transform(F.regexp_extract_all(s, F.lit(r"(?i)([0-9][0-9.,]*)\s*dB\s*\(?A\)?"), 1), lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double"))
        return numbers.let(F.array_max(levels), lambda x: F.when(x.isNotNull(), F.concat(x.cast("string"), F.lit(" dB(A)"))).otherwise(s))

    def metric(s: Column) -> Column:
        outside = F.regexp_replace(s, r"\([^()]*\)", " ")
        imperial = numbers.let(outside, lambda x: x.rlike(r"(?i)[0-9]\s*(?:in\b|inch|ft\b|feet|lbs?\b|pounds?|oz\b|°\s*F)") & ~x.rlike(r"(?i)[0-9]\s*(?:mm|cm|m|kg|g|°\s*C)\b"))
        inside = F.regexp_extract(s, r"(?i)\(([^()]*[0-9]\s*(?:mm|cm|m|km|kg|g|°\s*C)\b[^()]*)\)", 1)
        return numbers.let(inside, lambda x: F.trim(F.when((x != "") & imperial, x).otherwise(s)))

    out = plain(raw)
    for key_of, step in (("poe_budget", watts), ("acoustic_noise", loudest)):
        out = numbers.let(out, step) if key == key_of else out
    return numbers.let(out, metric)


def converted(number: Column, token: Column, hint: Column, field: Field) -> Column:
    """struct(value, reason) of a number and its unit in the field's unit."""
    target = canonical(field.unit) if field.unit else None
    counts = field.unit is None or field.unit in COUNTS
    bare = token == ""
    times = magnitude(token)
    if counts:
        own = unit_of(token, target[0] if target else None)
        noun = F.lit(False) if field.unit is None else F.regexp_replace(F.lower(token), "s$", "") == field.unit.lower().removesuffix("s")
        dimension = own["dimension"]
        physical = numbers.let(dimension, lambda x: x.isNotNull() & (x != "count") & (F.lit(True) if target is None else x != target[0]))
        value = F.when(bare | noun, number).when(times.isNotNull(), F.round(number * times, 6)).when(~physical, number)
        return numbers.let(value, lambda v: F.struct(v.alias("value"), F.when(v.isNull(), "UNIT_UNKNOWN").alias("reason")))
    digits = DECIMALS.get(field.unit, 6)

    def in_unit(used: Column) -> Column:
        affine = (used["dimension"] == "tempF") & (target[0] == "tempC")
        return F.when(affine, F.round((number * used["factor"] - 32) * 5 / 9, digits)).when(used["dimension"] == target[0], F.round(number * used["factor"] / target[1], digits))

    value = numbers.let(unit_of(F.when(bare, F.coalesce(hint, F.lit(""))).otherwise(token), target[0]), in_unit)
    missing = bare & hint.isNull()
    return numbers.let(value, lambda v: F.struct(F.when(~missing, v).alias("value"), F.when(missing, "UNIT_MISSING").when(v.isNull(), "UNIT_UNKNOWN").alias("reason")))


def outside_band(value: Column, field: Field) -> Column:
    return F.lit(False) if field.band is None else ~value.between(*field.band)


def result(reason: Column, **values: Column) -> Column:
    kinds = {"num": "double", "low": "double", "high": "double", "flag": "boolean", "text": "string", "items": "array<string>"}
    return numbers.let(reason, lambda r: F.struct(r.isNull().alias("ok"), *[F.when(r.isNull(), values[k]).cast(t).alias(k) if k in values else F.lit(None).cast(t).alias(k) for k, t in kinds.items()], r.alias("reason")))


def read_number(s: Column, pattern: str, number: int, unit: int, locale: str) -> Column:
    """struct(n, unit) of a pattern's groups."""
    n = numbers.parse_number(F.nullif(F.regexp_extract(s, pattern, number), F.lit("")), locale)
    return F.struct(n.alias("n"), F.trim(F.regexp_extract(s, pattern, unit)).alias("unit"))


def number_field(s: Column, hint: Column, field: Field, locale: str) -> Column:
    hit = read_number(s, f"({NUMBER})\\s*({TOKEN})", 1, 2, locale)
    if field.key.endswith("_max") or field.key == "heat_dissipation":
        span = f"^\\s*({NUMBER})\\s*({TOKEN})\\s*(?:bis|to|–|—|-|/)\\s*({NUMBER})\\s*({TOKEN})\\s*(?:\\([^()]*\\))?\\s*$"

        def high_end(x: Column) -> Column:
            one_unit = (x["a"]["unit"] == "") | (x["b"]["unit"] == "") | (F.lower(x["a"]["unit"]) == F.lower(x["b"]["unit"]))
            top = F.struct(F.greatest(x["a"]["n"], x["b"]["n"]).alias("n"), F.coalesce(F.nullif(x["b"]["unit"], F.lit("")), x["a"]["unit"]).alias("unit"))
            return F.when(one_unit, top)

        ends = F.struct(read_number(s, span, 1, 2, locale).alias("a"), read_number(s, span, 3, 4, locale).alias("b"))
        hit = F.coalesce(F.when(s.rlike(span), numbers.let(ends, high_end)), hit)

    def judged(x: Column, c: Column) -> Column:
        reason = F.when(x["n"].isNull(), "PARSE_FAIL").when(c["reason"].isNotNull(), c["reason"]).when(outside_band(c["value"], field), "RANGE_VIOLATION")
        return result(reason, num=c["value"])

    return numbers.let(hit, lambda x: numbers.let(converted(x["n"], x["unit"], hint, field), lambda c: judged(x, c)))


def range_field(s: Column, hint: Column, field: Field, locale: str) -> Column:
    pattern = f"(?i)({NUMBER})\\s*({TOKEN})\\s*(?:to|bis|\\.\\.\\.|…|–|—|~|-)\\s*({NUMBER})\\s*({TOKEN})"
    single = read_number(s, f"({NUMBER})\\s*({TOKEN})", 1, 2, locale)
    ends = F.struct(read_number(s, pattern, 1, 2, locale).alias("a"), read_number(s, pattern, 3, 4, locale).alias("b"))
    ends = F.when(s.rlike(pattern), ends).otherwise(numbers.let(single, lambda x: F.struct(x.alias("a"), x.alias("b"))))

    def judged(x: Column) -> Column:
        unit = F.coalesce(F.nullif(x["b"]["unit"], F.lit("")), x["a"]["unit"])
        both = F.struct(converted(x["a"]["n"], unit, hint, field).alias("a"), converted(x["b"]["n"], unit, hint, field).alias("b"))
        unread = x["a"]["n"].isNull() | x["b"]["n"].isNull()
        return numbers.let(both, lambda c: verdict(unread, c["a"], c["b"]))

    def verdict(unread: Column, a: Column, b: Column) -> Column:
        reason = F.when(unread, "PARSE_FAIL").when(a["reason"].isNotNull(), a["reason"]).when(a["value"] > b["value"], "PARSE_FAIL").when(outside_band(a["value"], field) | outside_band(b["value"], field), "RANGE_VIOLATION")
        return result(reason, low=a["value"], high=b["value"])

    return numbers.let(ends, judged)


def choice_field(s: Column, field: Field) -> Column:
    mapped = first_of([(s.rlike(f"(?i){p}"), v) for p, v in field.choices]) if field.choices else F.lit(None).cast("string")
    direct = F.regexp_replace(F.lower(s), r"\s+", "-")
    value = F.coalesce(mapped, direct)
    return result(F.when(~value.isin(*field.domain), "ENUM_VIOLATION"), text=value)


def flag_field(s: Column, field: Field) -> Column:
    value = F.when(s.rlike(NO), False).when(s.rlike(YES) | (s.rlike(f"(?i){field.hint}") if field.hint else F.lit(False)), True)
    return result(F.when(value.isNull(), "PARSE_FAIL"), flag=value)


def normalized(raw: Column, label: Column, field: Field, locale: str = "en") -> Column:
    """struct(ok, num, low, high, flag, text, items, reason) of a raw text as the field's type; the unit of a label counts
    where the text has none."""
    if field.kind == "ls":  # not inside a lambda: splitting a list is a Python function
        items = split_list(plain(raw))
        reason = F.when(F.size(items) == 0, "PARSE_FAIL")
        none = [F.lit(None).cast(t).alias(k) for k, t in (("num", "double"), ("low", "double"), ("high", "double"), ("flag", "boolean"), ("text", "string"))]
        return F.struct(reason.isNull().alias("ok"), *none, F.when(reason.isNull(), items).alias("items"), reason.alias("reason"))
    types = {"n": number_field, "nr": range_field}

    def read(s: Column, hint: Column) -> Column:
        if field.kind not in types:
            value = {"b": lambda: flag_field(s, field), "e": lambda: choice_field(s, field), "s": lambda: result(F.lit(None).cast("string"), text=s)}[field.kind]()
            return numbers.let(value, lambda r: final(s, F.lit(False), r))
        pid = s.rlike("[A-Za-z]") & part_number_refusal(s).isNull()
        return numbers.let(pid, lambda p: numbers.let(types[field.kind](s, F.when(~p, hint), field, locale), lambda r: final(s, p, r)))

    def final(s: Column, pid: Column, r: Column) -> Column:
        reason = F.when(s == "", "PARSE_FAIL").when(pid & r["reason"].isNotNull(), "VALUE_IS_PID").otherwise(r["reason"])
        return numbers.let(reason, lambda x: F.struct(x.isNull().alias("ok"), *[F.when(x.isNull(), r[k]).alias(k) for k in ("num", "low", "high", "flag", "text", "items")], x.alias("reason")))

    return numbers.let(F.struct(prepared(raw, field.key).alias("s"), label_unit(label).alias("hint")), lambda x: read(x["s"], x["hint"]))


def ordered_axes(label: Column, h: Column, w: Column, d: Column) -> Column:
    """Height, width and depth of three values in the order that a label such as (W x D x H) names."""
    axes = [F.lower(F.regexp_extract(label, r"(?i)\(\s*([HWD])\s*[x×]\s*([HWD])\s*[x×]\s*([HWD])\s*\)", i)) for i in (1, 2, 3)]
    values = (h, w, d)

    def axis(name: str, default: Column) -> Column:
        return F.when(axes[0] == "", default).when(axes[0] == name, values[0]).when(axes[1] == name, values[1]).when(axes[2] == name, values[2])

    return F.struct(axis("h", h).alias("h"), axis("w", w).alias("w"), axis("d", d).alias("d"))
