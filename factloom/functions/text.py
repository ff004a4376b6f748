"""Rules about text: slugs, part numbers, product classes, description quality, image addresses, lists, ports."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def first_of(rules: list[tuple[Column, str]], default: str | None = None) -> Column:
    """The name of the first rule that holds; rules are ordered."""
    head, *rest = rules
    out = reduce(lambda acc, r: acc.when(r[0], r[1]), rest, F.when(head[0], head[1]))
    return out.otherwise(default)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def canonical_json(text: Column) -> Column:
    """JSON with sorted object keys and arrays in their order."""
    return F.to_json(F.parse_json(text))


def part_number_reason(token: Column) -> Column:
    """Why a token is no part number; null if it may be one."""
    t = F.trim(token)
    return first_of(
        [
            (t == "", "empty"),
            (F.length(t) < 4, "too_short"),
            (F.length(t) > 40, "too_long"),
            (t.rlike(r"\s"), "has_space"),
            (~t.rlike(r"^[A-Za-z0-9][A-Za-z0-9+=./#-]*$"), "bad_character"),
            (t.rlike(r"^[0-9]+$"), "digits_only"),
            (~t.rlike(r"[0-9]"), "no_digit"),
            (t.rlike(r"^[0-9.]+(?i:mm|cm|kg|w|v|hz|ghz|gbps|mbps)$"), "measurement"),
            (t.rlike(r"^(?i:v|ver|rev)[0-9.]+$"), "version"),
            (t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "date"),
            (t.rlike(r"^(?i:rfc|ieee|iso|en)-?[0-9.]+[a-z]*$"), "standard"),
        ]
    )


def product_class(sku: Column, name: Column, software_category: Column | None = None) -> Column:
    """hardware, license, service, software, accessory or bundle by ordered rules."""
    s, n = F.upper(F.rtrim(sku, F.lit("="))), F.lower(name)
    rules = [
        (s.rlike("^(L-|LIC-)|-LIC$") | n.rlike(r"\blicen[cs]e\b"), "license"),
        (s.rlike("^(CON-|SVC-)") | n.rlike(r"\b(support|service|warranty)\b"), "service"),
        (s.rlike("-(SW|K9)$") | n.rlike(r"\bsoftware\b"), "software"),
        (n.rlike(r"\b(cable|bracket|rack mount|rail kit|antenna)\b"), "accessory"),
        (s.rlike("-BUN$") | n.rlike(r"\bbundle\b"), "bundle"),
    ]
    if software_category is not None:
        rules.insert(0, (software_category, "software"))
    return first_of(rules, "hardware")


def description_reason(text: Column, sku: Column | None = None) -> Column:
    """Why a text is no description, by ordered rules; null if it may be one."""
    t = F.trim(text)
    folded = F.regexp_replace(F.lower(t), "[^a-z0-9]+", "")
    rules = [
        (text.isNull(), "missing"),
        (t == "", "empty"),
        (F.lower(t).isin("n/a", "na", "none", "null", "-", "tbd", "unknown"), "void_value"),
        (F.length(t) < 6, "too_short"),
        (F.length(t) > 400, "too_long"),
        (t.rlike(r"(.)\1{5,}"), "repeated_filler"),
        (F.size(F.filter(F.split(t, r"[ \t\n\r]+"), lambda w: w.rlike("[A-Za-z]{2,}"))) < 2, "not_prose"),
    ]
    if sku is not None:
        rules.insert(5, (folded == F.regexp_replace(F.lower(sku), "[^a-z0-9]+", ""), "same_as_sku"))
    return first_of(rules)


def url_key(url: Column) -> Column:
    """Host and path in lower case, without scheme, query, rendition segments and repeated segments."""
    rest = F.lower(F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z]+://", ""), r"[?#].*$", ""))
    parts = F.filter(F.split(rest, "/"), lambda p: (p != "") & ~p.rlike(r"^([0-9]+x[0-9]+|w_?[0-9]+|h_?[0-9]+|thumb|small|medium|large)$"))
    once = F.filter(F.transform(parts, lambda p, i: F.when((i > 0) & (p == F.get(parts, i - 1)), F.lit("")).otherwise(p)), lambda p: p != "")
    return F.array_join(once, "/")


def size_hint(url: Column) -> Column:
    """Width that the address itself names, or null."""
    query = F.regexp_extract(url, r"[?&](?:w|width|wid)=([0-9]+)", 1)
    path = F.regexp_extract(url, r"/([0-9]+)x[0-9]+(?:/|$)", 1)
    return F.coalesce(F.nullif(query, F.lit("")), F.nullif(path, F.lit(""))).cast("int")


def same_text(a: Column, b: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(a)), r"\s+", " ") == F.regexp_replace(F.lower(F.trim(b)), r"\s+", " ")


def truncated_prefix(a: Column, b: Column) -> Column:
    """Whether one is the other cut at about 160 characters."""

    def cut(x: Column, y: Column) -> Column:
        head = F.regexp_replace(x, r"\s*\S+$", "")
        return F.length(x).between(158, 160) & (F.length(head) >= 96) & F.startswith(y, head)

    return cut(a, b) | cut(b, a)


def same_value(num_a: Column, num_b: Column, text_a: Column, text_b: Column, unit: Column | None = None) -> Column:
    """Which rule makes two readings agree: exact, numeric_tolerance (2 % where a unit without zero point is known),
    prefix_truncated; null if none does."""
    close = F.abs(num_a - num_b) <= 1e-6
    tolerant = F.lit(False)
    if unit is not None:
        tolerant = unit.isNotNull() & ~unit.isin("°C", "°F", "dBm", "dB") & (F.abs(num_a - num_b) <= 0.02 * F.greatest(F.abs(num_a), F.abs(num_b)))
    return first_of([(F.coalesce(close, text_a == text_b, F.lit(False)), "exact"), (F.coalesce(tolerant, F.lit(False)), "numeric_tolerance"), (F.coalesce(truncated_prefix(text_a, text_b), F.lit(False)), "prefix_truncated")])


OPEN, CLOSE = "([{", ")]}"


def split_items(text: str | None) -> list[str]:
    """Items of a list in text: bullets and newlines if there are several, else commas, semicolons and `and` that are
    outside brackets; a comma between digits does not split."""
    if not text:
        return []
    rows = [x.strip(" \t\r-*•·") for x in re.split(r"[\n•·]", text)]
    rows = [x for x in rows if x]
    if len(rows) > 1:
        return rows
    out, depth, begin = [], 0, 0
    i = 0
    while i < len(text):
        c = text[i]
        if c in OPEN:
            depth += 1
        elif c in CLOSE:
            depth = max(0, depth - 1)
        elif not depth:
            m = re.match(r";|,(?![0-9]{3}\b)|\s(?:and|und)\s", text[i:])
            if m:
                out.append(text[begin:i])
                i += m.end()
                begin = i
                continue
        i += 1
    out.append(text[begin:])
    return [x.strip() for x in out if x.strip()]


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_list(text: pd.Series) -> pd.Series:
    return text.map(split_items)


PORT = re.compile(r"(?P<n>\d+)\s*x?\s*(?P<speed>(?:\d+(?:\.\d+)?/)*\d+(?:\.\d+)?\s*[GMT]b?(?:E|ps|ASE-T)?)?\s*(?P<kind>RJ-?45|SFP28|SFP\+|SFP|QSFP28|QSFP\+|QSFP|USB|console)", re.I)


def ports_of(text: str | None) -> list[dict]:
    """Ports named in a text as {typ, speed, n}; texts with anything that looks like a port but is not read give none."""
    out: dict[tuple, int] = {}
    for segment in split_items(text):
        m = PORT.search(segment)
        if not m:
            if re.search(r"\b(port|slot)s?\b", segment, re.I):
                return []
            continue
        kind = m["kind"].upper().replace("-", "")
        speed = re.sub(r"\s|bps|ps|ASE-T|(?<=[GMT])[bB]?E?", "", m["speed"] or "").upper()
        out.setdefault((kind, speed), int(m["n"]))
    return [{"typ": k, "speed": s, "n": n} for (k, s), n in out.items()]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("typ", T.StringType()), T.StructField("speed", T.StringType()), T.StructField("n", T.IntegerType())])))
def parse_ports(text: pd.Series) -> pd.Series:
    return text.map(ports_of)


def pattern_verdicts(corpus, patterns: list[tuple[str, str]], least: int = 3):
    """Of each named pattern how many rows of corpus(text) it matches, and whether that is enough."""
    counts = corpus.agg(*[F.count_if(F.col("text").rlike(p)).alias(n) for n, p in patterns])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("matches")) for n, _ in patterns])).alias("x")).select("x.*")
    return rows.withColumn("accepted", F.col("matches") >= least)
