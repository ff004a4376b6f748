"""Finder definitions: named selections of parts, checked before they run, and their parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from . import filters, paging, reads

WIDGETS = {"n": ("range",), "nr": ("range",), "b": ("toggle",), "e": ("select", "multi"), "s": ("search", "multi"), "ls": ("multi",)}


@dataclass(frozen=True)
class Facet:
    key: str
    widget: str


@dataclass(frozen=True)
class Tool:
    id: str
    fixed_filter: str = ""
    facets: tuple[Facet, ...] = ()
    columns: tuple[str, ...] = ()
    sort: str | None = None
    examples: tuple[dict, ...] = field(default=())


def problems(tool: Tool, dictionary: dict[str, str], profile: set[str]) -> list[str]:
    """Everything that is wrong with a definition, each in its own words."""
    out = []
    if not tool.id or tool.id != tool.id.lower() or " " in tool.id:
        out.append(f"{tool.id!r} is no identifier")
    try:
        for t in filters.split_terms(tool.fixed_filter):
            term = filters.parse_term(t)
            if term.key not in dictionary:
                out.append(f"fixed filter: unknown field {term.key}")
            else:
                filters.predicate(term, dictionary[term.key])
    except ValueError as e:
        out.append(f"fixed filter: {e}")
    keys = [f.key for f in tool.facets]
    out += [f"facet {k} is there twice" for k in sorted({k for k in keys if keys.count(k) > 1})]
    for f in tool.facets:
        kind = dictionary.get(f.key)
        if kind is None:
            out.append(f"facet: unknown field {f.key}")
        elif kind == "struct":
            out.append(f"facet: {f.key} is a structure")
        elif f.widget not in WIDGETS[kind]:
            out.append(f"facet: {f.key} cannot be a {f.widget}")
        elif f.key not in profile:
            out.append(f"facet: no part of this kind has {f.key}")
    out += [f"column: unknown field {c}" for c in tool.columns if c not in dictionary]
    if len(set(tool.columns)) < len(tool.columns):
        out.append("a column is there twice")
    if tool.sort is not None and dictionary.get(tool.sort) != "n":
        out.append(f"sort: {tool.sort} is not a number")
    for e in tool.examples:
        try:
            parameters(tool, e, dictionary)
        except ValueError as x:
            out.append(f"example: {x}")
    return out


def parameters(tool: Tool, given: dict[str, str | list[str]], dictionary: dict[str, str]) -> str:
    """The filter that a caller's parameters mean: key_min and key_max for ranges, repeats for multi only."""
    known = {f.key: f.widget for f in tool.facets}
    accepted = [x for k, w in known.items() for x in ([f"{k}_min", f"{k}_max"] if w == "range" else [k])]
    filters.strict(given, tuple(accepted))
    terms = []
    for name, value in given.items():
        values = value if isinstance(value, list) else [value]
        if any("," in v for v in values):
            raise ValueError(f"{name}: a value cannot hold a comma")
        key = name if name in known else name.rsplit("_", 1)[0]
        if len(values) > 1 and known[key] != "multi":
            raise ValueError(f"{name} takes one value")
        op = {"range": ">=" if name.endswith("_min") else "<=", "search": "~"}.get(known[key], "=")
        terms += [f"{key}{op}{v}" for v in values]
    for t in terms:
        term = filters.parse_term(t)
        filters.predicate(term, dictionary[term.key])
    return ",".join(terms)


def run(tool: Tool, parts: DataFrame, facts: DataFrame, dictionary: dict[str, str], given: dict | None = None, down: bool = False, limit: int = 50) -> DataFrame:
    """One page of a tool's parts: fixed and given filters, sorted by a number with missing ones last, with one cell for
    each declared column.  The page is cut before the cells are joined."""
    text = ",".join(x for x in (tool.fixed_filter, parameters(tool, given or {}, dictionary)) if x)
    found = filters.filtered(parts.select("part_id"), facts, text, dictionary)
    if tool.sort:
        value = facts.where(F.col("field_key") == tool.sort).select("part_id", F.col("value_num").alias("_v"))
        found = found.join(value, "part_id", "left")
    else:
        found = found.withColumn("_v", F.lit(None).cast("double"))
    page = paging.page(found.select("part_id", paging.missing_last(F.col("_v"), down).alias("sort_value")), [("sort_value", False), ("part_id", False)], limit)
    cells = facts.where(F.col("field_key").isin(*tool.columns)).groupBy("part_id").pivot("field_key", list(tool.columns)).agg(F.first("value_text"))
    return page.join(cells, "part_id", "left").select("part_id", "sort_value", *[F.col(c).alias(f"cell_{c}") for c in tool.columns])


def facets(tool: Tool, parts: DataFrame, facts: DataFrame, dictionary: dict[str, str]) -> DataFrame:
    """Values of the tool's facets within its selection, in declared order; facets nobody has stay, with 0 parts."""
    chosen = filters.filtered(parts.select("part_id"), facts, tool.fixed_filter, dictionary)
    own = facts.join(chosen, "part_id", "left_semi").where(F.col("field_key").isin(*[f.key for f in tool.facets]))
    values = reads.facet_values(own).select("field_key", "value", "parts")
    declared = F.broadcast(facts.sparkSession.createDataFrame([(i, f.key) for i, f in enumerate(tool.facets)], "place int, field_key string"))
    return declared.join(values, "field_key", "left").select("place", "field_key", "value", F.coalesce("parts", F.lit(0)).alias("parts"))
