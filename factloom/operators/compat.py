"""Whether the records of a compatibility matrix are well formed, and the gate that says so of a whole load.

Answers of such a service are not kept, so values cannot be read again; their shape can be checked, of every record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.identity import part_number_refusal

#: Places where a number is yet unknown: two or more X by themselves.
UNKNOWN_NUMBER = r"(?<![A-Za-z0-9])X{2,}(?:\.X{2,})?(?![A-Za-z0-9])"
ISO_DATE, FLAG, QUERY = "[0-9]{4}-[0-9]{2}-[0-9]{2}", r"(?i)^\s*(?:y|n|yes|no)\s*$", "(?i)^[A-Z0-9-]{3,}$"


def numbers_wrong(numbers: Column, what: str, unknown_allowed: bool = True) -> Column:
    """A problem for each element that is no part number (nor, where that is allowed, a placeholder of one)."""

    def wrong(x: Column) -> Column:
        refused = part_number_refusal(x).isNotNull()
        return refused & ~F.coalesce(x.rlike(UNKNOWN_NUMBER), F.lit(False)) if unknown_allowed else refused

    found = F.filter(F.coalesce(numbers, F.array().cast("array<string>")), wrong)
    return F.transform(found, lambda x: F.concat(F.lit(f'{what} "'), F.coalesce(x, F.lit("")), F.lit('" is no part number')))


def hosts_wrong(addresses: Column, what: str, hosts: tuple[str, ...]) -> Column:
    """A problem for each address that is stated and not on one of the hosts."""
    allowed = "(?i)^https://(?:" + "|".join(h.replace(".", r"\.") for h in hosts) + ")/"
    found = F.filter(F.coalesce(addresses, F.array().cast("array<string>")), lambda a: (a != "") & ~a.rlike(allowed))
    return F.transform(found, lambda a: F.concat(F.lit(f"{what} "), a, F.lit(" is elsewhere")))


def problems(records: DataFrame, hosts: tuple[str, ...]) -> DataFrame:
    """The records with `problems` (distinct and sorted, empty if well formed) and `empty` (a platform without an optic).

    records: type, sku, family_query, datasheet_url, end_of_sale, modules (array of numbers), compatible_optics (array of sku
    and source_url), compat (array of sku, more fields may follow).  A record of any other type is a problem itself; a null
    array is an empty one, and an empty text one that is not stated.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    optics = F.coalesce(F.size("compatible_optics"), F.lit(0)) <= 0
    one = lambda wrong, problem: F.when(wrong, F.array(problem)).otherwise(F.array().cast("array<string>"))
    platform = F.concat(
        one(~text("family_query").rlike(QUERY), F.concat(F.lit('family_query "'), text("family_query"), F.lit('" is no query'))),
        one(optics, F.lit("no compatible optic")),
        numbers_wrong(F.col("compatible_optics.sku"), "optic"),
        hosts_wrong(F.col("compatible_optics.source_url"), "source", hosts),
        numbers_wrong(F.col("modules"), "module", False),
    )
    ends = text("end_of_sale")
    transceiver = F.concat(
        numbers_wrong(F.array("sku"), "sku"),
        hosts_wrong(F.array("datasheet_url"), "datasheet", hosts),
        numbers_wrong(F.col("compat.sku"), "equivalent"),
        one((ends != "") & ~ends.rlike(ISO_DATE) & ~ends.rlike(FLAG), F.concat(F.lit('end_of_sale "'), ends, F.lit('" is neither a date nor a flag'))),
    )
    kind, other = text("type"), F.array(F.concat(F.lit('unknown type "'), text("type"), F.lit('"')))
    found = F.when(kind == "platform-compat", platform).when(kind == "transceiver", transceiver).otherwise(other)
    return records.withColumns({"problems": F.array_sort(F.array_distinct(found)), "empty": (kind == "platform-compat") & optics})


def gate(judged: DataFrame, by: list[str], least: float = 0.98) -> DataFrame:
    """Of each group: checked records, precision (share without a problem), recall (share that is not empty) and verdict: pass
    if precision is at least `least` and no record is empty, else fail.  A load without a record has no row and no pass."""
    n = F.count(F.lit(1))
    out = judged.groupBy(*by).agg(n.alias("checked"), F.round(F.count_if(F.size("problems") == 0) / n, 4).alias("precision"), F.round(F.count_if(~F.col("empty")) / n, 4).alias("recall"), F.count_if("empty").alias("empty"))
    return out.withColumn("verdict", F.when((F.col("precision") >= least) & (F.col("empty") == 0), "pass").otherwise("fail")).drop("empty")


def problem_counts(judged: DataFrame) -> DataFrame:
    """How many records have each kind of problem (what stands between quotes or after the first word left out)."""
    kind = F.regexp_replace(F.regexp_replace("problem", '"(?:[^"]|"(?! is))*"', '""'), r"^(source|datasheet) .* is elsewhere$", "$1 is elsewhere")
    return judged.select(F.explode("problems").alias("problem")).groupBy(kind.alias("problem")).agg(F.count(F.lit(1)).alias("n"))
