"""Normalised fields out of raw texts made from the part table, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import normalize as n
from ..operators import labels
from ..sources.tables import load
from .queries import query

FIELDS = {
    f.key: f
    for f in (
        n.Field("power_max", "n", "W", (0, 50_000)),
        n.Field("temp_operating", "nr", "°C", (-80, 150)),
        n.Field("weight", "n", "kg"),
        n.Field("throughput", "n", "Gbit/s"),
        n.Field("users", "n"),
        n.Field("slots", "n", "slots"),
        n.Field("stackable", "b", hint="stackwise|stacking"),
        n.Field("layer", "e", choices=((r"l2\+|layer\s*2\+", "l2plus"), (r"l3|layer\s*3", "l3"), (r"l2|layer\s*2", "l2")), domain=("l2", "l2plus", "l3")),
        n.Field("mtbf", "n", "h"),
        n.Field("acoustic_noise", "n", "dB(A)"),
        n.Field("memory", "n", "GB"),
        n.Field("protocols", "ls"),
        n.Field("note", "s"),
    )
}
#: field, label, text before and after the size (or another number), and what comes out in SQL: value, second value, reason.
CASES = [
    ("power_max", "Power", "", "-{s5} W", "s + 5", None, None),
    ("power_max", "Max power (W)", "", "", "s", None, None),
    ("power_max", "Power", "", " kg", None, None, "UNIT_UNKNOWN"),
    ("power_max", "Power", "", "", None, None, "UNIT_MISSING"),
    ("power_max", "Power", "", "00000 W", None, None, "RANGE_VIOLATION"),
    ("power_max", "Power (W)", "ABC-1", "", None, None, "VALUE_IS_PID"),
    ("power_max", "Power", "up to ", " kW", "CASE WHEN s * 1000 <= 50000 THEN s * 1000 END", None, "CASE WHEN s * 1000 > 50000 THEN 'RANGE_VIOLATION' END"),
    ("temp_operating", "Temp", "", "°F to {s5}°F", "round((s - 32) * 5 / 9, 1)", "round((s + 5 - 32) * 5 / 9, 1)", None),
    ("temp_operating", "Temp", "9", " to {s5} °C", None, None, "PARSE_FAIL"),
    ("temp_operating", "Temp", "", " °C", "s", "s", None),
    ("weight", "Weight", "2.2 lb (", " kg)", "s", None, None),
    ("weight", "Weight", "", " g", "s / 1000", None, None),
    ("weight", "Weight [kg]", "", "", "s", None, None),
    ("throughput", "Rate", "", " G", "s", None, None),
    ("throughput", "Rate", "", " MB/s", None, None, "UNIT_UNKNOWN"),
    ("throughput", "Rate", "", " Mb/s", "s / 1000", None, None),
    ("throughput", "Rate (hours)", "", "", None, None, "UNIT_UNKNOWN"),
    ("users", "Users", "", "k", "s * 1000", None, None),
    ("users", "Users", "", " W", None, None, "UNIT_UNKNOWN"),
    ("users", "Users", "", " million", "s * 1000000", None, None),
    ("slots", "Slots", "", " slot", "s", None, None),
    ("stackable", "Stack", "No, ", "", "0", None, None),
    ("stackable", "Stack", "StackWise-", "", "1", None, None),
    ("stackable", "Stack", "maybe ", "", None, None, "PARSE_FAIL"),
    ("layer", "Layer", "L2+ ", "", "2.5", None, None),
    ("layer", "Layer", "none ", "", None, None, "ENUM_VIOLATION"),
    ("mtbf", "MTBF (hours)", "", ",000", "s * 1000", None, None),
    ("acoustic_noise", "Noise", "", " dB(A) / {s5} dB(A)", "s + 5", None, None),
    ("memory", "Memory", "", " GB/16 GB", "s", None, None),
    ("protocols", "Protocols", "OSPF, BGP; v", "", "3", None, None),
    ("note", "Note", "about ", "", "length('about ' || p_size)", None, None),
    ("weight", "Weight", None, "", None, None, "PARSE_FAIL"),
]
CASE_SQL = " UNION ALL ".join(f"SELECT p_partkey, {i} AS place, '{f}' AS field, ({v or 'NULL'})::DOUBLE AS value, ({v2 or 'NULL'})::DOUBLE AS second, {r if (r or '').startswith('CASE') else repr(r) if r else 'NULL'} AS reason FROM (SELECT *, p_size::DOUBLE AS s FROM part)" for i, (f, _, _, _, v, v2, r) in enumerate(CASES))


def raw_texts(spark, d) -> DataFrame:
    def text(before, after):
        if before is None:
            return F.lit(None).cast("string")
        head, *tail = after.split("{s5}")
        return F.concat(F.lit(before), F.col("p_size").cast("string"), F.lit(head), *[x for t in tail for x in ((F.col("p_size") + 5).cast("string"), F.lit(t))])

    rows = [F.struct(F.lit(i).alias("place"), F.lit(f).alias("field"), F.lit(label).alias("label"), text(a, b).alias("raw")) for i, (f, label, a, b, *_) in enumerate(CASES)]
    return load(spark, d, "part").select("p_partkey", F.explode(F.array(*rows)).alias("r")).select("p_partkey", "r.*")


def typed(rows: DataFrame) -> DataFrame:
    """Each row by the rules of its own field."""
    return labels.typed(rows, FIELDS)


@query(CASE_SQL)
def normalized_fields(spark, d):
    slug = F.when(F.col("v.text") == "l2plus", 2.5).otherwise(F.length("v.text").cast("double"))
    value = F.coalesce("v.num", "v.low", F.col("v.flag").cast("double"), F.when(F.col("v.items").isNotNull(), F.size("v.items").cast("double")), slug)
    return typed(raw_texts(spark, d)).select("p_partkey", "place", "field", value.alias("value"), F.col("v.high").alias("second"), F.col("v.reason").alias("reason"))


@query(f"SELECT field, coalesce(reason, 'ok') AS reason, count(*) AS n FROM ({CASE_SQL}) GROUP BY ALL")
def normalize_report(spark, d):
    """Every text is read once, however many rows state it."""
    texts = raw_texts(spark, d).groupBy("field", "label", "raw").agg(F.count(F.lit(1)).alias("n"))
    return labels.read_texts(texts, FIELDS).groupBy("field", F.coalesce("v.reason", F.lit("ok")).alias("reason")).agg(F.sum("n").alias("n"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'section' WHEN 1 THEN 'ok' WHEN 2 THEN 'unmapped' WHEN 3 THEN 'UNIT_MISSING' ELSE 'ok' END AS outcome, CASE p_partkey % 5 WHEN 1 THEN p_size::DOUBLE WHEN 4 THEN p_size / 1000 END AS value FROM part""")
def map_facts(spark, d):
    """Labels to fields, values by the field's rules: heading, unmapped, refused or a value."""
    turn, size = (F.col("p_partkey") % 5 + 1).cast("int"), F.col("p_size").cast("string")
    label = F.element_at(F.array(F.lit("General Notes"), F.lit("Max power (W)"), F.lit("Colour"), F.lit("Weight"), F.lit("Weight")), turn)
    raw = F.element_at(F.array(F.lit("general-notes"), size, F.lit("red"), size, F.concat(size, F.lit(" g"))), turn)
    rows = load(spark, d, "part").select("p_partkey", label.alias("label"), raw.alias("raw"))
    field = F.when(F.col("label").rlike("(?i)power"), "power_max").when(F.col("label").rlike("(?i)^weight"), "weight")
    rows = rows.withColumn("field", field)
    values = F.when(F.col("field") == "power_max", labels.rule(FIELDS["power_max"])).when(F.col("field") == "weight", labels.rule(FIELDS["weight"]))
    rows = rows.withColumn("v", values)
    outcome = F.when(n.is_heading(F.col("label"), F.col("raw")), "section").when(F.col("field").isNull(), "unmapped").otherwise(F.coalesce("v.reason", F.lit("ok")))
    return rows.select("p_partkey", outcome.alias("outcome"), F.col("v.num").alias("value"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 2 END::DOUBLE + p_size AS h, CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 3 END::DOUBLE + p_size AS w, CASE p_partkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END::DOUBLE + p_size AS d FROM part")
def ordered_dimensions(spark, d):
    label = F.element_at(F.array(F.lit("Dimensions"), F.lit("Size (W x D x H)"), F.lit("Size (d × h × w) in mm")), (F.col("p_partkey") % 3 + 1).cast("int"))
    size = F.col("p_size").cast("double")
    return load(spark, d, "part").select("p_partkey", n.ordered_axes(label, size + 1, size + 2, size + 3).alias("x")).select("p_partkey", "x.h", "x.w", "x.d")
