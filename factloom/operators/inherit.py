"""What a document says of a family, and which of its parts may take it.

Values form a lattice: those that a document states of a part itself, of a family, and of all that it is about.  A part takes
the nearest one; a value further out reaches it only if the document describes the part, the field may be inherited, and no
exception stands nearer.  Two passes: own values first, then the others, against what the first has found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .writes import model_tokens

# Classes and categories of parts that documents only list, shapes of component numbers, and words that name
# no family.
LISTED_CLASSES = ("license", "software", "service", "accessory", "bundle")
LISTED_CATEGORIES = ("transceiver",)
BEGINS = ("CAB-", "STACK-", "PWR-", "FAN-", "NXA-FAN", "GLC-", "CWDM-", "DWDM-", "CPAK-", "FET-", "XFP", "X2-")
HOLDS = ("-STACK-", "-PWR-", "-PAC-", "-PDC-", "-FAN-", "SFP", "-SSD")
NO_FAMILY = ("cisco", "series", "switch", "switches", "router", "routers", "system", "systems", "the", "and", "data", "sheet", "datasheet", "product", "products", "platform", "platforms", "module", "modules", "solution", "solutions", "for", "with")
# Fields that a category of parts cannot have.
NEVER = {
    "transceiver": (
        "supported_transceivers", "stack_ports", "stacking_bandwidth", "psu_options", "module_slots", "poe_budget", "switching_capacity", "forwarding_rate", "jumbo_mtu", "mac_table", "vlan_max",
        "ipv4_routes", "ipv6_routes", "queues_per_port", "qos_features", "segment_routing_features", "fabric_services", "programming_interfaces", "snmp_mibs", "dram", "flash",
    )
}
OWN, FAMILY, DOCUMENT = 0, 1, 2


def component(sku: Column) -> Column:
    """The shape of a component that a number has, or null; the sign of a spare part does not count."""
    s = F.regexp_replace(F.upper(F.trim(sku)), "=+$", "")
    shapes = [(F.startswith(s, F.lit(t)), t) for t in BEGINS] + [(F.contains(s, F.lit(t)), t) for t in HOLDS]
    return F.coalesce(*[F.when(c, t) for c, t in shapes])


def family_words(name: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*NO_FAMILY))


def family_keys(name: Column) -> Column:
    """What two names are compared by: their words, and their model numbers."""
    models = F.filter(model_tokens(F.coalesce(name, F.lit(""))), lambda w: ~F.lower(w).isin(*NO_FAMILY))
    return F.struct(family_words(name).alias("words"), models.alias("models"))


def other_family(mine: Column, named: Column) -> Column:
    """The rule by which two names with these keys do not mean one family, or null.  They do if they share a model number, where
    both have some, or any word, where neither has; else it is not known."""
    words, models = ([x[c] for x in (mine, named)] for c in ("words", "models"))
    some = [F.size(x) > 0 for x in models]
    unknown = (F.size(words[0]) == 0) | (F.size(words[1]) == 0) | (some[0] != some[1])
    return F.when(unknown, "family:unknown").when(~F.when(some[0], F.arrays_overlap(*models)).otherwise(F.arrays_overlap(*words)), "family:mismatch")


def listed_only(sku: Column, product_class: Column, category: Column) -> Column:
    """Why a part is one that documents only list, whatever they describe, or null."""
    shape = F.transform(F.array(component(sku)), lambda c: F.concat(F.lit("component:"), c))[0]
    return F.coalesce(F.when(product_class.isin(*LISTED_CLASSES), F.concat(F.lit("class:"), product_class)), shape, F.when(category.isin(*LISTED_CATEGORIES), F.concat(F.lit("category:"), category)))


def undescribed(sku: Column, product_class: Column, category: Column, part_family: Column, doc_family: Column) -> Column:
    """Why a part is not one that the document describes, or null."""
    return F.coalesce(listed_only(sku, product_class, category), other_family(family_keys(part_family), family_keys(doc_family)))


def inapplicable(category: Column, field: Column) -> Column:
    """The rule by which a part cannot have a field, or null."""
    return F.coalesce(*[F.when((category == c) & field.isin(*fields), F.lit(f"not_applicable:{c}")) for c, fields in NEVER.items()])


def inherited(stated: DataFrame, listed: DataFrame, parts: DataFrame, classes: DataFrame) -> DataFrame:
    """Every value that a document offers to a part that it lists, with the rule that refuses it (null: taken).

    stated: doc_id, level (OWN, FAMILY, DOCUMENT), part_id (of own values), family (of others, null: the document's own),
    field, value; listed: doc_id, part_id; parts: part_id, sku, class, category, family; classes: field, kind (A: may be inherited,
    B: never, C: unless the document states the field of some part itself).
    Returns doc_id, part_id, field, level, value, rule.

    What a part's and a family's name say is worked out once a part and once a document and name, before they meet; what a
    document states meets each part that it lists as one row a name, and is dealt out into fields last.
    """
    p = parts.select("part_id", "category", listed_only(F.col("sku"), F.col("class"), F.col("category")).alias("r_listed"), family_keys(F.col("family")).alias("mine"))
    own = stated.where(F.col("level") == OWN).join(p.select("part_id", "category"), "part_id").select("doc_id", "part_id", "field", "level", "value", inapplicable(F.col("category"), F.col("field")).alias("rule"))
    taken = own.where("rule is null")
    has = taken.groupBy("doc_id", "part_id").agg(F.collect_set("field").alias("has"))
    exceptions = taken.select("doc_id", "field").distinct().withColumn("exception", F.lit(True))
    wide = stated.where(F.col("level") != OWN).join(classes, "field", "left").join(exceptions, ["doc_id", "field"], "left")
    wide = wide.groupBy("doc_id", "family").agg(F.collect_list(F.struct("field", "level", "value", "kind", "exception")).alias("said")).select("doc_id", "said", family_keys(F.col("family")).alias("named"))
    met = listed.distinct().join(has, ["doc_id", "part_id"], "left").join(p, "part_id").join(wide, "doc_id")
    unfit = F.coalesce("r_listed", other_family(F.col("mine"), F.col("named")))
    met = met.select("doc_id", "part_id", "category", "has", unfit.alias("r_part"), "said")
    offers = met.select("doc_id", "part_id", "category", "has", "r_part", F.explode("said").alias("x")).select("doc_id", "part_id", "category", "has", "r_part", "x.*")
    r_field = inapplicable(F.col("category"), F.col("field"))
    rule = (
        F.when(F.col("kind") == "B", "class_b")
        .when(F.col("r_part").isNotNull(), F.col("r_part"))
        .when(r_field.isNotNull(), r_field)
        .when(F.array_contains("has", F.col("field")), "own_value")
        .when((F.col("kind") == "C") & F.col("exception"), "exception_in_document")
        .when(F.col("kind").isNull(), "no_class")
    )
    return own.unionByName(offers.select("doc_id", "part_id", "field", "level", "value", rule.alias("rule")))


def nearest(values: DataFrame) -> DataFrame:
    """Of each part and field the nearest value taken: own before family before document, then of the smallest document."""
    order = F.struct("level", "doc_id", "value")
    return values.where("rule is null").groupBy("part_id", "field").agg(F.min(order).alias("x")).select("part_id", "field", "x.level", "x.doc_id", "x.value")


def refusals(values: DataFrame) -> DataFrame:
    return values.where("rule is not null").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def classes_of(spark, **fields: str) -> DataFrame:
    """A table of fields by class: classes_of(spark, A="certifications ieee_standards", B="weight")."""
    return spark.createDataFrame(reduce(list.__add__, [[(f, kind) for f in names.split()] for kind, names in fields.items()]), "field string, kind string")
