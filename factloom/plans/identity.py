"""Queries about part numbers, classes, descriptions and names, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import identity
from ..operators.monitor import streaks
from ..sources.tables import load
from .queries import query

# Every row of part gives tokens of many shapes, made from its own values.
TOKENS_SQL = """
tokens AS (SELECT p_partkey, place, token FROM (SELECT p_partkey, unnest([
  p_brand, p_name, p_size::VARCHAR, p_size || 'W', p_size || '-' || (p_size + 10) || '=', lpad(p_partkey::VARCHAR, 7, '1'), lpad(p_partkey::VARCHAR, 5, '8') || '=', '2024-10-' || (10 + p_size % 20),
  p_size || '-Port', '802.' || (p_size % 12 + 1) || 'af', 'SFP+', 'IPv6', 'V' || p_size || '.' || (p_size % 7), (p_size % 9 + 1) || '.Ports', p_type, 'A' || (p_size % 10), p_type || '-' || p_partkey, p_type || ',' || p_size,
  '##' || p_partkey, '8' || (p_size % 10) || (1 + p_size % 9) || 'VA', p_size || 'x' || p_size || 'G=', p_size || 'GBASE-SR', 'TCP-' || p_size, '', '12-' || (p_partkey + 1000) || '-01', p_size || '-Mar-' || (1990 + p_size), p_size || '.5K=', '98' || (10 + p_size) || '-40',
  left(p_type, 3) || '-' || left(p_name, 3), p_brand || '=', '19' || (10 + p_size % 80) || '-' || (10 + p_size % 80) || '=', NULL]) AS token, generate_subscripts(range(32), 1) AS place FROM part))
"""


def tokens(spark, d) -> DataFrame:
    p = load(spark, d, "part")
    size, key = F.col("p_size"), F.col("p_partkey")

    def text(*xs):
        return F.concat(*[(F.lit(x) if isinstance(x, str) else x).cast("string") for x in xs])

    shapes = [
        F.col("p_brand"), F.col("p_name"), text(size), text(size, "W"), text(size, "-", size + 10, "="), F.lpad(text(key), 7, "1"), text(F.lpad(text(key), 5, "8"), "="), text("2024-10-", size % 20 + 10),
        text(size, "-Port"), text("802.", size % 12 + 1, "af"), F.lit("SFP+"), F.lit("IPv6"), text("V", size, ".", size % 7), text(size % 9 + 1, ".Ports"), F.col("p_type"), text("A", size % 10), text(F.col("p_type"), "-", key), text(F.col("p_type"), ",", size),
        text("##", key), text("8", size % 10, size % 9 + 1, "VA"), text(size, "x", size, "G="), text(size, "GBASE-SR"), text("TCP-", size), F.lit(""), text("12-", key + 1000, "-01"), text(size, "-Mar-", size + 1990), text(size, ".5K="), text("98", size + 10, "-40"),
        text(F.substring("p_type", 1, 3), "-", F.substring("p_name", 1, 3)), text(F.col("p_brand"), "="), text("19", size % 80 + 10, "-", size % 80 + 10, "="), F.lit(None).cast("string"),
    ]
    return p.select("p_partkey", F.posexplode(F.array(*shapes)).alias("at", "token")).select("p_partkey", (F.col("at") + 1).cast("long").alias("place"), "token")


#: The same rules for an engine whose patterns cannot look ahead.
REFUSAL_SQL = r"""
CASE WHEN t = '' THEN 'empty' WHEN regexp_matches(t, '[\x00-\x1f,;<>"''\\|{}\[\]]') THEN 'bad_char' WHEN regexp_matches(t, '\s') THEN 'whitespace'
  WHEN regexp_full_match(t, '[0-9]{2}-[0-9]{4,}-[0-9]{2}|[0-9]{6,8}|8[0-9][1-9][Vv][Aa]=?') THEN NULL
  WHEN regexp_full_match(t, '[0-9]{4,}(-[0-9]+)*=|[0-9]{4}-[0-9]{2}') AND NOT regexp_matches(t, '^(19|20)[0-9]{2}-') THEN NULL
  WHEN regexp_full_match(upper(c), '([0-9]{1,2}-)?(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[A-Z]*-[0-9]{2,4}|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}') THEN 'date'
  WHEN (regexp_full_match(upper(c), 'NUM([-/X~]NUM)*\+?') OR regexp_full_match(upper(c), '[0-9]{1,2}-[A-Z]{2,8}')) AND NOT (t LIKE '%=' AND contains(lower(c), 'x')) THEN 'quantity'
  WHEN regexp_matches(upper(c), '^[0-9]{1,2}\.[A-Z]') THEN 'footnote'
  WHEN regexp_full_match(upper(t), '[0-9]+(\.[0-9]+)?(/[0-9]+)*(GBASE|BASE|GE|G)(-[A-Z0-9]{1,6})?|(IEEE)?802(\.[0-9]+[A-Z]{0,3})+') THEN 'standard'
  WHEN regexp_full_match(upper(c), 'V?[0-9]+(\.[0-9]+)+(\([0-9]+\))?[A-Z]{0,2}[0-9]*') THEN 'version'
  WHEN regexp_full_match(upper(t), 'RJ-?[0-9]{2}|USB.*|HDMI|VGA|DVI|[QO]?SFP(\+|28|56|-DD)?|XFP|GBIC') THEN 'connector'
  WHEN regexp_full_match(upper(t), '(IPV[46]|ISO|EN|UL|CE|TCP|UDP|TLS|SSL|DNS|BGP|OSPF|VLAN|MAC)([./-]?V?[0-9][0-9A-Z./-]*)?') THEN 'protocol'
  WHEN NOT regexp_matches(t, '[A-Za-z]') THEN 'no_letter' WHEN length(t) < 4 THEN 'too_short' WHEN NOT regexp_matches(t, '[0-9]') AND NOT contains(t, '-') THEN 'bare_word' END
""".replace("NUM", "[0-9]+([.,][0-9]+)?(KW|MW|GBE|GBPS|MBPS|KBPS|MPPS|PPS|KHZ|MHZ|GHZ|HZ|VAC|VDC|DBM|BTU|RPM|LBS|GB|MB|TB|KB|GE|MA|MS|MM|CM|IN|LB|KG|DB|VA|AC|DC|K|M|G|T|W|V|A)?")
TRIMMED_SQL = "trim(coalesce(token, '')) AS t, regexp_replace(trim(coalesce(token, '')), '=$', '') AS c"


@query(f"WITH {TOKENS_SQL} SELECT p_partkey, place, token, {REFUSAL_SQL} AS refusal FROM (SELECT *, {TRIMMED_SQL} FROM tokens)")
def part_number_refusals(spark, d):
    return tokens(spark, d).withColumn("refusal", identity.part_number_refusal(F.col("token")))


@query(f"WITH {TOKENS_SQL} SELECT coalesce(refusal, 'part_number') AS refusal, count(*) AS n, min(token) AS example FROM (SELECT *, {REFUSAL_SQL} AS refusal FROM (SELECT *, {TRIMMED_SQL} FROM tokens)) GROUP BY 1")
def junk_sweep(spark, d):
    """Queued keys by why they are no part numbers."""
    refusal = F.coalesce(identity.part_number_refusal(F.col("token")), F.lit("part_number"))
    return tokens(spark, d).groupBy(refusal.alias("refusal")).agg(F.count(F.lit(1)).alias("n"), F.min("token").alias("example"))


SKUS_SQL = """
skus AS (SELECT p_partkey, p_type, [ 'CON-', 'L-', 'SW-', 'ISE-', 'ISE-SNS-', 'C9', 'AC-PLS', 'x', 'E-', ''][1 + p_partkey % 10] || p_size || ['', '-RTU', '-SUB', '-LIC-A', '-K9', 'AAE', '-SIA3'][1 + p_size % 7] || ['', '=', '=='][1 + p_partkey % 3] AS sku,
  CASE p_type WHEN 'PROMO' THEN false WHEN 'SMALL' THEN NULL ELSE true END AS is_hardware FROM part)
"""
RULES_SQL = " ".join(
    f"WHEN {dict(prefix='starts_with', suffix='suffix', contains='contains')[k]}(s, '{t}')" + (f" AND NOT contains(s, '{identity.UNLESS[t]}')" if t in identity.UNLESS else "") + f" THEN '{c}|{identity.rule_name(k, t)}'" for k, t, c in identity.CLASS_RULES
)


def skus(spark, d) -> DataFrame:
    p = load(spark, d, "part")

    def turn(items, by, n):
        return F.element_at(F.array(*[F.lit(x) for x in items]), (by % n + 1).cast("int"))

    key, size = F.col("p_partkey"), F.col("p_size")
    sku = F.concat(turn(["CON-", "L-", "SW-", "ISE-", "ISE-SNS-", "C9", "AC-PLS", "x", "E-", ""], key, 10), size.cast("string"), turn(["", "-RTU", "-SUB", "-LIC-A", "-K9", "AAE", "-SIA3"], size, 7), turn(["", "=", "=="], key, 3))
    hardware = F.when(F.col("p_type") == "PROMO", False).when(F.col("p_type") != "SMALL", True)
    return p.select("p_partkey", "p_type", sku.alias("sku"), hardware.alias("is_hardware"))


CLASSED_SQL = f"""
classed AS (SELECT p_partkey, p_type, sku, split_part(v, '|', 1) AS class, split_part(v, '|', 2) AS reason FROM (SELECT *, CASE WHEN s = '' THEN 'unknown|empty-sku' {RULES_SQL}
  WHEN is_hardware THEN 'hardware|category-is_hardware=true:' || p_type WHEN NOT is_hardware THEN 'software|category-is_hardware=false:' || p_type ELSE 'unknown|category-unknown:' || p_type END AS v
  FROM (SELECT *, regexp_replace(upper(trim(sku)), '=+$', '') AS s FROM skus)))
"""


def classed(spark, d) -> DataFrame:
    c = identity.product_class(F.col("sku"), F.col("p_type"), F.col("is_hardware"))
    return skus(spark, d).withColumn("c", c).select("p_partkey", "p_type", "sku", "c.class", "c.reason")


@query(f"WITH {SKUS_SQL}, {CLASSED_SQL} SELECT p_partkey, sku, class, reason FROM classed")
def product_classes(spark, d):
    return classed(spark, d).select("p_partkey", "sku", "class", "reason")


@query(f"WITH {SKUS_SQL}, {CLASSED_SQL} SELECT p_partkey, old_class, class, reason FROM (SELECT *, CASE WHEN p_partkey % 4 = 0 THEN 'unknown' WHEN p_partkey % 4 = 1 THEN 'hardware' ELSE class END AS old_class, p_partkey % 6 <> 5 AS owned FROM classed) WHERE old_class <> class AND owned")
def reclassify_plan(spark, d):
    """Rows whose class changes, and whose old reason the rules own."""
    key = F.col("p_partkey")
    old = F.when(key % 4 == 0, "unknown").when(key % 4 == 1, "hardware").otherwise(F.col("class"))
    return classed(spark, d).withColumn("old_class", old).where((F.col("old_class") != F.col("class")) & (key % 6 != 5)).select("p_partkey", "old_class", "class", "reason")


VOID_SQL = ", ".join(f"'{x}'" for x in identity.VOID)
PLACEHOLDER_SQL = " ".join(f"WHEN regexp_matches(lower(t), '(^|[^a-z0-9]){p.replace('.', '[.]')}([^a-z0-9]|$)') THEN 'placeholder:{p}'" for p in identity.PLACEHOLDERS)


@query(rf"""WITH texts AS (SELECT p_partkey, p_brand AS sku, [p_name, p_brand, p_type || ' ' || p_size, NULL, ' ', 'N/A', left(p_name, 4), repeat(p_name || ' ', 60), p_type || '-' || p_size || p_partkey, p_name || '......', p_name || ' xxx', 'TBD: ' || p_name, p_name || ' annnex', '10/100/1000'][1 + p_partkey % 14] AS text FROM part)
  SELECT p_partkey, CASE WHEN text IS NULL THEN 'missing' WHEN t = '' THEN 'empty' WHEN lower(t) IN ({VOID_SQL}) THEN 'void_value' WHEN length(t) < 6 THEN 'too_short' WHEN length(t) > 400 THEN 'too_long' WHEN upper(t) = upper(sku) THEN 'same_as_sku'
  WHEN regexp_full_match(upper(t), '[A-Z0-9]+([-/=+.][A-Z0-9]+)*=?') AND regexp_matches(t, '[A-Za-z]') THEN 'pid_only' WHEN len(list_filter(range(1, length(t) - 4), lambda i: substr(t, i, 6) = repeat(substr(t, i, 1), 6))) > 0 THEN 'repeated_filler'
  WHEN len(regexp_extract_all(t, '[A-Za-z]{{2,}}')) < 2 THEN 'not_prose' {PLACEHOLDER_SQL} END AS refusal FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM texts)""")
def description_refusals(spark, d):
    name, kind, size = F.col("p_name"), F.col("p_type"), F.col("p_size").cast("string")
    texts = [name, F.col("p_brand"), F.concat(kind, F.lit(" "), size), F.lit(None).cast("string"), F.lit(" "), F.lit("N/A"), F.substring(name, 1, 4), F.repeat(F.concat(name, F.lit(" ")), 60), F.concat(kind, F.lit("-"), size, F.col("p_partkey").cast("string"))]
    texts += [F.concat(name, F.lit("......")), F.concat(name, F.lit(" xxx")), F.concat(F.lit("TBD: "), name), F.concat(name, F.lit(" annnex")), F.lit("10/100/1000")]
    text = F.element_at(F.array(*texts), (F.col("p_partkey") % 14 + 1).cast("int"))
    return load(spark, d, "part").select("p_partkey", identity.description_refusal(text, F.col("p_brand")).alias("refusal"))


@query(r"""SELECT s_suppkey, name, CASE WHEN regexp_replace(upper(coalesce(name, '')), '[^A-Z0-9]', '', 'g') IN ('', 'S' || s_suppkey, 'ACMES' || s_suppkey, 'NORTHWINDS' || s_suppkey) THEN true ELSE false END AS placeholder,
  length(trim(pid)) BETWEEN 2 AND 40 AND regexp_matches(pid, '[0-9]') AND regexp_full_match(trim(pid), '[A-Za-z0-9][A-Za-z0-9./+=-]*') AND NOT trim(pid) LIKE '%.' AS is_pid
  FROM (SELECT s_suppkey, ['Acme S-' || s_suppkey, 's' || s_suppkey, s_name, NULL, '--', 'North Wind s ' || s_suppkey, 'Other S' || s_suppkey][1 + s_suppkey % 7] AS name, [s_name, 'S-' || s_suppkey, 'See note ' || s_suppkey, 'AB', 'X' || s_suppkey || '.'][1 + s_suppkey % 5] AS pid FROM supplier)""")
def placeholder_names(spark, d):
    k = F.col("s_suppkey").cast("string")

    def at(n, *xs):
        return F.element_at(F.array(*xs), (F.col("s_suppkey") % n + 1).cast("int"))

    name = at(7, F.concat(F.lit("Acme S-"), k), F.concat(F.lit("s"), k), F.col("s_name"), F.lit(None).cast("string"), F.lit("--"), F.concat(F.lit("North Wind s "), k), F.concat(F.lit("Other S"), k))
    pid = at(5, F.col("s_name"), F.concat(F.lit("S-"), k), F.concat(F.lit("See note "), k), F.lit("AB"), F.concat(F.lit("X"), k, F.lit(".")))
    s = load(spark, d, "supplier").select("s_suppkey", name.alias("name"), pid.alias("pid"), F.concat(F.lit("S-"), k).alias("sku"))
    return s.select("s_suppkey", "name", identity.is_placeholder_name(F.col("name"), F.col("sku"), ("Acme", "North Wind")).alias("placeholder"), identity.is_pid(F.col("pid")).alias("is_pid"))


@query("""SELECT p_partkey, vendor, family, CASE WHEN p_partkey % 6 = 0 AND vendor <> 'cisco' THEN 'cisco' WHEN p_partkey % 6 = 1 AND vendor NOT IN ('hpe', 'aruba') THEN 'aruba' WHEN p_partkey % 6 = 2 THEN 'ibm' END AS other_brand, sku LIKE '0%' AS leading_zero
  FROM (SELECT p_partkey, ['cisco', 'hpe', 'arista'][1 + p_partkey % 3] AS vendor, ['Cisco ' || p_name, p_name || ' aruba-CX', 'The IBM ' || p_type, 'arubatic ' || p_name, p_name, NULL][1 + p_partkey % 6] AS family, lpad(p_size::VARCHAR, 3, '0') || 'A' AS sku FROM part)""")
def foreign_parts(spark, d):
    key = F.col("p_partkey")
    vendor = F.element_at(F.array(F.lit("cisco"), F.lit("hpe"), F.lit("arista")), (key % 3 + 1).cast("int"))
    families = [F.concat(F.lit("Cisco "), "p_name"), F.concat("p_name", F.lit(" aruba-CX")), F.concat(F.lit("The IBM "), "p_type"), F.concat(F.lit("arubatic "), "p_name"), F.col("p_name"), F.lit(None).cast("string")]
    p = load(spark, d, "part").select("p_partkey", vendor.alias("vendor"), F.element_at(F.array(*families), (key % 6 + 1).cast("int")).alias("family"), F.concat(F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit("A")).alias("sku"))
    return p.select("p_partkey", "vendor", "family", identity.other_brand(F.col("vendor"), F.col("family")).alias("other_brand"), F.startswith("sku", F.lit("0")).alias("leading_zero"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM orders")
def long_dates(spark, d):
    written = F.when(F.col("o_orderkey") % 5 == 0, F.date_format("o_orderdate", "MMM d yyyy")).otherwise(F.date_format("o_orderdate", "MMMM d, yyyy"))
    return load(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format(identity.long_date(written), "yyyy-MM-dd").alias("parsed"))


@query("""WITH known AS (SELECT p_partkey, upper(p_type) || '-' || p_partkey || CASE WHEN p_size % 2 = 0 THEN '=' ELSE '' END AS sku FROM part),
  seen AS (SELECT p_partkey AS page, ['WS-', '', 'C1-'][1 + p_size % 3] || upper(p_type) || '-' || (p_partkey // 2) AS token FROM part), v AS (SELECT page, token, unnest(list_distinct([token, token || '=', regexp_replace(token, '^(WS|C1)-', '')])) AS spelling FROM seen)
  SELECT DISTINCT page, token, k.p_partkey AS part_id FROM v JOIN known k ON k.sku = v.spelling""")
def token_variants(spark, d):
    p = load(spark, d, "part")
    known = p.select(F.col("p_partkey").alias("part_id"), F.concat(F.upper("p_type"), F.lit("-"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 2 == 0, "=").otherwise("")).alias("spelling"))
    prefix = F.element_at(F.array(F.lit("WS-"), F.lit(""), F.lit("C1-")), (F.col("p_size") % 3 + 1).cast("int"))
    seen = p.select(F.col("p_partkey").alias("page"), F.concat(prefix, F.upper("p_type"), F.lit("-"), F.floor(F.col("p_partkey") / 2).cast("string")).alias("token"))
    return seen.withColumn("spelling", F.explode(identity.token_variants(F.col("token")))).join(known, "spelling").select("page", "token", "part_id").distinct()


@query("""WITH t AS (SELECT *, CASE event_id % 3 WHEN 0 THEN 'SKU-' || event_id WHEN 1 THEN event_id || 'W' ELSE 'PN' || event_id END AS key FROM events WHERE event_type <> 'view'),
  real AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM t WHERE event_id % 3 <> 1)
  SELECT user_id, coalesce(min(r) FILTER (event_type = 'signup'), max(r) + 1)::BIGINT - 1 AS streak, CASE WHEN user_id % 5 <= 2 THEN 15 ELSE 100 END AS most, coalesce(min(r) FILTER (event_type = 'signup'), max(r) + 1) - 1 >= CASE WHEN user_id % 5 <= 2 THEN 15 ELSE 100 END AS alarm FROM real GROUP BY user_id""")
def not_listed_streak(spark, d):
    """Latest unbroken run of not-listed answers to keys that are part numbers; other tasks and keys do not count.  Vendors
    (tier up to 2) alarm at 15, distributors at 100."""
    turn, key = F.col("event_id") % 3, F.col("event_id").cast("string")
    asked = load(spark, d, "events").where("event_type <> 'view'")
    asked = asked.withColumn("key", F.when(turn == 0, F.concat(F.lit("SKU-"), key)).when(turn == 1, F.concat(key, F.lit("W"))).otherwise(F.concat(F.lit("PN"), key)))
    real = asked.where(identity.part_number_refusal(F.col("key")).isNull())
    most = F.when(F.col("user_id") % 5 <= 2, 15).otherwise(100)
    return streaks(real, "user_id", ["ts", "event_id"], F.col("event_type") != "signup").select("user_id", "streak", most.alias("most"), (F.col("streak") >= most).alias("alarm"))


@query("SELECT doc_id, source, contains(translate(upper(text), '+= ', ''), translate(upper(w), '+= ', '')) AND translate(upper(w), '+= ', '') <> '' AS named FROM (SELECT doc_id, source, text, [source, left(text, 6) || '+', 'no such ' || doc_id, '= +'][1 + doc_id % 4] AS w FROM documents)")
def sku_mentions(spark, d):
    word = F.element_at(F.array(F.col("source"), F.concat(F.substring("text", 1, 6), F.lit("+")), F.concat(F.lit("no such "), F.col("doc_id").cast("string")), F.lit("= +")), (F.col("doc_id") % 4 + 1).cast("int"))
    return load(spark, d, "documents").select("doc_id", "source", identity.names_sku(F.col("text"), word).alias("named"))
