"""Pictures claimed by parts, made from the part table, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import images as x
from ..sources.tables import load
from .queries import query

#: Numbers: AX12, AX12-1, AX12-2 ... are a family of ten; each part claims six addresses.
CLAIMS_SQL = """
p AS (SELECT p_partkey AS part_id, p_brand AS vendor, p_size, 'AX' || p_partkey // 10 || CASE WHEN p_partkey % 10 > 0 THEN '-' || p_partkey % 10 ELSE '' END AS sku, 'AX' || p_partkey // 10 AS family FROM part),
claims AS (SELECT part_id, vendor, p_size, sku, position, url, CASE WHEN position % 2 = 0 THEN ' ' ELSE 'role' || position END AS role, CASE WHEN (part_id + position) % 3 > 0 THEN 'alt ' || position END AS alt FROM (
  SELECT *, unnest([1, 2, 3, 4, 5, 6]) AS position, unnest(['HTTPS://Cdn.example:8080/img/webp/img/' || sku || '.jpg?width=' || p_size * 20 || '&q=1', CASE WHEN part_id % 3 = 0 THEN 'https://cdn.example/img/' || sku || '.jpg' ELSE 'https://cdn.example/img/thumb/' || sku || '.JPG?q=1&w=' || p_size * 31 END,
    'https://cdn.example/p/' || family || '%20' || family || '-' || (part_id * 7) % 10 || '_front.png', 'https://cdn.example/b/' || replace(vendor, '#', '-') || '/' || p_size || '.png', CASE WHEN part_id % 4 = 0 THEN 'https://cdn.example/Logo/' || part_id || '.png' ELSE 'https://cdn.example/n/' || part_id || '.png' END, CASE WHEN part_id % 5 = 0 THEN 'data:image/png' WHEN part_id % 5 = 1 THEN '' ELSE 'https://cdn.example/i/' || family || '.gif' END]) AS url FROM p)),
keyed AS (SELECT *, CASE WHEN regexp_matches(url, '^https?://', 'i') THEN replace(replace(replace(replace(replace(lower(split_part(split_part(url, '?', 1), '://', 2)), '%20', ' '), ':8080', ''), '/webp', ''), '/thumb', ''), 'img/img/', 'img/') END AS url_key FROM claims WHERE url <> ''),
judged AS (SELECT *, CASE WHEN url_key IS NULL THEN 'not-an-http-url' WHEN contains(url_key, 'logo') THEN 'placeholder-url:logo' END AS refusal, TRY_CAST(nullif(regexp_extract(url, '[?&](?:width|w)=([0-9]{2,5})(?:&|$)', 1), '') AS INT) AS width FROM keyed)
"""
KEPT_SQL = """kept AS (SELECT part_id, url_key, arg_min(url, (coalesce(-width, -999999), position)) AS url, min((coalesce(-width, -999999), position)) AS w, arg_min(trim(role), position) FILTER (trim(role) <> '') AS role, arg_min(alt, position) FILTER (alt IS NOT NULL) AS alt FROM judged WHERE refusal IS NULL GROUP BY 1, 2)"""
STEM = "upper(regexp_extract(url_key, '([^/]*)\\.[^./]*$', 1))"


def claims(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    p = load(spark, d, "part").select(k.alias("part_id"), F.col("p_brand").alias("vendor"), "p_size", F.concat(F.lit("AX"), F.floor(k / 10).cast("string")).alias("family"), "p_partkey")
    sku = F.concat("family", F.when(k % 10 > 0, F.concat(F.lit("-"), (k % 10).cast("string"))).otherwise(""))
    p = p.withColumn("sku", sku)

    def address(*parts):
        return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])

    fam, own = F.col("family"), F.col("sku")
    urls = [
        address("HTTPS://Cdn.example:8080/img/webp/img/", own, ".jpg?width=", size * 20, "&q=1"),
        F.when(k % 3 == 0, address("https://cdn.example/img/", own, ".jpg")).otherwise(address("https://cdn.example/img/thumb/", own, ".JPG?q=1&w=", size * 31)),
        address("https://cdn.example/p/", fam, "%20", fam, "-", k * 7 % 10, "_front.png"),
        address("https://cdn.example/b/", F.regexp_replace("vendor", "#", "-"), "/", size, ".png"),
        F.when(k % 4 == 0, address("https://cdn.example/Logo/", k, ".png")).otherwise(address("https://cdn.example/n/", k, ".png")),
        F.when(k % 5 == 0, "data:image/png").when(k % 5 == 1, "").otherwise(address("https://cdn.example/i/", fam, ".gif")),
    ]
    rows = p.select("part_id", "vendor", "p_size", "sku", F.posexplode(F.array(*urls)).alias("position", "url")).withColumn("position", F.col("position") + 1)
    n = F.col("position")
    return rows.withColumns({"role": F.when(n % 2 == 0, " ").otherwise(address("role", n)), "alt": F.when((F.col("part_id") + n) % 3 > 0, address("alt ", n))})


@query(f"WITH {CLAIMS_SQL.strip()}, {KEPT_SQL} SELECT part_id, url_key, url, nullif(-w[1], 999999) AS width, role, alt FROM kept")
def page_pictures(spark, d):
    return x.page_candidates(claims(spark, d), "part_id")[0]


@query(f"WITH {CLAIMS_SQL.strip()} SELECT part_id, url, refusal AS reason FROM judged WHERE refusal IS NOT NULL")
def refused_pictures(spark, d):
    return x.page_candidates(claims(spark, d), "part_id")[1]


def rows_of(spark, d):
    c = claims(spark, d).where("url <> ''")
    return c.select((F.col("part_id") * 10 + F.col("position")).alias("id"), "part_id", "vendor", "p_size", "sku", "position", "url", x.picture_key(F.col("url")).alias("url_key"))


NAMED_SQL = f"""stems AS (SELECT part_id * 10 + position AS id, part_id, vendor, sku, {STEM} AS stem, regexp_split_to_array({STEM}, '[ _]+') AS words FROM judged WHERE url_key IS NOT NULL),
tokens AS (SELECT id, vendor, sku, stem AS named FROM stems UNION SELECT id, vendor, sku, unnest(words) FROM stems UNION SELECT id, vendor, sku, unnest(string_split(array_to_string(words, '-'), '-')) FROM stems),
named AS (SELECT t.id, bool_or(replace(t.named, '-', '') = replace(t.sku, '-', '')) AS own, min(t.named) FILTER (replace(t.named, '-', '') <> replace(t.sku, '-', '') AND NOT starts_with(t.sku, t.named || '-')) AS other FROM tokens t SEMI JOIN p ON p.vendor = t.vendor AND p.sku = t.named GROUP BY 1)"""


@query(f"WITH {CLAIMS_SQL.strip()}, {NAMED_SQL} SELECT id, other FROM named WHERE NOT own AND other IS NOT NULL")
def pictures_of_others(spark, d):
    rows = rows_of(spark, d)
    return x.named_others(rows, rows.select("vendor", "sku"))


@query(f"""WITH {CLAIMS_SQL.strip()}, {NAMED_SQL},
c AS (SELECT part_id * 10 + position AS id, *, count(DISTINCT part_id) OVER (PARTITION BY url_key) AS claims FROM judged),
f AS (SELECT id, part_id, CASE WHEN id % 7 > 0 THEN CASE WHEN id % 11 = 0 THEN 404 ELSE 200 END END AS http, id % 13 > 0 AS picture, CASE WHEN p_size % 6 = 0 THEN vendor ELSE id::VARCHAR END AS content, p_size * 20 AS width, p_size * 15 AS height FROM c WHERE id % 17 > 0),
held AS (SELECT content, count(DISTINCT part_id) AS holders FROM f WHERE http = 200 AND picture GROUP BY 1),
ladder AS (SELECT id, CASE WHEN refusal IS NOT NULL THEN refusal WHEN claims > 3 THEN 'shared-across-parts:' || claims WHEN NOT own AND other IS NOT NULL THEN 'names-another-sku:' || other END AS before,
  CASE WHEN f.id IS NULL THEN NULL WHEN http IS NULL THEN 'fetch-error' WHEN http <> 200 THEN 'http-' || http END AS failed,
  CASE WHEN NOT picture THEN 'not-an-image' WHEN holders >= 6 THEN 'generic-content:' || holders WHEN width < 300 THEN 'tiny-image:' || width || 'x' || height END AS after, f.id IS NOT NULL AS answered
  FROM (SELECT id, refusal, claims FROM c) LEFT JOIN named USING (id) LEFT JOIN (SELECT id, id AS fid, http, picture, content, width, height FROM f) f USING (id) LEFT JOIN held USING (content))
SELECT id, CASE WHEN before IS NOT NULL THEN 'rejected' WHEN failed IS NOT NULL THEN 'failed' WHEN after IS NOT NULL THEN 'rejected' WHEN answered THEN 'promoted' ELSE 'waiting' END AS status, coalesce(before, failed, after) AS reason FROM ladder""".replace("f.id IS", "f.fid IS"))
def picture_decisions(spark, d):
    rows, i, size = rows_of(spark, d), F.col("id"), F.col("p_size")
    content = F.when(size % 6 == 0, F.col("vendor")).otherwise(i.cast("string"))
    http = F.when(i % 7 > 0, F.when(i % 11 == 0, 404).otherwise(200))
    fetched = rows.where(i % 17 > 0).select("id", "part_id", http.alias("http"), F.when(i % 13 > 0, "png").alias("format"), content.alias("sha256"), (size * 20).alias("width"), (size * 15).alias("height"))
    held = fetched.where("http = 200 and format is not null").select("part_id", "sha256")
    return x.decided(rows, rows.select("vendor", "sku"), fetched.drop("part_id"), held)
