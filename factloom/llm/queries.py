"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .best_fit_packing import best_fit_packing
from .exact_topk import exact_topk
from .jaccard_join import jaccard_join
from .license_scans import license_scan
from .line_dedup import line_dedup
from .periodic_runs import periodic_runs
from .repetition_rules import repetition_rules
from .secret_scans import secret_scan, spelt
from .shared import shared_folder
from .sharding import sharded, store_map
from .source_mixing import mixed
from .substring_dedup import substring_dedup
from .token_alignment import alignment_scores
from .token_counts import token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_bpe() -> dict[str, str]:
    import public_tokenizers

    return {"tokenizer": tokenizer("byte_bpe_50k.json"), "ranks": tokenizer("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), **byte_bpe())


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map is stored for 39 shards, read back, and edited for the fortieth."""
    maps = f"{shared_folder(spark)}/slot-maps-{uuid.uuid4().hex}"
    documents = table(spark, sf_dir, "documents")
    store_map(documents, maps, shards=39)
    return sharded(documents, shards=40, maps=maps)


def op6_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(table(spark, sf_dir, "documents")).drop("longest_repeat")


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as the corpus has, drawn at the tempered weights."""
    return mixed(table(spark, sf_dir, "documents"), budget_ratio=1.0)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(spelt("base"), 256).alias("base_sha256"), spelt("spans").alias("spans"), spelt("live").alias("live"), spelt("copied").alias("copied"), "n_repositories", "n_owners")


def looped(documents: DataFrame) -> DataFrame:
    """The documents of the contract: in one of ten by hash, the words from a place on repeat from there with a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n, g = F.size(w), F.floor(h / 10)
        a = (g % F.greatest(n, F.lit(1))).cast("int")
        p = F.floor((n - a) / (3 + g % 8)).cast("int") + 1
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.element_at(w, (a + (i - a) % p + 1).cast("int")))), " ")

    text = F.when(h % 10 == 0, F.element_at(F.transform(F.array(words), repeated), 1)).otherwise(F.col("text"))
    return documents.select("doc_id", text.alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = periodic_runs(looped(table(spark, sf_dir, "documents")))
    rows = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = [F.col(f"strongest.{c}").alias(c) for c in ("start", "length", "period")]
    exponent = F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli")
    return runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, exponent, F.sha2(rows, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_scores(table(spark, sf_dir, "documents"), model=tokenizer("piece_bpe_32k.model"), **byte_bpe())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_exact_topk": op3_exact_topk,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_sharding": op5_sharding,
    "op6_repetition_rules": op6_repetition_rules,
    "op7_license_scans": op7_license_scans,
    "op8_source_mixing": op8_source_mixing,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_line_dedup": op10_line_dedup,
    "op11_secret_scans": op11_secret_scans,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op11_secret_scans": r"""
WITH patterns(kind, name, p, v) AS (VALUES
    (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 2),
    (1, 'access', 'AKIA[A-Z0-9]+', 0), (2, 'hex', '[0-9a-f]{32,}', 0), (3, 'other', '[A-Za-z0-9+/_-]{20,}={0,2}', 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
m AS (SELECT r, kind, name, regexp_extract_all(t, p) AS hits, regexp_extract_all(t, p, v) AS vals, list_transform(regexp_split_to_array(t, p), lambda x: length(x)) AS gaps
  FROM d, patterns WHERE regexp_matches(t, p)),
e AS (SELECT r, kind, name, vals[i] AS val, length(hits[i]) AS n, sum(gaps[i] + CASE WHEN i > 1 THEN length(hits[i - 1]) ELSE 0 END) OVER (PARTITION BY r, kind ORDER BY i) AS start
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m)),
s AS (SELECT r, kind, name, val, start, start + n AS stop FROM e WHERE length(val) >= [8, 16, 32, 20][kind + 1] AND (kind < 3 OR (regexp_matches(val, '[A-Z]') AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[0-9]')))),
f AS (SELECT * FROM s WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM s b WHERE b.r = s.r AND b.kind < 3 AND b.start < s.stop AND s.start < b.stop)),
o AS (SELECT val, count(DISTINCT (doc_id, source)) AS repositories, count(DISTINCT coalesce(source, '')) AS owners FROM f JOIN d USING (r) GROUP BY val),
c AS (SELECT val, sum(n * (n - 1)) AS equal FROM (SELECT val, ch, count(*) AS n FROM (SELECT val, unnest(string_split(val, '')) AS ch FROM o) GROUP BY ALL) GROUP BY val),
j AS (SELECT *, owners >= 3 OR repositories >= 10 AS copied, name || ':' || start::BIGINT || ':' || stop::BIGINT AS x,
    owners = 1 AND repositories < 10 AND 8 * equal <= length(val) * (length(val) - 1)
      AND NOT regexp_matches(val, '(?i)example|sample|dummy|placeholder|changeme|your|insert|redacted|xxxx|0000|1234|abcd') AS live
  FROM f JOIN o USING (val) JOIN c USING (val)),
g AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(x, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(x, ',' ORDER BY start, kind) FILTER (kind < 3 OR live) AS spans,
    string_agg(x, ',' ORDER BY start, kind) FILTER (live) AS live, string_agg(x, ',' ORDER BY start, kind) FILTER (copied) AS copied, max(repositories) AS n_repositories, max(owners) AS n_owners
  FROM j GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(live, '') AS live, coalesce(copied, '') AS copied, coalesce(n_repositories, 0)::BIGINT AS n_repositories, coalesce(n_owners, 0)::BIGINT AS n_owners
FROM d LEFT JOIN g USING (r)
""",
    "op12_periodic_runs": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w0,
    list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)) AS digits FROM documents),
h AS (SELECT r, doc_id, w0, len(w0) AS n, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(digits, lambda c: c::BIGINT), lambda c, b:
    list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) AS h FROM d),
g AS (SELECT *, h // 10 AS g, (h // 10) % greatest(n, 1) AS a, 1 + (n - (h // 10) % greatest(n, 1)) // (3 + (h // 10) % 8) AS p FROM h),
t AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN w0[:a] || list_transform(range(a, n), lambda i: w0[a + (i - a) % p + 1]) ELSE w0 END AS w FROM g),
x AS (SELECT r, w, n, list_transform(w, lambda v: hash(v)) AS k FROM t),
lags AS (SELECT r, k, n, unnest(generate_series(1, n // 4)) AS q FROM x WHERE n >= 6),
likely AS (SELECT r, k, n, q FROM lags WHERE len(list_filter(range(0, (n - q) // q), lambda j: k[j * q + 1:j * q + q] = k[j * q + q + 1:j * q + 2 * q])) > 0),
meets AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM (SELECT r, q, k, unnest(generate_series(1, n - q)) AS i FROM likely) WHERE k[i] = k[i + q]),
stretches AS (SELECT r, min(i) - 1 AS start, count(*) + q AS length, q AS period FROM meets GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT r, start, length, min(period) AS period FROM stretches GROUP BY r, start, length),
best AS (SELECT r, start, length, period FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / period DESC, start, period) = 1),
text AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) + 1 AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS c FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM x) ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(s, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM t LEFT JOIN best USING (r) LEFT JOIN text USING (r) LEFT JOIN kept USING (r)
""",
    "op9_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 5 * c >= 4 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
copies AS (SELECT w, count(*) AS n FROM d GROUP BY w)
SELECT doc_id, (SELECT min(b) FROM reach WHERE a = doc_id)::BIGINT AS class_id, (SELECT count(*) FROM links WHERE a = doc_id)::BIGINT AS n_links,
  CASE WHEN len(w) = 0 THEN 1 ELSE copies.n END::BIGINT AS n_copies
FROM d JOIN copies USING (w)
""",
    "op6_repetition_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d),
r AS (
  SELECT doc_id, k, unnest(generate_series(i, i + k - 1)) AS p FROM (
    SELECT doc_id, i, k, count(*) OVER (PARTITION BY doc_id, k, s) AS n
    FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM p, (VALUES (5), (8)) AS ks(k) WHERE i + k - 1 <= len(w)))
  WHERE n > 1),
long AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, array_to_string(w[i:i + 200], ' ') AS s FROM p WHERE i + 200 <= len(w)) GROUP BY doc_id, s HAVING count(*) > 1),
c AS (SELECT doc_id, count(DISTINCT p) FILTER (k = 8) AS n_repeat_words, count(DISTINCT p) FILTER (k = 5) AS n_covered_words FROM r GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^ \t-\r]') GROUP BY doc_id),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_covered_words, 0)::BIGINT AS n_covered_words, long.doc_id IS NOT NULL AS too_long
  FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN long USING (doc_id)),
g AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_covered_words <= 0.4 * n_words AND NOT too_long AS kept, n_covered_words
FROM g
""",
    "op3_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op1_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM places),
firsts AS (SELECT s, min(doc_id) AS m FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(13)) AS j FROM windows JOIN firsts USING (s) WHERE doc_id > m)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
}
