"""Pictures of pages: which addresses are one picture, which are refused, and what is decided of each candidate.

An address is judged by three things: its own text, how many parts claim it, and whether its file names another part.  What
was fetched is judged by its content.  All of it is columns and joins; no picture is opened here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Words in addresses that are no pictures of a product.
PLACEHOLDERS = (
    "placeholder", "no_image", "noimage", "no-image", "image-not-available", "imagenotavailable", "coming-soon", "comingsoon", "logo",
    "spacer", "/blank.", "/1x1.", "pixel.gif", "transparent.gif", "sprite", "swatch", "/icons/", "/icon-", "favicon", "default_product",
    "dummy", "watermark", "stock-photo", "clipboard_", "screenshot", "diagram", "topology",
)
# Path segments that name a rendition of a picture, not the picture.
RENDITIONS = ("mf_webp", "webp", "jpg", "jpeg", "png", "thumbnail", "thumbs", "thumb", "resize", "scaled")
# Suffixes of numbers that name the same product.
SAME_PRODUCT = ("=", "-HW")
# Names of a width in the query of an address, by precedence.
WIDTHS = ("width", "w", "maxwidth", "sw")
# Most parts that share an address, parts that share a content, least pixels of the long side.
MOST_PER_KEY, MOST_PER_CONTENT, LEAST_PIXELS = 3, 6, 300

ADDRESS = r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]+)?(/[^?#]*)"


def picture_key(url: Column, renditions: tuple[str, ...] = RENDITIONS) -> Column:
    """Host and path in lower case without query, rendition segments and doubled segments; null if it is no http address
    with a file.  The last segment, the file, always stays."""
    host = F.lower(F.regexp_extract(url, ADDRESS, 1))
    path = F.regexp_replace(F.regexp_extract(url, ADDRESS, 2), r"\+", "%2B")
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    parts = F.transform(parts, lambda s: F.lower(F.coalesce(F.try_url_decode(s), s)))

    def of(segments: Column) -> Column:
        folders = F.filter(F.slice(segments, 1, F.size(segments) - 1), lambda s: ~s.isin(*renditions))
        once = F.zip_with(folders, F.concat(F.array(F.lit("")), folders), lambda a, b: F.when(a != b, a))
        return F.concat_ws("/", host, F.array_compact(once), F.element_at(segments, -1))

    return F.when((host != "") & (F.size(parts) > 0), F.element_at(F.transform(F.array(parts), of), 1))


def width_hint(url: Column) -> Column:
    """The width that an address asks for, of two to five digits."""
    found = [F.regexp_extract(url, rf"\?(?:[^#]*&)?{name}=([0-9]{{2,5}})(?:[&#]|$)", 1) for name in WIDTHS]
    return F.coalesce(*[F.when(x != "", x.cast("int")) for x in found])


def placeholder_reason(key: Column, words: tuple[str, ...] = PLACEHOLDERS) -> Column:
    """Why an address is refused by its text alone; null if it is not."""
    return F.coalesce(F.when(key.isNull(), "not-an-http-url"), *[F.when(F.contains(key, F.lit(w)), f"placeholder-url:{w}") for w in words])


def judged(url: Column) -> Column:
    """url_key and reason of an address as a struct.  The key is bound once: a filter on the reason is pushed down to where the
    address is read, and would else work the key out anew for each word that refuses it."""
    return F.element_at(F.transform(F.array(picture_key(url)), lambda k: F.struct(k.alias("url_key"), placeholder_reason(k).alias("reason"))), 1)


def page_candidates(images: DataFrame, page: str) -> tuple[DataFrame, DataFrame]:
    """(a row for each picture of each page, the refused addresses with their reasons).

    images: page, position (order on the page), url, role, alt.  Of the addresses of one picture the one without a width stays
    (it is the original), else the widest, else the first; role and alt are the first ones stated, on whichever address.
    """
    filled = lambda c: F.when(F.trim(c) != "", F.struct("position", F.trim(c).alias("v")))
    rows = images.withColumn("url", F.trim("url")).where("url <> ''").withColumn("j", judged(F.col("url"))).select("*", "j.*").drop("j")
    refused = rows.where("reason is not null").select(page, "url", "reason")
    hint = width_hint(F.col("url"))
    best = F.struct(F.coalesce(-hint, F.lit(-(2**31 - 1))).alias("rank"), "position", "url", hint.alias("width"))
    kept = rows.where("reason is null").groupBy(page, "url_key").agg(F.min(best).alias("b"), F.min(filled(F.col("role"))).alias("r"), F.min(filled(F.col("alt"))).alias("a"))
    return kept.select(page, "url_key", F.col("b.url").alias("url"), F.col("b.width").alias("width"), F.col("r.v").alias("role"), F.col("a.v").alias("alt")), refused


def file_tokens(key: Column) -> Column:
    """What could be a number in the name of a file, in upper case: the name itself, its words, their pieces between dashes,
    and neighbouring ones of these joined by a dash; three characters or more."""

    def joined(p: Column) -> Column:
        pairs = F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 2, F.size(p)), lambda a, b: F.concat_ws("-", a, b))
        return F.concat(p, pairs)

    def of(stem: Column) -> Column:
        words = F.filter(F.split(F.regexp_replace(stem, r"[^\p{L}\p{N}-]", " "), " "), lambda w: w != "")
        pieces = F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.filter(F.split(w, "-"), lambda x: x != ""))))
        return F.concat(F.array(stem), F.flatten(F.transform(F.array(pieces), joined)))

    stem = F.upper(F.regexp_replace(F.element_at(F.split(key, "/"), -1), r"\.[^.]*$", ""))
    return F.filter(F.array_distinct(F.flatten(F.transform(F.array(stem), of))), lambda t: F.length(t) >= 3)


def relation(mine: Column, named: Column) -> Column:
    """same, family or other: a number is of a family's if it goes on behind a dash (a letter alone is another product)."""
    end = rf"(?<=.)(?:{'|'.join(SAME_PRODUCT)})+$"
    a, b = (F.regexp_replace(F.upper(F.trim(x)), end, "") for x in (mine, named))
    plain = [F.regexp_replace(x, r"[^\p{L}\p{N}]", "") for x in (a, b)]
    return F.when(plain[0] == plain[1], "same").when((b != "") & F.startswith(a, F.concat(b, F.lit("-"))), "family").otherwise("other")


def named_others(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """id and the least of the other numbers that a candidate's file names, if it does not name the part's own.

    candidates: id, vendor, sku, url_key; known: vendor, sku.  Tokens meet the known numbers in an equi join.
    """
    tokens = candidates.select("id", "vendor", F.col("sku").alias("mine"), F.explode(file_tokens(F.col("url_key"))).alias("named"))
    named = tokens.join(known.select("vendor", F.upper("sku").alias("named")).distinct(), ["vendor", "named"])
    kind = relation(F.col("mine"), F.col("named"))
    found = named.groupBy("id").agg(F.bool_or(kind == "same").alias("own"), F.min(F.when(kind == "other", F.col("named"))).alias("other"))
    return found.where("not own and other is not null").select("id", "other")


def decided(candidates: DataFrame, known: DataFrame, fetched: DataFrame, pictures: DataFrame, most: int = MOST_PER_KEY, most_content: int = MOST_PER_CONTENT, least: int = LEAST_PIXELS) -> DataFrame:
    """id, status (rejected, failed, promoted or waiting) and reason of every candidate, by ordered rules.

    candidates: id, part_id, vendor, sku, url, url_key; known: vendor, sku; fetched: id, http (null: no answer), format (null:
    no picture), sha256, width, height; pictures: part_id, sha256 of those that are held already.  Shared addresses and
    contents are counted by distinct parts, and only the counts beyond the limits come back, so that a picture that a third of
    all parts claim is one row of the join.
    """

    def shared(rows: DataFrame, by: str, n: str, beyond: Column) -> DataFrame:
        return rows.groupBy(by).agg(F.countDistinct("part_id").alias(n)).where(beyond)

    by_key = shared(candidates, "url_key", "claims", F.col("claims") > most)
    by_content = shared(pictures, "sha256", "holders", F.col("holders") >= most_content)
    rows = candidates.select("id", "url_key").join(by_key, "url_key", "left").join(named_others(candidates, known).hint("merge"), "id", "left")
    rows = rows.join(fetched.withColumn("answered", F.lit(True)).join(by_content, "sha256", "left").hint("merge"), "id", "left")
    before = F.coalesce(
        placeholder_reason(F.col("url_key")),
        F.concat(F.lit("shared-across-parts:"), "claims"),
        F.concat(F.lit("names-another-sku:"), "other"),
    )
    failed = F.when(F.col("answered") & F.col("http").isNull(), "fetch-error").when(F.col("http") != 200, F.concat(F.lit("http-"), "http"))
    after = F.coalesce(
        F.when(F.col("answered") & F.col("format").isNull(), "not-an-image"),
        F.concat(F.lit("generic-content:"), "holders"),
        F.when(F.greatest("width", "height") < least, F.concat(F.lit("tiny-image:"), "width", F.lit("x"), "height")),
    )
    steps = [(before, "rejected"), (failed, "failed"), (after, "rejected")]
    status = reduce(lambda rest, s: F.when(s[0].isNotNull(), s[1]).otherwise(rest), reversed(steps), F.when(F.col("answered"), "promoted").otherwise("waiting"))
    return rows.select("id", status.alias("status"), F.coalesce(before, failed, after).alias("reason"))
