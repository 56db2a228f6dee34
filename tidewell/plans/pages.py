"""Page queries: the given pages, and pages of listings rendered from orders, through the HTML tokenizer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.sorts import top_per_key
from ..sources import html as H
from .frames import FRAMES, load
from .registry import query


def _site(spark, sf_dir, *fields):
    """(id, url, page) of the given pages, whose pairs are the heading and the text after it."""
    pages = load(spark, sf_dir, "pages")
    return H.parse_pages(pages, "page_id", start="article", headings=("h1",), fields=fields).withColumn("kind", F.lit("page")).withColumnRenamed("page_id", "id")


def _listing_pages(spark, sf_dir):
    """The listing pages; their orders are one small file here, so these are dealt out before they become pages."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice").repartition(spark.sparkContext.defaultParallelism)
    return spark.sql(FRAMES["listing_pages"].replace("FROM orders", "FROM {orders}"), orders=orders)


def _ads(spark, sf_dir, *fields):
    """(id, page) of the listing pages."""
    return H.parse_pages(_listing_pages(spark, sf_dir), "listing_id", fields=fields).withColumn("kind", F.lit("listing")).withColumnRenamed("listing_id", "id")


_BARE = "regexp_replace(html, '(?s)<script>.*?</script>|<style>.*?</style>|<!--.*?-->', ' ', 'g')"
_TEXT = "nullif(trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g')), '')"
_TYPE = "CASE WHEN o_orderkey % 5 <> 0 THEN lower(o_orderpriority) || ' home' END"
_BEDROOMS = "CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey % 6 AS VARCHAR) END"
_PRICE = "CASE WHEN o_orderkey % 17 <> 0 THEN '$' || CAST(CAST(floor(o_totalprice / 40) AS BIGINT) AS VARCHAR) END"
_TERM = "CAST(o_orderkey % 12 + 1 AS VARCHAR) || ' months'"
_ROOM = "'Bright <corner> room ' || CAST(o_orderkey AS VARCHAR) || ' near transit'"
_LISTS = "CASE WHEN o_orderkey % 3 <> 0 THEN 'wifi|gym' || CASE WHEN o_orderkey % 2 = 0 THEN '|parking' ELSE '' END ELSE '' END"


@query(
    "extract_detail_pairs",
    rf"""SELECT 'page' AS kind, page_id AS id, label, list_filter(list_transform(parts, lambda x: {_TEXT.format("regexp_replace(x, '(?s)</p>.*', '')")}), lambda x: x <> label)[1] AS "value"
      FROM (SELECT page_id, {_TEXT.format("regexp_extract(h, '(?s)<h1>(.*?)</h1>', 1)")} AS label, string_split(regexp_extract(h, '(?s)<article>(.*?)(?:</article>|$)', 1), '<p>')[2:] AS parts FROM (SELECT page_id, {_BARE} AS h FROM pages)) WHERE "value" IS NOT NULL
    UNION ALL SELECT 'listing', o_orderkey, label, "value" FROM (
      SELECT o_orderkey, unnest(['Housing Type', 'Bedroom(s)', 'Lease Term', 'Tenant Type']) AS label, unnest([{_TYPE}, {_BEDROOMS}, {_TERM}, 'Any']) AS "value" FROM orders) WHERE "value" IS NOT NULL""",
)
def extract_detail_pairs(spark, sf_dir):
    rows = _site(spark, sf_dir, "pairs").unionByName(_ads(spark, sf_dir, "pairs"))
    return rows.select("kind", "id", F.inline("page.pairs"))


@query(
    "extract_page_fields",
    rf"""SELECT 'page' AS kind, page_id AS id, {_TEXT.format("regexp_extract(h, '(?s)<title>(.*?)</title>', 1)")} AS title, nullif(regexp_extract(h, '<html lang="([a-zA-Z-]+)"', 1), '') AS language,
        {_TEXT.format("regexp_extract(h, '(?s)<h1>(.*?)</h1>', 1)")} AS heading, NULL AS address, NULL AS price, {_TEXT.format("regexp_extract(h, '(?s)<article>(.*?)(?:</article>|$)', 1)")} AS text,
        len(regexp_extract_all(h, '<p>')) AS paragraphs, len(regexp_extract_all(h, '<a ')) AS links, NULL AS description, '' AS amenities, NULL AS contact, NULL AS phone FROM (SELECT page_id, {_BARE} AS h FROM pages)
    UNION ALL SELECT 'listing', o_orderkey, 'Listing ' || CAST(o_orderkey AS VARCHAR) || ' & more', 'en-CA', NULL, CAST(o_custkey AS VARCHAR) || ' King & Queen Street' || CASE WHEN o_orderkey % 17 = 0 THEN ' ask' ELSE '' END, {_PRICE},
        concat_ws(' ', CAST(o_custkey AS VARCHAR) || ' King & Queen Street', coalesce({_PRICE}, 'ask'), 'View Map Housing Type', {_TYPE}, 'Bedroom(s)', {_BEDROOMS}, 'Lease Term', {_TERM}, 'from May', CASE WHEN o_orderkey % 2 = 0 THEN 'Lease Term none' END,
          'Tenant Type Any', {_ROOM}, CASE WHEN o_orderkey % 3 <> 0 THEN 'Amenities wifi gym wifi' || CASE WHEN o_orderkey % 2 = 0 THEN ' parking' ELSE '' END END, 'Contact Landlord Your contact is Ann O''Neil', CAST(o_custkey AS VARCHAR), 'Call: 519-555-' || CAST(1000 + o_custkey % 9000 AS VARCHAR)),
        CASE WHEN o_orderkey % 2 = 0 THEN 9 ELSE 8 END, 2, {_ROOM}, {_LISTS}, 'Ann O''Neil ' || CAST(o_custkey AS VARCHAR), '519-555-' || CAST(1000 + o_custkey % 9000 AS VARCHAR) FROM orders""",
)
def extract_page_fields(spark, sf_dir):
    fields = ("title", "language", "heading", "block", "text", "paragraphs", "links", "description", "amenities", "contact", "phone")
    rows = _site(spark, sf_dir, *fields).unionByName(_ads(spark, sf_dir, *fields))
    address, price = H.title_block(F.col("page.block"))
    return rows.select(
        "kind", "id", "page.title", "page.language", "page.heading", address.alias("address"), price.alias("price"), "page.text", F.col("page.paragraphs").cast("long").alias("paragraphs"), F.size("page.links").cast("long").alias("links"),
        "page.description", F.array_join("page.amenities", "|").alias("amenities"), "page.contact", "page.phone",
    )


#: The images of a listing page by position, with the score that the rules give them.
_IMG = """SELECT o_orderkey AS listing_id, source, position, replace(path, '#', CAST(o_orderkey AS VARCHAR)) AS url, image_key, score FROM orders, (VALUES
  ('meta', 0, 'https://homes.example/media/#/cover-photo.jpg', 'cover-photo.jpg', 55), ('link', 2, 'https://homes.example/rent/map.png', 'map.png', 6),
  ('img', 3, 'https://homes.example/media/#/photo1.jpg?w=9', 'photo1.jpg', 37), ('img', 4, 'https://homes.example/media/#/photo2.jpg', 'photo2.jpg', 36),
  ('srcset', 5, 'https://homes.example/media/#/photo1-thumb.jpg', 'photo1.jpg', 10), ('srcset', 6, 'https://cdn.example/#/photo3.webp', 'photo3.webp', 22), ('background', 7, 'https://homes.example/rent/gallery4.png', 'gallery4.png', 21)) v(source, position, path, image_key, score)"""


def _images(spark, sf_dir):
    """(listing_id, source, position, url) of what the listing pages name as images."""
    found = H.parse_pages(_listing_pages(spark, sf_dir), "listing_id", carry=("url",), fields=("images",)).select("listing_id", F.col("url").alias("_page"), F.inline("page.images"))
    # behind a generator, so that filters and scores use the address without making it again
    rows = found.select("listing_id", "source", "position", F.explode(F.array(H.absolute(F.col("_page"), F.col("url")))).alias("url"))
    return rows.where(X.is_image_url(F.col("url")))


@query("extract_image_candidates", f"SELECT listing_id, source, position, url FROM ({_IMG})")
def extract_image_candidates(spark, sf_dir):
    return _images(spark, sf_dir).select("listing_id", "source", "position", "url")


@query("fn_image_url", f"SELECT listing_id, position, image_key FROM ({_IMG})")
def fn_image_url(spark, sf_dir):
    return _images(spark, sf_dir).select("listing_id", "position", X.image_key(F.col("url")).alias("image_key"))


@query("fn_image_score", f"SELECT listing_id, position, score FROM ({_IMG})")
def fn_image_score(spark, sf_dir):
    return _images(spark, sf_dir).select("listing_id", "position", X.image_score(F.col("url"), F.col("source"), F.col("position")).alias("score"))


@query("topk_image_gallery", f"SELECT listing_id, position, url FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY score DESC, position) AS k FROM (SELECT *, row_number() OVER (PARTITION BY listing_id, image_key ORDER BY score DESC, position) AS j FROM ({_IMG})) WHERE j = 1) WHERE k <= 4")
def topk_image_gallery(spark, sf_dir):
    rows = _images(spark, sf_dir).withColumns({"score": X.image_score(F.col("url"), F.col("source"), F.col("position")), "image_key": X.image_key(F.col("url"))})
    unique = top_per_key(rows, ["listing_id", "image_key"], [F.desc("score"), F.col("position")], 1)
    return top_per_key(unique, ["listing_id"], [F.desc("score"), F.col("position")], 4).select("listing_id", "position", "url")
