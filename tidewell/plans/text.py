"""Parsing and normalizing, over notices derived from orders and customers, pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import addresses as A
from ..functions import text as T
from .frames import FRAMES, frame, load
from .registry import query

FRAMES["notices"] = """
    SELECT o_orderkey AS id,
      CASE o_orderkey % 8 WHEN 0 THEN ' NaN ' WHEN 1 THEN 'None' WHEN 2 THEN '  Quiet   street ' WHEN 3 THEN '' WHEN 4 THEN 'yes' WHEN 5 THEN 'No' WHEN 6 THEN '1,250.50' ELSE CAST(o_orderkey % 97 AS STRING) END AS field,
      CASE o_orderkey % 6 WHEN 0 THEN concat('$', CAST(400 + o_custkey % 900 AS STRING), ' per month plus utilities') WHEN 1 THEN concat('only $1,', CAST(100 + o_custkey % 800 AS STRING), '/week, all utilities included') WHEN 2 THEN concat('$', CAST(20 + o_custkey % 80 AS STRING), ' a night. heat included') WHEN 3 THEN 'monthly cleaning, call for price' WHEN 4 THEN concat('Rent $', CAST(o_custkey % 3000 AS STRING), '.50 utilities extra') END AS price_text,
      CASE o_orderkey % 5 WHEN 0 THEN concat(CAST(o_custkey % 300 + 1 AS STRING), ' Richmond Street North, London, ON, Canada') WHEN 1 THEN concat('Apt ', CAST(o_custkey % 9 + 1 AS STRING), ', ', CAST(o_custkey % 300 + 1 AS STRING), ' Oxford Road, London') WHEN 2 THEN concat(CAST(o_custkey % 30 + 1 AS STRING), '-', CAST(o_custkey % 300 + 1 AS STRING), ' Talbot Avenue') WHEN 3 THEN concat(CAST(o_custkey % 300 + 1 AS STRING), ' King Crescent Unit ', CAST(o_custkey % 9 AS STRING)) ELSE '' END AS address,
      CASE o_orderkey % 4 WHEN 0 THEN 'Wifi|Parking|(2)|Gym' WHEN 1 THEN 'Parking (1)|Utilities Incl' WHEN 2 THEN '["b","A","b"]' WHEN 3 THEN 'wifi, gym ,wifi' END AS tokens,
      CASE o_orderkey % 9 WHEN 0 THEN 'Available May to August, 4 month sublet near bus 2 and route 27' WHEN 1 THEN 'females only, no smoking, 1 year lease' WHEN 2 THEN 'Quiet students, no parking' WHEN 3 THEN 'Nov - Feb stay, month to month, 3 parking spaces' WHEN 4 THEN 'Fully furnished, 2.5 km to campus, move in now' WHEN 5 THEN 'unfurnished, smokers ok, family home' WHEN 6 THEN 'for men only, 16 months, bus 2, bus 9, bus 2' END AS description,
      CASE o_orderkey % 7 WHEN 0 THEN 'House to Share' WHEN 1 THEN 'Town home' WHEN 2 THEN 'Bachelor  Apt' WHEN 3 THEN 'luxury condo' WHEN 4 THEN 'basement apt' WHEN 5 THEN 'Loft Space' END AS category,
      CASE o_orderkey % 4 WHEN 0 THEN 'Female' WHEN 1 THEN 'any gender' WHEN 2 THEN 'men' END AS gender,
      CASE o_orderkey % 3 WHEN 0 THEN concat('https://www.homes.example/listing/', CAST(o_orderkey AS STRING), '?x=1') WHEN 1 THEN concat('http://other.example/listing/', CAST(o_orderkey AS STRING)) ELSE 'HTTPS://homes.example/listing/77/photos' END AS url
    FROM orders"""


def _notices(spark, sf_dir):
    return frame(spark, sf_dir, "notices")


def _text(name: str, sql: str, columns):
    """A query over notices with the id and the given columns."""

    @query(name, f"SELECT id, {sql} FROM notices")
    def run(spark, sf_dir):
        return _notices(spark, sf_dir).select("id", *(c.alias(n) for n, c in columns().items()))


_CLEAN = "CASE WHEN lower(trim(field)) NOT IN ('', 'nan', 'none', 'null', 'nat') THEN trim(field) END"
_text("fn_clean_text", f"{_CLEAN} AS cleaned", lambda: dict(cleaned=T.clean_text(F.col("field"))))
#: Given texts with what only the compatibility form and folding make equal.
FRAMES["written"] = """
    SELECT doc_id AS id, concat(CASE doc_id % 6 WHEN 0 THEN 'ＦＵＬＬ　Ｗｉｄｔｈ １２ ' WHEN 1 THEN 'ﬁne ﬂat oﬃce ' WHEN 2 THEN 'STRASSE Straße ẞ ' WHEN 3 THEN '½ ² № ℃ ' WHEN 4 THEN ' Ⅷ　ǆ K ' ELSE '' END, CASE WHEN doc_id % 11 = 0 THEN '' ELSE text END) AS raw
    FROM documents"""
_WIDE = "'ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ０１２３４５６７８９　', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789 '"
_PARTS = "raw"
for _old, _new in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ß", "ss"), ("ẞ", "ss"), ("½", "1⁄2"), ("²", "2"), ("№", "No"), ("℃", "°c"), ("Ⅷ", "viii"), ("ǆ", "dž"), ("K", "k")):
    _PARTS = f"replace({_PARTS}, '{_old}', '{_new}')"


@query("fn_comparison_text", f"SELECT id, nullif(trim(regexp_replace(lower(translate({_PARTS}, {_WIDE})), '\\s+', ' ', 'g')), '') AS compared FROM written")
def fn_comparison_text(spark, sf_dir):
    return frame(spark, sf_dir, "written").select("id", T.comparison_text(F.col("raw")).alias("compared"))


_BOOL = f"CASE WHEN lower({_CLEAN}) IN ('true', '1', 'yes', 'y', 't') THEN true WHEN lower({_CLEAN}) IN ('false', '0', 'no', 'n', 'f') THEN false END"
_text("fn_parse_bool", f"{_BOOL} AS parsed, CASE WHEN {_CLEAN} IS NOT NULL AND {_BOOL} IS NULL THEN 'invalid_boolean' END AS issue", lambda: dict(parsed=T.parse_bool(F.col("field"))[0], issue=T.parse_bool(F.col("field"))[1]))
_NUM = f"TRY_CAST(replace({_CLEAN}, ',', '') AS DOUBLE)"
_text("fn_parse_number", f"{_NUM} AS parsed, CASE WHEN {_CLEAN} IS NOT NULL AND {_NUM} IS NULL THEN 'invalid_number' END AS issue, CASE WHEN {_NUM} = floor({_NUM}) THEN {_NUM} END AS whole",
      lambda: dict(parsed=T.parse_number(F.col("field"))[0], issue=T.parse_number(F.col("field"))[1], whole=T.parse_number(F.col("field"), True)[0]))
_text("fn_money_decimal", f"CAST(TRY_CAST(regexp_replace(upper({_CLEAN}), 'CAD|[$,\\s]', '', 'g') AS DECIMAL(12,2)) AS DOUBLE) AS amount", lambda: dict(amount=T.money(F.col("field")).cast("double")))
_text("fn_parse_list", "CASE id % 4 WHEN 0 THEN '(2);Gym;Parking;Wifi' WHEN 1 THEN 'Parking (1);Utilities Incl' WHEN 2 THEN 'A;b' ELSE 'gym;wifi' END AS items", lambda: dict(items=F.array_join(T.parse_list(F.col("tokens")), ";")))
_text("fn_source_url", "CASE WHEN regexp_matches(url, '^(?i:https?)://(?:www\\.)?homes\\.example/listing/(\\d+)') THEN 'https://homes.example/listing/' || regexp_extract(url, '/listing/(\\d+)', 1) END AS canonical, CASE WHEN regexp_matches(url, '^(?i:https?)://(?:www\\.)?homes\\.example/listing/(\\d+)') THEN CAST(regexp_extract(url, '/listing/(\\d+)', 1) AS BIGINT) END AS source_id",
      lambda: dict(canonical=T.source_url(F.col("url"), r"homes\.example", "/listing/")[0], source_id=T.source_url(F.col("url"), r"homes\.example", "/listing/")[1]))
_STREET = """CASE WHEN address LIKE 'Apt %' THEN regexp_replace(address, '^Apt \\d, (\\d+) Oxford Road, London$', '\\1 oxford rd london') WHEN address LIKE '%Richmond%' THEN regexp_extract(address, '^\\d+') || ' richmond st north'
  WHEN address LIKE '%Talbot%' THEN regexp_extract(address, '-(\\d+) ', 1) || ' talbot ave' WHEN address LIKE '%King%' THEN regexp_extract(address, '^\\d+') || ' king crescent' END"""
_OWN_UNIT = "CASE WHEN address LIKE 'Apt %' THEN 'apt:' || regexp_extract(address, '^Apt (\\d)', 1) WHEN address LIKE '%Talbot%' THEN 'unit:' || regexp_extract(address, '^(\\d+)-', 1) WHEN address LIKE '%King%' THEN 'unit:' || regexp_extract(address, 'Unit (\\d)', 1) END"


@query("fn_normalize_address", f"""WITH p AS (SELECT id, {_STREET} AS street, {_OWN_UNIT} AS unit, address <> '' AS complete, address LIKE '%Canada' OR (address <> '' AND id % 2 = 0) AS sure FROM notices)
  SELECT id, street, unit, false AS ambiguous, complete, CASE WHEN sure THEN street || '|' || coalesce(unit, 'no-unit') || '|london|on|ca' END AS match_key FROM p""")
def fn_normalize_address(spark, sf_dir):
    """Every second address has a geocode that is sure of its city."""
    rows = _notices(spark, sf_dir).select("id", A.address_parts(F.col("address")).alias("p"))
    geocoded = lambda value: F.when(F.col("id") % 2 == 0, F.lit(value))
    _, key = A.property_key(F.col("p"), geocoded("London"), geocoded("CA"), geocoded("ok"), geocoded(0.9), geocoded(42.9), geocoded(-81.2))
    return rows.select("id", "p.street", "p.unit", "p.ambiguous", "p.complete", key.alias("match_key"))


# every street word and direction, with and without a unit; the SQL names the short forms literally
_WORDS = "('STREET', 'ST'), ('AVENUE', 'AVE'), ('ROAD', 'RD'), ('DRIVE', 'DR'), ('COURT', 'CT'), ('PLACE', 'PL'), ('CRESCENT', 'CRES'), ('BOULEVARD', 'BLVD'), ('LANE', 'LN'), ('TERRACE', 'TER'), ('WAY', 'WAY'), ('PARK', 'PARK')"
_WINDS = "('', ''), (' North', ' N'), (' SOUTH', ' S'), (' east', ' E'), (' w', ' W')"
_UNITS = "('', NULL), (', Unit 4', '4'), (' #12-B', '12-B'), (' apt. 7', '7')"


@query("fn_normalize_civic", f"SELECT c_custkey, long || wind || tail AS suffix, c_custkey || ' OLD QUEEN ' || short || brief AS civic, unit FROM customer, (VALUES {_WORDS}) w(long, short), (VALUES {_WINDS}) d(wind, brief), (VALUES {_UNITS}) u(tail, unit)")
def fn_normalize_civic(spark, sf_dir):
    parts = [spark.sql(f"SELECT * FROM VALUES {values} AS t({name}, _{name})").drop(f"_{name}") for name, values in (("word", _WORDS), ("wind", _WINDS), ("tail", _UNITS))]
    suffixes = parts[0].join(parts[1]).join(parts[2]).select(F.concat("word", "wind", "tail").alias("suffix"))
    # the customers are one small file, so they are dealt out before each becomes 240 addresses
    rows = load(spark, sf_dir, "customer").select("c_custkey").repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey").join(F.broadcast(suffixes))
    civic = A.civic_parts(F.concat_ws(" ", F.col("c_custkey").cast("string"), F.lit("Old  Queen"), "suffix"))
    return rows.select("c_custkey", "suffix", civic["civic"].alias("civic"), civic["unit"].alias("unit"))


_text("fn_geocode_query", "CASE id % 5 WHEN 0 THEN address || ', Ontario' WHEN 1 THEN address || ', Ontario, Canada' WHEN 2 THEN address || ', London, Ontario, Canada' WHEN 3 THEN address || ', London, Ontario, Canada' END AS q", lambda: dict(q=T.geocode_query(F.col("address"))))
_AMT = "TRY_CAST(nullif(replace(regexp_extract(price_text, '\\$\\s*([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(\\.[0-9]{2})?', 1), ',', '') || regexp_extract(price_text, '\\$\\s*([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(\\.[0-9]{2})?', 2), '') AS DOUBLE)"
_PER = "CASE id % 6 WHEN 0 THEN 'month' WHEN 1 THEN 'week' WHEN 2 THEN 'day' END"
_text("fn_price_parse", f"{_AMT} AS amount, {_PER} AS period", lambda: dict(amount=T.price_amount(F.col("price_text")), period=T.price_period(F.col("price_text"))))
_text("fn_price_monthly", f"CASE {_PER} WHEN 'month' THEN {_AMT} WHEN 'week' THEN round({_AMT} * 52 / 12, 2) WHEN 'day' THEN round({_AMT} * 365 / 12, 2) END AS monthly", lambda: dict(monthly=T.price_monthly(T.price_amount(F.col("price_text")), T.price_period(F.col("price_text")))))
_text("fn_housing_type", "CASE id % 7 WHEN 0 THEN 'house_to_share' WHEN 1 THEN 'townhouse' WHEN 2 THEN 'bachelor_apartment' WHEN 3 THEN 'condo' WHEN 4 THEN 'apartment' WHEN 5 THEN 'loft_space' END AS kind", lambda: dict(kind=T.housing_type(F.col("category"))))
_text("fn_gender_pref", "CASE id % 4 WHEN 0 THEN CASE WHEN id % 9 = 1 THEN 'female_only' ELSE 'female_preferred' END WHEN 1 THEN 'any' WHEN 2 THEN CASE WHEN id % 9 = 6 THEN 'male_only' ELSE 'male_preferred' END ELSE CASE id % 9 WHEN 1 THEN 'female_only' WHEN 6 THEN 'male_only' ELSE 'not_specified' END END AS preference", lambda: dict(preference=T.gender_preference(F.col("gender"), F.col("description"))))
_text("fn_keyword_flags", "CASE id % 9 WHEN 1 THEN false WHEN 5 THEN true END AS smoking, CASE WHEN id % 9 = 4 THEN true END AS available_now, CASE id % 9 WHEN 2 THEN 'student' WHEN 5 THEN 'family' ELSE 'not_specified' END AS tenant",
      lambda: dict(smoking=T.says(F.col("description"), r"smoking allowed|smokers ok|smoker friendly", r"non-smoking|no smoking|smoke ?free"), available_now=T.says(F.col("description"), r"immediate|available now|move in now|asap"),
      tenant=F.when(F.lower("description").contains("student"), "student").when(F.lower("description").contains("professional"), "professional").when(F.lower("description").contains("family"), "family").otherwise("not_specified")))
_text("fn_parking", "CASE WHEN id % 4 < 2 THEN true WHEN id % 9 = 2 THEN false WHEN id % 9 = 3 THEN true END AS available, CASE WHEN id % 4 = 0 THEN 2 WHEN id % 4 = 1 THEN 1 WHEN id % 9 = 3 THEN 3 END AS spaces",
      lambda: dict(available=T.parking(F.split("tokens", r"\|"), F.col("description"))[0], spaces=T.parking(F.split("tokens", r"\|"), F.col("description"))[1]))
_text("fn_utilities", "CASE WHEN id % 4 = 1 THEN 'all_included' ELSE CASE id % 6 WHEN 0 THEN 'not_included' WHEN 1 THEN 'all_included' WHEN 2 THEN 'partially_included' WHEN 4 THEN 'not_included' END END AS status", lambda: dict(status=T.utilities(F.lit(None).cast("string"), F.split("tokens", r"\|"), F.col("price_text"))))
_text("fn_sublet_furnished_bath", "CASE WHEN id % 9 = 0 THEN true END AS sublet, CASE id % 9 WHEN 4 THEN true WHEN 5 THEN false END AS furnished", lambda: dict(sublet=T.says(F.col("description"), r"\bsublets?\b|\bsublease\b"), furnished=T.says(F.col("description"), r"\bfurnished\b", r"\bunfurnished\b|not furnished")))
_text("fn_lease_term_type", "CASE id % 9 WHEN 0 THEN 4 WHEN 1 THEN 12 WHEN 6 THEN 16 END AS months, CASE id % 9 WHEN 0 THEN 'sublet' WHEN 1 THEN 'yearly' WHEN 3 THEN 'month_to_month' WHEN 6 THEN 'yearly' END AS lease", lambda: dict(months=T.lease_months(F.col("description")), lease=T.lease_type(F.col("description"))))
_text("fn_month_interval", "CASE id % 9 WHEN 0 THEN '5,6,7,8' WHEN 3 THEN '11,12,1,2' END AS months, CASE id % 9 WHEN 0 THEN 'summer_only' WHEN 3 THEN 'non_summer' END AS season",
      lambda: dict(months=F.array_join(T.month_interval(F.col("description")).cast("array<string>"), ","), season=T.summer_overlap(T.month_interval(F.col("description")))))
_text("fn_extract_misc", "CASE id % 9 WHEN 0 THEN '2,27' WHEN 6 THEN '2,9' ELSE '' END AS routes, CASE WHEN id % 9 = 4 THEN 2.5e0 END AS km", lambda: dict(routes=F.array_join(T.transit_routes(F.col("description")), ","), km=T.distance_km(F.col("description"))))
_text("fn_address_conflict", """CASE WHEN address = '' THEN false WHEN regexp_extract(address, '\\d+') = '' THEN false ELSE list_has_any(regexp_extract_all(address, '\\d+'), ['7', '12']) = false OR id % 5 <> 0 END AS conflict""",
      lambda: dict(conflict=T.address_conflict(F.col("address"), F.lit("7/12 Richmond Street North, London, ON, Canada"))))


@query("redact_raw", """SELECT c_custkey, concat(chr(123), '"name":"', regexp_replace(c_name, '[0-9]{9,}', '[digits]', 'g'), '","api_key":"[redacted]"', chr(125)) AS redacted FROM customer""")
def redact_raw(spark, sf_dir):
    rows = load(spark, sf_dir, "customer")
    raw = F.create_map(F.lit("name"), F.col("c_name"), F.lit("api_key"), F.col("c_mktsegment"))
    return rows.select("c_custkey", F.to_json(T.redact(raw)).alias("redacted"))
