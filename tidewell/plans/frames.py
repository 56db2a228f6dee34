"""Role frames: the driver's tables seen as listings, observations, samples and places.

Each frame is one SELECT in the dialect that Spark and DuckDB share, so a query
and its check start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

FRAMES = {
    # a listing in a market: orders of customers
    "listings": """
        SELECT o_orderkey AS listing_id, o_custkey AS property_id, 'src-' || CAST(o_orderkey AS STRING) AS source_listing_id,
          CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'relisted' ELSE 'removed' END AS listing_status,
          CASE WHEN o_orderkey % 17 <> 0 THEN CAST(floor(o_totalprice / 40) AS DOUBLE) END AS price_monthly,
          CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey % 6 AS INT) END AS bedrooms,
          CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'apartment' WHEN '2' THEN 'house' WHEN '3' THEN 'house_to_share' WHEN '5' THEN 'Apartment_To_Share' END AS housing_type,
          CASE o_orderkey % 4 WHEN 0 THEN 'entire' WHEN 1 THEN 'room' WHEN 2 THEN 'shared' END AS rental_structure,
          CASE o_orderkey % 5 WHEN 0 THEN 'fixed' WHEN 1 THEN 'Monthly' WHEN 2 THEN 'sublet' END AS lease_type,
          CASE o_orderkey % 7 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS is_sublet,
          CASE WHEN o_orderkey % 5 < 2 THEN true WHEN o_orderkey % 5 < 4 THEN false END AS furnished,
          CASE WHEN o_orderkey % 3 = 0 THEN true WHEN o_orderkey % 3 = 1 THEN false END AS utilities_included,
          CASE WHEN o_orderkey % 6 = 0 THEN true WHEN o_orderkey % 6 < 4 THEN false END AS parking_available,
          CASE WHEN o_orderkey % 8 = 0 THEN true WHEN o_orderkey % 8 < 4 THEN false END AS laundry,
          CASE o_orderkey % 5 WHEN 0 THEN 'summer' WHEN 1 THEN 'Summer_Only' WHEN 2 THEN 'non_summer' WHEN 3 THEN 'fall' END AS availability_category,
          CASE o_orderkey % 4 WHEN 0 THEN 'female' WHEN 1 THEN 'any' END AS preferred_gender,
          CASE o_orderkey % 3 WHEN 0 THEN 'no pets' WHEN 1 THEN 'Cats' END AS pet_policy,
          CASE o_orderkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'parsed' WHEN 2 THEN 'needs-review' END AS data_quality_status,
          concat(lower(c_mktsegment), ' place ', CAST(o_orderkey % 100 AS STRING)) AS title,
          concat(CAST(c_custkey % 400 + 1 AS STRING), ' ', c_mktsegment, CASE c_custkey % 3 WHEN 0 THEN ' Street' WHEN 1 THEN ' Ave' ELSE ' Road' END, CASE c_custkey % 5 WHEN 0 THEN ' Unit ' || CAST(c_custkey % 7 AS STRING) ELSE '' END, ', London') AS address,
          CASE o_orderkey % 4 WHEN 0 THEN 'wifi|laundry' WHEN 1 THEN 'parking' WHEN 2 THEN 'wifi|parking|gym' END AS amenities,
          CASE WHEN c_custkey % 19 <> 0 THEN 42.9e0 + (c_custkey * 7919 % 2000) / 10000e0 END AS latitude,
          CASE WHEN c_custkey % 19 <> 0 THEN -81.4e0 + (c_custkey * 10473 % 3000) / 10000e0 END AS longitude,
          CASE WHEN c_custkey % 23 <> 0 THEN (c_custkey * 31 % 200) / 10e0 END AS distance_km,
          o_orderkey % 8 <> 0 AS location_map_visible, o_orderkey % 6 <> 0 AS location_route_available,
          CASE o_orderkey % 5 WHEN 0 THEN 'excluded' WHEN 1 THEN 'partial' ELSE 'ranked' END AS ranking_status,
          CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey * 37 % 1001) / 10e0 END AS ranking_overall_score,
          CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey * 41 % 1001) / 10e0 END AS ranking_value_score,
          CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey * 43 % 1001) / 10e0 END AS ranking_campus_access_score,
          CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderkey * 47 % 1001) / 10e0 END AS ranking_transit_score,
          CASE WHEN o_orderkey % 10 <> 0 THEN (o_orderkey * 29 % 101) / 100e0 END AS geocode_confidence,
          o_orderdate AS last_seen_at
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    # history of an entity: events of users
    "observations": """
        SELECT event_id AS id, user_id AS listing_id, ts AS observed_at, CAST(ts AS DATE) AS run_day,
          CASE WHEN event_id % 9 <> 0 THEN CAST(floor(value) AS DOUBLE) END AS price_monthly,
          CASE event_type WHEN 'error' THEN 'removed' WHEN 'signup' THEN 'relisted' ELSE 'active' END AS listing_status,
          concat(event_type, ' ', CAST(event_id % 3 AS STRING)) AS title,
          CASE event_id % 4 WHEN 0 THEN concat('Rent is $', CAST(event_id % 50 AS STRING)) WHEN 1 THEN '  Now   Open ' WHEN 2 THEN 'now open' END AS description,
          props
        FROM events""",
    # travel samples of a profile: line items of a supplier and return flag
    "samples": """
        SELECT l_suppkey AS property_id, CASE l_returnflag WHEN 'A' THEN 'weekday_morning_commute' WHEN 'N' THEN 'weekday_midday' ELSE 'sunday_daytime' END AS time_period,
          l_shipdate AS departure_at, l_orderkey AS sample_id, l_linenumber AS sample_line,
          CASE WHEN l_linenumber <> 3 THEN CAST(l_quantity * 60 AS INT) END AS duration_seconds,
          CASE l_linenumber WHEN 3 THEN 'unavailable' WHEN 4 THEN 'estimated' WHEN 5 THEN 'error' ELSE 'available' END AS status,
          CAST(l_quantity * 20 AS INT) AS walking_duration_seconds, CAST(l_orderkey % 4 AS INT) AS transfer_count,
          CASE WHEN l_linenumber = 3 THEN CASE l_orderkey % 3 WHEN 0 THEN 'no_route' WHEN 1 THEN 'walking_better' ELSE 'no_route|timeout' END END AS diagnostic_codes
        FROM lineitem""",
    # profiles of a property by mode: line items again, one row per order line
    "profiles": """
        SELECT l_orderkey * 10 + l_linenumber AS profile_id, l_partkey AS property_id, CASE l_linestatus WHEN 'O' THEN 'hub' ELSE 'mall' END AS hotspot_id,
          CASE l_linenumber % 3 WHEN 0 THEN 'walking' WHEN 1 THEN 'cycling' ELSE 'transit' END AS travel_mode,
          CASE WHEN l_linenumber % 3 = 2 THEN 'weekday_morning_commute' END AS time_period,
          CASE WHEN l_suppkey % 10 <> 0 THEN CAST(l_quantity * 60 AS INT) END AS representative_duration_seconds,
          CASE l_orderkey % 5 WHEN 0 THEN 'straight_line' WHEN 1 THEN 'cached_exact_property' ELSE 'exact_route' END AS result_type,
          CASE l_orderkey % 4 WHEN 0 THEN 'partial' ELSE 'complete' END AS quality_status,
          CASE l_orderkey % 3 WHEN 0 THEN 'n1' WHEN 1 THEN 'n2' END AS network_version, CASE l_orderkey % 2 WHEN 0 THEN 's1' END AS schedule_version,
          l_orderkey % 7 = 0 AS is_stale, l_shipdate AS calculated_at, CASE WHEN l_orderkey % 6 <> 0 THEN l_shipdate + INTERVAL '180' DAY END AS expires_at
        FROM lineitem""",
    # pages of listings as a site would serve them: markup in scripts and comments, tags left open, references, a value left out
    "listing_pages": """
        SELECT o_orderkey AS listing_id, concat('https://homes.example/rent/', CAST(o_orderkey AS STRING), '?from=list') AS url,
          concat('<!DOCTYPE html><HTML lang="en-CA"><head><meta property="og:image" content="/media/', CAST(o_orderkey AS STRING), '/cover-photo.jpg"><title>Listing ', CAST(o_orderkey AS STRING), ' &amp; more</title>',
            '<style>@import url(/media/style.jpg); </p> <h3></style><script>var t="</p><h3>Housing Type</h3><p>castle</p>";</script></head><body><nav><a href="/home"><img src="/media/site-logo.png" alt="home"></a></nav>',
            '<!-- <h2>1 Old Road $1</h2><h3>Bedroom(s)</h3><p>99</p> --><h2>', CAST(o_custkey AS STRING), ' King &amp; Queen Street <b>', CASE WHEN o_orderkey % 17 <> 0 THEN concat('$', CAST(CAST(floor(o_totalprice / 40) AS BIGINT) AS STRING)) ELSE 'ask' END, '</b> View Map</h2>',
            '<h3>Housing&nbsp;Type</h3><p>', CASE WHEN o_orderkey % 5 <> 0 THEN concat(lower(o_orderpriority), ' <i>home</i>') ELSE '' END, '<h3>Bedroom(s)</h3><div class=v><span>', CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey % 6 AS STRING) ELSE ' ' END, '</span></div>',
            '<h3>Lease Term</h3><p> ', CAST(o_orderkey % 12 + 1 AS STRING), '  months </p><p>from May', CASE WHEN o_orderkey % 2 = 0 THEN '<h3>Lease Term</h3><p>none' ELSE '' END,
            '<h3>Tenant Type</h3><p>Any</p><p>Bright &lt;corner&gt; room ', CAST(o_orderkey AS STRING), '<br>near <a href="map.png">transit</a></p>',
            CASE WHEN o_orderkey % 3 <> 0 THEN concat('<h3>Amenities</h3><ul><li>wifi<li>gym<li>wifi', CASE WHEN o_orderkey % 2 = 0 THEN '<li>parking' ELSE '' END, '</ul>') ELSE '' END,
            '<h3>Contact Landlord</h3><p>Your contact is</p><p>Ann O&#39;Neil ', CAST(o_custkey AS STRING), '</p><p>Call: 519-555-', CAST(1000 + o_custkey % 9000 AS STRING), '</p>',
            '<img src="/media/', CAST(o_orderkey AS STRING), '/photo1.jpg?w=9" data-src=/media/', CAST(o_orderkey AS STRING), '/photo2.jpg srcset="/media/', CAST(o_orderkey AS STRING), '/photo1-thumb.jpg 320w, //cdn.example/', CAST(o_orderkey AS STRING), '/photo3.webp 2x">',
            '<div style="background: url( gallery4.png )"></div>', CASE WHEN o_orderkey % 7 <> 0 THEN '<footer>&copy; homes</footer></body></html>' ELSE '<foot' END) AS html
        FROM orders""",
    # origins of travel: four customers to a building, its door 2, 13 or 78 m away; a stop for twelve
    "origins": """
        SELECT c_custkey AS property_id,
          CASE WHEN c_custkey % 19 <> 0 THEN 42.9e0 + (CAST(floor(c_custkey / 4) AS BIGINT) * 7919 % 2000) / 10000e0 + CASE c_custkey % 4 WHEN 0 THEN 0e0 WHEN 1 THEN 0.00002e0 WHEN 2 THEN 0.00012e0 ELSE 0.0007e0 END END AS latitude,
          CASE WHEN c_custkey % 19 <> 0 THEN -81.4e0 + (CAST(floor(c_custkey / 4) AS BIGINT) * 10473 % 3000) / 10000e0 END AS longitude,
          CASE WHEN c_custkey % 10 <> 0 THEN concat('s', CAST(CAST(floor(c_custkey / 12) AS BIGINT) AS STRING)) END AS nearest_stop_id,
          CASE WHEN c_custkey % 11 <> 0 THEN 60 + c_custkey % 7 * 30 END AS walking_to_stop_seconds
        FROM customer""",
    # destinations, one of unknown place
    "hotspots": "SELECT concat('h', CAST(r_regionkey AS STRING)) AS hotspot_id, CASE WHEN r_regionkey <> 4 THEN 42.95e0 + r_regionkey / 50e0 END AS latitude, CASE WHEN r_regionkey <> 4 THEN -81.3e0 + r_regionkey / 40e0 END AS longitude FROM region",
    # every origin to every destination by every mode
    "travel_requests": """
        SELECT c_custkey * 100 + r_regionkey * 10 + m AS request_id, c_custkey AS property_id, concat('h', CAST(r_regionkey AS STRING)) AS hotspot_id,
          CASE m WHEN 0 THEN 'walking' WHEN 1 THEN 'cycling' ELSE 'transit' END AS travel_mode, CASE m WHEN 2 THEN 'weekday_morning_commute' END AS time_period, 'n1' AS network_version
        FROM customer CROSS JOIN region CROSS JOIN (VALUES (0), (1), (2)) modes(m)""",
    # stored profiles of those origins: one order each, some calculated when the door was elsewhere
    "travel_profiles": """
        SELECT o_orderkey AS profile_id, CASE WHEN o_orderkey % 6 <> 0 THEN o_custkey END AS property_id, o_custkey AS origin_id, o_orderkey % 9 = 0 AS moved, o_orderkey % 31 = 0 AS unlocated,
          concat('h', CAST(CAST(floor(o_orderkey / 3) AS BIGINT) % 5 AS STRING)) AS hotspot_id,
          CASE o_orderkey % 3 WHEN 0 THEN 'walking' WHEN 1 THEN 'cycling' ELSE 'transit' END AS travel_mode, CASE o_orderkey % 3 WHEN 2 THEN 'weekday_morning_commute' END AS time_period,
          CASE WHEN o_orderkey % 10 = 1 THEN 'n0' ELSE 'n1' END AS network_version,
          CASE WHEN o_orderkey % 13 <> 0 THEN 300 + o_orderkey % 1500 END AS duration, CASE WHEN o_orderkey % 13 <> 0 THEN 30 + o_orderkey % 1500 END AS shortest, CASE WHEN o_orderkey % 13 <> 0 THEN 420 + o_orderkey % 1500 END AS longest,
          1000 + o_orderkey % 5000 AS distance, CASE WHEN o_orderkey % 3 = 2 THEN 90 + o_orderkey % 200 END AS walking,
          CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 0e0 ELSE (50 + o_orderkey % 50) / 100e0 END AS confidence,
          CASE WHEN o_orderkey % 3 = 2 AND o_orderkey % 7 <> 0 THEN 200 + o_orderkey % 900 END AS to_destination, CASE WHEN o_orderkey % 4 <> 0 THEN 45 + o_orderkey % 100 END AS origin_walk,
          o_orderdate AS calculated_at, o_orderkey % 7 = 0 AS is_stale, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate + INTERVAL '1500' DAY END AS expires_at
        FROM orders""",
    # places on a plane of metres: parts and customers
    "stops": "SELECT s_suppkey AS stop_id, CAST(s_suppkey * 7919 % 10007 AS DOUBLE) AS x, CAST(s_suppkey * 10473 % 10009 AS DOUBLE) AS y FROM supplier",
    "places": "SELECT c_custkey AS place_id, CAST(c_custkey * 5231 % 10007 AS DOUBLE) AS x, CAST(c_custkey * 8929 % 10009 AS DOUBLE) AS y FROM customer",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A role frame over the tables of sf_dir."""
    used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", FRAMES[name])]
    text = FRAMES[name]
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: load(spark, sf_dir, t) for t in used})


def with_frames(sql: str) -> str:
    """The SQL with the role frames that it names as common table expressions."""
    used = [n for n in FRAMES if re.search(rf"\b{n}\b", sql)]
    head = ", ".join(f"{n} AS ({FRAMES[n]})" for n in used)
    sql = sql.strip()
    if not head:
        return sql
    if (rest := re.match(r"WITH( RECURSIVE)?\s", sql)) is not None:
        return f"WITH{rest[1] or ''} {head}, {sql[rest.end():]}"
    return f"WITH {head} {sql}"
