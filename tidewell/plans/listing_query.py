"""The listing query surface: filters, pages, markers, facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import filters as P
from ..operators import projections as V
from ..operators import sorts as O
from ..operators.filters import ListingQuery
from .frames import frame, load
from .registry import query

_COMMUTE = """v AS (SELECT *, row_number() OVER (PARTITION BY property_id, travel_mode, time_period ORDER BY calculated_at DESC, profile_id DESC) AS k FROM profiles
  WHERE hotspot_id = 'hub' AND network_version IS NOT DISTINCT FROM 'n1' AND (travel_mode <> 'transit' OR schedule_version IS NOT DISTINCT FROM 's1') AND NOT is_stale AND (expires_at IS NULL OR expires_at > TIMESTAMP '1998-06-01 00:00:00')),
 w AS (SELECT DISTINCT property_id FROM v WHERE k = 1 AND travel_mode = 'walking' AND time_period IS NULL AND result_type IN ('exact_route', 'cached_exact_property', 'cached_exact_origin') AND quality_status = 'complete' AND representative_duration_seconds <= 1800),
 t AS (SELECT DISTINCT property_id FROM v WHERE k = 1 AND travel_mode = 'transit' AND time_period = 'weekday_morning_commute' AND result_type IN ('exact_route', 'cached_exact_property', 'cached_exact_origin') AND quality_status = 'complete' AND representative_duration_seconds <= 1800)"""
_CONTEXT = P.AccessContext("hub", "1998-06-01 00:00:00", "n1", "s1")


def _filtered(name: str, where: str, asked: ListingQuery) -> None:
    @query(name, f"SELECT listing_id FROM listings WHERE {where}")
    def run(spark, sf_dir):
        return frame(spark, sf_dir, "listings").where(asked.predicate()).select("listing_id")


_filtered("filter_ids", "listing_id IN (1, 7, 42, 900)", ListingQuery(listing_ids=(1, 7, 42, 7, 900)))
_filtered("filter_range_nullsafe", "price_monthly >= 800 AND price_monthly <= 2400", ListingQuery(min_price=800, max_price=2400))
_filtered("filter_equality", "bedrooms = 2 AND furnished = true AND laundry = false AND location_map_visible = true", ListingQuery(bedrooms=2, furnished=True, laundry=False, location_map_visible=True))
_filtered("filter_text_ci", "lower(coalesce(housing_type, '')) = 'apartment_to_share' AND lower(coalesce(lease_type, '')) = 'monthly' AND lower(coalesce(pet_policy, '')) = 'cats'", ListingQuery(housing_type="apartment_to_share", lease_type="monthly", pet_policy="CATS"))
_filtered("filter_search", "contains(lower(concat_ws(' ', title, address, housing_type, lease_type, amenities)), 'gym')", ListingQuery(search=" Gym "))
_filtered("filter_set_membership", "housing_type IN ('house_to_share', 'apartment_to_share')", ListingQuery(roommates_wanted=True))
_filtered("filter_score_bounds", "ranking_overall_score >= 40 AND ranking_overall_score <= 90 AND ranking_value_score >= 20 AND ranking_campus_access_score >= 10 AND ranking_transit_score >= 10", ListingQuery(min_score=40, max_score=90, min_value_score=20, min_campus_access_score=10, min_transit_score=10))
_filtered("filter_max_distance", "distance_km <= 5.5", ListingQuery(max_distance_km=5.5))


@query("filter_tristate_season", "SELECT listing_id, coalesce(is_sublet, CASE WHEN lower(coalesce(availability_category, '')) IN ('summer', 'summer_only', 'summer_available') THEN true WHEN lower(coalesce(availability_category, '')) = 'non_summer' THEN false END) AS summer FROM listings")
def filter_tristate_season(spark, sf_dir):
    return frame(spark, sf_dir, "listings").select("listing_id", P.summer(F.col("is_sublet")).alias("summer"))


@query("filter_commute_exists", f"WITH {_COMMUTE} SELECT listing_id FROM listings WHERE location_route_available AND property_id IN (SELECT property_id FROM w)")
def filter_commute_exists(spark, sf_dir):
    latest = P.latest_profiles(frame(spark, sf_dir, "profiles"), _CONTEXT)
    return P.within_commute(frame(spark, sf_dir, "listings"), latest, "walking", 30).select("listing_id")


@query("join_commute_intersect", f"WITH {_COMMUTE} SELECT listing_id FROM listings WHERE location_route_available AND property_id IN (SELECT property_id FROM w) AND property_id IN (SELECT property_id FROM t)")
def join_commute_intersect(spark, sf_dir):
    latest = P.latest_profiles(frame(spark, sf_dir, "profiles"), _CONTEXT)
    near = P.within_commute(frame(spark, sf_dir, "listings"), latest, "walking", 30)
    return P.within_commute(near, latest, "transit", 30, "weekday_morning_commute").select("listing_id")


@query("filter_visible_markers", "SELECT listing_id, latitude, longitude, price_monthly FROM listings WHERE location_map_visible AND latitude IS NOT NULL AND longitude IS NOT NULL")
def filter_visible_markers(spark, sf_dir):
    return frame(spark, sf_dir, "listings").where("location_map_visible and latitude is not null and longitude is not null").select("listing_id", "latitude", "longitude", "price_monthly")


@query("filter_current_version", "SELECT profile_id FROM profiles WHERE network_version IS NOT DISTINCT FROM 'n1' AND (travel_mode <> 'transit' OR schedule_version IS NOT DISTINCT FROM 's1') AND NOT is_stale AND (expires_at IS NULL OR expires_at > TIMESTAMP '1998-06-01 00:00:00')")
def filter_current_version(spark, sf_dir):
    return frame(spark, sf_dir, "profiles").where(P.current_version(_CONTEXT)).select("profile_id")


@query("filter_url_rows", "SELECT DISTINCT url FROM pages WHERE url IS NOT NULL AND contains(url, '/en/')")
def filter_url_rows(spark, sf_dir):
    return load(spark, sf_dir, "pages").where(F.col("url").contains("/en/")).select("url").dropDuplicates(["url"])


@query("sort_page_total", "SELECT listing_id, price_monthly, rank_no, total FROM (SELECT listing_id, price_monthly, row_number() OVER (ORDER BY price_monthly ASC NULLS LAST, listing_id) AS rank_no, count(*) OVER () AS total FROM listings WHERE furnished) WHERE rank_no > 40 AND rank_no <= 60")
def sort_page_total(spark, sf_dir):
    rows = frame(spark, sf_dir, "listings").where(ListingQuery(furnished=True).predicate())
    found = O.page(rows, "price_low", 20, 40).select("listing_id", "price_monthly")
    numbered = found.withColumn("rank_no", F.row_number().over(O.Window.orderBy(*O.sort_order("price_low"))) + 40)
    return numbered.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


@query("agg_global_stats", "SELECT count(*) AS total, count(*) FILTER (WHERE location_map_visible) AS map_ready, round(avg(price_monthly), 4) AS average_price FROM listings")
def agg_global_stats(spark, sf_dir):
    return frame(spark, sf_dir, "listings").agg(F.count("*").alias("total"), F.count_if("location_map_visible").alias("map_ready"), F.round(F.avg("price_monthly"), 4).alias("average_price"))


@query("agg_facets", "SELECT field, value, count(*) AS n FROM (SELECT 'housing_type' AS field, housing_type AS value FROM listings UNION ALL SELECT 'lease_type', lease_type FROM listings UNION ALL SELECT 'bedrooms', CAST(bedrooms AS VARCHAR) FROM listings) WHERE value IS NOT NULL GROUP BY 1, 2")
def agg_facets(spark, sf_dir):
    return A.facets(frame(spark, sf_dir, "listings"), ["housing_type", "lease_type", "bedrooms"])


@query("agg_map_clusters", "SELECT floor(latitude * 100) AS lat_cell, floor(longitude * 100) AS lon_cell, count(*) AS n, min(price_monthly) AS cheapest, min(listing_id) AS first_id FROM listings WHERE location_map_visible AND latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1, 2")
def agg_map_clusters(spark, sf_dir):
    rows = frame(spark, sf_dir, "listings").where("location_map_visible and latitude is not null and longitude is not null")
    return V.map_clusters(rows, 2)


@query("sort_cluster_members", """SELECT cell, string_agg(CAST(listing_id AS VARCHAR), ',' ORDER BY price_monthly ASC NULLS LAST, title, listing_id) AS members FROM
  (SELECT *, property_id AS cell FROM listings) GROUP BY cell""")
def sort_cluster_members(spark, sf_dir):
    rows = frame(spark, sf_dir, "listings").withColumn("cell", F.col("property_id"))
    entry = F.struct(F.col("price_monthly").isNull().alias("a"), F.col("price_monthly").alias("b"), F.col("title").alias("c"), F.col("listing_id").alias("d"))
    return rows.groupBy("cell").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.d.cast("string")), ",").alias("members"))


@query("project_summary", "SELECT listing_id, title, price_monthly, housing_type, concat(ranking_status, ':', coalesce(CAST(CAST(ranking_overall_score * 10 AS INT) AS VARCHAR), '-')) AS ranking FROM listings")
def project_summary(spark, sf_dir):
    return V.public_summary(frame(spark, sf_dir, "listings")).select("listing_id", "title", "price_monthly", "housing_type", F.concat("ranking.status", F.lit(":"), F.coalesce((F.col("ranking.overall") * 10).cast("int").cast("string"), F.lit("-"))).alias("ranking"))


@query("project_markers", "SELECT listing_id, latitude, longitude, price_monthly FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY listing_id) AS k FROM listings WHERE location_map_visible AND latitude IS NOT NULL AND longitude IS NOT NULL) WHERE k = 1")
def project_markers(spark, sf_dir):
    return V.markers(frame(spark, sf_dir, "listings"))


_MASK = "CASE WHEN location_map_visible AND latitude IS NOT NULL AND coalesce(geocode_confidence, 0) >= 0.8 THEN 'verified' WHEN latitude IS NOT NULL THEN 'hidden' ELSE 'unavailable' END"


@query("mask_location", f"SELECT listing_id, {_MASK} AS location_status, CASE WHEN {_MASK} = 'verified' THEN latitude END AS latitude, CASE WHEN {_MASK} = 'verified' THEN longitude END AS longitude, CASE WHEN {_MASK} = 'verified' THEN distance_km END AS distance_km, {_MASK} = 'verified' AND coalesce(location_route_available, false) AS location_route_available FROM listings")
def mask_location(spark, sf_dir):
    return V.mask_location(frame(spark, sf_dir, "listings")).select("listing_id", "location_status", "latitude", "longitude", "distance_km", "location_route_available")


@query("explain_reasons", """SELECT listing_id, concat_ws('; ', CASE WHEN price_monthly < 1500 THEN printf('%d%% below the median', CAST(floor((1500 - price_monthly) / 15) AS INT)) END, CASE WHEN distance_km <= 2 THEN printf('%d minutes on foot', CAST(floor(distance_km * 12.5) AS INT)) END, CASE WHEN ranking_transit_score >= 50 THEN 'good morning transit' END) AS reasons FROM listings""")
def explain_reasons(spark, sf_dir):
    return frame(spark, sf_dir, "listings").select("listing_id", F.array_join(V.reasons(F.col("price_monthly"), F.lit(1500.0), F.floor(F.col("distance_km") * 12.5).cast("int"), F.col("distance_km") <= 2, F.col("ranking_transit_score") >= 50), "; ").alias("reasons"))


@query("project_website_ready", "SELECT listing_id, title, address, price_monthly, bedrooms FROM listings")
def project_website_ready(spark, sf_dir):
    return V.existing(frame(spark, sf_dir, "listings"), ["listing_id", "title", "address", "price_text", "price_monthly", "bedrooms", "bathrooms"])


@query("comparison_matrix", "SELECT listing_id, field, value FROM (SELECT listing_id, 'price' AS field, CASE WHEN price_monthly IS NULL THEN 'Unknown' ELSE CAST(CAST(price_monthly AS INT) AS VARCHAR) END AS value FROM listings UNION ALL SELECT listing_id, 'furnished', CASE WHEN furnished IS NULL THEN 'Unknown' WHEN furnished THEN 'Yes' ELSE 'No' END FROM listings UNION ALL SELECT listing_id, 'type', coalesce(housing_type, 'Unknown') FROM listings)")
def comparison_matrix(spark, sf_dir):
    return V.comparison(frame(spark, sf_dir, "listings"))


@query("filter_review_items", "SELECT listing_id, data_quality_status FROM listings WHERE data_quality_status = 'needs-review' AND (price_monthly IS NULL OR bedrooms IS NULL) AND geocode_confidence BETWEEN 0.2 AND 0.9")
def filter_review_items(spark, sf_dir):
    rows = frame(spark, sf_dir, "listings").withColumn("issues", V.issues())
    wanted = F.exists("issues", lambda x: (x.category == "missing") & x.field.isin("price_monthly", "bedrooms"))
    return rows.where(wanted & (F.col("data_quality_status") == "needs-review") & P.within("geocode_confidence", 0.2, 0.9)).select("listing_id", "data_quality_status")
