"""Public shapes of listings: summaries, markers, masked locations, reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORES = ("overall", "value", "campus_access", "transit")


def public_summary(listings: DataFrame) -> DataFrame:
    """Listings without internal columns, their scores in one struct."""
    ranking = F.struct(F.col("ranking_status").alias("status"), *(F.col(f"ranking_{s}_score").alias(s) for s in SCORES))
    hidden = ["ranking_status", *(f"ranking_{s}_score" for s in SCORES), "source_listing_id", "description"]
    return listings.withColumn("ranking", ranking).drop(*hidden)


def markers(listings: DataFrame) -> DataFrame:
    """One marker per property: its first visible listing with coordinates."""
    visible = listings.where("location_map_visible and latitude is not null and longitude is not null")
    first = visible.groupBy("property_id").agg(F.min_by(F.struct("listing_id", "latitude", "longitude", "price_monthly"), "listing_id").alias("m"))
    return first.select("m.*")


def map_clusters(rows: DataFrame, decimals: int) -> DataFrame:
    """Rows by the cell of their coordinates at so many decimals: count, cheapest price, first id."""
    scale = 10**decimals
    return rows.groupBy(F.floor(F.col("latitude") * scale).cast("double").alias("lat_cell"), F.floor(F.col("longitude") * scale).cast("double").alias("lon_cell")).agg(F.count("*").alias("n"), F.min("price_monthly").alias("cheapest"), F.min("listing_id").alias("first_id"))


def mask_location(listings: DataFrame, least_confidence: float = 0.8) -> DataFrame:
    """Fail-closed location: coordinates, distance and route only where the location is verified."""
    placed = F.col("latitude").isNotNull()
    sure = F.coalesce("geocode_confidence", F.lit(0.0)) >= least_confidence
    status = F.when(F.coalesce("location_map_visible", F.lit(False)) & placed & sure, "verified").when(placed, "hidden").otherwise("unavailable")
    rows = listings.withColumn("location_status", status)
    shown = F.col("location_status") == "verified"
    rows = rows.withColumns({c: F.when(shown, F.col(c)) for c in ("latitude", "longitude", "distance_km")})
    return rows.withColumns({"location_map_visible": shown, "location_route_available": shown & F.coalesce("location_route_available", F.lit(False))})


def reasons(price: Column, median: Column, walk_minutes: Column, walk_good: Column, transit_good: Column) -> Column:
    """Short texts for what speaks for a listing; absent ones are left out."""
    share = F.floor((median - price) * 100 / median).cast("int")
    parts = (
        F.when(price < median, F.format_string("%d%% below the median", share)),
        F.when(walk_good, F.format_string("%d minutes on foot", walk_minutes)),
        F.when(transit_good, F.lit("good morning transit")),
    )
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def existing(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Those of the columns that the rows have, in the given order."""
    return rows.select(*(c for c in columns if c in rows.columns))


def comparison(listings: DataFrame) -> DataFrame:
    """(listing_id, field, value): side by side texts, unknowns named as such."""
    yes_no = F.when(F.col("furnished").isNull(), "Unknown").when(F.col("furnished"), "Yes").otherwise("No")
    values = {"price": F.coalesce(F.col("price_monthly").cast("int").cast("string"), F.lit("Unknown")), "furnished": yes_no, "type": F.coalesce("housing_type", F.lit("Unknown"))}
    return listings.select("listing_id", *(v.alias(k) for k, v in values.items())).unpivot("listing_id", list(values), "field", "value")


def issues(fields: Sequence[str] = ("price_monthly", "bedrooms", "housing_type", "latitude")) -> Column:
    """An array of (category, field) for what a listing lacks."""
    return F.filter(F.array(*(F.when(F.col(f).isNull(), F.struct(F.lit("missing").alias("category"), F.lit(f).alias("field"))) for f in fields)), lambda x: x.isNotNull())


def latest(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key by the order columns, nulls first."""
    w = Window.partitionBy(key).orderBy(*(F.desc_nulls_last(c) for c in order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
