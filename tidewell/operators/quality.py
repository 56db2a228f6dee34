"""Decision tables over columns: merges, gates, flags, reviews, comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.scratch import settled


def _present(*flags: Column) -> Column:
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def promote_rules(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """`*_rule` fills an unset field and sets `*_source` to rule; a set field keeps its source."""
    fill = {}
    for f in fields:
        use = F.col(f).isNull() & F.col(f"{f}_rule").isNotNull()
        fill[f] = F.coalesce(f, f"{f}_rule")
        fill[f"{f}_source"] = F.when(use, "rule").otherwise(F.col(f"{f}_source"))
    return rows.withColumns(fill)


def unresolved_groups(groups: Mapping[str, Sequence[str]]) -> Column:
    """Names of the field groups of which no field is set."""
    return _present(*(F.when(F.coalesce(*(F.col(f).cast("string") for f in fields)).isNull(), F.lit(name)) for name, fields in groups.items()))


def evidence_gate(value: Column, evidence: Column, sources: Column, supports: Column) -> tuple[Column, Column]:
    """(accepted value, blocked): the evidence must stand verbatim in a source text and support the value."""
    text = F.lower(F.trim(evidence))
    verbatim = (text != "") & F.exists(sources, lambda s: F.lower(s).contains(text))
    fine = F.coalesce(verbatim & supports, F.lit(False))
    return F.when(fine, value), value.isNotNull() & ~fine


def consensus(first: DataFrame, second: DataFrame, key: str, field: str) -> DataFrame:
    """(key, field, disagree): the value of two passes where they agree, else null and a flag."""
    rows = first.select(key, F.col(field).alias("_a")).join(second.select(key, F.col(field).alias("_b")), key)
    same = F.col("_a").eqNullSafe(F.col("_b"))
    return rows.select(key, F.when(same, F.col("_a")).alias(field), (~same).alias("disagree"))


def precedence(manual: Column, rule: Column, canonical: Column) -> tuple[Column, Column]:
    """(value, source): manual before rule before canonical."""
    return F.coalesce(manual, rule, canonical), F.when(manual.isNotNull(), "manual").when(rule.isNotNull(), "rule").when(canonical.isNotNull(), "canonical")


def contradiction_flags() -> Column:
    """Flags of a listing whose fields don't fit together."""
    price = F.col("price_monthly")
    return _present(
        F.when(F.col("is_sublet") & (F.lower("lease_type") == "fixed"), "sublet_with_fixed_lease"),
        F.when(F.col("utilities_included") & F.col("title").contains("machinery"), "utilities_conflict"),
        F.when(~F.col("furnished") & F.coalesce("amenities", F.lit("")).contains("gym"), "furnished_conflict"),
        F.when(~F.col("parking_available") & F.coalesce("amenities", F.lit("")).contains("parking"), "parking_conflict"),
        F.when(~price.between(250, 3500), "price_out_of_range"),
    )


def geocode_qc(status: Column, latitude: Column, result_type: Column, city: Column, country: Column, confidence: Column, far_km: Column, least: float = 0.8, most_km: float = 25.0) -> tuple[Column, Column]:
    """(map_ready, issues): all issues but the distance block."""
    issues = _present(
        F.when(~status.eqNullSafe(F.lit("ok")), F.concat(F.lit("geocode_status_"), F.coalesce(status, F.lit("missing")))),
        F.when(latitude.isNull(), "missing_lat_lng"),
        F.when(result_type == "city", "city_level_only"),
        F.when(city.isNotNull() & (city != "") & (city != "london"), "city_mismatch"),
        F.when(~country.eqNullSafe(F.lit("ca")), "country_mismatch"),
        F.when(confidence.isNull() | (confidence < least), "low_confidence"),
        F.when(far_km > most_km, "far_from_centre"),
    )
    return F.size(F.array_except(issues, F.array(F.lit("far_from_centre")))) == 0, issues


def data_quality(required: Sequence[str], map_ready: Column, confidence: Column, review: Column) -> tuple[Column, Column]:
    """(score, status): completeness of 70, 20 for the map, up to 10 for confidence; a review caps at 55."""
    known = sum((F.when(F.col(f).isNotNull(), 1).otherwise(0) for f in required), F.lit(0))
    score = known / len(required) * 70 + F.when(map_ready, 20).otherwise(0) + F.coalesce(F.least(F.lit(10.0), F.greatest(F.lit(0.0), confidence * 10)), F.lit(0.0))
    score = F.when(review, F.least(score, F.lit(55.0))).otherwise(score)
    return score, F.when(review, "needs-review").when(score >= 85, "confirmed").otherwise("parsed")


def field_quality(value: Column, source: Column) -> Column:
    text = F.lower(F.coalesce(source, F.lit("")))
    return F.when(value.isNull(), "unknown").when(text.contains("manual") | text.contains("human"), "human-reviewed").when(text.contains("ai"), "AI-assisted").when(text.contains("rule") | text.contains("pars"), "parsed").otherwise("confirmed")


def field_changes(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, before, after, change): fields that differ between two versions; keys of one side are added or removed."""
    side = lambda df, name: df.select(key, F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias(name))
    rows = side(old, "o").join(side(new, "n"), key, "full")
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"o.{f}").alias("before"), F.col(f"n.{f}").alias("after")) for f in fields)))
    rows = rows.select(key, F.col("o").isNull().alias("_added"), F.col("n").isNull().alias("_gone"), pairs.alias("p")).select(key, "_added", "_gone", "p.*")
    rows = rows.where(~F.col("before").eqNullSafe(F.col("after")))
    change = F.when(F.col("_added"), "added").when(F.col("_gone"), "removed").when(F.col("before").isNull(), "filled").when(F.col("after").isNull(), "cleared").otherwise("changed")
    return rows.select(key, "field", "before", "after", change.alias("change"))


def label_counts(old: DataFrame, new: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, value, n_old, n_new): how often each label occurs in either version.

    Null and blank labels count as `<unknown>`; a version without a field has no labels of it.
    """
    def counts(df, name):
        label = lambda f: F.coalesce(F.nullif(F.trim(F.col(f).cast("string")), F.lit("")), F.lit("<unknown>"))
        pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), label(f).alias("value")) for f in fields if f in df.columns)))
        return df.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias(name))

    rows = counts(old, "n_old").join(counts(new, "n_new"), ["field", "value"], "full")
    return rows.select("field", "value", F.coalesce("n_old", F.lit(0)).alias("n_old"), F.coalesce("n_new", F.lit(0)).alias("n_new"))


def reuse_geocodes(rows: DataFrame, earlier: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """rows (key, listing_url, address) with a decision and the fields of an earlier geocode.

    A geocode is reused if it was made for the same URL and the same normalized
    address; otherwise the decision names what differs and the fields are null.
    """
    cached = earlier.select(key, F.struct("listing_url", "geocode_query", "geocode_status", *fields).alias("_c"))
    both = rows.join(cached, key, "left")
    same = lambda a, b: X.comparison_text(a).eqNullSafe(X.comparison_text(b))
    decision = (
        F.when(F.col("_c").isNull(), "rejected: not cached")
        .when(~F.trim("listing_url").eqNullSafe(F.trim("_c.listing_url")), "rejected: source URL")
        .when(~same(F.col("address"), F.col("_c.geocode_query")), "rejected: normalized address")
        .when(F.lower("_c.geocode_status") == "missing_address", "missing")
        .otherwise("reused")
    )
    both = both.withColumn("decision", decision)
    return both.select(*rows.columns, "decision", *(F.when(F.col("decision") == "reused", F.col(f"_c.{f}")).alias(f) for f in fields))


def geocode_resolution(rows: DataFrame, cache: DataFrame, provider: str, latitudes: tuple[float, float], longitudes: tuple[float, float], least: float) -> DataFrame:
    """rows with the reason why their cached geocode is accepted or not: the first check that fails.

    cache is (query, provider, latitude, longitude, geocode_confidence,
    geocode_status); a null provider is the expected one.  A query must have one
    candidate, and it must say what the row says.
    """
    said = ["latitude", "longitude", "geocode_confidence", "geocode_status"]
    candidates = cache.groupBy(F.lower("query").alias("_q")).agg(F.count("*").alias("_n"), F.min(F.struct("provider", *said)).alias("_c"))
    both = rows.withColumn("_q", F.lower("geocode_query")).join(candidates, "_q", "left")
    fails = lambda test: ~F.coalesce(test, F.lit(False))
    text = X.comparison_text(F.col("address"))
    checks = [
        ("geocode_address_query_mismatch", fails(text == X.comparison_text(F.col("geocode_query")))),
        ("geocode_multiple_cached_candidates", F.col("_n") > 1),
        ("geocode_cache_evidence_missing", F.col("_n").isNull()),
        ("geocode_provider_mismatch", F.lower(F.coalesce("_c.provider", F.lit(provider))) != provider),
        ("geocode_cache_result_mismatch", ~F.struct(*said).eqNullSafe(F.struct(*(F.col(f"_c.{x}").alias(x) for x in said)))),
        ("geocode_outside_bounds", fails(F.col("latitude").between(*latitudes) & F.col("longitude").between(*longitudes))),
        ("geocode_confidence_below_threshold", fails(F.col("geocode_confidence") >= least)),
        ("geocode_status_not_ok", fails(F.lower("geocode_status") == "ok")),
        ("geocode_property_precision_required", fails(F.lower("geocode_result_type") == "building")),
        ("geocode_full_match_required", fails(F.lower("geocode_match_type") == "full_match")),
    ]
    reason = F.coalesce(*(F.when(failed, F.lit(name)) for name, failed in checks), F.lit("cached_geocode_verified"))
    return both.select(*rows.columns, reason.alias("reason"))


def property_conflicts(rows: DataFrame) -> DataFrame:
    """(conflict, place, n) of rows (latitude, longitude, address, unit): likely repeats of a property.

    One coordinate, to six decimals, with several addresses; one address of
    which some rows have a unit and others none.
    """
    micro = lambda c: F.floor(F.col(c) * 1e6 + 0.5).cast("long").cast("string")
    places = rows.where("latitude is not null and longitude is not null").groupBy(F.concat_ws(",", micro("latitude"), micro("longitude")).alias("place"))
    several = places.agg(F.countDistinct("address").alias("n")).where("n > 1").select(F.lit("several_addresses").alias("conflict"), "place", "n")
    units = rows.where("address is not null").groupBy(F.col("address").alias("place")).agg(F.countDistinct("unit").alias("n"), F.bool_or(F.col("unit").isNull()).alias("_none"))
    return several.unionByName(units.where("_none and n > 0").select(F.lit("unit_presence_differs").alias("conflict"), "place", "n"))


def review_index(issues: DataFrame, key: str, block: int = 10_000) -> DataFrame:
    """(category, field, block, n, ids): the ids of each kind of issue, a row for each block of ids so that no list grows with the data."""
    by = issues.groupBy("category", "field", F.floor(F.col(key) / block).alias("block"))
    return by.agg(F.count("*").alias("n"), F.sort_array(F.collect_list(key)).alias("ids"))


def identity_violations(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, problem): keys that are missing on a side or occur more than once."""
    a, b = left.groupBy(key).agg(F.count("*").alias("_a")), right.groupBy(key).agg(F.count("*").alias("_b"))
    rows = a.join(b, key, "full")
    problem = F.when(F.col("_a").isNull(), "only_right").when(F.col("_b").isNull(), "only_left").when((F.col("_a") > 1) | (F.col("_b") > 1), "repeated")
    return rows.select(key, problem.alias("problem")).where("problem is not null")


def table_fingerprint(rows: DataFrame, key: str, columns: Sequence[str], parts: int = 64) -> DataFrame:
    """(n, fingerprint): equal for equal sets of rows, whatever their order.

    Rows are hashed into a fixed number of parts, each part's sorted hashes are
    summed as numbers; the last step sees `parts` rows only.
    """
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in (key, *columns)))
    digest = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(20,0)")
    by_part = rows.select(F.pmod(F.col(key), F.lit(parts)).alias("part"), digest.alias("d")).groupBy("part").agg(F.count("*").alias("n"), F.sum("d").alias("s"))
    return by_part.agg(F.sum("n").alias("n"), F.sum("s").cast("string").alias("fingerprint"))


def review_items(issues: DataFrame, key: str) -> DataFrame:
    """Issues (key, category, field, reason) collapsed per key: sorted distinct lists joined by pipes."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|").alias(c)
    return issues.groupBy(key).agg(joined("category"), joined("field"), joined("reason"))


def review_decision(structured: Column, rule: Column, convertible: Column, cached: Column, explicit: Column, manual: Column, inferred: Column) -> tuple[Column, Column]:
    """(decision, status) of an issue by the first source that settles it."""
    source = (
        F.when(structured, "structured_source").when(rule, "deterministic_rule").when(convertible, "price_conversion").when(cached, "verified_geocode")
        .when(explicit, "explicit_text").when(manual, "existing_manual").when(inferred, "inferred_only").otherwise("legitimately_unknown")
    )
    status = F.when(source == "existing_manual", "already_resolved").when(source == "inferred_only", "human_review_required").when(source == "legitimately_unknown", "accepted_as_unknown").otherwise("auto_resolved")
    return source, status


def apply_updates(rows: DataFrame, updates: DataFrame, key: str, fields: Sequence[str], fingerprint: str = "fingerprint") -> DataFrame:
    """Rows with the updates (key, fingerprint, field, value) that were made for their present state.

    Updates for another fingerprint are stale and do nothing; each field takes
    at most one value, the least of several.
    """
    wide = updates.groupBy(key, fingerprint).pivot("field", list(fields)).agg(F.min("value"))
    wide = wide.select(F.col(key).alias("_k"), F.col(fingerprint).alias("_f"), *(F.col(f).alias(f"_{f}") for f in fields))
    rows = rows.join(wide, (F.col(key) == F.col("_k")) & (F.col(fingerprint) == F.col("_f")), "left")
    applied = F.coalesce(*(F.col(f"_{f}") for f in fields)).isNotNull()
    return rows.withColumn("applied", applied).withColumns({f: F.coalesce(F.col(f"_{f}"), F.col(f).cast("string")) for f in fields}).drop("_k", "_f", *(f"_{f}" for f in fields))


def run_completion(stages: DataFrame, run: str, order: str) -> DataFrame:
    """(run, complete, mismatches): all stages completed, and each takes as many rows as the one before gave."""
    before = F.lag("output_rows").over(Window.partitionBy(run).orderBy(order))
    rows = stages.withColumn("_m", F.coalesce(before != F.col("input_rows"), F.lit(False)))
    return rows.groupBy(run).agg(F.bool_and(F.col("status") == "completed").alias("complete"), F.count_if("_m").alias("mismatches"))


# What a coordinate must pass before a city's official one replaces it, in order; the names are the reasons given.
COORDINATE_GATES = (
    "no_usable_current_coordinate", "city_dataset_not_current", "city_dataset_not_accepted", "city_match_confidence_below_threshold", "city_match_review_required", "city_match_has_unresolved_reasons", "unit_requires_exact_unit_match",
    "shared_municipal_address_point", "municipal_address_status_not_accepted", "invalid_city_geometry", "city_geometry_outside_london_bounds", "parcel_not_uniquely_resolved", "building_not_uniquely_resolved",
    "missing_usable_geoapify_comparison", "missing_city_movement_comparison", "automatic_city_movement_threshold_exceeded", "large_parcel_without_unique_building", "multi_building_parcel_without_unique_building",
    "multi_address_parcel_without_unique_building",
)
# The policy's limits.
LEAST_MATCH, MOST_MOVE, LARGE_PARCEL, SIMPLE_PARCEL_ADDRESSES, CITY_SRID = 0.98, 100.0, 6937.72, 1, 26917


def coordinate_gates(bounds: Sequence[float]) -> Column:
    """Names of the COORDINATE_GATES that a row of evidence fails; null evidence fails its gate.

    Columns: current_usable, dataset_current, dataset_accepted, match_confidence,
    match_review, match_reasons (array), unit_status, shared_properties,
    address_status, city_x, city_y, city_valid, city_srid, parcel, building,
    provider_usable, provider_distance, movement, parcel_area,
    parcel_buildings, parcel_addresses.
    """
    holds = lambda test: F.coalesce(test, F.lit(False))
    col = F.col
    x0, y0, x1, y1 = map(F.lit, bounds)
    located = holds(col("city_x").isNotNull() & col("city_y").isNotNull() & ~F.isnan("city_x") & ~F.isnan("city_y") & col("city_valid") & (col("city_srid") == CITY_SRID))
    one_building = holds(col("building") == "unique_contains")
    failed = {
        "no_usable_current_coordinate": ~holds(col("current_usable")),
        "city_dataset_not_current": ~holds(col("dataset_current")),
        "city_dataset_not_accepted": ~holds(col("dataset_accepted")),
        "city_match_confidence_below_threshold": ~holds(col("match_confidence") >= LEAST_MATCH),
        "city_match_review_required": holds(col("match_review")),
        "city_match_has_unresolved_reasons": holds(F.size("match_reasons") > 0),
        "unit_requires_exact_unit_match": holds(col("unit_status") == "unresolved"),
        "shared_municipal_address_point": ~holds(col("shared_properties") == 1),
        "municipal_address_status_not_accepted": ~holds(col("address_status").isin("active", "current")),
        "invalid_city_geometry": ~located,
        "city_geometry_outside_london_bounds": located & ~holds(col("city_x").between(x0, x1) & col("city_y").between(y0, y1)),
        "parcel_not_uniquely_resolved": ~holds(col("parcel") == "unique_contains"),
        "building_not_uniquely_resolved": holds(col("building").isin("ambiguous", "contradiction")),
        "missing_usable_geoapify_comparison": ~holds(col("provider_usable")) | col("provider_distance").isNull(),
        "missing_city_movement_comparison": col("movement").isNull(),
        "automatic_city_movement_threshold_exceeded": holds(col("movement") > MOST_MOVE),
        "large_parcel_without_unique_building": holds(col("parcel_area") > LARGE_PARCEL) & ~one_building,
        "multi_building_parcel_without_unique_building": holds(col("parcel_buildings") > 1) & ~one_building,
        "multi_address_parcel_without_unique_building": holds(col("parcel_addresses") > SIMPLE_PARCEL_ADDRESSES) & ~one_building,
    }
    return _present(*(F.when(failed[name], name) for name in COORDINATE_GATES))


# The flags (on the map, with a route) that go with each location status.
LOCATION_FLAGS = {"available": (True, True), "limited": (True, False), "unavailable": (False, False)}


def visibility_problems(rows: DataFrame, properties: DataFrame, key: str = "property_id") -> DataFrame:
    """(key, problem): what keeps a table of location visibility from being taken.

    By row: an id that isn't positive or is repeated, a status that isn't one,
    flags that don't match it, reasons that aren't a JSON array of texts, no
    policy or source, a fingerprint that isn't SHA-256, a property that isn't
    known.  Of the table: a property without a row (missing), and rows of more
    than one policy and source, told once with a null key.
    """
    identity = F.struct("policy_version", "source_run_id", "source_fingerprint")
    times = rows.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    known = properties.select(F.col(key).alias("_p")).distinct().withColumn("_known", F.lit(True))
    full = rows.join(times, F.col(key) == F.col("_k"), "left").join(known, F.col(key) == F.col("_p"), "left")
    holds = lambda test: F.coalesce(test, F.lit(False))
    flags = F.lit(False)
    for status, (shown, routed) in LOCATION_FLAGS.items():
        flags = flags | ((F.col("status") == status) & (F.col("map_visible") == shown) & (F.col("route_available") == routed))
    said = F.from_json("reason_codes", "array<string>")
    texts = F.col("reason_codes").isNull() | (F.trim("reason_codes").startswith("[") & said.isNotNull() & F.forall(said, lambda r: F.coalesce(F.trim(r) != "", F.lit(False))))
    listed = F.col("status").isin(*LOCATION_FLAGS)
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    problems = _present(
        F.when(~holds(F.col(key) > 0), "id_not_positive"), F.when(F.col("_n") > 1, "id_repeated"), F.when(~holds(listed), "status_invalid"), F.when(holds(listed) & ~holds(flags), "flags_do_not_match"), F.when(~holds(texts), "reasons_not_texts"),
        F.when(~(filled("policy_version") & filled("source_run_id")), "identity_missing"), F.when(~holds(F.col("source_fingerprint").rlike("^[0-9a-f]{64}$")), "fingerprint_not_sha256"), F.when(F.col("_known").isNull(), "property_unknown"),
    )
    by_row = full.select(key, F.explode(problems).alias("problem"))
    absent = properties.select(key).distinct().join(rows.select(key), key, "left_anti").select(key, F.lit("missing").alias("problem"))
    several = rows.agg(F.countDistinct(identity).alias("n")).where("n > 1").select(F.lit(None).cast(rows.schema[key].dataType).alias(key), F.lit("several_identities").alias("problem"))
    return by_row.unionByName(absent).unionByName(several)
