"""Importing a run: a snapshot of listings against the stored state, as one plan and one commit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from ..sources.versions import Commit, VersionedTable

#: Columns of the stored state.
STATE = "listing_id long, property_key string, property_match_key string, match_key string, price double, title string, status string, missed int, last_run string"
# The counts that an import reports.
SUMMARY = (
    "new_listings", "updated_listings", "unchanged_listings", "relisted_listings", "possibly_removed_listings", "removed_listings", "observations_inserted", "properties_created", "properties_reused",
    "possible_property_duplicates", "review_items_created", "rows_rejected", "rows_with_warnings",
)
#: Match keys of stored properties up to which they are broadcast, not shuffled.
BROADCAST_KEYS = 100_000


@dataclass(frozen=True)
class ImportPlan:
    """What a run changes: the next state, and the rows to add to the other tables."""

    state: DataFrame
    properties: DataFrame
    observations: DataFrame
    reviews: DataFrame
    rejected: DataFrame
    summary: dict[str, int]


def _differs(names: Sequence[str]) -> Column:
    test = F.lit(False)
    for n in names:
        test |= ~F.col(n).eqNullSafe(F.col(f"_{n}"))
    return test


def import_plan(snapshot: DataFrame, state: DataFrame, run_id: str, *, lifecycle: bool = True, removed_after: int = 2) -> ImportPlan:
    """The plan of a snapshot (listing_id, match_key, price, title) against the state (columns of STATE).

    - Rejected: rows without id, and all rows of an id that the snapshot repeats; such an id counts as neither present nor absent.
    - Property: the stored link's, else the stored property of the match key, else a new one named by the key's digest
      (the listing's own, without a key).  Properties aren't merged by likeness.
    - Change: new, relisted (it was removed), updated (key, price or title differ), unchanged, or absent.
    - Absence, if the run may apply it (lifecycle): one run makes a listing possibly removed, removed_after runs removed.
    - Observations: a row for each change but unchanged, and for each new state of an absent listing.
    - Reviews: a missing price, an address that moved under a stored link, and a link whose key names another stored property.

    The state has an id once, and no null id.  The snapshot is grouped by id once and joined once to the state, and the
    result is kept, by columns, for the summary and the tables.
    """
    run = F.lit(run_id)
    rows = snapshot.select("listing_id", "match_key", F.col("price").cast("double").alias("price"), "title")
    fields = ("match_key", "price", "title")
    times = rows.groupBy(F.col("listing_id").alias("_id")).agg(F.count("*").alias("_times"))
    rejected = rows.join(times.where("_id is null or _times > 1"), F.col("listing_id").eqNullSafe(F.col("_id")), "left_semi")
    once = F.col("listing_id").isNotNull() & (F.col("_times") == 1)
    given = rows.groupBy("listing_id").agg(F.count("*").alias("_times"), *(F.first(c).alias(c) for c in fields))
    given = given.select("listing_id", *(F.when(once, F.col(c)).alias(c) for c in fields), F.when(once, True).alias("_new"), F.when(~once, F.col("_times")).alias("_rejected"))

    old = state.select("listing_id", *(F.col(c).alias(f"_{c}") for c in state.columns if c != "listing_id")).withColumn("_old", F.lit(True))
    both = given.join(old, "listing_id", "full").withColumn("_unsafe", F.col("_rejected").isNotNull())
    change = (
        F.when(F.col("_unsafe"), "kept")
        .when(F.col("_old").isNull(), "new")
        .when(F.col("_new").isNull(), "absent")
        .when(F.col("_status") == "removed", "relisted")
        .when(_differs(("match_key", "price", "title")), "updated")
        .otherwise("unchanged")
    )
    keys = stored(state.where("property_match_key is not null").groupBy(F.col("property_match_key").alias("match_key")).agg(F.min("property_key").alias("_key_property")))
    few = keys.count() <= BROADCAST_KEYS
    named = both.withColumn("change", change).join(F.broadcast(keys) if few else keys.hint("merge"), "match_key", "left")
    made = F.concat(F.lit("new-"), F.substring(F.sha2(F.coalesce("match_key", F.concat(F.lit("listing:"), F.col("listing_id").cast("string"))), 256), 1, 16))
    here = F.col("_new").isNotNull()
    missed = F.when(here, 0).when(F.lit(lifecycle) & (F.col("change") == "absent"), F.col("_missed") + 1).otherwise(F.col("_missed"))
    status = F.when(here, "active").when((F.col("change") != "absent") | (F.col("_status") == "removed") | F.lit(not lifecycle), F.col("_status")).when(missed >= removed_after, "removed").otherwise("possibly_removed")
    pick = lambda c: F.when(here, F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
    created = here & F.col("_property_key").isNull() & F.col("_key_property").isNull()
    rival = here & F.col("_property_key").isNotNull() & F.col("_key_property").isNotNull() & (F.col("_key_property") != F.col("_property_key"))
    planned = named.select(
        "listing_id", "change", F.coalesce("_property_key", "_key_property", made).alias("property_key"), F.coalesce("_property_match_key", "match_key").alias("property_match_key"), pick("match_key"), pick("price"), pick("title"),
        status.alias("status"), missed.cast("int").alias("missed"), F.when(here, run).otherwise(F.col("_last_run")).alias("last_run"), created.alias("_created"), here.alias("_here"), F.col("_status").alias("_before"), "_rejected", (here | F.col("_old").isNotNull()).alias("_kept"),
        F.filter(
            F.array(
                F.when(here & F.col("price").isNull(), "missing_price"), F.when(here & F.col("_old").isNotNull() & ~F.col("match_key").eqNullSafe(F.col("_match_key")), "address_changed"), F.when(rival, "possible_property_duplicate")
            ),
            lambda x: x.isNotNull(),
        ).alias("warnings"),
    )
    whole = stored(planned)  # read by the counts, the state and the rows to add
    planned = whole.where("_kept")
    moved = (F.col("change") == "absent") & (F.col("status") != F.col("_before"))
    seen = F.col("change").isin("new", "updated", "relisted") | moved
    kept = F.col("_kept")
    tests = {f"{c}_listings": F.col("change") == c for c in ("new", "updated", "unchanged", "relisted")} | {f"{c}_listings": moved & (F.col("status") == c) for c in ("possibly_removed", "removed")}
    tests |= {"observations_inserted": seen, "possible_property_duplicates": F.array_contains("warnings", "possible_property_duplicate"), "rows_with_warnings": F.size("warnings") > 0}
    by_property = whole.groupBy("property_key").agg(
        *(F.count_if(kept & test).alias(n) for n, test in tests.items()), F.sum(F.when(kept, F.size("warnings"))).alias("review_items_created"), F.sum("_rejected").alias("rows_rejected"),
        F.count_if(kept & F.col("_created")).alias("_made"), F.count_if(kept & F.col("_here") & ~F.col("_created")).alias("_reused"),
    )
    found = by_property.agg(
        *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in (*tests, "review_items_created", "rows_rejected")), F.count_if(F.col("property_key").isNotNull() & (F.col("_made") > 0)).alias("properties_created"), F.count_if(F.col("property_key").isNotNull() & (F.col("_reused") > 0)).alias("properties_reused")
    ).first()
    return ImportPlan(
        state=planned.select(*(c.split()[0] for c in STATE.split(", "))),
        properties=planned.where("_created").groupBy("property_key").agg(F.min("property_match_key").alias("match_key")),
        observations=planned.where(seen).select("listing_id", run.alias("run_id"), "change", "status", "price", "title"),
        reviews=planned.select("listing_id", run.alias("run_id"), F.explode("warnings").alias("reason")),
        rejected=rejected,
        summary={name: found[name] for name in SUMMARY},
    )


def import_run(table: VersionedTable, snapshot: DataFrame, run_id: str, observed_at: datetime, **options) -> tuple[str, Commit, ImportPlan | None]:
    """(status, commit, plan) of bringing a run into the state table.

    A run that is in changes nothing and gives its commit; one that isn't after
    the last raises OutOfOrderRun before anything is planned.  The state and the
    summary are committed together, by one pointer file.
    """
    if table.already(run_id, observed_at) is not None:
        return "already_imported", next(c for c in table.history() if c.run_id == run_id), None
    state = table.read() if table.current() else table.spark.createDataFrame([], STATE)
    plan = import_plan(snapshot, state, run_id, **options)
    status, commit = table.publish(plan.state, run_id, observed_at, plan.summary)
    return status, commit, plan
