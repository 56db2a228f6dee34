"""Review decisions as a log: the state of each key, the progress of a review, and rules run again under what people decided."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The states of an issue, and those that are done with.
STATES = ("unresolved", "draft", "decided", "applied", "stale")
DONE = ("decided", "applied")


def decision_states(log: DataFrame, key: Sequence[str], order: Sequence[str] = ("happened_at", "event_id")) -> DataFrame:
    """(key, state, value, decided_by, superseded): the fold of each key's log in its order.

    log: the key's columns, the order's, action and value.  Actions are drafted,
    decided, applied (of the decision before it) and source_changed; others say
    nothing.  A draft or decision supersedes those before it; a change of the
    source after it makes it stale, whatever was applied; a decision that is
    applied afterwards stays so.  value and decided_by (the order's last column)
    are those of the last decision, superseded counts decisions before it.

    The fold needs only the last entry of each kind, so it is one aggregation
    with partial results, however long or skewed the log of a key is.
    """
    place = F.struct(*order)
    last = lambda *actions: F.max(F.when(F.col("action").isin(*actions), place))
    of = lambda c: F.max_by(F.when(F.col("action") == "decided", F.col(c)), F.when(F.col("action") == "decided", place))
    rows = log.groupBy(*key).agg(
        last("drafted", "decided").alias("_said"), last("decided").alias("_decided"), last("applied").alias("_applied"), last("source_changed").alias("_changed"), of("value").alias("value"), of(order[-1]).alias("decided_by"),
        F.count_if(F.col("action") == "decided").alias("_n"),
    )
    after = lambda a, b: F.coalesce(F.col(a) > F.col(b), F.lit(False))
    state = (
        F.when(F.col("_said").isNull(), "unresolved")
        .when(after("_changed", "_said"), "stale")
        .when(~F.coalesce(F.col("_decided") == F.col("_said"), F.lit(False)), "draft")
        .when(after("_applied", "_decided"), "applied")
        .otherwise("decided")
    )
    return rows.select(*key, state.alias("state"), "value", "decided_by", F.greatest(F.col("_n") - 1, F.lit(0)).alias("superseded"))


def with_states(issues: DataFrame, states: DataFrame, key: Sequence[str]) -> DataFrame:
    """The issues with their state, unresolved where the log has none."""
    return issues.join(states.select(*key, "state"), list(key), "left").withColumn("state", F.coalesce("state", F.lit("unresolved")))


def review_dashboard(issues: DataFrame, states: DataFrame, key: Sequence[str], listing: str, by: str, facet: str) -> DataFrame:
    """Progress by `by` and over all ('__all__'): issues of each state, listings, listings with all issues done, and the facet's sorted values.

    Issues are counted per listing first, so a listing is complete if what is
    not done there is none; the totals are sums of these counts.
    """
    rows = with_states(issues, states, key)
    done = F.col("state").isin(*DONE)
    both = rows.withColumn("_by", F.explode(F.array(F.col(by), F.lit("__all__"))))
    per = both.groupBy("_by", listing).agg(*(F.count_if(F.col("state") == s).alias(s) for s in STATES), F.count_if(~done).alias("_open"), F.collect_set(facet).alias("_facet"))
    total = per.groupBy("_by").agg(*(F.sum(s).alias(s) for s in STATES), F.count("*").alias("listings"), F.count_if(F.col("_open") == 0).alias("complete_listings"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_facet")))).alias("facets"))
    return total.withColumn("issues", sum((F.col(s) for s in STATES), F.lit(0))).withColumnRenamed("_by", by)


def replay(rows: DataFrame, states: DataFrame, key: Sequence[str], fields: Mapping[str, tuple[Column, Column, Column]], field_column: str = "field") -> DataFrame:
    """rows with a struct (value, source) for each field: rules and gates over cached inferences, without new ones.

    fields: name -> (the rule's value, the cached one, whether the gate lets it
    pass).  What a person decided, and isn't stale, stays: source `manual`.
    Else the rule's value, else the cached one if it passes; one that doesn't
    is `rejected`, with no value; where there is nothing the source is null.
    """
    own = states.where(F.col("state").isin(*DONE)).groupBy(*key).pivot(field_column, list(fields)).agg(F.first(F.struct("value")))
    out = rows.join(own.select(*key, *(F.col(f"`{n}`").alias(f"_manual_{n}") for n in fields)), list(key), "left")
    for name, (rule, cached, passes) in fields.items():
        manual = F.col(f"_manual_{name}")
        told = lambda value, source: F.struct(value.cast("string").alias("value"), F.lit(source).alias("source"))
        passes = F.coalesce(passes, F.lit(False))
        answer = F.when(manual.isNotNull(), told(manual["value"], "manual")).when(rule.isNotNull(), told(rule, "rule")).when(cached.isNotNull() & passes, told(cached, "inference")).when(cached.isNotNull(), told(F.lit(None), "rejected")).otherwise(told(F.lit(None), None))
        out = out.withColumn(name, answer)
    return out.drop(*(f"_manual_{n}" for n in fields))
