"""Dates, service times, ages and service calendars."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Service periods as (day of the reference week from Monday, first departures).
PERIODS = {
    "weekday_morning_commute": (0, ("07:30", "08:00", "08:30")),
    "weekday_midday": (0, ("11:30", "12:00", "12:30")),
    "weekday_evening_commute": (0, ("16:30", "17:00", "17:30")),
    "weekday_late_evening": (0, ("21:30", "22:00", "22:30")),
    "saturday_daytime": (5, ("11:30", "12:00", "12:30")),
    "sunday_daytime": (6, ("11:30", "12:00", "12:30")),
}
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def iso_date(value: Column) -> tuple[Column, Column]:
    """(date, issue) of strict yyyy-MM-dd text."""
    text = F.trim(value)
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))
    return day, F.when(text.isNotNull() & (text != "") & day.isNull(), F.lit("invalid_date"))


def aware_utc(value: Column) -> Column:
    """UTC text of a timestamp that names its zone; null without a zone."""
    zoned = value.rlike(r"(?:Z|[+-]\d{2}:\d{2})$")
    return F.when(zoned, F.date_format(F.try_to_timestamp(value), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def departures(rows: DataFrame, monday: Column, zone: str, periods: Mapping[str, tuple] = PERIODS) -> DataFrame:
    """Rows by period and departure: local times in the reference week as UTC timestamps."""
    each = F.array(*(F.struct(F.lit(p).alias("time_period"), F.lit(d).alias("day"), F.lit(t).alias("clock")) for p, (d, ts) in periods.items() for t in ts))
    rows = rows.withColumn("_p", F.explode(each))
    local = F.to_timestamp(F.concat_ws(" ", F.date_add(monday, F.col("_p.day")).cast("string"), F.col("_p.clock")), "yyyy-MM-dd HH:mm")
    return rows.withColumns({"time_period": F.col("_p.time_period"), "departure_at": F.to_utc_timestamp(local, zone)}).drop("_p")


def age_score(seen: Column, now: Column, unknown: float = 30.0) -> Column:
    """max(0, 100 - 2 * days); unknown without a time."""
    days = (F.unix_timestamp(now) - F.unix_timestamp(seen)) / 86400
    return F.when(days.isNull(), F.lit(unknown)).otherwise(F.greatest(F.lit(0.0), 100 - 2 * days))


def service_days(calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(service_id, day) on which a service runs: its range's weekdays, plus added, minus removed dates.

    calendar has service_id, start_date, end_date (dates) and a 0/1 column per
    weekday; exceptions have service_id, day and exception_type (1 adds, 2 removes).
    """
    flags = F.array(*(F.col(d).cast("int") for d in WEEKDAYS))
    days = calendar.select("service_id", flags.alias("f"), F.explode(F.sequence("start_date", "end_date")).alias("day"))
    days = days.where(F.element_at("f", F.weekday("day") + 1) == 1).select("service_id", "day")
    added = exceptions.where("exception_type = 1").select("service_id", "day")
    return days.unionByName(added).distinct().join(exceptions.where("exception_type = 2").select("service_id", "day"), ["service_id", "day"], "left_anti")
