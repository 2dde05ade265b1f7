"""The analytical views: functions from the events table (deduplicated by id) to a DataFrame.

Distinct counts are exact unless ``approx``, where a sketch bounds the state of a group. All of them
are one aggregation that combines before its shuffle; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..operators.tags import flatten


def _unique(column: str, approx: bool) -> Column:
    return F.approx_count_distinct(column) if approx else F.count_distinct(column)


def _day() -> Column:
    return expr.event_date(F.col("created_at"))


def _time(c: Column) -> Column:
    return F.timestamp_seconds(c)


def event_stats(events: DataFrame, approx: bool = False) -> DataFrame:
    grouped = events.groupBy(_day().alias("date"), "kind").agg(
        F.count("*").alias("event_count"),
        _unique("pubkey", approx).alias("unique_authors"),
        F.avg(expr.byte_length(F.col("content"))).alias("avg_content_length"),
        F.sum(F.size("tags").cast("long")).alias("total_tags"),
    )
    return grouped.orderBy(F.desc("date"), F.desc("event_count"), "kind")


def relay_stats(events: DataFrame, approx: bool = False) -> DataFrame:
    grouped = (
        events.where("relay_source <> ''")
        .groupBy("relay_source")
        .agg(
            F.count("*").alias("event_count"),
            _unique("id", approx).alias("unique_events"),
            F.min("created_at").alias("earliest_event"),
            F.max("created_at").alias("latest_event"),
            _unique("pubkey", approx).alias("unique_authors"),
        )
    )
    return grouped.orderBy(F.desc("event_count"), "relay_source")


def tag_stats(events: DataFrame, approx: bool = False) -> DataFrame:
    grouped = flatten(events).groupBy("tag_name").agg(F.count("*").alias("occurrence_count"), _unique("event_id", approx).alias("unique_events"))
    return grouped.orderBy(F.desc("occurrence_count"), "tag_name")


def _active_users(events: DataFrame, name: str, period: Column, approx: bool) -> DataFrame:
    grouped = events.groupBy(period.alias(name)).agg(_unique("pubkey", approx).alias("active_users"), F.count("*").alias("total_events"))
    return grouped.orderBy(F.desc(name))


def daily_active_users(events: DataFrame, approx: bool = False) -> DataFrame:
    return _active_users(events, "date", _day(), approx)


def weekly_active_users(events: DataFrame, approx: bool = False) -> DataFrame:
    return _active_users(events, "week", expr.week_start(_day()), approx)


def monthly_active_users(events: DataFrame, approx: bool = False) -> DataFrame:
    return _active_users(events, "month", expr.month_start(_day()), approx)


def users_with_metadata(events: DataFrame) -> DataFrame:
    """The latest profile of each author (of equal times the greatest id's) and how often it changed."""
    grouped = (
        events.where("kind = 0")
        .groupBy("pubkey")
        .agg(
            F.max_by("content", F.struct("created_at", "id")).alias("latest_metadata"),
            F.max("created_at").alias("last_updated"),
            F.count("*").alias("metadata_updates"),
        )
    )
    return grouped.orderBy(F.desc("last_updated"), "pubkey")


def verified_user_activity(events: DataFrame) -> DataFrame:
    """Activity per day of authors that have a profile; the kinds of a day are listed in order, repeats kept."""
    known = events.where("kind = 0").select("pubkey").distinct()
    grouped = (
        events.join(known, "pubkey", "left_semi")
        .groupBy("pubkey", _day().alias("date"))
        .agg(
            F.count("*").alias("total_events"),
            F.count_distinct("kind").alias("unique_kinds"),
            F.sort_array(F.collect_list("kind")).alias("kinds_used"),
        )
    )
    return grouped.orderBy(F.desc("date"), F.desc("total_events"), "pubkey")


def metadata_stats(events: DataFrame) -> DataFrame:
    """One row over authors with a profile. ``total_metadata_events`` counts authors, as it is defined."""
    per_user = events.where("kind = 0").groupBy("pubkey").agg(F.count("*").alias("updates"))
    return per_user.agg(
        F.count_distinct("pubkey").alias("total_users_with_metadata"),
        F.count("*").alias("total_metadata_events"),
        F.avg("updates").alias("avg_updates_per_user"),
        F.percentile("updates", F.lit(0.5)).alias("median_updates_per_user"),
        F.max("updates").alias("max_updates_per_user"),
    )


def activity_by_kind(events: DataFrame, approx: bool = False) -> DataFrame:
    grouped = events.groupBy(_day().alias("date"), "kind").agg(F.count("*").alias("events"), _unique("pubkey", approx).alias("unique_publishers"))
    return grouped.orderBy(F.desc("date"), F.desc("events"), "kind")


def _publishers(events: DataFrame, *more: Column) -> DataFrame:
    grouped = events.groupBy("pubkey").agg(
        F.count("*").alias("total_events"),
        F.count_distinct("kind").alias("unique_kinds"),
        F.min("created_at").alias("first_event"),
        F.max("created_at").alias("last_event"),
        *more,
    )
    return grouped.withColumn("days_active", expr.day_difference(F.col("first_event"), F.col("last_event")))


def top_publishers(events: DataFrame) -> DataFrame:
    return _publishers(events).orderBy(F.desc("total_events"), "pubkey")


def top_verified_publishers(events: DataFrame) -> DataFrame:
    """As ``top_publishers``, with the profile, for authors that have one: authors are aggregated before the join."""
    profile = users_with_metadata(events).select("pubkey", F.col("latest_metadata").alias("metadata"))
    joined = _publishers(events).join(profile, "pubkey")
    columns = ["pubkey", "total_events", "unique_kinds", "first_event", "last_event", "days_active", "metadata"]
    return joined.select(*columns).orderBy(F.desc("total_events"), "pubkey")


#: All views by name; ``create_views`` makes temporary views of them.
VIEWS: dict[str, Callable[[DataFrame], DataFrame]] = {
    f.__name__: f
    for f in (
        event_stats, relay_stats, tag_stats, daily_active_users, weekly_active_users, monthly_active_users, users_with_metadata,
        verified_user_activity, metadata_stats, activity_by_kind, top_publishers, top_verified_publishers,
    )
}


def create_views(events: DataFrame) -> None:
    """Temporary SQL views: events, event_tags_flat and every view above."""
    events.createOrReplaceTempView("events_local")
    flatten(events).createOrReplaceTempView("event_tags_flat")
    for name, view in VIEWS.items():
        view(events).createOrReplaceTempView(name)


# Recipes: parametrised reads of the events table and of its views.


def recent_events(events: DataFrame, as_of: int, seconds: int = 86_400, most: int = 100) -> DataFrame:
    """The latest events of the last day before ``as_of``."""
    since = events.where(F.col("created_at") >= as_of - seconds)
    return since.select("id", "pubkey", "created_at", "kind", "content").orderBy(F.desc("created_at"), "id").limit(most)


def month_histogram(events: DataFrame, month: int) -> DataFrame:
    """Events by kind of a month given as yyyyMM."""
    rows = events.where(expr.month_number(_day()) == month)
    return rows.groupBy("kind").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "kind")


def recent_of_kind(events: DataFrame, kind: int, most: int = 100) -> DataFrame:
    rows = events.where(F.col("kind") == kind)
    return rows.select("id", "pubkey", "created_at", "content").orderBy(F.desc("created_at"), "id").limit(most)


def kind_distribution(events: DataFrame, most: int | None = None) -> DataFrame:
    rows = events.groupBy("kind").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "kind")
    return rows if most is None else rows.limit(most)


def tagged_with(events: DataFrame, name: str, value: str) -> DataFrame:
    """Events with a tag of that name and first value: hashtags, mentions."""
    rows = flatten(events).where((F.col("tag_name") == name) & (F.col("tag_value_primary") == value))
    return rows.select("event_id", "pubkey", "created_at", "kind").orderBy(F.desc("created_at"), "event_id")


def replies(events: DataFrame, name: str = "e") -> DataFrame:
    """Tags marked as a reply, with what they reply to."""
    rows = flatten(events).where((F.col("tag_name") == name) & (F.col("tag_value_position_4") == "reply"))
    return rows.select("event_id", F.col("tag_value_primary").alias("replied_to_event"), "pubkey", "created_at")


def tags_of_event(events: DataFrame, event_id: str) -> DataFrame:
    return flatten(events.where(F.col("id") == event_id)).select("tag_name", "tag_value_primary", "tag_value_count")


def tags_of_kind(events: DataFrame, kind: int, name: str) -> DataFrame:
    rows = flatten(events.where(F.col("kind") == kind)).where(F.col("tag_name") == name)
    return rows.select("event_id", "tag_value_primary", "created_at")


def events_by_author(events: DataFrame, pubkey: str) -> DataFrame:
    rows = events.where(F.col("pubkey") == pubkey)
    return rows.select("id", "created_at", "kind", "content").orderBy(F.desc("created_at"), "id")


def recent_daily_active_users(events: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return daily_active_users(events.where(_day() >= F.date_sub(F.lit(as_of).cast("date"), days)))


def recent_activity(events: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    return activity_by_kind(events.where(_day() >= F.date_sub(F.lit(as_of).cast("date"), days)))


def date_range(events: DataFrame) -> DataFrame:
    return events.agg(F.min(_day()).alias("earliest"), F.max(_day()).alias("latest"))


def import_summary(events: DataFrame) -> DataFrame:
    size = F.sum(expr.byte_length(F.col("content")))
    return events.agg(
        F.count("*").alias("total_events"),
        F.count_distinct("pubkey").alias("unique_authors"),
        F.count_distinct("kind").alias("unique_kinds"),
        F.min("created_at").alias("earliest_event"),
        F.max("created_at").alias("latest_event"),
        size.alias("content_bytes"),
        expr.readable_size(size).alias("content_size"),
    )
