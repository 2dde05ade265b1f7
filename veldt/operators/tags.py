"""The flattened tag table and what is read from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr

FLAT_COLUMNS = [
    "event_id", "pubkey", "created_at", "kind", "tag_array", "tag_name", "tag_value_primary", "tag_value_position_3", "tag_value_position_4",
    "tag_value_position_5", "tag_value_position_6", "tag_values_all", "tag_value_count", "tag_full",
]


def flatten(events: DataFrame) -> DataFrame:
    """One row per tag that is not empty; values by place, missing ones as ''. A narrow projection."""
    exploded = events.select(F.col("id").alias("event_id"), "pubkey", "created_at", "kind", F.explode("tags").alias("tag_array"))
    tag = F.col("tag_array")
    size = F.size(tag)
    return exploded.where(size >= 1).select(
        "event_id",
        "pubkey",
        "created_at",
        "kind",
        "tag_array",
        F.element_at(tag, 1).alias("tag_name"),
        expr.tag_value(tag, 2).alias("tag_value_primary"),
        *[expr.tag_value(tag, n).alias(f"tag_value_position_{n}") for n in range(3, 7)],
        F.slice(tag, 2, F.greatest(size - 1, F.lit(0))).alias("tag_values_all"),
        (size - 1).cast("long").alias("tag_value_count"),
        tag.alias("tag_full"),
    )


def relay_hints(events: DataFrame, most: int | None = None) -> DataFrame:
    """Addresses of relays that events name, with how often: r and relay tags, third places of e, p and a tags.

    ``most`` keeps the most named ones (ties by address).
    """
    flat = flatten(events)
    first = flat.where(F.col("tag_name").isin("r", "relay")).select(F.col("tag_value_primary").alias("relay"))
    third = flat.where(F.col("tag_name").isin("e", "p", "a")).select(F.col("tag_value_position_3").alias("relay"))
    named = first.unionAll(third).where(F.col("relay").startswith("ws://") | F.col("relay").startswith("wss://"))
    counted = named.groupBy("relay").agg(F.count("*").alias("mentions"))
    return counted.orderBy(F.desc("mentions"), "relay").limit(most) if most is not None else counted
