"""Deduplication of events: first wins, latest version wins, unions of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(events: DataFrame, order: list[Column | str], key: list[str] | None = None) -> DataFrame:
    """Of the rows that share a key (the id) the first by ``order``; the order must settle ties."""
    window = Window.partitionBy(*(key or ["id"])).orderBy(*order)
    return events.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def _content_order(columns: list[str], but: set[str]) -> list[Column]:
    """What settles ties between rows that differ at all: the columns in order, those of events first; maps can't be ordered."""
    first = [c for c in ("id", "created_at", "pubkey", "kind", "sig", "relay_source", "content", "tags") if c in columns]
    return [F.col(c) for c in dict.fromkeys([*first, *columns]) if c not in but]


def latest_wins(events: DataFrame, version: str = "indexed_at", key: list[str] | None = None) -> DataFrame:
    """Of the rows that share a key the one of the highest version; of equal versions the least by id, then by the other columns.

    ``key=["created_at", "kind", "pubkey"]`` replaces by sorting key instead of by id.
    """
    return first_wins(events, [F.desc(version), *_content_order(events.columns, {version})], key)


def merge_sources(sources: list[DataFrame], *, dedup: bool = True) -> DataFrame:
    """The union of sources; with ``dedup`` an event of an earlier source wins over a later one's.

    Within a source the first by file and position stays, else the least by the columns in order.
    """
    ranked = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    union = ranked[0]
    for s in ranked[1:]:
        union = union.unionByName(s)
    if dedup:
        place = [c for c in ("file_path", "position") if c in union.columns]
        union = first_wins(union, ["_source", *place, *_content_order(union.columns, {"_source", *place})])
    return union.drop("_source")


def new_only(events: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """Events whose id no known row has: insert-or-ignore as an anti join."""
    return events.join(known.select(key), key, "left_anti")


def replaceable(events: DataFrame) -> DataFrame:
    """The latest event of each author and replaceable kind; other kinds unchanged.

    Replaceable: kinds 0, 3 and 10000 to 19999. Ties in time go to the least id.
    """
    kind = F.col("kind")
    can = kind.isin(0, 3) | kind.between(10000, 19999)
    latest = first_wins(events.where(can), [F.desc("created_at"), F.col("id")], ["pubkey", "kind"])
    return events.where(~can).unionByName(latest)
