"""A lookup index of events by id, kind, author and time: an ordinary Parquet table.

The index is written sorted by kind and time within files, with bloom filters on id and pubkey, so
lookups read few row groups.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import INDEX_RECORD
from .dedup import first_wins, new_only


def records(events: DataFrame, indexed_at: int | None = None) -> DataFrame:
    """The index rows of events that know their ``file_path``."""
    now = F.lit(int(time.time()) if indexed_at is None else indexed_at).cast("long")
    return events.select("id", "kind", "pubkey", "created_at", "file_path", now.alias("indexed_at"))


class EventIndex:
    """Index rows in a folder (or any DataFrame of them, read-only)."""

    def __init__(self, spark: SparkSession, path: str | None = None, rows: DataFrame | None = None) -> None:
        self.spark, self.path, self._rows = spark, path, rows

    @property
    def rows(self) -> DataFrame:
        if self._rows is not None:
            return self._rows
        try:
            return self.spark.read.schema(INDEX_RECORD).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], INDEX_RECORD)
            raise

    def _write(self, rows: DataFrame, mode: str) -> None:
        ordered = rows.sortWithinPartitions("kind", "created_at")
        writer = ordered.write.mode(mode).option("parquet.bloom.filter.adaptive.enabled", "true")
        for c in ("id", "pubkey"):
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(self.path)

    def rebuild(self, events: DataFrame, indexed_at: int | None = None) -> None:
        """Replace the index; of events that share an id the first by file name, then place, stays."""
        place = [c for c in ("file_path", "position") if c in events.columns]
        once = first_wins(events, [*place, "created_at", "pubkey"])
        self._write(records(once, indexed_at), "overwrite")

    def analyse(self, name: str) -> None:
        """Register the index in the catalog under a name, with statistics for the optimizer: after a rebuild."""
        self.spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        self.spark.sql(f"CREATE TABLE `{name}` USING parquet LOCATION '{self.path}'")
        self.spark.sql(f"ANALYZE TABLE `{name}` COMPUTE STATISTICS FOR COLUMNS kind, pubkey, created_at, file_path")

    def insert(self, events: DataFrame, indexed_at: int | None = None) -> tuple[int, int]:
        """Add events whose id is new; returns how many were added and how many were not."""
        place = [c for c in ("file_path", "position") if c in events.columns]
        fresh = new_only(records(first_wins(events, [*place, "created_at", "pubkey"]), indexed_at), self.rows).persist()
        try:
            total, added = events.count(), fresh.count()
            if added:
                self._write(fresh, "append")
        finally:
            fresh.unpersist()
        return added, total - added

    def get(self, event_id: str) -> DataFrame:
        """The row of an id: at most one."""
        return self.rows.where(F.col("id") == event_id).limit(1)

    def contains(self, event_id: str) -> bool:
        return not self.get(event_id).isEmpty()

    def _latest(self, rows: DataFrame) -> DataFrame:
        return rows.orderBy(F.desc("created_at"), "id")

    def by_kind(self, kind: int) -> DataFrame:
        return self._latest(self.rows.where(F.col("kind") == kind))

    def by_pubkey(self, pubkey: str) -> DataFrame:
        return self._latest(self.rows.where(F.col("pubkey") == pubkey))

    def by_date_range(self, start: int, end: int) -> DataFrame:
        """Rows of a time range, both ends included."""
        return self._latest(self.rows.where(F.col("created_at").between(start, end)))

    def stats(self) -> DataFrame:
        """One row: total_events, unique_files, unique_pubkeys, earliest_event, latest_event (null if empty)."""
        return self.rows.agg(
            F.count("*").alias("total_events"),
            F.count_distinct("file_path").alias("unique_files"),
            F.count_distinct("pubkey").alias("unique_pubkeys"),
            F.min("created_at").alias("earliest_event"),
            F.max("created_at").alias("latest_event"),
        )
