"""The events table: Parquet partitioned by day, deduplicated on request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import byte_length, event_date, event_json, readable_size
from ..operators.dedup import latest_wins
from ..schema import EVENT_COLUMNS


class EventStore:
    """Events under ``path/event_date=.../``, sorted by time, kind and author within files."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _fs(self):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def exists(self) -> bool:
        fs, path = self._fs()
        return fs.exists(path(self.path))

    def append(self, events: DataFrame, *, per_file: int = 5_000_000, mode: str = "append") -> None:
        """Add events; a late event goes to its own day. Days are spread over as many tasks as their rows need."""
        rows = events
        if "indexed_at" not in rows.columns:
            rows = rows.withColumn("indexed_at", F.current_timestamp())
        if "relay_source" not in rows.columns:
            rows = rows.withColumn("relay_source", F.lit(""))
        rows = rows.select(*EVENT_COLUMNS, "indexed_at", "relay_source", event_date(F.col("created_at")).alias("event_date"))
        dealt = rows.hint("rebalance", "event_date").sortWithinPartitions("event_date", "created_at", "kind", "pubkey")
        writer = dealt.write.mode(mode).partitionBy("event_date").option("maxRecordsPerFile", per_file)
        # Filters as large as a row group's ids need, up to 1 MB.
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
        writer.option("parquet.bloom.filter.enabled#pubkey", "true").option("parquet.bloom.filter.enabled#id", "true").parquet(self.path)

    def read(self, start: int | None = None, end: int | None = None) -> DataFrame:
        """Events, of a time range with both ends included; whole days outside it are not read."""
        rows = self.spark.read.parquet(self.path)
        at, day = F.col("created_at"), F.col("event_date")
        if start is not None:
            rows = rows.where((day >= event_date(F.lit(start))) & (at >= start))
        if end is not None:
            rows = rows.where((day <= event_date(F.lit(end))) & (at <= end))
        return rows

    def events(self, key: list[str] | None = None) -> DataFrame:
        """The latest version of each event: what the views read."""
        return latest_wins(self.read(), key=key)

    def count(self) -> int:
        return self.read().count()

    def compact(self, key: list[str] | None = None) -> None:
        """Rewrite the table without superseded versions; the old files go when the new ones are whole."""
        fs, path = self._fs()
        made, old = f"{self.path}__new", f"{self.path}__old"
        for leftover in (made, old):
            fs.delete(path(leftover), True)
        EventStore(self.spark, made).append(self.events(key).drop("event_date"), mode="overwrite")
        fs.rename(path(self.path), path(old))
        fs.rename(path(made), path(self.path))
        fs.delete(path(old), True)

    def days(self) -> DataFrame:
        """The table's days with their rows; read from Parquet footers."""
        return self.read().groupBy("event_date").agg(F.count("*").alias("events")).orderBy("event_date")

    def parts(self) -> DataFrame:
        """Files and bytes of each day, as the table's metadata."""
        files = self.read().select("event_date", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).distinct()
        by_day = files.groupBy("event_date").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
        return by_day.withColumn("readable", readable_size(F.col("bytes"))).orderBy("event_date")

    def compression(self) -> DataFrame:
        """One row: bytes of the events as JSON lines, bytes of the table, and their ratio."""
        json_bytes = self.read().agg(F.sum(byte_length(event_json()) + 1).alias("json_bytes"))
        stored = self.parts().agg(F.sum("bytes").alias("stored_bytes"))
        both = json_bytes.join(stored)  # one row each
        return both.withColumn("ratio", F.round(F.col("json_bytes") / F.nullif("stored_bytes", F.lit(0)), 2))

    def analyse(self, name: str) -> None:
        """Register the table in the catalog under a name and compute its statistics for the optimizer."""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` USING parquet LOCATION '{self.path}'")
        self.spark.sql(f"MSCK REPAIR TABLE `{name}`")
        self.spark.sql(f"ANALYZE TABLE `{name}` COMPUTE STATISTICS")

    def drop_days_before(self, day: str) -> list[str]:
        """Delete the partitions of earlier days; returns their names."""
        fs, path = self._fs()
        gone = []
        for status in fs.listStatus(path(self.path)):
            name = status.getPath().getName()
            if name.startswith("event_date=") and name.removeprefix("event_date=") < day:
                fs.delete(status.getPath(), True)
                gone.append(name)
        return sorted(gone)

    def sorted_copy(self, to: str, by: list[str]) -> None:
        """A copy in another order, for reads that filter on ``by``."""
        self.read().repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").parquet(to)
