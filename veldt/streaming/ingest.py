"""Streaming ingest: lines are filtered, deduplicated, checked and stored in micro-batches.

Within a batch the first copy of an id stays; across batches the index decides, so the horizon of
deduplication has no end and late events go to their own day instead of being dropped. The index is
written last: a batch that is run again after a failure finds what it had not indexed and stores it
again under the same ids, and the store's readers take one version of each.
``bounded_dedup`` is the other choice: state up to a watermark, no index.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import first_wins, new_only
from ..operators.index import EventIndex
from ..operators.ingest import classify, quarantine, valid_events, validated
from ..operators.tags import flatten, relay_hints
from ..schema import EVENT_COLUMNS
from ..sources.store import EventStore


def _has(name: str, values: list[str]):
    return lambda t: (F.try_element_at(t, F.lit(1)) == name) & F.try_element_at(t, F.lit(2)).isin(values)


@dataclass(frozen=True)
class Accept:
    """Which events to take; an empty list takes all, and every list has to agree."""

    kinds: list[int] = field(default_factory=list)
    authors: list[str] = field(default_factory=list)
    tags: dict[str, list[str]] = field(default_factory=dict)

    def condition(self) -> Column:
        out = F.lit(True)
        if self.kinds:
            out &= F.col("kind").isin(self.kinds)
        if self.authors:
            out &= F.col("pubkey").isin(self.authors)
        for name, values in self.tags.items():
            if values:
                out &= F.exists("tags", _has(name, values))
        return out


def stream_lines(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Lines of the files that appear in a folder."""
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return rows.select("value", F.col("_metadata.file_name").alias("file_path"), F.col("_metadata.file_block_start").alias("block_start"))


def bounded_dedup(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One event per id as far back as the watermark reaches."""
    timed = events.withColumn("event_time", F.timestamp_seconds("created_at"))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["id"])


def windowed_counts(events: DataFrame, size: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Events by kind in windows of event time."""
    timed = events.withColumn("event_time", F.timestamp_seconds("created_at")).withWatermark("event_time", delay)
    counted = timed.groupBy(F.window("event_time", size), "kind").agg(F.count("*").alias("events"))
    return counted.select(F.col("window.start").alias("window_start"), "kind", "events")


@dataclass
class Ingest:
    """Sinks of a streaming ingest and the checks that it makes."""

    store: EventStore
    index: EventIndex
    tags_path: str | None = None
    quarantine_path: str | None = None
    accept: Accept = field(default_factory=Accept)
    event_ids: bool = True
    signatures: bool = True

    #: Counts of the last batches by number, for monitoring: see ``health``.
    metrics: list[dict] = field(default_factory=list)
    most_metrics: int = 1000
    #: Where relays that new events name are written, with how often; none by default.
    relays_path: str | None = None

    def batch(self, lines: DataFrame, number: int = 0) -> None:
        """Take in one micro-batch.

        Lines are parsed and checked by their form first; events that are not wanted or known already go before
        hashes and signatures, the dear part, are looked at. Different events under one id are told apart after
        that: the first valid one stays.
        """
        began = time.time()
        parsed = classify(lines, event_ids=False, signatures=False).persist()
        told = None
        try:
            wanted = parsed.where("status = 'valid'").where(self.accept.condition())
            # Exact copies share a verdict: one of them is looked at.
            unknown = first_wins(new_only(wanted, self.index.rows), ["file_path", "block_start"], EVENT_COLUMNS)
            told = validated(unknown, event_ids=self.event_ids, signatures=self.signatures).persist()
            if self.quarantine_path:
                rejected = quarantine(parsed).unionByName(quarantine(told))
                rejected.write.mode("append").parquet(self.quarantine_path)
            fresh = first_wins(valid_events(told), ["file_path", "block_start", "created_at", "content"]).persist()
            try:
                added = fresh.count()
                if added:
                    self.store.append(fresh.drop("file_path", "block_start"))
                    if self.tags_path:
                        flatten(fresh).write.mode("append").parquet(self.tags_path)
                    if self.relays_path:
                        relay_hints(fresh).write.mode("append").parquet(self.relays_path)
                    self.index.insert(fresh)
            finally:
                fresh.unpersist()
            counts = {r.status: r["count"] for r in parsed.groupBy("status").count().collect()}
            refused = told.where("status = 'invalid'").count()
            one = {"batch": number, "lines": sum(counts.values()), "refused": refused, "added": added, "seconds": round(time.time() - began, 3)}
            self.metrics.append(one | {s: counts.get(s, 0) for s in ("filtered", "skipped", "invalid")})
            del self.metrics[: -self.most_metrics]
        finally:
            parsed.unpersist()
            if told is not None:
                told.unpersist()

    def health(self, query: StreamingQuery | None = None) -> dict:
        """Whether the stream runs, what failed, and sums over the batches that ``metrics`` holds."""
        sums = {k: sum(m[k] for m in self.metrics) for k in ("lines", "filtered", "skipped", "invalid", "refused", "added")}
        failed = query.exception() if query is not None else None
        return {"active": query.isActive if query is not None else None, "error": str(failed) if failed else None, "batches": len(self.metrics), **sums}

    @staticmethod
    def stop(query: StreamingQuery, seconds: int = 60) -> None:
        """End after the batch that runs now, or after so many seconds; what is not indexed is taken in again at the next start."""
        until = time.time() + seconds
        while query.isActive and query.status["isTriggerActive"] and time.time() < until:
            time.sleep(0.1)
        query.stop()

    def start(self, lines: DataFrame, checkpoint: str, *, every: str | None = "30 seconds") -> StreamingQuery:
        """Run until stopped, or, with ``every=None``, over what is there now."""
        writer = lines.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
        return writer.start()
