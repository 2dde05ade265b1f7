"""Paths of object stores and of the web: which file system they are of, and files of them as event rows."""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wire

_BUCKET = re.compile(r"s3[an]?://([^/]+)(?:/(.*))?")


def bucket_and_key(uri: str) -> tuple[str, str]:
    """The bucket and the key (or its beginning) of ``s3://bucket/key``; ValueError for anything else."""
    m = _BUCKET.fullmatch(uri)
    if m is None:
        raise ValueError(f"no path of an object store: {uri}")
    return m[1], m[2] or ""


def read_pb_objects(spark: SparkSession, paths: str | list[str], *, mode: str = "PERMISSIVE", pattern: str = "*.pb.gz") -> DataFrame:
    """Event files of any store that Spark reads (s3a, hdfs, abfss, viewfs, ...), as ``events_pb`` gives them.

    Each file is one row of bytes for the task that decodes it, so files should be of a day's size or less
    (2 GB at most); ``write_pb_parts`` makes such. Broken records are passed over (PERMISSIVE), given
    as rows whose event is null (REPORT) or an error (FAILFAST).
    """
    from .events_pb import SCHEMA, batch_of

    strict, report = mode.upper() == "FAILFAST", mode.upper() == "REPORT"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = []
                with gzip.open(io.BytesIO(body.as_buffer())) as stream:
                    for place, event in wire.read_events(stream, strict=strict, report=report):
                        held.append((*(event or [None] * 7), name, place))
                        if len(held) == 4096:
                            yield batch_of(held)
                            held = []
                if held:
                    yield batch_of(held)

    named = [re.sub(r"^s3n?://", "s3a://", p) for p in ([paths] if isinstance(paths, str) else paths)]
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(named)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInArrow(run, SCHEMA)


def write_pb_parts(events: DataFrame, folder: str, *, per_file: int = 200_000, level: int = 6, mode: str = "append") -> None:
    """Events as parts of day files in any store that Spark writes: Parquet rows of one gzip member each.

    ``folder/event_date=.../``: a row has the file's name and its bytes, made where the events are. A day is spread over
    as many tasks as its events need, and no byte goes through the driver. ``read_pb_parts`` reads them back; ``members``
    of one day put behind each other are that day's ``.pb.gz`` file.
    """
    from ..functions.expr import date_key
    from ..schema import EVENT

    names = EVENT.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def member(day: str) -> pa.RecordBatch:
            body = wire.compress(iter(held.pop(day)), level)
            return pa.RecordBatch.from_arrays([pa.array([day]), pa.array([body], pa.binary())], ["event_date", "member"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *event, day in zip(*columns, strict=True):
                own = held.setdefault(day, [])
                own.append((*event[:4], [list(t) for t in event[4] or []], *event[5:]))
                if len(own) >= per_file:
                    yield member(day)
        for day in sorted(held):
            yield member(day)

    rows = events.select(*names, date_key(F.col("created_at")).alias("event_date")).hint("rebalance", "event_date")
    rows.mapInArrow(run, "event_date string, member binary").write.mode(mode).partitionBy("event_date").parquet(folder)


def read_pb_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The events of ``write_pb_parts``, with the day as ``event_date``."""
    from ..schema import EVENT
    from .events_pb import batch_of

    names = EVENT.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for day, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = []
                with gzip.open(io.BytesIO(body.as_buffer())) as stream:
                    for place, event in wire.read_events(stream):
                        held.append((*event, day, place))
                        if len(held) == 4096:
                            yield batch_of(held)
                            held = []
                if held:
                    yield batch_of(held)

    rows = spark.read.option("basePath", folder).schema("member binary, event_date string").parquet(folder)
    return rows.select("event_date", "member").mapInArrow(run, _parts_schema()).select(*names, F.col("file_path").alias("event_date"))


def _parts_schema():
    from .events_pb import SCHEMA

    return SCHEMA
