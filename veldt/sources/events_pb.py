"""The data source ``events_pb``: folders of ``YYYY_MM_DD.pb.gz`` files.

Reading gives the event, ``file_path`` (the file's name) and ``position``; one partition per file.
``mode`` is PERMISSIVE (broken records are passed over), REPORT (they, and the place where a file
breaks off, are rows whose event is null) or FAILFAST. Writing adds a gzip member per
task and day; the members reach the day's file only when the whole job commits. Options:
``compressionLevel`` (0 to 9, 6 by default). The folder has to be one that all machines mount.
"""

from __future__ import annotations

import glob
import gzip
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..schema import EVENT
from . import wire

SCHEMA = StructType([*EVENT.fields, StructField("file_path", StringType()), StructField("position", LongType())])
_ARROW = pa.schema(
    [
        ("id", pa.string()), ("pubkey", pa.string()), ("created_at", pa.int64()), ("kind", pa.int32()), ("tags", pa.list_(pa.list_(pa.string()))),
        ("content", pa.string()), ("sig", pa.string()), ("file_path", pa.string()), ("position", pa.int64()),
    ]
)
TEMPORARY = re.compile(r"thread_(\d+)_(\d{4})_(\d{2})_(\d{2})\.pb\.gz\.tmp")


def local(path: str) -> str:
    return re.sub(r"^file:/+", "/", path)


def temporary_date(name: str) -> str | None:
    """The day of a temporary file's name, as ``YYYY_MM_DD``."""
    m = TEMPORARY.fullmatch(name)
    return "_".join(m.groups()[1:]) if m else None


def event_files(paths: list[str], pattern: str = "*.pb.gz") -> list[str]:
    """The files of folders (not of their folders) and single files, by name within each path."""
    out = []
    for path in map(local, paths):
        if os.path.isdir(path):
            out += sorted(glob.glob(os.path.join(glob.escape(path), pattern)))
        elif os.path.exists(path):
            out.append(path)
        elif found := sorted(glob.glob(path)):
            out += found
        else:
            raise FileNotFoundError(path)
    return out


def batch_of(rows: list) -> pa.RecordBatch:
    """Rows of the event, its file and its position as a batch."""
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = options["path"].split(",")
        self.pattern = options.get("pattern", "*.pb.gz")
        mode = options.get("mode", "PERMISSIVE").upper()
        self.strict, self.report = mode == "FAILFAST", mode == "REPORT"

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in event_files(self.paths, self.pattern)] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        name, held = os.path.basename(partition.path), []
        with gzip.open(partition.path) as stream:
            for place, event in wire.read_events(stream, strict=self.strict, report=self.report):
                held.append((*(event or [None] * 7), name, place))
                if len(held) == 4096:
                    yield batch_of(held)
                    held = []
        if held:
            yield batch_of(held)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool) -> None:
        self.folder, self.overwrite = local(options["path"]), overwrite
        self.level = int(options.get("compressionlevel", options.get("compressionLevel", 6)))
        self.places = [schema.fieldNames().index(c) for c in EVENT.fieldNames()]

    def write(self, rows: Iterator) -> _Written:
        work = os.path.join(self.folder, "_temporary")
        os.makedirs(work, exist_ok=True)
        open_files: dict[str, tuple[str, gzip.GzipFile]] = {}
        for row in rows:
            event = tuple(row[i] for i in self.places)
            event = (*event[:4], [list(t) for t in event[4] or []], *event[5:])
            day = datetime.fromtimestamp(event[2], UTC).strftime("%Y_%m_%d")
            if day not in open_files:
                path = os.path.join(work, f"{day}.{uuid.uuid4().hex}.tmp")
                open_files[day] = path, gzip.GzipFile(path, "wb", self.level, mtime=0)
            body = wire.encode(event)
            open_files[day][1].write(wire.varint(len(body)) + body)
        for _, f in open_files.values():
            f.close()
        return _Written([(day, path) for day, (path, _) in sorted(open_files.items())])

    def commit(self, messages: list[_Written | None]) -> None:
        """Put each day's members together and rename the result into place."""
        days: dict[str, list[str]] = {}
        for m in messages:
            for day, path in m.files if m else ():
                days.setdefault(day, []).append(path)
        os.makedirs(self.folder, exist_ok=True)
        if self.overwrite:
            for path in event_files([self.folder]):
                if os.path.basename(path).removesuffix(".pb.gz") not in days:
                    os.remove(path)
        for day, parts in days.items():
            final = os.path.join(self.folder, f"{day}.pb.gz")
            whole = os.path.join(self.folder, "_temporary", f"{day}.{uuid.uuid4().hex}.whole")
            before = [final] if os.path.exists(final) and not self.overwrite else []
            with open(whole, "wb") as out:
                for part in [*before, *parts]:
                    with open(part, "rb") as f:
                        while block := f.read(1 << 20):
                            out.write(block)
            os.replace(whole, final)
        self._clean(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clean(messages)

    def _clean(self, messages: list[_Written | None]) -> None:
        for m in messages:
            for _, path in m.files if m else ():
                if os.path.exists(path):
                    os.remove(path)
        work = os.path.join(self.folder, "_temporary")
        if os.path.isdir(work) and not os.listdir(work):
            os.rmdir(work)


class EventsPb(DataSource):
    @classmethod
    def name(cls) -> str:
        return "events_pb"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(schema, self.options, overwrite)


def read_pb(spark: SparkSession, paths: str | list[str], *, mode: str = "PERMISSIVE", pattern: str = "*.pb.gz") -> DataFrame:
    spark.dataSource.register(EventsPb)
    joined = paths if isinstance(paths, str) else ",".join(paths)
    return spark.read.format("events_pb").option("mode", mode).option("pattern", pattern).load(joined)


def write_pb(events: DataFrame, folder: str, *, mode: str = "append", level: int = 6) -> None:
    """Write events; rows are dealt by day first, so a day's file is made by few tasks."""
    from ..functions.expr import date_key

    events.sparkSession.dataSource.register(EventsPb)
    dealt = events.select(EVENT.fieldNames()).repartition(date_key(events["created_at"]))
    dealt.write.format("events_pb").option("compressionLevel", level).mode(mode).save(folder)
