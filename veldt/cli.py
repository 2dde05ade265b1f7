"""Command line: convert, merge, index, import. ``python -m veldt.cli --help``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.dedup import first_wins, merge_sources
from .operators.index import EventIndex
from .operators.ingest import classify, conversion_stats, error_breakdown, quarantine, valid_events
from .session import get_session
from .sources.events_pb import read_pb, write_pb
from .sources.lines import read_lines
from .sources.store import EventStore


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="veldt", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    convert = commands.add_parser("convert", help="JSON lines to event files by day")
    convert.add_argument("input", nargs="+")
    convert.add_argument("-o", "--output-dir", default="./pb_data")
    convert.add_argument("--no-validate-signatures", action="store_true")
    convert.add_argument("--no-validate-event-ids", action="store_true")
    convert.add_argument("--no-filter-kinds", action="store_true")
    convert.add_argument("--no-dedup", action="store_true")
    convert.add_argument("--quarantine", help="folder for rejected lines (Parquet)")
    convert.add_argument("--compression-level", type=int, default=6, choices=range(10))
    merge = commands.add_parser("merge", help="merge temporary event files into the files by day")
    merge.add_argument("output_dir")
    merge.add_argument("--temporary", help="folder of the temporary files; tmp/ of the output by default")
    merge.add_argument("--compression-level", type=int, default=6, choices=range(10))
    index = commands.add_parser("index", help="rebuild the lookup index from event files")
    index.add_argument("action", choices=["rebuild", "stats"])
    index.add_argument("pb_dir")
    index.add_argument("--index-path")
    load = commands.add_parser("import", help="load event files into the events table")
    load.add_argument("--input", nargs="+", required=True)
    load.add_argument("--table", required=True)
    load.add_argument("--dry-run", action="store_true")
    return top


def convert(spark: SparkSession, a: argparse.Namespace) -> int:
    """0, or 1 if there were lines and none was valid."""
    told = classify(
        read_lines(spark, a.input),
        prefilter=not a.no_filter_kinds,
        event_ids=not a.no_validate_event_ids,
        signatures=not a.no_validate_signatures,
    ).persist()
    try:
        stats = conversion_stats(told).first()
        if stats.valid_events:
            events = valid_events(told)
            write_pb(merge_sources([events], dedup=not a.no_dedup), a.output_dir, mode="append", level=a.compression_level)
        print(f"total {stats.total_lines}, valid {stats.valid_events}, invalid {stats.invalid_events}, skipped {stats.skipped_lines}, "
              f"filtered {stats.filtered_lines}, success rate {stats.success_rate:.1f}%")  # fmt: skip
        for row in error_breakdown(told).collect() if stats.invalid_events else ():
            print(f"  {row.category}: {row['count']}")
        if a.quarantine:
            quarantine(told).write.mode("append").parquet(a.quarantine)
    finally:
        told.unpersist()
    return int(stats.valid_events == 0 and stats.invalid_events > 0)


def merge(spark: SparkSession, a: argparse.Namespace) -> int:
    """Temporary copies win over the final files'; temporary files go only after the result is whole.

    Files with records that can't be read stay where they are, final ones under a name of their own; 1 is
    returned for them.
    """
    import os

    from .sources.events_pb import event_files, local

    folder = a.temporary or os.path.join(a.output_dir, "tmp")
    temporary, final = event_files([folder], "*.pb.gz.tmp"), event_files([a.output_dir])
    if not temporary:
        print("nothing to merge")
        return 0
    sources = [read_pb(spark, folder, pattern="*.pb.gz.tmp", mode="REPORT")]
    if final:
        sources.append(read_pb(spark, a.output_dir, mode="REPORT"))
    read = merge_sources([s.withColumn("_final", F.lit(bool(i))) for i, s in enumerate(sources)], dedup=False).persist()
    try:
        broken = {(r.file_path, r._final): r.n for r in read.where("id IS NULL").groupBy("file_path", "_final").agg(F.count("*").alias("n")).collect()}
        whole = read.where("id IS NOT NULL")
        merged = first_wins(whole, ["_final", "file_path", "position"]).drop("file_path", "position", "_final")
        total, n = whole.count(), merged.count()
        for path in final:
            if (os.path.basename(path), True) in broken:
                os.replace(local(path), local(path) + ".broken")
        write_pb(merged, a.output_dir, mode="overwrite", level=a.compression_level)
    finally:
        read.unpersist()
    for path in temporary:
        if (os.path.basename(path), False) not in broken:
            os.remove(local(path))
    print(f"{n} events, {total - n} duplicates, {sum(broken.values())} broken records")
    for (name, _), count in sorted(broken.items()):
        print(f"  {name} is kept: {count} records can't be read")
    return int(bool(broken))


def index(spark: SparkSession, a: argparse.Namespace) -> int:
    found = EventIndex(spark, a.index_path or f"{a.pb_dir.rstrip('/')}/index.parquet")
    if a.action == "rebuild":
        found.rebuild(read_pb(spark, a.pb_dir))
    s = found.stats().first()
    print(f"{s.total_events} events, {s.unique_files} files, {s.unique_pubkeys} authors, {s.earliest_event} to {s.latest_event}")
    return 0


def load(spark: SparkSession, a: argparse.Namespace) -> int:
    events = read_pb(spark, a.input, mode="FAILFAST")
    if a.dry_run:
        print(f"{events.count()} events read, none written")
        return 0
    store = EventStore(spark, a.table)
    store.append(events.drop("file_path", "position"))
    print(f"{store.count()} events in the table")
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = get_session("veldt " + a.command)
    return {"convert": convert, "merge": merge, "index": index, "import": load}[a.command](spark, a)


if __name__ == "__main__":
    sys.exit(main())
