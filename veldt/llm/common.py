"""Helpers that the operators share: tables, the shared folder, batch iteration."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, *, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the folder that driver and executors share and read it back, which ends its lineage."""
    spark = df.sparkSession
    path = scratch(spark)
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._veldt_path = path
    return out


def drop_cut(*tables: DataFrame | None) -> None:
    """Delete tables that ``cut`` wrote and nothing will read again."""
    for df in tables:
        path = getattr(df, "_veldt_path", None)
        if path is not None:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def settle(df: DataFrame) -> DataFrame:
    """``cut``, after which the table that ``df`` was made of goes."""
    out = cut(df)
    drop_cut(df)
    return out


#: About so many bytes of text are looked at together; arrays made for them are some dozens of times as large.
PART_BYTES = 1 << 19


def parts(batches: Iterator[pa.RecordBatch], name: str, most_bytes: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts hold about ``most_bytes``, at least one row each.

    Only a slice's texts are Python objects at a time. At the end, freed memory goes back to the system,
    as the worker may live on and others need it.
    """
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(batch.schema.get_field_index(name))).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes, side="right"))
            stop = max(at + 1, stop)
            yield batch.slice(at, stop - at)
            at = stop
    give_back()


def give_back() -> None:
    """Return freed memory to the system, where the C library has a call for that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The column as strings; null counts as the empty text."""
    return [t if t is not None else "" for t in column(batch, name)]


def changes(table: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    """Whether each row but the first differs from the one before in any of the columns."""
    out = np.zeros(max(table.num_rows - 1, 0), bool)
    for name in names:
        v = table.column(name).to_numpy()
        out |= v[1:] != v[:-1]
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.Table]:
    """Sorted batches, put together so that no table ends inside a group of equal ``names``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and changes(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]), names)[0]:
            yield pa.Table.from_batches(held)
            held = []
        cuts = np.flatnonzero(changes(pa.Table.from_batches([batch]), names))
        if len(cuts):
            last = int(cuts[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Powers:
    """Powers of an odd base modulo 2**64 and their inverses, for prefix hashes of spans."""

    def __init__(self, base: int) -> None:
        self.base = base
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 1 << 16)
            inverse = pow(self.base, -1, 1 << 64)
            for name, base in (("up", self.base), ("down", inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


POWERS = Powers(0x9E3779B97F4A7C15)
OTHER_POWERS = Powers(0xD1342543DE82EF95)


class Spans:
    """64-bit hashes of spans of a sequence of symbols, equal for equal spans wherever they stand.

    Prefix sums of symbol times power make every span a subtraction. Such a polynomial
    modulo 2**64 is weak for spans of thousands of crafted symbols; callers keep long spans apart.
    """

    def __init__(self, symbols: np.ndarray, powers: Powers = POWERS) -> None:
        up, self.down = powers.reach(len(symbols) + 1)
        self.prefix = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(0x1000193)) * up[:-1], out=self.prefix[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.prefix[ends] - self.prefix[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    """The hash of each ``symbols[start:end]``."""
    return Spans(symbols, powers).hashes(starts, ends)
