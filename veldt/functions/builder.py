"""Event rows with defaults: what is not given is empty or 0."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENT


@dataclass(frozen=True)
class Event:
    """One event; ``with_`` gives a changed copy, so a base event can be built on many times."""

    id: str = ""
    pubkey: str = ""
    created_at: int = 0
    kind: int = 0
    tags: tuple[tuple[str, ...], ...] = field(default=())
    content: str = ""
    sig: str = ""

    def with_(self, **values) -> Event:
        return replace(self, **values)

    def tagged(self, *tag: str) -> Event:
        """One more tag."""
        return replace(self, tags=(*self.tags, tuple(tag)))

    def row(self) -> tuple:
        return tuple([list(t) for t in self.tags] if f.name == "tags" else getattr(self, f.name) for f in fields(self))


def frame_of(spark: SparkSession, events: list[Event]) -> DataFrame:
    return spark.createDataFrame([e.row() for e in events], EVENT)


def with_defaults(rows: DataFrame) -> DataFrame:
    """Rows of any event columns as whole events: absent columns and nulls get their defaults, other columns go."""
    empty = dict(zip(EVENT.fieldNames(), Event().row(), strict=True))
    out = []
    for f in EVENT.fields:
        default = F.lit(empty[f.name]) if f.name != "tags" else F.array()
        value = F.coalesce(F.col(f.name), default.cast(f.dataType)) if f.name in rows.columns else default
        out.append(value.cast(f.dataType).alias(f.name))
    return rows.select(out)
