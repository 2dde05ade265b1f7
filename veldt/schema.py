"""Record types of the event log."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAGS = T.ArrayType(T.ArrayType(T.StringType()))

EVENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("pubkey", T.StringType()),
        T.StructField("created_at", T.LongType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("tags", TAGS),
        T.StructField("content", T.StringType()),
        T.StructField("sig", T.StringType()),
    ]
)

INDEX_RECORD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("pubkey", T.StringType()),
        T.StructField("created_at", T.LongType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("indexed_at", T.LongType()),
    ]
)

EVENT_COLUMNS = EVENT.fieldNames()

#: The error categories of rejected records.
CATEGORIES = ("ParseError", "InvalidTagValue", "InvalidKind", "InvalidSignature", "InvalidEventId", "HashError", "StorageError", "ValidationError")

#: The ranges of kinds by how their events live.
KIND_CLASSES = (("regular", 1000, 9999), ("replaceable", 10000, 19999), ("ephemeral", 20000, 29999), ("addressable", 30000, 39999))


def kind_class(kind: Column) -> Column:
    """The name of the range that a kind lies in; 'other' outside all of them."""
    out = F.lit("other")
    for name, low, high in KIND_CLASSES:
        out = F.when(kind.between(low, high), F.lit(name)).otherwise(out)
    return out
