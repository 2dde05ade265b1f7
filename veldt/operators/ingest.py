"""Raw lines to events: prefilter, parse, and an ordered ladder of checks.

``classify`` gives every line one status: filtered (its kind is out of range before parsing), skipped
(blank), invalid (with a reason and a category) or valid (with the event's columns). The first check
that fails names the reason. Nothing is dropped, so the parts always add up to the whole. Everything
is JVM-side but the signature check, which sees only rows that passed all before it.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..functions.schnorr import BAD_KEY, BAD_SIGNATURE, signature_reason
from ..schema import EVENT_COLUMNS

STATUSES = ("filtered", "skipped", "invalid", "valid")
PROVENANCE = ["file_path", "block_start"]


def category_of(reason: Column) -> Column:
    """The category of a reason by what it says, the most specific first."""
    says = reason.contains
    ladder = [
        (says("Invalid tag value"), "InvalidTagValue"),
        (says("kind") & says("out of valid range"), "InvalidKind"),
        (says("Signature verification failed") | says("Invalid signature"), "InvalidSignature"),
        (says("Event ID") | says("EventIdMismatch"), "InvalidEventId"),
        (says("hash_error"), "HashError"),
        (says("storage_error"), "StorageError"),
        (says("validation_error"), "ValidationError"),
        (says("parse_error"), "ParseError"),
    ]
    out = F.lit("ValidationError")
    for test, name in reversed(ladder):
        out = F.when(test, F.lit(name)).otherwise(out)
    return F.when(reason.isNotNull(), out)


def _variant_type(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _is(v: Column, name: str) -> Column:
    """Whether a variant is there and of a type that has no parts."""
    return F.coalesce(F.schema_of_variant(v) == name, F.lit(False))


def _json_type(v: Column) -> Column:
    """The JSON name of a variant's type."""
    kind = _variant_type(v)
    names = {"STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "OBJECT": "object", "ARRAY": "array"}
    out = F.lit("number")
    for spark_name, name in names.items():
        out = F.when(kind == spark_name, F.lit(name)).otherwise(out)
    return out


def parse(lines: DataFrame, value: str = "value") -> DataFrame:
    """Adds the event's columns and ``parse_reason`` (null where the line is an event)."""
    v = F.try_parse_json(F.col(value))
    rows = expr.settled(lines, lines.columns, v.alias("_v"))
    field = lambda name, kind: F.try_variant_get("_v", f"$.{name}", kind)
    rows = expr.settled(
        rows,
        lines.columns,
        F.col("_v").isNull().alias("_broken"),
        *[field(c, "string").alias(c) for c in ("id", "pubkey", "content", "sig")],
        *[field(c, "bigint").alias(c) for c in ("created_at", "kind")],
        field("tags", "array<variant>").alias("_tags"),
        reduce(and_, [_is(field(c, "variant"), "STRING") for c in ("id", "pubkey", "content", "sig")]).alias("_strings"),
        *[_is(field(c, "variant"), "BIGINT").alias(f"_whole_{c}") for c in ("created_at", "kind")],
    )
    places = F.flatten(
        F.transform(
            "_tags",
            lambda t, i: F.coalesce(
                F.transform(
                    F.try_variant_get(t, "$", "array<variant>"),
                    lambda x, j: F.when(~_is(x, "STRING"), F.struct(i.alias("i"), j.alias("j"), _json_type(x).alias("type"))),
                ),
                F.array(),
            ),
        )
    )
    read = [*lines.columns, "_broken", "id", "pubkey", "content", "sig", "created_at", "kind", "_strings", "_whole_created_at", "_whole_kind"]
    rows = expr.settled(
        rows,
        read,
        F.get(F.filter(places, lambda x: x.isNotNull()), F.lit(0)).alias("_bad"),
        F.transform("_tags", lambda t: F.try_variant_get(t, "$", "array<string>")).alias("tags"),
    )
    whole = F.col("_whole_kind")
    shaped = F.col("tags").isNotNull() & ~F.exists("tags", lambda t: t.isNull())
    complete = F.col("_strings") & F.col("_whole_created_at") & whole & F.coalesce(shaped, F.lit(False))
    range_said = F.concat(
        F.lit("parse_error: Conversion failed: Event kind "), F.col("kind").cast("string"), F.lit(" is out of valid range (0-65535)")
    )
    tag_said = F.concat(
        F.lit("parse_error: Conversion failed: Invalid tag value: tags["), F.col("_bad.i").cast("string"), F.lit("]["), F.col("_bad.j").cast("string"),
        F.lit("] is "), F.col("_bad.type"), F.lit(", expected string"),
    )
    reason = (
        F.when(F.col("_broken"), "parse_error: Conversion failed: Invalid JSON")
        .when(whole & ~F.col("kind").between(0, 65535), range_said)
        .when(F.col("_bad").isNotNull(), tag_said)
        .when(~complete, "parse_error: Conversion failed: fields id, pubkey, created_at, kind, tags, content, sig are required, each of its type")
    )
    kind = F.when(F.col("kind").between(0, 65535), F.col("kind")).cast("int")
    fields = ["id", "pubkey", "created_at", "tags", "content", "sig"]
    return expr.settled(rows, [*lines.columns, *fields], kind.alias("kind"), reason.alias("parse_reason"))


def basic_reason() -> Column:
    """What the cheap checks of a parsed event say, the first that fails; null if none does."""
    hexes = [("id", "Event ID", 64), ("pubkey", "Pubkey", 64), ("sig", "Signature", 128)]
    out = F.lit(None).cast("string")
    kind, at = F.col("kind"), F.col("created_at")
    out = F.when(~kind.between(0, 65535), F.concat(F.lit("validation_error: Validation failed: Invalid kind: "), kind.cast("string"))).otherwise(out)
    out = F.when(at < 0, F.concat(F.lit("validation_error: Validation failed: Invalid timestamp: "), at.cast("string"))).otherwise(out)
    for name, said, digits in reversed(hexes):
        text = F.concat(
            F.lit(f"validation_error: Validation failed: Invalid hex encoding: {said} must be {digits} hex characters, got: "), F.col(name)
        )
        out = F.when(~expr.is_hex_of(F.col(name), digits), text).otherwise(out)
    return out


def _signature_said(told: Column) -> Column:
    prefix = "validation_error: Validation failed: "
    return (
        F.when(told == BAD_SIGNATURE, F.lit(prefix + "Invalid signature: malformed signature"))
        .when(told == BAD_KEY, F.lit(prefix + "Invalid public key: malformed public key"))
        .when(told != "", F.lit(prefix + "Signature verification failed: incorrect signature"))
    )


def validate(parsed: DataFrame, *, event_ids: bool = True, signatures: bool = True) -> DataFrame:
    """Adds ``reason``: the parse reason, then basic fields, then the id, then the signature.

    The hash is computed once, for both; signatures are over the recomputed hash, not the stored id.
    """
    rows = expr.settled(parsed, parsed.columns, F.coalesce("parse_reason", basic_reason()).alias("reason"))
    if not (event_ids or signatures):
        return rows
    rows = expr.settled(rows, rows.columns, F.when(F.col("reason").isNull(), expr.event_hash()).alias("_hash"))
    if event_ids:
        said = F.concat(
            F.lit("validation_error: Validation failed: Event ID mismatch: expected "), F.col("_hash"), F.lit(", got "), F.col("id")
        )
        told = F.coalesce("reason", F.when(F.col("id") != F.col("_hash"), said))
        rows = expr.settled(rows, [c for c in rows.columns if c != "reason"], told.alias("reason"))
    if signatures:
        told = signature_reason(F.col("_hash"), F.col("pubkey"), F.col("sig"), F.col("reason").isNull())
        rows = rows.withColumn("_told", told)
        kept = [c for c in rows.columns if c not in ("reason", "_told")]
        rows = expr.settled(rows, kept, F.coalesce("reason", _signature_said(F.col("_told"))).alias("reason"))
    return rows.drop("_hash")


def classify(lines: DataFrame, *, prefilter: bool = True, event_ids: bool = True, signatures: bool = True, value: str = "value") -> DataFrame:
    """Every line with its status, reason and category, and the event's columns where it is valid."""
    text = F.col(value)
    early = F.when(expr.is_blank(text), "skipped")
    if prefilter:
        early = early.when(~expr.kind_prefilter(text), "filtered")
    marked = expr.settled(lines, lines.columns, early.alias("_early"))
    marked = marked.withColumn("_line", F.when(F.col("_early").isNull(), text))
    kept = [c for c in lines.columns if c != value]
    rows = validate(parse(marked.select(*kept, text.alias("_raw"), "_early", "_line"), "_line"), event_ids=event_ids, signatures=signatures)
    status = F.coalesce("_early", F.when(F.col("reason").isNotNull(), "invalid").otherwise("valid"))
    rows = expr.settled(rows, rows.columns, status.alias("status"))
    invalid = F.col("status") == "invalid"
    return rows.select(
        *kept,
        F.col("_raw").alias(value),
        "status",
        F.when(invalid, category_of(F.col("reason"))).alias("category"),
        F.when(invalid, F.col("reason")).alias("reason"),
        *[F.when(F.col("status") == "valid", F.col(c)).alias(c) for c in EVENT_COLUMNS],
        F.when(invalid, F.col("id")).alias("rejected_id"),
    )


def validated(classified: DataFrame, *, event_ids: bool = True, signatures: bool = True) -> DataFrame:
    """The valid rows of ``classify`` once more, through the checks of id and signature that it was told to leave out."""
    rows = classified.where("status = 'valid'").withColumn("parse_reason", F.lit(None).cast("string"))
    kept = [c for c in classified.columns if c not in ("status", "category", "reason", "rejected_id", *EVENT_COLUMNS)]
    told = validate(rows.drop("status", "category", "reason", "rejected_id"), event_ids=event_ids, signatures=signatures)
    invalid = F.col("reason").isNotNull()
    return told.select(
        *kept,
        F.when(invalid, "invalid").otherwise("valid").alias("status"),
        F.when(invalid, category_of(F.col("reason"))).alias("category"),
        "reason",
        *[F.when(~invalid, F.col(c)).alias(c) for c in EVENT_COLUMNS],
        F.when(invalid, F.col("id")).alias("rejected_id"),
    )


def valid_events(classified: DataFrame) -> DataFrame:
    where = [c for c in classified.columns if c in PROVENANCE]
    return classified.where("status = 'valid'").select(*EVENT_COLUMNS, *where)


def quarantine(classified: DataFrame) -> DataFrame:
    """Rejected lines with where they stood, the category, the shortened reason and the start of the id."""
    where = [c for c in classified.columns if c in PROVENANCE]
    rows = classified.where("status = 'invalid'")
    return rows.select(*where, "category", expr.shortened(F.col("reason")).alias("reason"), F.substring("rejected_id", 1, 8).alias("id_start"), "value")


def conversion_stats(classified: DataFrame) -> DataFrame:
    """One row: total, filtered, skipped, invalid and valid lines, and the share of valid ones in percent."""
    counts = classified.agg(
        F.count("*").alias("total_lines"),
        *[F.count(F.when(F.col("status") == s, 1)).alias(f"{s}_{'events' if s in ('valid', 'invalid') else 'lines'}") for s in STATUSES],
    )
    return counts.withColumn("success_rate", expr.percent(F.col("valid_events"), F.col("total_lines")))


def error_breakdown(classified: DataFrame) -> DataFrame:
    """Rejected lines by category, most frequent first."""
    rows = classified.where("status = 'invalid'").groupBy("category").agg(F.count("*").alias("count"))
    return rows.orderBy(F.desc("count"), "category")
