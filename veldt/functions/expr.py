"""Column builders: hex and length checks, canonical JSON, hashes, tags, dates. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64_MAX = "18446744073709551615"


def settled(df: DataFrame, keep: list[str], *computed: Column) -> DataFrame:
    """``keep`` and computed columns that later filters and projections take as they are.

    Catalyst moves filters below projections by writing the projections into them, over and over where
    expressions refer to each other; a generator of one row is a wall to that.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*computed))))


def is_hex(c: Column) -> Column:
    """Whether every character is a hexadecimal digit; true for the empty string."""
    return c.rlike("^[0-9a-fA-F]*$")


def is_hex_of(c: Column, digits: int) -> Column:
    return c.rlike(f"^[0-9a-fA-F]{{{digits}}}$")


def byte_length(c: Column) -> Column:
    return F.octet_length(c).cast("long")


def json_string(c: Column) -> Column:
    """A JSON string literal: quote, backslash and the 32 control characters escaped, in lower-case hex.

    Control characters are rare: only strings that hold one go through their replacements.
    """
    plain = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    out = plain
    for code in range(32):
        out = F.replace(out, F.lit(chr(code)), F.lit(short.get(code, f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(c.rlike(r"[\x00-\x1f]"), out).otherwise(plain), F.lit('"'))


def json_tags(tags: Column) -> Column:
    one = lambda t: F.concat(F.lit("["), F.array_join(F.transform(t, json_string), ","), F.lit("]"))
    return F.concat(F.lit("["), F.array_join(F.transform(tags, one), ","), F.lit("]"))


def canonical_json(pubkey: Column, created_at: Column, kind: Column, tags: Column, content: Column) -> Column:
    """``[0,pubkey,created_at,kind,tags,content]`` without white space: what an event's id is the hash of."""
    return F.concat(
        F.lit("[0,"), json_string(pubkey), F.lit(","), created_at.cast("string"), F.lit(","), kind.cast("string"), F.lit(","),
        json_tags(tags), F.lit(","), json_string(content), F.lit("]"),
    )


def event_hash() -> Column:
    """The recomputed id of an event row, lower-case hex."""
    return F.sha2(canonical_json(*(F.col(c) for c in ("pubkey", "created_at", "kind", "tags", "content"))), 256)


def event_json(pretty: bool = False) -> Column:
    """The event as a JSON object, fields in declaration order."""
    fields = F.struct("id", "pubkey", "created_at", "kind", "tags", "content", "sig")
    return F.to_json(fields, {"pretty": "true"} if pretty else {})


def event_time(created_at: Column) -> Column:
    return F.timestamp_seconds(created_at)


def date_key(created_at: Column) -> Column:
    """The UTC day as ``yyyy_MM_dd``; the day number is exact whatever the session's time zone."""
    return F.date_format(event_date(created_at), "yyyy_MM_dd")


def event_date(created_at: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(created_at / 86400).cast("int"))


def month_number(day: Column) -> Column:
    """The month of a day as yyyyMM."""
    return F.year(day) * 100 + F.month(day)


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def week_start(day: Column) -> Column:
    """The Monday of a day's week."""
    return F.date_sub(day, F.weekday(day))


def day_difference(first: Column, last: Column) -> Column:
    return F.datediff(event_date(last), event_date(first)).cast("long")


def tag_value(tag: Column, place: int) -> Column:
    """The tag's value at a place from 1, or the empty string."""
    return F.coalesce(F.try_element_at(tag, F.lit(place)), F.lit(""))


def without_tags(tags: Column, name: str) -> Column:
    """The tags but those of one name; empty tags stay."""
    return F.filter(tags, lambda t: ~F.coalesce(F.try_element_at(t, F.lit(1)) == name, F.lit(False)))


def readable_size(size: Column) -> Column:
    """Bytes in binary units with two decimals, as ``12.34 KiB``."""
    out = F.concat(F.format_string("%.2f", size.cast("double")), F.lit(" B"))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB"), 1):
        scaled = F.concat(F.format_string("%.2f", size / float(1024**power)), F.lit(f" {unit}"))
        out = F.when(size >= 1024**power, scaled).otherwise(out)
    return out


def shortened(reason: Column, most: int = 100) -> Column:
    """At most ``most`` characters, the last three of them dots where something is cut."""
    return F.when(F.length(reason) > most, F.concat(F.substring(reason, 1, most - 3), F.lit("..."))).otherwise(reason)


def percent(part: Column, whole: Column) -> Column:
    """To one decimal; 0 of nothing."""
    return F.round(F.coalesce(100 * part / F.nullif(whole, F.lit(0)), F.lit(0.0)), 1)


def kind_prefilter(line: Column) -> Column:
    """Keeps a raw line unless its first ``"kind"`` is a number over 65535 that 64 bits hold."""
    number = F.regexp_extract(line, r'"kind"\s*:\s*([0-9]+)', 1)
    # More than 20 digits, leading zeros aside, overflow 64 bits.
    trimmed = F.regexp_replace(number, "^0+(?=[0-9])", "")
    value = F.when(F.length(trimmed) <= 20, trimmed).try_cast("decimal(20,0)")
    fits = F.coalesce((value <= 65535) | (value > F.lit(U64_MAX).cast("decimal(20,0)")), F.lit(True))
    # Few lines have a number of five digits or more there: the others need no look at it.
    return F.when(line.rlike(r'"kind"\s*:\s*[0-9]{5}'), fits).otherwise(F.lit(True))


def is_blank(line: Column) -> Column:
    """Whether a line is empty or all white space of any kind."""
    return line.rlike(r"^[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*$")
