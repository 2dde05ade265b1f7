"""The driver's ``events`` table as an event log, in Spark and in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"signup": 0, "view": 1, "click": 7, "purchase": 9735, "error": 1984}
RELAYS = ("", "wss://a", "wss://b", "wss://c")


def _sha(prefix: str, c: Column) -> Column:
    return F.sha2(F.concat(F.lit(prefix), c.cast("string")), 256)


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, pubkey, created_at, kind, tags, content, sig, relay_source, n (the row's number).

    Rows of fewer files than there are cores are dealt out first: making events of them is the dear part.
    """
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    cores = spark.sparkContext.defaultParallelism
    if len(rows.inputFiles()) < cores:
        rows = rows.repartition(cores)
    kind = F.lit(None).cast("int")
    for name, number in KINDS.items():
        kind = F.when(F.col("event_type") == name, number).otherwise(kind)
    other = _sha("u:", (F.col("user_id") + 1) % 150)
    tags = F.array(F.array(F.lit("t"), F.col("event_type")), F.array(F.lit("p"), other, F.lit(""), F.lit("reply")))
    tags = F.when(F.col("event_id") % 10 == 0, F.concat(tags, F.array(F.array(F.lit("-"))))).otherwise(tags)
    relay = F.lit(RELAYS[0])
    for i, name in enumerate(RELAYS[1:], 1):
        relay = F.when(F.col("event_id") % 4 == i, name).otherwise(relay)
    # A timestamp without a zone is read as UTC, whatever the session's zone.
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    return rows.select(
        _sha("e:", F.col("event_id")).alias("id"),
        _sha("u:", F.col("user_id")).alias("pubkey"),
        F.floor(micros / 1_000_000).cast("long").alias("created_at"),
        kind.alias("kind"),
        tags.alias("tags"),
        F.col("props").alias("content"),
        F.lit("c" * 128).alias("sig"),
        relay.alias("relay_source"),
        F.col("event_id").cast("long").alias("n"),
    )


EVENTS_SQL = """WITH ev AS (
  SELECT sha256('e:' || event_id) AS id, sha256('u:' || user_id) AS pubkey, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS created_at,
    CAST(CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 7 WHEN 'purchase' THEN 9735 WHEN 'error' THEN 1984 END AS INTEGER) AS kind,
    list_concat([['t', event_type], ['p', sha256('u:' || ((user_id + 1) % 150)), '', 'reply']],
      CASE WHEN event_id % 10 = 0 THEN [['-']] ELSE [] END) AS tags,
    props AS content, repeat('c', 128) AS sig,
    CASE event_id % 4 WHEN 1 THEN 'wss://a' WHEN 2 THEN 'wss://b' WHEN 3 THEN 'wss://c' ELSE '' END AS relay_source,
    CAST(event_id AS BIGINT) AS n, CAST(make_timestamp((epoch_us(ts) // 1000000) * 1000000) AS DATE) AS day
  FROM events
), flat AS (
  SELECT id AS event_id, pubkey, created_at, kind, t AS tag, t[1] AS tag_name, coalesce(t[2], '') AS v2, coalesce(t[3], '') AS v3,
    coalesce(t[4], '') AS v4, coalesce(t[5], '') AS v5, coalesce(t[6], '') AS v6
  FROM (SELECT *, unnest(tags) AS t FROM ev) WHERE len(t) >= 1
)
"""


def raw_lines(events: DataFrame) -> DataFrame:
    """JSON lines of the events, some of them broken in a way that the row's number tells.

    n % 20: 1 blank, 2 no JSON, 3 a kind out of range, 4 a tag value that is a number, 5 no content,
    6 a short id, 7 a negative time, 8 an id that is not the hash; the rest have their hash as id.
    """
    from ..functions import expr

    case = F.col("n") % 20
    ident = F.when(case == 6, "short").when(case == 8, F.col("id")).otherwise(expr.event_hash())
    at = F.when(case == 7, F.lit(-1)).otherwise(F.col("created_at"))
    kind = F.when(case == 3, F.lit(70202)).otherwise(F.col("kind"))
    tags = F.when(case == 4, '[["e",1]]').otherwise(expr.json_tags(F.col("tags")))
    content = F.when(case == 5, "").otherwise(F.concat(F.lit(',"content":'), expr.json_string(F.col("content"))))
    line = F.concat(
        F.lit('{"id":"'), ident, F.lit('","pubkey":"'), F.col("pubkey"), F.lit('","created_at":'), at.cast("string"), F.lit(',"kind":'),
        kind.cast("string"), F.lit(',"tags":'), tags, content, F.lit(',"sig":"'), F.col("sig"), F.lit('"}'),
    )
    value = F.when(case == 1, "  ").when(case == 2, "{not json").otherwise(line)
    return expr.settled(events, ["n"], value.alias("value"))
