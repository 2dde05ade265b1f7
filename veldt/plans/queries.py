"""Registered queries over the driver's tables, each with its SQL for DuckDB."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr, schnorr
from ..operators import dedup, tags
from ..operators.index import EventIndex, records
from ..operators.ingest import basic_reason, category_of, classify, conversion_stats, error_breakdown, valid_events
from ..schema import kind_class
from ..session import scratch
from ..sources.lines import read_lines, write_json
from ..sources.remote import read_pb_parts, write_pb_parts
from ..sources.store import EventStore
from ..streaming.ingest import Accept, Ingest
from . import views
from .adapter import EVENTS_SQL, load_events, raw_lines

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: The literals that parametrised queries take.
AUTHOR, MONTH, AS_OF, AS_OF_DAY = 7, 202401, 1_705_000_000, "2024-01-12"


def _register(name: str, sql: str | None, query: Callable[[DataFrame], DataFrame]) -> None:
    _QUERIES[name] = lambda spark, sf_dir: query(load_events(spark, sf_dir))
    if sql is not None:
        _SQL[name] = EVENTS_SQL + sql


def _dates(df: DataFrame) -> DataFrame:
    """Dates as text, which every engine writes alike."""
    return df.select([F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes])


def _view(name: str, sql: str) -> None:
    _register(name, sql, lambda e, f=views.VIEWS[name]: _dates(f(e)))


_view("event_stats", """SELECT CAST(day AS VARCHAR) AS date, kind, count(*) AS event_count, count(DISTINCT pubkey) AS unique_authors,
  avg(strlen(content)) AS avg_content_length, CAST(sum(len(tags)) AS BIGINT) AS total_tags FROM ev GROUP BY day, kind""")
_view("relay_stats", """SELECT relay_source, count(*) AS event_count, count(DISTINCT id) AS unique_events, min(created_at) AS earliest_event,
  max(created_at) AS latest_event, count(DISTINCT pubkey) AS unique_authors FROM ev WHERE relay_source <> '' GROUP BY 1""")
_view("tag_stats", "SELECT tag_name, count(*) AS occurrence_count, count(DISTINCT event_id) AS unique_events FROM flat GROUP BY 1")
for _name, _column, _sql in (
    ("daily_active_users", "date", "day"),
    ("weekly_active_users", "week", "CAST(date_trunc('week', day) AS DATE)"),
    ("monthly_active_users", "month", "CAST(date_trunc('month', day) AS DATE)"),
):
    _view(_name, f"SELECT CAST({_sql} AS VARCHAR) AS {_column}, count(DISTINCT pubkey) AS active_users, count(*) AS total_events FROM ev GROUP BY 1")
_view("users_with_metadata", """SELECT pubkey, arg_max(content, (created_at, id)) AS latest_metadata, max(created_at) AS last_updated,
  count(*) AS metadata_updates FROM ev WHERE kind = 0 GROUP BY 1""")
_view("verified_user_activity", """SELECT pubkey, CAST(day AS VARCHAR) AS date, count(*) AS total_events, count(DISTINCT kind) AS unique_kinds,
  list_sort(list(kind)) AS kinds_used FROM ev WHERE pubkey IN (SELECT pubkey FROM ev WHERE kind = 0) GROUP BY pubkey, day""")
_view("metadata_stats", """SELECT count(DISTINCT pubkey) AS total_users_with_metadata, count(*) AS total_metadata_events, avg(u) AS avg_updates_per_user,
  quantile_cont(u, 0.5) AS median_updates_per_user, max(u) AS max_updates_per_user
  FROM (SELECT pubkey, count(*) AS u FROM ev WHERE kind = 0 GROUP BY 1)""")
_view("activity_by_kind", "SELECT CAST(day AS VARCHAR) AS date, kind, count(*) AS events, count(DISTINCT pubkey) AS unique_publishers FROM ev GROUP BY day, kind")
_PUBLISHERS = """SELECT pubkey, count(*) AS total_events, count(DISTINCT kind) AS unique_kinds, min(created_at) AS first_event,
  max(created_at) AS last_event, date_diff('day', min(day), max(day)) AS days_active FROM ev GROUP BY 1"""
_view("top_publishers", _PUBLISHERS)
_view("top_verified_publishers", f"""SELECT p.*, m.metadata FROM ({_PUBLISHERS}) p JOIN
  (SELECT pubkey, arg_max(content, (created_at, id)) AS metadata FROM ev WHERE kind = 0 GROUP BY 1) m USING (pubkey)""")

_ME = f"sha256('u:{AUTHOR}')"


def _me():
    return F.sha2(F.lit(f"u:{AUTHOR}"), 256)


def _flat(e: DataFrame) -> DataFrame:
    joined = lambda c: F.concat(F.lit("["), F.array_join(c, "|"), F.lit("]"))
    rows = tags.flatten(e)
    return rows.select(*[joined(F.col(c)).alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes])


_register("tags_flat", """SELECT event_id, pubkey, created_at, kind, '[' || array_to_string(tag, '|') || ']' AS tag_array, tag_name, v2 AS tag_value_primary,
  v3 AS tag_value_position_3, v4 AS tag_value_position_4, v5 AS tag_value_position_5, v6 AS tag_value_position_6,
  '[' || array_to_string(tag[2:], '|') || ']' AS tag_values_all, CAST(len(tag) - 1 AS BIGINT) AS tag_value_count,
  '[' || array_to_string(tag, '|') || ']' AS tag_full FROM flat""", _flat)
_register("recent_events", f"""SELECT id, pubkey, created_at, kind, content FROM ev WHERE created_at >= {AS_OF} - 86400
  ORDER BY created_at DESC, id LIMIT 100""", lambda e: views.recent_events(e, AS_OF))
_register("month_histogram", f"SELECT kind, count(*) AS count FROM ev WHERE year(day) * 100 + month(day) = {MONTH} GROUP BY 1",
          lambda e: views.month_histogram(e, MONTH))
_register("recent_kind_notes", "SELECT id, pubkey, created_at, content FROM ev WHERE kind = 1 ORDER BY created_at DESC, id LIMIT 100",
          lambda e: views.recent_of_kind(e, 1))
_register("kind_distribution", "SELECT kind, count(*) AS count FROM ev GROUP BY 1", views.kind_distribution)
_register("top_kinds", "SELECT kind, count(*) AS count FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3", lambda e: views.kind_distribution(e, 3))
_register("hashtag_lookup", "SELECT event_id, pubkey, created_at, kind FROM flat WHERE tag_name = 't' AND v2 = 'click'",
          lambda e: views.tagged_with(e, "t", "click"))
_register("replies", "SELECT event_id, v2 AS replied_to_event, pubkey, created_at FROM flat WHERE tag_name = 'p' AND v4 = 'reply'",
          lambda e: views.replies(e, "p"))
_register("mentions", f"SELECT event_id, pubkey, created_at, kind FROM flat WHERE tag_name = 'p' AND v2 = {_ME}",
          lambda e: tags.flatten(e).where((F.col("tag_name") == "p") & (F.col("tag_value_primary") == _me())).select("event_id", "pubkey", "created_at", "kind"))
_register("tags_of_event", "SELECT tag_name, v2 AS tag_value_primary, CAST(len(tag) - 1 AS BIGINT) AS tag_value_count FROM flat WHERE event_id = sha256('e:10')",
          lambda e: tags.flatten(e.where(F.col("id") == F.sha2(F.lit("e:10"), 256))).select("tag_name", "tag_value_primary", "tag_value_count"))
_register("tags_of_kind", "SELECT event_id, v2 AS tag_value_primary, created_at FROM flat WHERE kind = 7 AND tag_name = 't'",
          lambda e: views.tags_of_kind(e, 7, "t"))
_register("events_by_author", f"SELECT id, created_at, kind, content FROM ev WHERE pubkey = {_ME}",
          lambda e: e.where(F.col("pubkey") == _me()).select("id", "created_at", "kind", "content").orderBy(F.desc("created_at"), "id"))
_register("recent_daily_active_users", f"""SELECT CAST(day AS VARCHAR) AS date, count(DISTINCT pubkey) AS active_users, count(*) AS total_events FROM ev
  WHERE day >= DATE '{AS_OF_DAY}' - 30 GROUP BY day""", lambda e: _dates(views.recent_daily_active_users(e, AS_OF_DAY)))
_register("recent_activity", f"""SELECT CAST(day AS VARCHAR) AS date, kind, count(*) AS events, count(DISTINCT pubkey) AS unique_publishers FROM ev
  WHERE day >= DATE '{AS_OF_DAY}' - 7 GROUP BY day, kind""", lambda e: _dates(views.recent_activity(e, AS_OF_DAY)))
_register("date_range", "SELECT CAST(min(day) AS VARCHAR) AS earliest, CAST(max(day) AS VARCHAR) AS latest FROM ev", lambda e: _dates(views.date_range(e)))
_register("import_summary", """SELECT count(*) AS total_events, count(DISTINCT pubkey) AS unique_authors, count(DISTINCT kind) AS unique_kinds,
  min(created_at) AS earliest_event, max(created_at) AS latest_event, CAST(sum(strlen(content)) AS BIGINT) AS content_bytes FROM ev""",
  lambda e: views.import_summary(e).drop("content_size"))


# Index.


def _index(e: DataFrame) -> EventIndex:
    named = e.withColumn("file_path", F.concat(expr.date_key(F.col("created_at")), F.lit(".pb.gz")))
    return EventIndex(e.sparkSession, rows=records(named, 0).drop("indexed_at"))


#: The id and the key that the fixtures' event 5 and author have.
_EVENT, _AUTHOR_KEY = (hashlib.sha256(x.encode()).hexdigest() for x in ("e:5", f"u:{AUTHOR}"))
_INDEX = "SELECT id, kind, pubkey, created_at, strftime(day, '%Y_%m_%d') || '.pb.gz' AS file_path FROM ev "
_register("index_get", _INDEX + "WHERE id = sha256('e:5')", lambda e: _index(e).get(_EVENT))
_register("index_contains", "SELECT count(*) > 0 AS found FROM ev WHERE id = sha256('e:5')",
          lambda e: e.sparkSession.range(1).select(F.lit(_index(e).contains(_EVENT)).alias("found")))
_register("index_by_kind", _INDEX + "WHERE kind = 7", lambda e: _index(e).by_kind(7))
_register("index_by_pubkey", _INDEX + f"WHERE pubkey = {_ME}", lambda e: _index(e).by_pubkey(_AUTHOR_KEY))
_register("index_by_range", _INDEX + f"WHERE created_at BETWEEN {AS_OF} - 86400 AND {AS_OF}", lambda e: _index(e).by_date_range(AS_OF - 86_400, AS_OF))
_register("index_stats", """SELECT count(*) AS total_events, count(DISTINCT day) AS unique_files, count(DISTINCT pubkey) AS unique_pubkeys,
  min(created_at) AS earliest_event, max(created_at) AS latest_event FROM ev""", lambda e: _index(e).stats())


# Deduplication and unions: every third event stands in a second source too, with another text.


def _second(e: DataFrame) -> DataFrame:
    return e.where("n % 3 = 0").withColumn("content", F.lit("second"))


_register("dedup_first_wins", "SELECT id, content FROM ev", lambda e: dedup.merge_sources([e, _second(e)]).select("id", "content"))
_register("union_merge", "SELECT id, CASE WHEN n % 3 = 0 THEN 'second' ELSE content END AS content FROM ev",
          lambda e: dedup.merge_sources([_second(e), e]).select("id", "content"))
_register("union_all", "SELECT id, content FROM ev UNION ALL SELECT id, 'second' FROM ev WHERE n % 3 = 0",
          lambda e: dedup.merge_sources([e, _second(e)], dedup=False).select("id", "content"))
_register("latest_version_wins", "SELECT id, CASE WHEN n % 3 = 0 THEN 'second' ELSE content END AS content FROM ev",
          lambda e: dedup.latest_wins(e.withColumn("v", F.lit(0)).union(_second(e).withColumn("v", F.lit(1))), "v").select("id", "content"))
_register("latest_by_sort_key", """SELECT id, created_at, kind, pubkey FROM ev
  QUALIFY row_number() OVER (PARTITION BY created_at, kind, pubkey ORDER BY n DESC) = 1""",
  lambda e: dedup.latest_wins(e, "n", ["created_at", "kind", "pubkey"]).select("id", "created_at", "kind", "pubkey"))
_register("insert_ignore", "SELECT id FROM ev WHERE n % 3 <> 0", lambda e: dedup.new_only(e, _second(e)).select("id"))
_register("replaceable_kinds", """SELECT id, pubkey, kind FROM ev WHERE kind <> 0 UNION ALL
  SELECT arg_max(id, (created_at, -n2)), pubkey, 0 FROM (SELECT *, row_number() OVER (ORDER BY id) AS n2 FROM ev WHERE kind = 0) GROUP BY pubkey""",
  lambda e: dedup.replaceable(e).select("id", "pubkey", "kind"))


# Expressions.

_register("event_json", """SELECT '{"id":"' || id || '","pubkey":"' || pubkey || '","created_at":' || created_at || ',"kind":' || kind || ',"tags":' ||
  to_json(tags) || ',"content":' || to_json(content) || ',"sig":"' || sig || '"}' AS json FROM ev""", lambda e: e.select(expr.event_json().alias("json")))
_CANONICAL = """'[0,"' || pubkey || '",' || created_at || ',' || kind || ',' || to_json(tags) || ',' || to_json(content) || ']'"""
_register("canonical_json", f"SELECT id, {_CANONICAL} AS canonical FROM ev", lambda e: e.select(
    "id", expr.canonical_json(*(F.col(c) for c in ("pubkey", "created_at", "kind", "tags", "content"))).alias("canonical")))
_register("event_hash", f"SELECT id, sha256({_CANONICAL}) AS hash FROM ev", lambda e: e.select("id", expr.event_hash().alias("hash")))
_register("date_key", "SELECT id, strftime(day, '%Y_%m_%d') AS date_key FROM ev", lambda e: e.select("id", expr.date_key(F.col("created_at")).alias("date_key")))
_register("drop_tags", """SELECT id, to_json(list_filter(tags, lambda t: t[1] <> 'p')) AS tags FROM ev""",
          lambda e: e.select("id", expr.json_tags(expr.without_tags(F.col("tags"), "p")).alias("tags")))
_register("kind_classes", """SELECT CASE WHEN kind BETWEEN 1000 AND 9999 THEN 'regular' WHEN kind BETWEEN 10000 AND 19999 THEN 'replaceable'
  WHEN kind BETWEEN 20000 AND 29999 THEN 'ephemeral' WHEN kind BETWEEN 30000 AND 39999 THEN 'addressable' ELSE 'other' END AS kind_class,
  count(*) AS events FROM ev GROUP BY 1""", lambda e: e.groupBy(kind_class(F.col("kind")).alias("kind_class")).agg(F.count("*").alias("events")))
_register("warehouse_rows", "SELECT id, pubkey, created_at, CAST(kind AS INTEGER) AS kind, content, sig, '' AS relay_source FROM ev WHERE created_at < 4294967296",
          lambda e: e.where(F.col("created_at").between(0, 2**32 - 1) & F.col("kind").between(0, 65535)).select(
              "id", "pubkey", "created_at", "kind", "content", "sig", F.lit("").alias("relay_source")))
_register("relay_hints", "SELECT v3 AS relay, count(*) AS mentions FROM flat WHERE tag_name IN ('e', 'p', 'a') AND (v3 LIKE 'ws://%' OR v3 LIKE 'wss://%') GROUP BY 1 UNION ALL SELECT relay_source, count(*) FROM ev WHERE relay_source <> '' GROUP BY 1",
          lambda e: tags.relay_hints(e.withColumn("tags", F.when(F.col("relay_source") != "", F.concat("tags", F.array(F.array(F.lit("r"), F.col("relay_source"))))).otherwise(F.col("tags")))))
_register("accept_filter", "SELECT id FROM ev WHERE kind IN (1, 7) AND list_contains(list_transform(tags, lambda t: t[1] || ':' || coalesce(t[2], '')), 't:click')",
          lambda e: e.where(Accept(kinds=[1, 7], tags={"t": ["click"]}).condition()).select("id"))


# Ingest of lines, of which some are broken (see ``raw_lines``).

_register("kind_prefilter", "SELECT n FROM ev WHERE n % 20 <> 3", lambda e: raw_lines(e).where(expr.kind_prefilter(F.col("value"))).select("n"))
_register("blank_lines", "SELECT n FROM ev WHERE n % 20 = 1", lambda e: raw_lines(e).where(expr.is_blank(F.col("value"))).select("n"))
_STATUS = """CASE WHEN n % 20 = 1 THEN 'skipped' WHEN n % 20 = 3 THEN 'filtered' WHEN n % 20 IN (2, 4, 5, 6, 7, 8) THEN 'invalid' ELSE 'valid' END"""
_CATEGORY = """CASE n % 20 WHEN 2 THEN 'ParseError' WHEN 4 THEN 'InvalidTagValue' WHEN 5 THEN 'ParseError' WHEN 6 THEN 'InvalidEventId'
  WHEN 7 THEN 'ValidationError' WHEN 8 THEN 'InvalidEventId' END"""


def _told(e: DataFrame) -> DataFrame:
    return classify(raw_lines(e), signatures=False)


_register("ingest_classify", f"SELECT n, {_STATUS} AS status, {_CATEGORY} AS category FROM ev", lambda e: _told(e).select("n", "status", "category"))
_register("ingest_valid", f"SELECT n, sha256({_CANONICAL}) AS id, kind, content, to_json(tags) AS tags FROM ev WHERE {_STATUS} = 'valid'",
          lambda e: _told(e).where("status = 'valid'").select("n", "id", "kind", "content", expr.json_tags(F.col("tags")).alias("tags")))
_register("conversion_summary", f"""SELECT *, round(coalesce(100.0 * valid_events / nullif(total_lines, 0), 0), 1) AS success_rate FROM (
  SELECT count(*) AS total_lines, count(*) FILTER (s = 'filtered') AS filtered_lines, count(*) FILTER (s = 'skipped') AS skipped_lines,
  count(*) FILTER (s = 'invalid') AS invalid_events, count(*) FILTER (s = 'valid') AS valid_events FROM (SELECT {_STATUS} AS s FROM ev))""",
  lambda e: conversion_stats(_told(e)))
_register("error_breakdown", f"SELECT {_CATEGORY} AS category, count(*) AS count FROM ev WHERE {_STATUS} = 'invalid' GROUP BY 1",
          lambda e: error_breakdown(_told(e)))
_register("kind_out_of_range", "SELECT 'InvalidKind' AS category, count(*) AS count FROM ev WHERE n % 20 = 3",
          lambda e: error_breakdown(classify(raw_lines(e.where("n % 20 = 3")), prefilter=False, signatures=False)))
_register("basic_validation", """SELECT n, CASE n % 5 WHEN 0 THEN 'InvalidEventId' WHEN 1 THEN 'ValidationError' WHEN 2 THEN 'ValidationError'
  WHEN 3 THEN 'ValidationError' END AS category FROM ev""", lambda e: e.select(
    "n",
    F.when(F.col("n") % 5 == 0, "zz").otherwise(F.col("id")).alias("id"),
    F.when(F.col("n") % 5 == 1, F.repeat(F.lit("g"), F.lit(64))).otherwise(F.col("pubkey")).alias("pubkey"),
    F.when(F.col("n") % 5 == 2, F.lit(-1)).otherwise(F.col("created_at")).alias("created_at"),
    F.when(F.col("n") % 5 == 3, F.lit(70000)).otherwise(F.col("kind")).alias("kind"),
    "sig",
).select("n", category_of(basic_reason()).alias("category")))


# Whole texts of ``documents`` as event contents.


def _document_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    canonical = expr.canonical_json(F.lit("ab"), F.col("doc_id"), F.lit(1), F.array(F.array(F.lit("l"), F.col("lang"))), F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.sha2(canonical, 256).alias("hash"), expr.byte_length(F.coalesce("text", F.lit(""))).alias("bytes"))


_QUERIES["document_hash"] = _document_hash
_SQL["document_hash"] = """SELECT doc_id, sha256('[0,"ab",' || doc_id || ',1,[["l",' || to_json(lang) || ']],' || to_json(coalesce(text, '')) || ']') AS hash,
  CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes FROM documents"""


def _signature_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines through all checks: none of the keys here is on the curve, or no signature fits, so none is valid."""
    return error_breakdown(classify(raw_lines(load_events(spark, sf_dir)), signatures=True))


_QUERIES["signature_check"] = _signature_check


# Through sinks and sources and back.


def _rows(e: DataFrame, *more: str) -> DataFrame:
    return e.select("id", "pubkey", "created_at", "kind", expr.json_tags(F.col("tags")).alias("tags"), "content", "sig", *more)


_ROWS = "SELECT id, pubkey, created_at, kind, to_json(tags) AS tags, content, sig FROM ev"


def _through_parts(e: DataFrame) -> DataFrame:
    """Events as gzip members of length-delimited messages, by day, and back."""
    where = scratch(e.sparkSession)
    write_pb_parts(e, where, per_file=20_000)
    return _rows(read_pb_parts(e.sparkSession, where))


def _through_store(e: DataFrame) -> DataFrame:
    """Events put into the store twice, by their relays the second time: the latest versions by id."""
    store = EventStore(e.sparkSession, scratch(e.sparkSession))
    store.append(e.withColumn("indexed_at", F.timestamp_seconds(F.lit(1))).withColumn("relay_source", F.lit("")))
    store.append(e.withColumn("indexed_at", F.timestamp_seconds(F.lit(2))))
    return _rows(store.events(), "relay_source")


def _through_lines(e: DataFrame) -> DataFrame:
    """Events written as JSON lines, read and checked again (their ids are no hashes)."""
    where = scratch(e.sparkSession)
    write_json(e, where)
    return _rows(valid_events(classify(read_lines(e.sparkSession, where), event_ids=False, signatures=False)))


def _through_stream(e: DataFrame) -> DataFrame:
    """Raw lines taken in as two micro-batches, the second of which holds all of the first: what the store and the tag table have."""
    spark = e.sparkSession
    lines = raw_lines(e).select("n", "value", F.lit("f").alias("file_path"), F.col("n").alias("block_start"))
    where = scratch(spark)
    job = Ingest(EventStore(spark, f"{where}/events"), EventIndex(spark, f"{where}/index"), f"{where}/tags", signatures=False)
    job.batch(lines.where("n % 3 = 0").drop("n"), 0)
    job.batch(lines.drop("n"), 1)
    per_event = spark.read.parquet(f"{where}/tags").groupBy(F.col("event_id").alias("id")).agg(F.count("*").alias("n_tags"))
    return job.store.read().select("id", "kind", "content").join(per_event, "id")


def _through_index(e: DataFrame) -> DataFrame:
    """An index table: every third event inserted, then all, then what it holds by day file."""
    spark = e.sparkSession
    index = EventIndex(spark, scratch(spark))
    named = e.withColumn("file_path", F.concat(expr.date_key(F.col("created_at")), F.lit(".pb.gz")))
    first, then = index.insert(named.where("n % 3 = 0"), 0), index.insert(named, 0)
    counts = [F.lit(x).cast("long").alias(c) for c, x in zip(("added_first", "known_first", "added_then", "known_then"), (*first, *then), strict=True)]
    return index.rows.groupBy("file_path").agg(F.count("*").alias("events")).select("file_path", "events", *counts)


_register("pb_round_trip", _ROWS, _through_parts)
_register("store_round_trip", _ROWS.replace("sig FROM", "sig, relay_source FROM"), _through_store)
_register("lines_round_trip", _ROWS, _through_lines)
_register("stream_round_trip", f"SELECT sha256({_CANONICAL}) AS id, kind, content, len(tags) AS n_tags FROM ev WHERE {_STATUS} = 'valid'", _through_stream)
_register("index_round_trip", """SELECT strftime(day, '%Y_%m_%d') || '.pb.gz' AS file_path, count(*) AS events, (SELECT count(*) FROM ev WHERE n % 3 = 0) AS added_first,
  0::BIGINT AS known_first, (SELECT count(*) FROM ev WHERE n % 3 <> 0) AS added_then, (SELECT count(*) FROM ev WHERE n % 3 = 0) AS known_then FROM ev GROUP BY 1""", _through_index)


def _signed_profiles(e: DataFrame) -> DataFrame:
    """One profile event per author, n being the author's lowest event, signed with a key of the author's; then all checks."""
    authors = e.groupBy("pubkey").agg(F.min("n").alias("n"))

    @F.pandas_udf("pubkey string, secret string")
    def keys(seed: pd.Series) -> pd.DataFrame:
        secrets = [int(x, 16) % (schnorr.N - 1) + 1 for x in seed]
        return pd.DataFrame({"pubkey": [schnorr.sign(bytes(32), s)[0].hex() for s in secrets], "secret": [f"{s:064x}" for s in secrets]})

    @F.pandas_udf("string")
    def signatures(ids: pd.Series, secrets: pd.Series) -> pd.Series:
        return pd.Series([schnorr.sign(bytes.fromhex(i), int(s, 16))[1].hex() for i, s in zip(ids, secrets, strict=True)], dtype=object)

    keyed = authors.select("n", keys("pubkey").alias("k")).select("n", "k.*")
    events = keyed.select("*", F.lit(1_758_960_000).cast("long").alias("created_at"), F.lit(0).alias("kind"), F.concat(F.lit("author "), F.col("n")).alias("content"))
    events = events.withColumn("tags", F.array(F.array(F.lit("n"), F.col("n").cast("string")))).withColumn("id", expr.event_hash())
    signed = events.withColumn("sig", signatures("id", "secret"))
    # n % 3: 0 untouched, 1 the signature of another id, 2 one character of the signature changed.
    other = F.when(F.col("n") % 3 == 1, signatures(F.sha2("id", 256), "secret"))
    last = F.substring("sig", 128, 1)
    spoilt = F.when(F.col("n") % 3 == 2, F.concat(F.substring("sig", 1, 127), F.when(last == "0", "1").otherwise("0")))
    signed = signed.withColumn("sig", F.coalesce(other, spoilt, "sig"))
    told = classify(signed.select("n", expr.event_json().alias("value")))
    return told.select("n", "status", "category")


_register("signature_valid", """SELECT n, CASE WHEN n % 3 = 0 THEN 'valid' ELSE 'invalid' END AS status,
  CASE WHEN n % 3 = 0 THEN NULL ELSE 'InvalidSignature' END AS category FROM (SELECT pubkey, min(n) AS n FROM ev GROUP BY 1)""", _signed_profiles)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
