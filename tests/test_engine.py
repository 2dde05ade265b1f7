"""Ingest, index, files, store, streaming and command line on small fixtures."""

import gzip
import hashlib
import io
import json

import pytest
from pyspark.sql import functions as F

from veldt import cli
from veldt.functions import expr, schnorr
from veldt.functions.builder import Event, frame_of, with_defaults
from veldt.operators import dedup, ingest, tags
from veldt.operators.index import EventIndex
from veldt.plans import views
from veldt.schema import EVENT
from veldt.sources import wire
from veldt.sources.events_pb import event_files, read_pb, temporary_date, write_pb
from veldt.sources.remote import bucket_and_key, read_pb_objects, read_pb_parts, write_pb_parts
from veldt.sources.lines import count_lines, read_lines, write_json
from veldt.sources.store import EventStore
from veldt.streaming.ingest import Accept, Ingest, bounded_dedup, stream_lines, windowed_counts

DAY = 86_400


def signed(n, content="hi", tag_list=(), kind=1, created_at=1_758_960_000, secret=None):
    """A valid event as a dict."""
    secret = secret or 1000 + n
    key, _ = schnorr.sign(bytes(32), secret)
    event = {"pubkey": key.hex(), "created_at": created_at + n, "kind": kind, "tags": [list(t) for t in tag_list], "content": content}
    canonical = json.dumps([0, *(event[k] for k in ("pubkey", "created_at", "kind", "tags", "content"))], ensure_ascii=False, separators=(",", ":"))
    ident = hashlib.sha256(canonical.encode()).digest()
    return {"id": ident.hex(), **event, "sig": schnorr.sign(ident, secret)[1].hex()}


def lines_of(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def frame(spark, events):
    return spark.createDataFrame([tuple(e[c] for c in EVENT.fieldNames()) for e in events], EVENT)


def status(spark, line, **kw):
    r = ingest.classify(lines_of(spark, [line]), **kw).first()
    return r.status, r.category, r.reason


CONTROL = "".join(map(chr, range(32))) + '"\\/\x7fé漢😀\\u001F'


def test_valid_events_pass_all_checks(spark):
    told = ingest.classify(lines_of(spark, [json.dumps(signed(1)), json.dumps(signed(2, CONTROL, [["t", CONTROL], []]))]))
    assert [r.status for r in told.collect()] == ["valid", "valid"]
    assert sorted(r.content for r in ingest.valid_events(told).collect()) == sorted(["hi", CONTROL])


def test_ladder(spark):
    good = signed(3)
    bad = lambda **kw: json.dumps({**good, **kw})
    other = schnorr.sign(b"x" * 32, 77)[1].hex()
    cases = [
        ("", "skipped", None),
        (" \t ", "skipped", None),
        (bad(kind=70202), "filtered", None),
        ("not valid json", "invalid", "ParseError"),
        (json.dumps({"id": "invalid", "not": "complete"}), "invalid", "ParseError"),
        (bad(kind=-1), "invalid", "InvalidKind"),
        (bad(kind=1.5), "invalid", "ParseError"),
        (bad(tags=[["e", 1]]), "invalid", "InvalidTagValue"),
        (bad(tags=[["e", None]]), "invalid", "InvalidTagValue"),
        (bad(tags=["e"]), "invalid", "ParseError"),
        (bad(content=5), "invalid", "ParseError"),
        (bad(id="short"), "invalid", "InvalidEventId"),
        (bad(pubkey="g" * 64), "invalid", "ValidationError"),
        (bad(created_at=-1), "invalid", "ValidationError"),
        (bad(content="changed"), "invalid", "InvalidEventId"),
        (bad(sig=other), "invalid", "InvalidSignature"),
    ]
    told = {r.value: r for r in ingest.classify(lines_of(spark, [c[0] for c in cases])).collect()}
    assert [(c[0], told[c[0]].status, told[c[0]].category) for c in cases] == cases
    assert "tags[0][1] is number" in told[cases[7][0]].reason and "tags[0][1] is null" in told[cases[8][0]].reason
    found = status(spark, bad(kind=70202), prefilter=False)
    assert found[1] == "InvalidKind" and "70202" in found[2] and "0-65535" in found[2]


def test_signature_is_over_the_recomputed_hash(spark):
    """A signature that fits the stored id but not the content is refused."""
    good = signed(4)
    line = json.dumps({**good, "content": "changed"})
    assert status(spark, line, event_ids=False)[1] == "InvalidSignature"
    assert status(spark, line, event_ids=False, signatures=False)[0] == "valid"


def test_key_off_the_curve(spark):
    good = signed(5)
    fake = {**good, "pubkey": "b" * 64, "id": "a" * 64}
    told = status(spark, json.dumps(fake), event_ids=False)
    assert told[1] == "ValidationError" and "public key" in told[2]


def test_prefilter(spark):
    rows = [(f'{{"kind":{k}}}', keep) for k, keep in ((1, True), (100000, False), (65535, True), (65536, False), (0, True), (-5, True), (10**25, True))]
    rows += [("{}", True), ('{"kind" : 70000, "kind": 1}', False), ('{"kind":00000000000000000000000070000}', False)]
    df = spark.createDataFrame(rows, "value string, keep boolean")
    assert df.where(expr.kind_prefilter(F.col("value")) != F.col("keep")).count() == 0


def test_stats_and_quarantine(spark):
    lines = ["", json.dumps(signed(6)), "", "{bad", '{"kind":70000}', json.dumps({**signed(7), "id": "x" * 200})]
    told = ingest.classify(lines_of(spark, lines))
    s = ingest.conversion_stats(told).first()
    assert (s.total_lines, s.filtered_lines, s.skipped_lines, s.invalid_events, s.valid_events, s.success_rate) == (6, 1, 2, 2, 1, 16.7)
    assert all(len(r.reason) <= 100 for r in ingest.quarantine(told).collect())
    empty = ingest.conversion_stats(ingest.classify(lines_of(spark, []))).first()
    assert (empty.total_lines, empty.success_rate) == (0, 0.0)


@pytest.mark.parametrize("text", ["", "a", CONTROL, "\\u001F \\", "日本"])
def test_canonical_json(spark, text):
    df = spark.createDataFrame([("k", 5, 1, [["a", text], []], text)], "pubkey string, created_at long, kind int, tags array<array<string>>, content string")
    got = df.select(expr.canonical_json(*(F.col(c) for c in df.columns)).alias("x")).first().x
    assert got == json.dumps([0, "k", 5, 1, [["a", text], []], text], ensure_ascii=False, separators=(",", ":"))


def test_small_expressions(spark):
    df = spark.createDataFrame([(1_758_960_000, 1536)], "at long, size long")
    row = df.select(expr.date_key(F.col("at")), expr.readable_size(F.col("size")), expr.month_number(expr.event_date(F.col("at")))).first()
    assert tuple(row) == ("2025_09_27", "1.50 KiB", 202509)
    assert temporary_date("thread_3_2025_09_27.pb.gz.tmp") == "2025_09_27" and temporary_date("x.pb.gz") is None


def test_tag_flatten(spark):
    df = frame(spark, [{**signed(8), "tags": t} for t in ([], [["-"]], [["e", "id1", "", "reply"]], [[], ["t", "x"]])])
    rows = [(r.tag_name, r.tag_value_primary, r.tag_value_position_3, r.tag_value_position_4, r.tag_values_all, r.tag_value_count) for r in tags.flatten(df).collect()]
    assert sorted(rows) == sorted([("-", "", "", "", [], 0), ("e", "id1", "", "reply", ["id1", "", "reply"], 3), ("t", "x", "", "", ["x"], 1)])


def records(spark, rows):
    return spark.createDataFrame(rows, "id string, kind int, pubkey string, created_at long, file_path string")


def test_index(spark, tmp_path):
    index = EventIndex(spark, str(tmp_path / "index"))
    assert index.stats().first().total_events == 0 and index.stats().first().earliest_event is None
    rows = [("e1", 1, "p1", 1000, "f1"), ("e2", 1, "p2", 2000, "f1"), ("e3", 3, "p1", 3000, "f2")]
    assert index.insert(records(spark, rows)) == (3, 0)
    assert index.insert(records(spark, [rows[0], ("e4", 7, "p1", 500, "f3")])) == (1, 1)
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(index.by_kind(1)) == ["e2", "e1"]
    assert ids(index.by_pubkey("p1")) == ["e3", "e1", "e4"]
    assert ids(index.by_date_range(1000, 2000)) == ["e2", "e1"]
    assert index.contains("e3") and not index.contains("zz") and index.get("e3").first().file_path == "f2"
    assert EventIndex(spark, str(tmp_path / "index")).stats().first()[:3] == (4, 3, 2)
    index.rebuild(records(spark, [("e1", 1, "p1", 1, "b"), ("e1", 1, "p1", 1, "a")]))
    assert [(r.id, r.file_path) for r in index.rows.collect()] == [("e1", "a")]


def test_files_round_trip(spark, tmp_path):
    events = [signed(n, f"c{n}", [["t", "x"]], created_at=1_758_960_000 + n * DAY) for n in range(3)]
    out = str(tmp_path / "pb")
    write_pb(frame(spark, events), out, level=9)
    assert [p.rsplit("/", 1)[1] for p in event_files([out])] == ["2025_09_27.pb.gz", "2025_09_28.pb.gz", "2025_09_29.pb.gz"]
    write_pb(frame(spark, events[:1]), out)
    back = read_pb(spark, out)
    assert back.count() == 4 and {r.id for r in back.collect()} == {e["id"] for e in events}
    assert back.where("position = 1").first().file_path == "2025_09_27.pb.gz"
    (tmp_path / "pb" / "2025_01_01.pb.gz").write_bytes(gzip.compress(wire.varint(9) + b"abc"))
    assert read_pb(spark, out).count() == 4
    with pytest.raises(Exception, match="ends early"):
        read_pb(spark, out, mode="FAILFAST").count()
    with pytest.raises(Exception, match="nowhere"):
        read_pb(spark, str(tmp_path / "nowhere")).count()


def test_lines(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text("a\nb\n\nc")
    assert count_lines(spark, str(path)) == 4 and read_lines(spark, str(path)).where("file_path = 'in.jsonl'").count() == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_lines(spark, str(tmp_path / "none")).count()
    write_json(frame(spark, [signed(9, CONTROL)]), str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first().value) == signed(9, CONTROL)


def test_store(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "events"))
    events = [signed(n, created_at=1_758_960_000 + n * DAY) for n in range(3)]
    store.append(frame(spark, events))
    store.append(frame(spark, events[:1]))
    assert store.count() == 4 and store.events().count() == 3
    store.compact()
    assert store.count() == 3 and store.read(events[1]["created_at"]).count() == 2 and store.read(None, events[0]["created_at"]).count() == 1
    assert [r.files for r in store.parts().collect()] == [1, 1, 1] and store.compression().first().stored_bytes > 0
    plan = store.read(events[1]["created_at"])._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert store.drop_days_before("2025-09-28") == ["event_date=2025-09-27"] and store.count() == 2
    store.sorted_copy(str(tmp_path / "by_kind"), ["kind", "created_at"])
    assert spark.read.parquet(str(tmp_path / "by_kind")).count() == 2
    views.create_views(store.events())
    assert spark.sql("SELECT sum(total_events) AS n FROM daily_active_users").first().n == 2


def test_dedup_is_the_same_for_any_partitioning(spark):
    rows = [(f"i{n % 7}", n, f"f{n % 3}") for n in range(50)]
    df = spark.createDataFrame(rows, "id string, position int, file_path string")
    once = {tuple(r) for r in dedup.first_wins(df.repartition(1), ["file_path", "position"]).collect()}
    many = {tuple(r) for r in dedup.first_wins(df.repartition(9), ["file_path", "position"]).collect()}
    assert once == many and len(once) == 7


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    events = [signed(n, f"c{n}", [["t", "x"]], created_at=1_758_960_000 - n * DAY) for n in range(4)]
    texts = [json.dumps(e) for e in events]
    (source / "a.jsonl").write_text("\n".join([texts[0], texts[1], texts[0], "", "{bad"]))
    (source / "b.jsonl").write_text("\n".join([texts[1], texts[2], texts[3]]))
    job = Ingest(EventStore(spark, str(tmp_path / "store")), EventIndex(spark, str(tmp_path / "index")), str(tmp_path / "tags"), str(tmp_path / "bad"))
    for _ in range(2):
        job.start(stream_lines(spark, str(source), 1), str(tmp_path / "checkpoint"), every=None).awaitTermination(120)
    assert sorted(r.id for r in job.store.read().collect()) == sorted(e["id"] for e in events)
    assert job.index.stats().first().total_events == 4
    assert spark.read.parquet(str(tmp_path / "tags")).count() == 4 and spark.read.parquet(str(tmp_path / "bad")).count() == 1


def test_stream_accept_and_bounded_dedup(spark, tmp_path):
    df = frame(spark, [signed(1), signed(2, kind=7, tag_list=[["t", "a"]]), signed(3, kind=7)])
    assert df.where(Accept().condition()).count() == 3
    assert df.where(Accept(kinds=[7], tags={"t": ["a", "b"]}).condition()).count() == 1
    path = str(tmp_path / "s")
    for _ in range(2):
        df.write.mode("append").parquet(path)
    stream = bounded_dedup(spark.readStream.schema(EVENT).parquet(path))
    q = stream.writeStream.format("memory").queryName("deduped").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("deduped").count() == 3


def test_command_line(spark, tmp_path, capsys):
    source, out = tmp_path / "in.jsonl", str(tmp_path / "out")
    good = json.dumps(signed(1))
    source.write_text("\n".join(["", good, "", json.dumps(signed(2)), good, '{"id": "invalid", "not": "complete"}', ""]))
    assert cli.main(["convert", str(source), "-o", out]) == 0
    said = capsys.readouterr().out
    assert "valid 3" in said and "invalid 1" in said and "skipped 2" in said and "ParseError: 1" in said
    assert read_pb(spark, out).count() == 2
    assert cli.main(["index", "rebuild", out]) == 0 and "2 events" in capsys.readouterr().out
    assert cli.main(["import", "--input", out, "--table", str(tmp_path / "table"), "--dry-run"]) == 0
    assert cli.main(["import", "--input", out, "--table", str(tmp_path / "table")]) == 0
    assert EventStore(spark, str(tmp_path / "table")).count() == 2
    temporary = tmp_path / "out" / "tmp"
    temporary.mkdir()
    e = signed(3)
    (temporary / "thread_0_2025_09_27.pb.gz.tmp").write_bytes(wire.compress([tuple(e[c] for c in EVENT.fieldNames())] * 2))
    assert cli.main(["merge", out]) == 0 and read_pb(spark, out).count() == 3 and not list(temporary.iterdir())
    (tmp_path / "empty").write_text("")
    assert cli.main(["convert", str(tmp_path / "empty"), "-o", out]) == 0
    (tmp_path / "bad").write_text("{x\n")
    assert cli.main(["convert", str(tmp_path / "bad"), "-o", out]) == 1


def test_latest_version_does_not_depend_on_the_partitioning(spark):
    """Versions of one time under one id: the columns settle which stays."""
    base = signed(1)
    rows = [tuple({**base, "content": c, "sig": s}[k] for k in EVENT.fieldNames()) + (5, r) for c in "ba" for s in "dc" for r in ("y", "x")]
    df = spark.createDataFrame(rows, EVENT.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ") + ", indexed_at int, relay_source string")
    for n in (1, 2, 7):
        got = dedup.latest_wins(df.repartition(n)).first()
        assert (got.sig, got.relay_source, got.content) == ("c", "x", "a")
        assert dedup.merge_sources([df.repartition(n)]).first().content == "a"
    assert dedup.latest_wins(df.withColumn("indexed_at", F.when(F.col("content") == "b", 6).otherwise(5))).first().content == "b"


def test_merge_keeps_files_that_can_not_be_read(spark, tmp_path, capsys):
    out = tmp_path / "out"
    (out / "tmp").mkdir(parents=True)
    events = [tuple(signed(n)[c] for c in EVENT.fieldNames()) for n in range(3)]
    whole, broken = out / "tmp" / "thread_0_2025_09_27.pb.gz.tmp", out / "tmp" / "thread_1_2025_09_27.pb.gz.tmp"
    whole.write_bytes(wire.compress(events[:2]))
    broken.write_bytes(wire.compress(events[1:]) + gzip.compress(wire.varint(9) + b"abc"))
    (out / "2025_09_26.pb.gz").write_bytes(wire.compress(events[:1])[:-9])
    assert cli.main(["merge", str(out)]) == 1
    said = capsys.readouterr().out
    assert "3 events" in said and "2 broken records" in said and broken.name in said
    assert not whole.exists() and broken.exists() and (out / "2025_09_26.pb.gz.broken").exists()
    assert {r.id for r in read_pb(spark, str(out)).collect()} == {e[0] for e in events}
    told = read_pb(spark, str(out / "tmp"), pattern="*.tmp", mode="REPORT")
    assert [(r.id, r.position) for r in told.orderBy("position").collect()] == [(events[1][0], 0), (events[2][0], 1), (None, 2)]


def test_stream_looks_at_wanted_new_events_only(spark, tmp_path):
    """Replayed and unwanted events never reach the signature check; counts and health are told."""
    job = Ingest(EventStore(spark, str(tmp_path / "store")), EventIndex(spark, str(tmp_path / "index")), quarantine_path=str(tmp_path / "bad"),
                 accept=Accept(kinds=[1]), relays_path=str(tmp_path / "relays"))
    good, other, unwanted = signed(1, tag_list=[["r", "wss://x"]]), signed(2), {**signed(3, kind=7), "sig": "c" * 128}
    lines = [json.dumps(e) for e in (good, good, {**good, "sig": other["sig"]}, {**other, "content": "forged"}, unwanted)] + ["", "{bad"]
    df = lines_of(spark, lines).withColumn("file_path", F.lit("f")).withColumn("block_start", F.lit(0).cast("long"))
    job.batch(df, 0)
    job.batch(df, 1)
    assert [r.id for r in job.store.read().collect()] == [good["id"]]
    first, second = job.metrics
    assert (first["lines"], first["skipped"], first["invalid"], first["refused"], first["added"]) == (7, 1, 1, 2, 1)
    assert (second["refused"], second["added"]) == (1, 0)  # the forged one is new each time, the other has a known id
    assert {r.category for r in spark.read.parquet(str(tmp_path / "bad")).collect()} == {"ParseError", "InvalidSignature", "InvalidEventId"}
    assert [(r.relay, r.mentions) for r in spark.read.parquet(str(tmp_path / "relays")).collect()] == [("wss://x", 1)]
    assert job.health()["added"] == 1 and job.health()["batches"] == 2
    source = tmp_path / "in"
    source.mkdir()
    (source / "a").write_text(json.dumps(signed(9)))
    query = job.start(stream_lines(spark, str(source)), str(tmp_path / "checkpoint"), every="1 second")
    query.processAllAvailable()
    assert job.health(query)["active"] and job.health(query)["error"] is None and job.health()["added"] == 2
    job.stop(query)
    assert not query.isActive


def test_windowed_counts(spark, tmp_path):
    frame(spark, [signed(n, created_at=1_758_960_000 + 400 * n) for n in range(3)]).write.parquet(str(tmp_path / "s"))
    stream = windowed_counts(spark.readStream.schema(EVENT).parquet(str(tmp_path / "s")))
    q = stream.writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.events for r in spark.table("windowed").collect()) == [1, 1, 1]


def test_builder_and_defaults(spark):
    assert Event().row() == ("", "", 0, 0, [], "", "")
    base = Event(pubkey="p", kind=1)
    e = base.with_(content="c").tagged("t", "x").tagged("-")
    assert base.tags == () and e.row() == ("", "p", 0, 1, [["t", "x"], ["-"]], "c", "")
    assert wire.decode(wire.encode(e.row())) == e.row() and wire.encode(Event().row()) == b""
    df = frame_of(spark, [e, base])
    assert df.schema == EVENT and df.count() == 2
    rows = spark.createDataFrame([("i", None, 9)], "id string, content string, extra int")
    assert tuple(with_defaults(rows).first()) == ("i", "", 0, 0, [], "", "")


@pytest.mark.parametrize("uri, told", [("s3://b/p/q", ("b", "p/q")), ("s3://b", ("b", "")), ("s3a://b/", ("b", "")), ("http://x", None), ("s3://", None)])
def test_store_paths(uri, told):
    if told is None:
        with pytest.raises(ValueError, match="no path"):
            bucket_and_key(uri)
    else:
        assert bucket_and_key(uri) == told


def test_event_files_of_any_store(spark, tmp_path):
    """By paths that only Spark's file systems open, and days over many parts."""
    events = [signed(n, f"c{n}", created_at=1_758_960_000 + n % 2 * DAY) for n in range(9)]
    write_pb(frame(spark, events), str(tmp_path / "pb"))
    with open(tmp_path / "pb" / "2025_01_01.pb.gz", "wb") as f:
        f.write(gzip.compress(wire.varint(9) + b"abc"))
    spark.conf.set("fs.viewfs.mounttable.own.link./in", f"file://{tmp_path}")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.own.link./in", f"file://{tmp_path}")
    for path in (str(tmp_path / "pb"), "viewfs://own/in/pb"):
        got = read_pb_objects(spark, path)
        assert {tuple(r) for r in got.select("id", "file_path", "position").collect()} == {tuple(r) for r in read_pb(spark, str(tmp_path / "pb")).select("id", "file_path", "position").collect()}
    assert read_pb_objects(spark, str(tmp_path / "pb"), mode="REPORT").where("id IS NULL").count() == 1
    write_pb_parts(frame(spark, events).repartition(3), str(tmp_path / "parts"), per_file=2)
    back = read_pb_parts(spark, str(tmp_path / "parts"))
    assert {(r.id, r.content, r.event_date) for r in back.collect()} == {(e["id"], e["content"], "2025_09_27" if n % 2 == 0 else "2025_09_28") for n, e in enumerate(events)}
    assert back.count() == 9
    members = spark.read.parquet(str(tmp_path / "parts")).where("event_date = '2025_09_27'").collect()
    assert len(list(wire.read_events(gzip.open(io.BytesIO(b"".join(r.member for r in members)))))) == 5


def test_store_and_index_statistics(spark, tmp_path):
    store, index = EventStore(spark, str(tmp_path / "events")), EventIndex(spark, str(tmp_path / "index"))
    store.append(frame(spark, [signed(1), signed(2)]))
    index.rebuild(frame(spark, [signed(1), signed(2)]).withColumn("file_path", F.lit("f")))
    store.analyse("own_events")
    index.analyse("own_index")
    for name in ("own_events", "own_index"):
        assert "2 rows" in {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}["Statistics"]
        spark.sql(f"DROP TABLE {name}")


def test_pretty_shortened_and_hints(spark):
    event = signed(1, tag_list=[["r", "wss://a"], ["e", "i", "wss://b"], ["p", "k", "wss://a"], ["e", "i", "http://c"]])
    df = frame(spark, [event])
    text = df.select(expr.event_json(pretty=True).alias("x")).first().x
    assert json.loads(text) == event and text.count("\n") > 7
    told = spark.createDataFrame([("x" * 100,), ("y" * 101,), (None,)], "s string").select(expr.shortened(F.col("s")).alias("s")).collect()
    assert [r.s for r in told] == ["x" * 100, "y" * 97 + "...", None]
    assert [tuple(r) for r in tags.relay_hints(df, most=1).collect()] == [("wss://a", 2)]
