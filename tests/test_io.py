"""Sources, sinks and streams."""

import json
import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pageframe.functions.charset import decode_bytes
from pageframe.functions.extractors import by_row, register_extractor
from pageframe.operators import host_log as H
from pageframe.plans import queries as Q
from pageframe.sinks import writers as K
from pageframe.sources import readers as S
from pageframe.sources.checkpoints import cut_lineage, run_folder, shared_folder
from pageframe.streaming import events as St


@pytest.mark.parametrize(
    ("content", "kind", "text", "encoding"),
    [
        ("é".encode("latin-1"), "text/html; charset=ISO-8859-1", "é", "iso-8859-1"),
        (b'<meta charset="iso-8859-1">\xe9', None, '<meta charset="iso-8859-1">é', "iso-8859-1"),
        (b"<meta http-equiv=content-type content='text/html; charset=cp1251'>\xe9", "text/html", None, "cp1251"),
        ("é".encode("utf-8-sig"), None, "é", "utf-8"),
        (b"\xff\xfe\x81", None, "ÿþ\x81", "iso-8859-1"),
        (b"\xe9", "text/html; charset=utf-8", "é", "cp1252"),
        (b"plain", "text/html; charset=no-such", "plain", "utf-8"),
        (b"", None, "", "utf-8"),
    ],
)
def test_decode(content, kind, text, encoding):
    got = decode_bytes(content, kind)
    assert got[1] == encoding and (text is None or got[0] == text)


def test_decode_pages(spark):
    df = spark.createDataFrame([(1, "東京".encode("shift_jis"), "text/html; charset=shift_jis"), (2, None, None)], "i int, content binary, content_type string")
    rows = {r.i: (r.text, r.encoding) for r in S.decode_pages(df).collect()}
    assert rows == {1: ("東京", "shift_jis"), 2: (None, None)}


def test_read_pages_drops_empty_ones(spark, tmp_path):
    rows = [(1, "u", "<p>"), (2, "u", ""), (3, "u", None), (4, "u", " ")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    assert [r.page_id for r in S.read_pages(spark, str(tmp_path / "p")).collect()] == [1]


def test_lines_and_artifacts(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" h:1 \n\n plain\nh:2")
    assert {r.line for r in S.read_lines(spark, str(tmp_path)).collect()} == {"h:1", "plain", "h:2"}
    assert {r.line for r in S.read_lines(spark, str(tmp_path), ":").collect()} == {"h:1", "h:2"}
    row = S.read_artifacts(spark, str(tmp_path), "*.txt").collect()[0]
    assert row.bytes == 17 and len(row.sha256) == 64


def test_events_keep_corrupt_lines(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"event": "fetch_ok", "ts": "2024-01-01T00:00:00Z", "new_field": 1}\nnot json\n')
    rows = S.read_events(spark, str(tmp_path)).cache().collect()
    assert sorted((r.event, r[S.CORRUPT]) for r in rows if r.event) == [("fetch_ok", None)]
    assert [r[S.CORRUPT] for r in rows if r.event is None] == ["not json"]


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert run_folder(spark, "x") != run_folder(spark, "x")
    assert cut_lineage(spark.range(5).filter("id > 2")).count() == 2


def test_csv_keeps_text(spark, tmp_path):
    text = ' "quoted", \\ back\nline '
    rows = [("u", datetime(2024, 1, 1), "t", text, ["a", "b"], ["l"], None)]
    ddl = "url string, ts timestamp, title string, text string, keywords array<string>, links array<string>, api_endpoints array<string>"
    K.write_pages_csv(spark.createDataFrame(rows, ddl), str(tmp_path / "c"))
    back = spark.read.options(header=True, escape='"', multiLine=True).csv(str(tmp_path / "c")).first()
    assert (back.text, back.keywords, back.num_links) == (text, "a, b", "1")


def test_products_of_a_run_are_replaced(spark, tmp_path):
    rows = [("t", "$1", None, None, None, "/p", "s")]
    df = spark.createDataFrame(rows, "title string, price string, description string, reviews string, image string, url string, source_url string")
    for run in ("r1", "r2", "r1"):
        K.write_products(df, str(tmp_path), run, "now")
    back = spark.read.json(str(tmp_path / "json"))
    assert sorted(r.run_id for r in back.collect()) == ["r1", "r2"]


def test_ranked_lists(spark, tmp_path):
    df = spark.range(200).selectExpr("'h' || id || ':80' AS endpoint", "(200 - id) / 100D AS seconds", "'http' AS kind")
    K.write_ranked(df, str(tmp_path))
    lines = [r.value for r in spark.read.text(str(tmp_path / "detailed")).collect()]
    assert len(lines) == 50 and lines[0] == "h199:80 0.010s http"
    assert spark.read.text(str(tmp_path / "plain")).first().value == "h199:80"


def test_custom_extractor_in_sql(spark):
    register_extractor(spark, "shout", by_row(lambda html: {"loud": html.upper()}), "struct<loud:string>")
    assert spark.sql("SELECT shout('a').loud AS x").first().x == "A"


# --- streams --------------------------------------------------------------------

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def write_batches(folder, rows, size):
    """Files a stream reads one by one, oldest first."""
    folder.mkdir()
    for i in range(0, len(rows), size):
        file = folder / f"{i:06d}.json"
        file.write_text("\n".join(json.dumps(r) for r in rows[i : i + size]))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))


def stream(spark, folder, ddl):
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).json(str(folder))


def finished(spark, df, folder):
    St.run_available(St.write_stream(df, str(folder), "parquet"))
    return spark.read.schema(df.schema).parquet(f"{folder}/rows").collect()


def iso(moment):
    return moment.isoformat().replace("+00:00", "Z")


def test_breaker_stream_equals_batch_on_shuffled_input(spark, tmp_path):
    rng = random.Random(1)
    rows = [
        {"event_id": i, "ts": iso(START + timedelta(seconds=i * 3)), "host": rng.choice("ab"), "ok": rng.random() < 0.4}
        for i in range(600)
    ]
    order = sorted(rows, key=lambda r: r["event_id"] + rng.randrange(40))  # late by two minutes at most
    flush = {"event_id": 9999, "ts": iso(START + timedelta(days=1)), "host": "z", "ok": True}
    write_batches(tmp_path / "in", order + [flush], 130)
    ddl = "event_id long, ts timestamp, host string, ok boolean"
    log = stream(spark, tmp_path / "in", ddl)
    got = finished(spark, St.stream_breaker(log, 3, 10.0, late="10 minutes"), tmp_path / "out")
    batch = spark.createDataFrame([(r["event_id"], r["ts"], r["host"], r["ok"]) for r in rows], "event_id long, t string, host string, ok boolean")
    want = H.breaker_timeline(batch.withColumn("ts", F.col("t").cast("timestamp")), 3, 10.0).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


@pytest.mark.parametrize("late", ["0 seconds", "1 minute"])
def test_breaker_stream_tells_of_open_slices(spark, tmp_path, monkeypatch, late):
    """The query's rows when the log ends in a burst of failures, against the batch operator over the whole log."""
    rng = random.Random(2)
    ts = [START + timedelta(seconds=i * 3) for i in range(300)] + [START + timedelta(seconds=900, milliseconds=i) for i in range(20)]
    rows = [(i, t, "ab"[i % 2], 296 <= i < 300 or (i < 296 and rng.random() < 0.4)) for i, t in enumerate(ts)]
    log = spark.createDataFrame(rows, "event_id long, ts timestamp, host string, ok boolean")
    want = sorted(map(tuple, H.breaker_timeline(log, Q.BREAKER["threshold"], Q.BREAKER["cooldown_seconds"]).collect()))
    assert any(event_id >= 300 for _, event_id, *_ in want)
    if late == "0 seconds":
        monkeypatch.setattr(Q.X, "fetch_log", lambda spark, sf_dir: log)
        got = Q.QUERIES["stream_breaker"](spark, "").collect()
    else:
        write_batches(tmp_path / "in", [{"event_id": i, "ts": iso(t), "host": h, "ok": ok} for i, t, h, ok in rows], 100)
        options = {**Q.BREAKER, "late": late}
        events = stream(spark, tmp_path / "in", "event_id long, ts timestamp, host string, ok boolean")
        got = finished(spark, St.stream_breaker(events, **options), tmp_path / "out") + St.breaker_rest(log, **options).collect()
    assert sorted(map(tuple, got)) == want


def test_late_rows_and_repeats_are_dropped(spark, tmp_path):
    def row(minute, i):
        return {"ts": iso(START + timedelta(minutes=minute)), "event": "e", "url": f"u{i}"}

    minutes = [0, 1, 1, 200, 201, 202, 2, 203, 500, 501]
    rows = [row(minute, minute) for minute in minutes]
    write_batches(tmp_path / "in", rows, 2)
    counts = St.stream_progress(stream(spark, tmp_path / "in", S.EVENT_DDL), "10 minutes", late="30 minutes")
    got = {r.start.replace(tzinfo=timezone.utc): r.n for r in finished(spark, counts, tmp_path / "o1")}
    assert got[START] == 3  # the row of minute 2 came after the watermark
    unique = St.stream_events(spark, str(tmp_path / "in"), ["url"])
    assert len(finished(spark, unique, tmp_path / "o2")) == 9


def test_windows_and_sessions_hold_every_event(spark, tmp_path):
    rows = [{"ts": iso(START + timedelta(minutes=7 * i)), "event": "e", "url": f"u{i % 3}"} for i in range(60)]
    write_batches(tmp_path / "in", rows, 7)
    counts = St.stream_progress(stream(spark, tmp_path / "in", S.EVENT_DDL), "1 hour")
    St.run_available(St.write_versions(counts, str(tmp_path / "p")))
    got = St.read_versions(spark, str(tmp_path / "p"), counts.schema, ["start", "event"])
    assert got.agg(F.sum("n")).first()[0] == 60 and got.count() == 7
    sessions = St.stream_sessions(stream(spark, tmp_path / "in", S.EVENT_DDL), "url", 1800)
    St.run_available(St.write_versions(sessions, str(tmp_path / "s")))
    got = St.read_versions(spark, str(tmp_path / "s"), sessions.schema, ["url", "start"]).filter("n > 0")
    assert sorted((r.url, r.n) for r in got.collect()) == [("u0", 20), ("u1", 20), ("u2", 20)]


def test_sessions_merge_and_leave_the_state(spark, tmp_path):
    """Shuffled events of a few keys against a batch count; sessions that grow together; a state of open sessions alone."""
    rng = random.Random(4)
    seconds = [rng.randrange(0, 40_000) for _ in range(400)]
    rows = [{"ts": iso(START + timedelta(seconds=s, microseconds=i)), "event": "e", "url": rng.choice("abc")} for i, s in enumerate(seconds)]
    rows += [{"ts": None, "event": "e", "url": "a"}, {"ts": iso(START), "event": "e", "url": None}, {"ts": iso(START), "event": "e", "url": None}]
    rows += [{"ts": iso(START + timedelta(days=2, seconds=i)), "event": "e", "url": "z"} for i in range(2)]
    write_batches(tmp_path / "in", rows, 90)
    sessions = St.stream_sessions(stream(spark, tmp_path / "in", S.EVENT_DDL), "url", 300, late="12 hours")
    query = St.write_versions(sessions, str(tmp_path / "s")).trigger(availableNow=True).start()
    query.awaitTermination()
    versions = spark.read.parquet(str(tmp_path / "s/rows"))
    assert versions.filter("n = 0").count() > 0
    got = St.read_versions(spark, str(tmp_path / "s"), sessions.schema, ["url", "start"]).filter("n > 0")
    batch = spark.read.schema(S.EVENT_DDL).json(str(tmp_path / "in")).filter("ts IS NOT NULL")
    want = batch.groupBy(F.session_window("ts", "300 seconds").alias("w"), "url").count().select("url", "w.start", "w.end", "count")
    assert sorted(map(tuple, got.filter("url IS NOT NULL").collect())) == sorted(map(tuple, want.filter("url IS NOT NULL").collect()))
    assert [(r.url, r.n) for r in got.filter("url IS NULL").collect()] == [(None, 2)]
    last = [p for p in query.recentProgress if p["stateOperators"]][-1]
    assert last["stateOperators"][0]["numRowsTotal"] <= 4  # session and timer of z alone


def test_enrichment_by_a_growing_manifest(spark, tmp_path):
    """A line after its download matches, one out of range does not, a download without one appears behind the watermark."""

    def event(minute, url):
        return {"ts": iso(START + timedelta(minutes=minute)), "event": "download_complete", "url": url, "status": "ok", "event_id": minute}

    write_batches(tmp_path / "in", [event(0, "a"), event(1, "b"), event(2, "c"), event(600, "x"), event(601, "y"), event(602, "a")], 2)
    line = lambda minute, url: {"ts": iso(START + timedelta(minutes=minute)), "url": url, "path": f"p{minute}", "content_type": "t"}
    write_batches(tmp_path / "lines", [line(20, "a"), line(90, "c"), line(3, "n"), line(600, "n"), line(601, "x"), line(700, "n")], 1)
    ddl = f"event_id long, {S.EVENT_DDL}"
    lines = stream(spark, tmp_path / "lines", "url string, ts timestamp, path string, content_type string")
    enriched = St.stream_enrich(stream(spark, tmp_path / "in", ddl), lines, after="30 minutes", late="10 minutes")
    query = St.write_stream(enriched, str(tmp_path / "out"), "parquet").trigger(availableNow=True).start()
    query.awaitTermination()
    told = spark.read.schema(enriched.schema).parquet(str(tmp_path / "out/rows"))
    rows = {(r.event_id, r.path) for r in told.collect()}
    assert {(0, "p20"), (1, None), (2, None), (600, "p601")} <= rows
    rest = St.enrich_rest(spark.read.schema(ddl).json(str(tmp_path / "in")), told)
    every = rows | {(r.event_id, r.path) for r in rest.collect()}
    assert every == {(0, "p20"), (1, None), (2, None), (600, "p601"), (601, None), (602, None)}
    assert len(rows) + rest.count() == 6
    held = [p for p in query.recentProgress if p["stateOperators"]][-1]["stateOperators"][0]["numRowsTotal"]
    assert held < 10  # of twelve rows in all


def test_a_hook_sees_every_batch(spark, tmp_path):
    rows = [{"ts": iso(START), "event": "e", "url": f"u{i}"} for i in range(10)]
    write_batches(tmp_path / "in", rows, 4)
    seen = []

    def handle(batch, number):
        seen.append((number, sorted(r.url for r in batch.collect())))

    St.run_available(St.on_events(stream(spark, tmp_path / "in", S.EVENT_DDL), handle, str(tmp_path / "out")))
    assert [n for n, _ in seen] == [0, 1, 2] and sum((urls for _, urls in seen), []) == [f"u{i}" for i in range(10)]


def test_event_sink_replaces_a_repeated_batch(spark, tmp_path):
    rows = [{"ts": iso(START), "event": "download_complete", "status": "ok", "url": f"u{i}", "bytes": 1, "sha256": "x"} for i in range(4)]
    write_batches(tmp_path / "in", rows, 2)
    St.run_available(St.write_events_stream(stream(spark, tmp_path / "in", S.EVENT_DDL), str(tmp_path / "out")))
    assert S.read_manifest(spark, str(tmp_path / "out/manifest")).count() == 4
    assert spark.read.json(str(tmp_path / "out/events")).count() == 4


def test_effects_travel_packed():
    """A batch may hold all slices of a host; as objects an effect takes some kilobytes."""
    from pageframe.operators.host_log import slice_effect

    events = [{"ts_us": i * 1000, "event_id": i, "ok": i == 20} for i in range(40)]
    effects = [slice_effect(events, 3, 10_000), slice_effect(events[:1], 3, 10_000), slice_effect([], 3, 10_000)]
    assert [St.unpacked(St.packed(effect)) for effect in effects] == effects
    assert len(St.packed(effects[1])) < 64
