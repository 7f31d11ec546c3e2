"""Change streams: restarts, forgotten documents, folders that went, merged reports."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom import catalog
from textloom.plans import query as q
from textloom.plans.compile import Options, Source, compile_query
from textloom.sources.extract import SEPARATOR
from textloom.streaming import changes

START = datetime(2024, 1, 1)
CHANGES = "path string, at timestamp, seq long, body string, gone boolean"


def plain_log(rows, alerts):
    """Announcements in plain Python: rows (path, at, seq, body, gone) in order of time."""
    seen, out = set(), []
    for path, at, seq, body, gone in sorted(rows, key=lambda r: (r[1], r[2])):
        for name, word in alerts.items():
            key = (name, path)
            if gone and key in seen:
                seen.remove(key)
                out.append((name, path, seq, "forgotten"))
            elif not gone and word in (body or "") and key not in seen:
                seen.add(key)
                out.append((name, path, seq, "announced"))
    return sorted(out), seen


def change_rows(n, seed):
    pick = random.Random(seed)
    return [(f"d{pick.randrange(12)}", START + timedelta(seconds=i // 2), i, pick.choice(["a scum b", "plain", None, "contract", "contract scum"]), pick.random() < 0.2) for i in range(n)]


def rows_of(table):
    tests = {name: compile_query(q.parse(word), Source.of(F.coalesce("body", F.lit(""))), Options()).predicate for name, word in ALERTS.items()}
    return changes.alert_rows(table, tests, gone=F.col("gone"))


ALERTS = {"bad": "scum", "deals": "contract"}


def test_stream_over_restarts(spark, tmp_path):
    """Batches that arrive one by one, a stream that stops after each: once announced, forgotten, announced again."""
    rows, own = change_rows(240, 1), changes.state_session(spark)
    for part in range(3):
        spark.createDataFrame(rows[part * 80 : part * 80 + 80], CHANGES).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        stream = own.readStream.schema(CHANGES).parquet(f"{tmp_path}/in")
        changes.write_log(changes.announcements(rows_of(stream)), f"{tmp_path}/log", f"{tmp_path}/checkpoint").awaitTermination()
    log = spark.read.schema(changes.LOG).parquet(f"{tmp_path}/log")
    want, seen = plain_log(rows, ALERTS)
    assert sorted((r["alert"], r["document"], r["seq"], r["news"]) for r in log.collect()) == want
    whole = changes.announced_so_far(rows_of(spark.createDataFrame(rows, CHANGES)))
    assert sorted((r["alert"], r["document"], r["seq"], r["news"]) for r in whole.collect()) == want
    state = changes.seen_documents(log)
    assert {(r["alert"], r["document"]) for r in state.collect()} == seen and {r["fresh"] for r in state.collect()} == {True}


def test_a_lost_batch_is_written_once(spark, tmp_path):
    """A batch whose commit was lost is run again by the next start and leaves no second row."""
    own = changes.state_session(spark)
    spark.createDataFrame(change_rows(60, 2), CHANGES).write.parquet(f"{tmp_path}/in")
    start = lambda: changes.write_log(changes.announcements(rows_of(own.readStream.schema(CHANGES).parquet(f"{tmp_path}/in"))), f"{tmp_path}/log", f"{tmp_path}/checkpoint").awaitTermination()
    start()
    first = sorted(map(tuple, spark.read.schema(changes.LOG).parquet(f"{tmp_path}/log").collect()))
    for name in ("0", ".0.crc"):
        (tmp_path / "checkpoint/commits" / name).unlink()
    start()
    assert sorted(map(tuple, spark.read.schema(changes.LOG).parquet(f"{tmp_path}/log").collect())) == first == sorted(set(first))


@pytest.mark.parametrize("seed", range(2))
def test_the_log_of_large_batches(spark, tmp_path, seed):
    """Windows over each batch and a table of what was announced give the rows of one window over all; a batch whose commit was lost leaves none twice."""
    rows, log, state = change_rows(240, seed), f"{tmp_path}/log", f"{tmp_path}/state"
    assert changes.read_news(spark, log, state).count() == 0
    start = lambda: changes.log_announcements(rows_of(spark.readStream.schema(CHANGES).parquet(f"{tmp_path}/in")), log, state, f"{tmp_path}/checkpoint").awaitTermination()
    for k in range(4):
        spark.createDataFrame(rows[60 * k : 60 * k + 60], CHANGES).write.mode("append").parquet(f"{tmp_path}/in")
        start()
        found = sorted(map(tuple, changes.read_news(spark, log, state).collect()))
        assert found == sorted(map(tuple, changes.announced_so_far(rows_of(spark.createDataFrame(rows[: 60 * k + 60], CHANGES))).collect()))
        if k == 2:
            for name in ("2", ".2.crc"):
                (tmp_path / "checkpoint/commits" / name).unlink()
            start()
            assert sorted(map(tuple, changes.read_news(spark, log, state).collect())) == found
    (tmp_path / "state/v000000000003/_SUCCESS").unlink()
    assert 0 < changes.read_news(spark, log, state).count() < len(found)


def test_alert_stream_keeps_the_batches_out_of_python(spark, tmp_path, monkeypatch):
    """Rows of the registered stream pass no Python state, and events without a time are the last, as in its SQL."""
    monkeypatch.setattr(changes, "announcements", None)
    pick = random.Random(3)
    events = [(i, None if i % 17 == 0 else START + timedelta(seconds=pick.randrange(400)), pick.randrange(12), pick.choice(["error", "signup", "purchase", "view"])) for i in range(600)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, catalog.QUERIES["alert_stream"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(con.sql(catalog.ORACLES["alert_stream"]).fetchall()) and len(got) > 100


def test_known_documents_and_reads(spark):
    rows = [("a", 1, "known"), ("a", 2, "matches"), ("b", 3, "matches"), ("c", 4, "gone"), ("b", 5, "gone"), ("b", 6, "matches"), ("d", 7, "matches")]
    table = spark.createDataFrame([("x", p, START + timedelta(seconds=s), s, k) for p, s, k in rows], "alert string, document string, at timestamp, seq long, kind string")
    log = changes.announced_so_far(table)
    assert sorted((r["document"], r["seq"], r["news"]) for r in log.collect()) == [("a", 1, "known"), ("b", 3, "announced"), ("b", 5, "forgotten"), ("b", 6, "announced"), ("d", 7, "announced")]
    reads = spark.createDataFrame([("x", START + timedelta(seconds=6))], "alert string, at timestamp")
    assert {r["document"]: r["fresh"] for r in changes.seen_documents(log, reads).collect()} == {"a": False, "b": False, "d": True}
    assert changes.seen_documents(log.limit(0), reads).count() == 0


def test_folders_above(spark):
    inner = f"a/b.zip{SEPARATOR}c/d"
    paths = spark.createDataFrame([("a/b/c",), ("c",), ("/x/y",), (inner,), ("",), (None,)], "p string")
    got = {r["p"]: r["f"] for r in paths.select("p", changes.folders_above(F.col("p")).alias("f")).collect()}
    assert got == {"a/b/c": ["", "a", "a/b"], "c": [""], "/x/y": ["", "/x"], inner: ["", "a", "a/b.zip"], "": [""], None: None}


def plain_resolution(reports, listing, manifest):
    under = lambda p, f: p == f or f == "" or p.startswith(f + "/")
    changed, removed = set(), set()
    sites = {s for s, _, lost in reports if lost}
    reports = {(s, p) for s, p, _ in reports if s not in sites} | {(s, "") for s in sites}
    there = {(s, p): stamp for s, p, *stamp, out in listing if not out}
    known = {(s, p): stamp for s, p, *stamp in manifest}
    for s, f in reports:
        changed |= {(s, f)} & set(there)
        changed |= {k for k in there if k[0] == s and under(k[1], f) and known.get(k) != there[k]}
        removed |= {k for k in known if k[0] == s and under(k[1], f) and k not in there}
    return sorted([(*k, "changed") for k in changed] + [(*k, "removed") for k in removed])


@pytest.mark.parametrize("seed", range(3))
def test_resolution_of_reports(spark, seed):
    pick = random.Random(seed)
    paths = ["/".join(pick.choice("abc") for _ in range(pick.randrange(1, 4))) + f"/f{i}" for i in range(40)]
    listing = [(pick.choice("st"), p, pick.randrange(2), 0, pick.random() < 0.1) for p in paths if pick.random() < 0.8]
    manifest = [(pick.choice("st"), p, pick.randrange(2), 0) for p in paths]
    reports = [(pick.choice("st"), pick.choice([p, p.rpartition("/")[0], p.partition("/")[0]]), False) for p in pick.sample(paths, 12)] + [("t", "zz", seed == 2)]
    sizes = "site_id string, path string, size long, modified long"
    got = changes.resolve_reports(spark.createDataFrame(reports, "site_id string, path string, rescan boolean"), spark.createDataFrame(listing, sizes + ", excluded boolean"), spark.createDataFrame(manifest, sizes))
    assert sorted(map(tuple, got.collect())) == plain_resolution(reports, listing, manifest)


def test_a_gone_folder_on_a_stream(spark, tmp_path):
    """The documents under a folder that went are rows of the stream, joined from a table."""
    spark.createDataFrame([("s", "a/b", START, 1), ("s", "nothing", START, 2), ("s", "x.zip", START, 3)], "site_id string, path string, at timestamp, seq long").write.parquet(f"{tmp_path}/in")
    documents = spark.createDataFrame([("s", "a/b/c"), ("s", "a/b/d/e"), ("s", "a/bc"), ("t", "a/b/c"), ("s", f"x.zip{SEPARATOR}q")], "site_id string, path string")
    stream = spark.readStream.schema("site_id string, path string, at timestamp, seq long").parquet(f"{tmp_path}/in")
    run = changes.gone_documents(stream, documents).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination()
    assert {(r["path"], r["seq"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("a/b/c", 1), ("a/b/d/e", 1), (f"x.zip{SEPARATOR}q", 3)}


def test_reports_settle_on_a_stream(spark, tmp_path):
    """A run of reports comes out once, when the watermark has passed it, over two batches and a restart."""
    kind = "site_id string, path string, at timestamp, rescan boolean"
    second = lambda s: START + timedelta(seconds=s)
    for batch in ([("s", "a", second(0), False), ("s", "a", second(1), True), ("s", "b", second(1), False)], [("s", "a", second(2.5), False), ("s", "b", second(9), False)], [("s", "z", second(100), False)], [("s", "z", second(200), False)]):
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = changes.settled(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"))
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {(r["path"], r["at"], r["rescan"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("a", second(2.5), True, 3), ("b", second(1), False, 1), ("b", second(9), False, 1), ("z", second(100), False, 1)}
