"""Queues, replay, sessions and their streaming counterparts."""

from __future__ import annotations

import importlib
import random
import time
from pathlib import Path

import pytest
from log_model import Model
from pyspark.sql import functions as F

from marginalia.operators import (
    coalesce_changes,
    live_sessions,
    pending_count,
    read_changes,
    replay_prefix,
    session_expiry,
    sessions,
)
from marginalia.schema import CHANGES
from marginalia.scratch import shared_dir
from marginalia.sources import expire_snapshots, read_rejects, read_store
from marginalia.sources.files import scan_files
from marginalia.sources.store import CommitConflict, _mark, last_commit
from marginalia.streaming import (
    apply_batch,
    ingest_batch,
    stream_apply,
    stream_coalesce,
    stream_ingest,
    stream_pending,
    stream_sessions,
    stream_sessions_logout,
)
from test_changes import change

COLUMNS = CHANGES.fieldNames()


def changes(spark, log):
    return spark.createDataFrame([tuple(c[k] for k in COLUMNS) for c in log], CHANGES)


def random_queue(rng, n):
    return [dict(change(i, "save", f"k{rng.randint(0, 5)}.md", content=f"c{i}", tags=[]), ts=rng.randint(0, 20)) for i in range(n)]


def test_queue(spark):
    log = random_queue(random.Random(1), 80)
    df = changes(spark, log)
    latest = {}
    for c in sorted(log, key=lambda c: (c["ts"], c["seq"])):
        latest[c["key"]] = c["seq"]
    assert {r.key: r.seq for r in coalesce_changes(df).collect()} == latest
    shuffled = changes(spark, random.Random(2).sample(log, len(log)))
    assert {r.key: r.seq for r in coalesce_changes(shuffled).collect()} == latest
    assert pending_count(df).first().pending == 80
    order = [(r.ts, r.key) for r in read_changes(df).collect()]
    assert order == sorted(order)


def test_replay_stops_at_first_failure(spark):
    rows = [("a", 1, "k1", True), ("a", 2, "k2", False), ("a", 3, "k3", True), ("a", 4, "k4", False), ("b", 1, "k5", True), ("b", 9, "k6", True)]
    results = spark.createDataFrame(rows, "client_id string, ts bigint, key string, ok boolean")
    results = results.withColumn("seq", F.substring("key", 2, 1).cast("bigint"))
    got = {r.key: r.status for r in replay_prefix(results).collect()}
    assert got == {"k1": "applied", "k2": "failed", "k3": "queued", "k4": "queued", "k5": "applied", "k6": "applied"}


def test_replay_of_ties_and_unknown_results(spark):
    rows = [("a", 5, "k", 1, True), ("a", 5, "k", 2, False), ("a", 5, "k", 3, True), ("b", 5, "k", 4, None), ("b", 5, "j", 5, True)]
    results = spark.createDataFrame(rows, "client_id string, ts bigint, key string, seq bigint, ok boolean")
    got = {r.seq: r.status for r in replay_prefix(results).collect()}
    assert got == {1: "applied", 2: "failed", 3: "queued", 4: "failed", 5: "applied"}


def test_coalesce_aggregates_no_body(spark):
    plan = coalesce_changes(changes(spark, random_queue(random.Random(1), 3)))._jdf.queryExecution().optimizedPlan().toString()
    aggregate = plan[plan.index("Aggregate") :]
    assert "content" not in aggregate.split("\n")[0] and "max_by" not in plan


def model_sessions(events, ttl):
    out = []
    for token, ts in sorted(events):
        if out and out[-1][0] == token and ts - out[-1][2] <= ttl:
            out[-1][2], out[-1][3] = ts, out[-1][3] + 1
        else:
            out.append([token, ts, ts, 1])
    return sorted((t, s, e, e + ttl, n) for t, s, e, n in out)


def test_sessions(spark):
    rng = random.Random(6)
    ttl = 100
    events = [(rng.choice("ab" * 9 + "c"), rng.randint(0, 9000)) for _ in range(400)]
    events += [("edge", 0), ("edge", 100), ("edge", 201), ("edge", 99 + 201)]
    df = spark.createDataFrame(events, "token string, ts bigint")
    got = sessions(df, ttl_ms=ttl)
    columns = ["token", "start", "last", "expires", "n_events"]
    assert sorted(map(tuple, got.select(*columns).collect())) == model_sessions(events, ttl)
    expiry = {r.token: r.expires for r in session_expiry(df, ttl_ms=ttl).collect()}
    assert expiry["edge"] == 400
    table = session_expiry(df, ttl_ms=ttl).filter("token = 'edge'")
    assert live_sessions(table, 400).count() == 1 and live_sessions(table, 401).count() == 0
    assert live_sessions(table, 400, at_load=True).count() == 0


def test_logout_ends_a_token(spark):
    events = [("a", 0, False), ("a", 50, True), ("a", 60, False), ("a", 900, False), ("b", 5, False)]
    df = spark.createDataFrame(events, "token string, ts bigint, out boolean")
    rows = {r.token: (r.start, r.last, r.expires, r.n_events) for r in sessions(df, ttl_ms=100, logout=F.col("out")).collect()}
    assert rows == {"a": (0, 50, 50, 2), "b": (5, 5, 105, 1)}


def test_streamed_sessions_equal_batch(spark, tmp_path):
    rng = random.Random(8)
    events = sorted((rng.randint(0, 50_000_000), rng.choice("abc")) for _ in range(300))
    source = str(tmp_path / "events")
    for part in range(3):
        rows = [(t, ts) for ts, t in events[part * 100 : part * 100 + 100]]
        spark.createDataFrame(rows, "token string, ts bigint").coalesce(1).write.mode("append").parquet(source)
    # A last event far ahead lets the watermark close everything before it.
    spark.createDataFrame([("z", 10**9)], "token string, ts bigint").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("token string, ts bigint").option("maxFilesPerTrigger", 1).parquet(source)
    ttl = 400_000
    closed = stream_sessions(stream, ttl_ms=ttl)
    query = (
        closed.writeStream.outputMode("append").format("parquet")
        .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = spark.read.schema(closed.schema).parquet(str(tmp_path / "out"))
    want = model_sessions([(t, ts) for ts, t in events], ttl)
    assert sorted(map(tuple, got.select("token", "start", "last", "expires", "n_events").collect())) == want


def test_streamed_logout_equals_batch(spark, tmp_path):
    """Out of order over several batches; a logout that arrives late also refuses what came before it."""
    rng = random.Random(11)
    rows = [(f"t{rng.randint(0, 9)}", rng.randint(0, 3_000_000), rng.random() < 0.04) for _ in range(300)]
    rows += [("t1", 5, None), (None, 7, True), ("t2", None, True), ("hot", 9, False)] + [("hot", 9, False)] * 50
    rng.shuffle(rows)
    schema, ttl = "token string, ts bigint, leaves boolean", 200_000
    source = str(tmp_path / "in")
    for part in range(3):
        spark.createDataFrame(rows[part::3], schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        closed = stream_sessions_logout(stream, F.col("leaves"), ttl_ms=ttl)
        if part == 2:
            spark.createDataFrame([("z", 10**9, False)], schema).write.mode("append").parquet(source)
        closed.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "cp")
        ).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(closed.schema).parquet(str(tmp_path / "out"))
    batch = sessions(spark.createDataFrame(rows, schema).dropna(subset=["token", "ts"]), ttl_ms=ttl, logout=F.col("leaves"))
    columns = ["token", "start", "last", "expires", "n_events"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))


def test_streamed_queue_equals_batch(spark, tmp_path):
    log = random_queue(random.Random(3), 60)
    source = str(tmp_path / "in")
    for part in range(3):
        changes(spark, log[part::3]).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(source)
    latest = {}

    def keep(batch, _):
        latest.update({r.key: r.seq for r in batch.collect() if r.pending})

    stream_coalesce(stream).writeStream.outputMode("update").foreachBatch(keep).option(
        "checkpointLocation", str(tmp_path / "cp")
    ).trigger(availableNow=True).start().awaitTermination()
    assert latest == {r.key: r.seq for r in coalesce_changes(changes(spark, log)).collect()}


def test_stream_replay_into_store(spark, tmp_path):
    store, source, checkpoint = (str(tmp_path / n) for n in ("store", "in", "cp"))
    first = [
        change(1, "save", None, name="n", folder="a", content="one", tags=["x"]),
        change(2, "save", "missing.md", content="kept"),
    ]
    second = [change(3, "save", "a/n.md", content="two", tags=[], folder="b")]
    model = Model([])
    for log in (first, second):
        model.apply(log)
        changes(spark, log).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(CHANGES).parquet(source)
        stream_apply(stream, store, checkpoint).awaitTermination()
    notes, folders = read_store(spark, store)
    assert {r.path: (r.content, list(r.tags), r.mod_time) for r in notes.collect()} == model.notes
    assert {r.path for r in folders.collect()} == model.folders
    assert [(r.seq, r.reason, r.content) for r in read_rejects(spark, store).collect()] == [(2, "not_found", "kept")]
    commit = last_commit(spark, store)
    assert commit["number"] == 2
    # The same batch delivered again changes nothing, also after another stream's commit.
    assert apply_batch(changes(spark, second), store, commit["source"]) is None
    other = [change(9, "create", name="other", content="o", tags=[])]
    assert apply_batch(changes(spark, other), store, "elsewhere#0") == 3
    assert apply_batch(changes(spark, second), store, commit["source"]) is None
    assert apply_batch(changes(spark, other), store, "elsewhere#0") is None
    # What an attempt without a marker left behind does not count.
    notes.limit(0).write.parquet(f"{store}/snapshot-000000000009-dead/rejects")
    assert read_rejects(spark, store).count() == 1
    assert read_rejects(spark, str(tmp_path / "new")).isEmpty()
    with pytest.raises(CommitConflict):
        _mark(spark, store, 3, {})
    # Old snapshots can go; the current one and all rejects stay.
    assert expire_snapshots(spark, store, keep=1) == 2
    assert {r.path for r in read_store(spark, store)[0].collect()} == {"b/n.md", "other.md"}
    # Two notes, so two buckets: one of the last commit, one that it shares with an older one.
    assert read_rejects(spark, store).count() == 1 and len(list((tmp_path / "store").glob("*/notes/bucket=*"))) == 2
    assert last_commit(spark, store)["number"] == 3


def test_applied_keys_leave_the_state(spark, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    schema = "key string, ts bigint, seq bigint, applied boolean"
    big, seen = 1 << 60, {}

    def keep(batch, batch_id):
        seen.update({r.key: (r.seq, r.pending) for r in batch.collect()})

    def drop(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(schema).parquet(source)
        waiting = stream_pending(arriving, keep_ms=0, clock_skew="0 seconds")
        query = waiting.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
        query.trigger(availableNow=True).start().awaitTermination()
        return {r.key.key for r in spark.read.format("statestore").load(checkpoint).select("key").collect()}

    first = [("a", 1, 1, False), ("a", 5, big + 1, None), ("b", 1, 2, False), ("c", 9, 7, True), (None, 1, 9, False)]
    assert "a" in drop(*first, ("d", 1, None, False))
    assert seen == {"a": (big + 1, True), "b": (2, True)}
    drop(("a", 5, big, True), ("b", 1, 2, True))  # the report of an earlier entry of a leaves the newest pending
    assert seen == {"a": (big + 1, True), "b": (2, False)}
    drop(("e", 1, 3, False))
    left = drop(("e", 2, 4, False))
    assert left == {"a", "e"}
    drop(("b", 0, 5, False))  # late, but its key has left: a new entry
    assert seen == {"a": (big + 1, True), "b": (5, True), "e": (4, True)}


def test_files_that_drop_in(spark, tmp_path):
    drop, store, checkpoint = tmp_path / "drop", str(tmp_path / "store"), str(tmp_path / "checkpoint")

    def put(name, content):
        path = drop / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)

    def take():
        stream_ingest(spark, str(drop), store, checkpoint, "in").awaitTermination()

    put("a.md", b"---\ntags: [x]\n---\none")
    put("b.exe", b"two")
    put("sub/c.txt", b"\xff\x00")
    take()
    put("sub/a.txt", b"again")
    put("empty.md", b"")
    put(".part.md", b"not ready")
    take()
    take()
    files = spark.read.format("binaryFile").load(f"{drop}/a.md")
    assert ingest_batch(files, store, f"{checkpoint}#0", "in") is None
    notes = {r.content: r for r in read_store(spark, store)[0].collect()}
    assert set(notes) == {"one", "again"}
    assert (notes["one"].path, notes["one"].tags) == ("in/a.md", ["x"])
    assert notes["again"].path.endswith("_a.md") and notes["again"].folder == "in"
    rejects = {r.path.rpartition("/")[2]: r.reason for r in read_rejects(spark, store).collect()}
    assert rejects == {"b.exe": "extension", "c.txt": "not_utf8"}


def test_files_that_drop_in_are_listed_by_tasks(spark, tmp_path):
    drop, store, checkpoint = tmp_path / "drop", str(tmp_path / "store"), tmp_path / "checkpoint"
    drop.mkdir()

    def take():
        stream_ingest(spark, str(drop), store, str(checkpoint), "in", files_per_batch=2).awaitTermination()

    take()
    assert last_commit(spark, store) is None
    for i in range(4):
        (drop / f"n{i}.md").write_text(f"{i}")
    take()
    take()
    assert sorted(r.content for r in read_store(spark, store)[0].collect()) == list("0123")
    assert last_commit(spark, store)["sources"] == {str(checkpoint): 1}
    # Spark's own log of a source, which the driver reads as a whole, names no file.
    assert not [p for p in checkpoint.glob("sources/**/*") if p.is_file() and b".md" in p.read_bytes()]


def test_a_drop_leaves_no_copies_of_its_files(spark, tmp_path, monkeypatch, request):
    """When a drop is committed its contents are on disk once, as changes; neither exchanges nor the files as they came are left."""
    module = importlib.import_module("marginalia.streaming.ingest")
    drop, store, seen = tmp_path / "drop", str(tmp_path / "store"), []
    drop.mkdir()
    for i in range(40):
        (drop / f"n{i:02}.{'md' if i % 4 else 'exe'}").write_text(f"text {i}")
    scratch = Path(shared_dir(spark).removeprefix("file:"))
    local = [Path(d) for d in spark._jsc.sc().env().blockManager().diskBlockManager().localDirsString()]

    def tables():
        return {table for run in scratch.iterdir() for table in run.iterdir()}

    def shuffled():
        return {path for folder in local for path in folder.rglob("shuffle_*.data")}

    before = tables(), shuffled()
    commit = module.commit_changes

    def looked(spark, store, changes, *args, **kw):
        for _ in range(100):  # Spark deletes them in the background
            if not (left := shuffled() - before[1]):
                break
            time.sleep(0.1)
        new = [spark.read.parquet(str(table)) for table in tables() - before[0]]
        seen.append((sum("content" in t.columns and not t.filter("content IS NOT NULL").isEmpty() for t in new), left, changes.count()))
        return commit(spark, store, changes, *args, **kw)

    monkeypatch.setattr(module, "commit_changes", looked)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    request.addfinalizer(lambda: spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold))
    assert ingest_batch(scan_files(spark, str(drop)), store, "s#0", "in") == 1
    assert seen == [(1, set(), 30)] and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
    assert read_store(spark, store)[0].count() == 30 and read_rejects(spark, store).count() == 10


@pytest.mark.parametrize("kind", ["sessions", "queue"])
def test_keys_share_states(spark, tmp_path, monkeypatch, kind):
    module = importlib.import_module(f"marginalia.streaming.{kind}")
    monkeypatch.setattr(module, "BUCKETS", 3, raising=False)
    rows = [(f"k{i}", i, t, i % 4 == 0 and t == 1001) for i in range(30) for t in (1000, 1001)]
    drop = str(tmp_path / "in")
    spark.createDataFrame(rows, "key string, seq bigint, ts bigint, out boolean").write.parquet(drop)
    events = spark.readStream.schema("key string, seq bigint, ts bigint, out boolean").parquet(drop)
    if kind == "sessions":
        stream, mode = stream_sessions_logout(events, F.col("out"), token="key", ttl_ms=10, watermark="0 seconds"), "append"
    else:
        stream, mode = stream_pending(events.withColumnRenamed("out", "applied")), "update"
    seen = []
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, _: seen.extend(batch.collect()))
    query = query.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 3
    if kind == "sessions":  # the watermark has reached 1001: only logouts have ended a session
        assert {tuple(r) for r in seen} == {(f"k{i}", 1000, 1001, 1001, 2) for i in range(0, 30, 4)}
    else:
        assert {tuple(r) for r in seen} == {(f"k{i}", 1000 if i % 4 == 0 else 1001, i, i % 4 != 0) for i in range(30)}
