"""The store's buckets: what a commit writes, reads and shares, and how commits meet."""

from __future__ import annotations

import random
from collections import Counter
from pathlib import Path

import pytest
from log_model import Model
from pyspark.sql import functions as F
from test_changes import PARTS, change
from test_flow import changes

from marginalia.plans import storing
from marginalia.schema import notes_from_parts
from marginalia.sources import (
    CommitConflict,
    commit_changes,
    expire_snapshots,
    read_folder,
    read_note,
    read_queue,
    read_rejects,
    read_store,
    read_tagged,
    write_buckets,
    write_snapshot,
)
from marginalia.sources import commits as commits_module
from marginalia.sources import store as store_module
from marginalia.sources.buckets import plan_layout
from marginalia.sources.store import _mark, last_commit, layout_of, read_buckets

FOLDERS = ["", "a", "a/b", "c", "d e", "f/g/h"]


def corpus(n):
    return [(f"{folder}/n{i}.md".lstrip("/"), f"text {i}", ["t"], i) for i in range(n) for folder in [FOLDERS[i % 6]]]


def made(spark, tmp_path, rows, buckets=100):
    store = str(tmp_path / "store")
    notes = notes_from_parts(spark.createDataFrame(rows, PARTS))
    write_snapshot(notes, spark.createDataFrame([], "path string"), store, buckets=buckets)
    return store


def written(tmp_path, number):
    return sorted(int(p.name.partition("=")[2]) for p in (tmp_path / "store").glob(f"snapshot-{number:012d}-*/notes/bucket=*"))


def holds(spark, store, model):
    notes, folders = read_store(spark, store)
    assert sorted((r.path, r.content, tuple(r.tags), r.mod_time) for r in notes.collect()) == sorted(
        (p, c, tuple(t), m) for p, (c, t, m) in model.notes.items()
    )
    assert sorted(r.path for r in folders.collect()) == sorted(model.folders)


def test_a_commit_writes_the_buckets_it_changes(spark, tmp_path):
    rows = corpus(300)
    store, model = made(spark, tmp_path, rows), Model(rows)
    before = last_commit(spark, store)
    total = sum(map(len, before["notes"].values()))
    log = [change(1, "update", "a/b/n2.md", content="changed", tags=[])]
    assert commit_changes(spark, store, changes(spark, log)) == 2
    model.apply(log)
    holds(spark, store, model)
    assert len(written(tmp_path, 2)) == 1 and last_commit(spark, store)["changed"] == written(tmp_path, 2)
    assert not list((tmp_path / "store").glob("snapshot-000000000002-*/folders"))
    after = last_commit(spark, store)
    assert sum(map(len, after["notes"].values())) == total
    # A new folder is added to the table, and a rejected change writes no notes at all.
    log = [change(2, "create", name="n", folder="new/place", content="x"), change(3, "delete", "gone.md")]
    commit_changes(spark, store, changes(spark, log))
    model.apply(log)
    assert commit_changes(spark, store, changes(spark, [change(4, "delete", "gone.md")])) == 4
    holds(spark, store, model)
    assert len(written(tmp_path, 3)) == 1 and written(tmp_path, 4) == []
    assert sorted(r.seq for r in read_rejects(spark, store).collect()) == [3, 4]


def test_random_logs_match_the_model(spark, tmp_path):
    rng, rows = random.Random(4), corpus(60)
    store, model, seq = made(spark, tmp_path, rows, buckets=8), Model(rows), 0
    for batch in range(4):
        log = []
        for _ in range(12):
            seq += 1
            path = rng.choice([*model.notes, "none.md"])
            kind = rng.choice(["update", "delete", "move", "duplicate", "save", "create", *(["move_folder", "rename_folder", "delete_folder"] if batch % 2 else [])])
            folder = rng.choice([*FOLDERS, "z"])
            if kind.endswith("_folder"):
                path = rng.choice(sorted(model.folders))
            log.append(change(seq, kind, None if kind == "create" else path, name=rng.choice([None, "x", f"r{seq}"]) if kind != "move_folder" else None,
                              folder=folder if kind in ("move", "create", "move_folder", "save") else None, content=f"c{seq}", tags=["u"]))
        commit_changes(spark, store, changes(spark, log), source=f"s#{batch}")
        model.apply(log)
        holds(spark, store, model)
        assert commit_changes(spark, store, changes(spark, log), source=f"s#{batch}") is None


def test_commits_on_disjoint_buckets_both_land(spark, tmp_path):
    rows = corpus(120)
    store, model = made(spark, tmp_path, rows), Model(rows)
    base = last_commit(spark, store)
    layout = layout_of(base)
    place = layout.bucket(F.col("folder"), F.col("path"))
    buckets = {r.path: r.b for r in read_store(spark, store)[0].select("path", place.alias("b")).collect()}
    mine, theirs = "a/n1.md", "c/n3.md"
    assert buckets[mine] != buckets[theirs]

    def attempt(path, content, **kw):
        notes = read_buckets(spark, store, base, [buckets[path]])
        notes = notes.withColumn("content", F.when(F.col("path") == path, content).otherwise(F.col("content")))
        return write_buckets(spark, store, base, notes, [buckets[path]], **kw)

    # The other writer is faster, at the last moment.
    log = [change(1, "update", theirs, content="theirs", tags=["t"], ts=3), change(2, "create", name="k", folder="q", content="k", ts=0)]
    made_first = []
    folders = spark.createDataFrame([("w", "", "w", 0)], store_module.FOLDERS)
    number = attempt(mine, "mine", source="m#1", new_folders=folders, before_mark=lambda: made_first.append(commit_changes(spark, store, changes(spark, log), source="o#7")))
    assert made_first == [2] and number == 3
    model.apply(log)
    model.notes[mine] = ("mine", *model.notes[mine][1:])
    model.folders.add("w")
    holds(spark, store, model)
    assert last_commit(spark, store)["sources"] == {"m": 1, "o": 7}
    # On the same bucket, or where it has read, the slower one must not win.
    with pytest.raises(CommitConflict):
        attempt(theirs, "late")
    with pytest.raises(CommitConflict):
        attempt("d e/n4.md", "late", read=[buckets[theirs]])
    with pytest.raises(CommitConflict):
        attempt("d e/n4.md", "late", all_new_folders=folders)
    holds(spark, store, model)


def test_a_conflicting_log_is_worked_out_again(spark, tmp_path, monkeypatch):
    rows = corpus(30)
    store, model = made(spark, tmp_path, rows), Model(rows)
    rival = [change(1, "update", "a/n1.md", content="rival", tags=[])]
    log = [change(2, "duplicate", "a/n1.md"), change(3, "update", "a/n1.md", content="mine", tags=[])]
    from marginalia.sources import commits

    real, raced = commits.write_buckets, []

    def slow(*args, **kw):
        if not raced:
            raced.append(True)
            commit_changes(spark, store, changes(spark, rival))
        return real(*args, **kw)

    monkeypatch.setattr(commits, "write_buckets", slow)
    assert commit_changes(spark, store, changes(spark, log)) == 3
    model.apply(rival)
    model.apply(log)
    holds(spark, store, model)
    raced.clear()
    with pytest.raises(CommitConflict):
        commit_changes(spark, store, changes(spark, log), retries=0)


def test_new_notes_are_added_to_their_buckets(spark, tmp_path, monkeypatch):
    """A commit of new notes writes those and no others; a bucket in many parts, or with a changed note, is one part again."""
    monkeypatch.setattr(commits_module, "BUCKET_PARTS", 3)
    rows = corpus(60)
    store, model = made(spark, tmp_path, rows, buckets=1), Model(rows)

    def commit(number, *log):
        assert commit_changes(spark, store, changes(spark, log)) == number
        model.apply(log)
        holds(spark, store, model)
        (folder,) = (tmp_path / "store").glob(f"snapshot-{number:012d}-*/notes")
        return spark.read.parquet(str(folder)).count(), len(last_commit(spark, store)["notes"])

    assert commit(2, change(1, "create", name="n1", folder="a", content="new", tags=["Rare"], ts=5), change(2, "create", name="k", folder="new", content="k")) == (2, 2)
    assert read_folder(spark, store, "a").count() == 11 and read_note(spark, store, "new/k.md").first().content == "k"
    assert read_tagged(spark, store, "rare").count() == 1 and read_tagged(spark, store, "t").count() == 60
    assert commit(3, change(3, "duplicate", "a/n1.md")) == (1, 3)
    assert commit(4, change(4, "create", name="l", folder="new", content="l")) == (64, 1)
    assert commit(5, change(5, "create", name="m", folder="new", content="m")) == (1, 2)
    assert commit(6, change(6, "update", "new/m.md", content="now", tags=[]), change(7, "create", name="o", content="o")) == (66, 1)
    assert commit(7, change(8, "create", name="p", content="p")) == (1, 2)
    assert expire_snapshots(spark, store, keep=1) == 6
    holds(spark, store, model)


def test_expiring_keeps_what_is_shared(spark, tmp_path):
    rows = corpus(60)
    store, model = made(spark, tmp_path, rows, buckets=10), Model(rows)
    for i in range(3):
        log = [change(i + 1, "update", "c/n3.md", content=f"v{i}", tags=[], folder=None)]
        commit_changes(spark, store, changes(spark, log))
        model.apply(log)
    notes_before = len(list((tmp_path / "store").glob("*/notes/bucket=*")))
    assert expire_snapshots(spark, store, keep=1) == 3
    holds(spark, store, model)
    assert notes_before - len(list((tmp_path / "store").glob("*/notes/bucket=*"))) == 3
    assert expire_snapshots(spark, store, keep=9) == 0


def test_a_hot_folder_lies_in_several_buckets(spark, tmp_path, monkeypatch):
    rows = [(f"hot/n{i}.md", f"x{i}", [], i) for i in range(400)] + corpus(30)
    notes = notes_from_parts(spark.createDataFrame(rows, PARTS))
    layout = plan_layout(notes, buckets=12, hot_notes=10)
    assert layout.hot == {"hot": 12}
    counts = Counter(r.b for r in notes.select(layout.bucket(F.col("folder"), F.col("path")).alias("b")).collect())
    assert max(counts.values()) < 100
    monkeypatch.setattr(store_module, "plan_layout", lambda *_: layout)
    store, model = made(spark, tmp_path, rows), Model(rows)
    log = [change(1, "delete", "hot/n7.md"), change(2, "create", name="n8", folder="hot", content="again", ts=5)]
    commit_changes(spark, store, changes(spark, log))
    model.apply(log)
    holds(spark, store, model)
    assert 1 <= len(written(tmp_path, 2)) <= 2
    hot = read_folder(spark, store, "hot")
    assert hot.count() == 400 and read_folder(spark, store, "none").count() == 0


def test_one_note_opens_one_bucket(spark, tmp_path):
    store = made(spark, tmp_path, corpus(300))
    found = read_note(spark, store, "a/b/n2.md")
    assert found.first().content == "text 2" and len({f.split("bucket=")[1].split("/")[0] for f in found.inputFiles()}) == 1
    assert len(found.inputFiles()) < len(read_store(spark, store)[0].inputFiles())
    assert read_note(spark, store, "a/b/none.md").count() == 0
    assert read_note(spark, str(tmp_path / "new"), "x.md").count() == 0
    assert read_folder(spark, store, "a").count() == 50


def test_many_added_folder_tables_become_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "FOLDER_PARTS", 2)
    rows = corpus(6)
    store, model = made(spark, tmp_path, rows, buckets=4), Model(rows)
    for i in range(3):
        log = [change(i, "create", name="n", folder=f"p{i}", content="x")]
        commit_changes(spark, store, changes(spark, log))
        model.apply(log)
    holds(spark, store, model)
    assert len(last_commit(spark, store)["folders"]) == 2


def test_a_failed_change_holds_back_its_client(spark, tmp_path):
    store = made(spark, tmp_path, [("n.md", "0", [], 1), ("m.md", "0", [], 1)], buckets=4)

    def batch(number, *log):
        rows = [dict(change(seq, "update", path, content=f"{client}{seq}", tags=[]), client_id=client) for seq, client, path in log if path]
        rows += [dict(change(seq, "create", name="missing", content="made"), client_id=client) for seq, client, path in log if not path]
        commit_changes(spark, store, changes(spark, rows), source=f"s#{number}", hold=True)
        waiting = {r.seq for r in read_queue(spark, store).collect()}
        return waiting, {r.path: r.content for r in read_store(spark, store)[0].collect()}

    assert batch(0, (1, "A", "n.md"), (2, "A", "missing.md"), (3, "A", "n.md"), (4, "B", "m.md"), (5, None, "gone.md")) == (
        {2, 3, 5}, {"n.md": "A1", "m.md": "B4"})
    # What A waits for comes, but only after what A said, so it is tried again with the next log.
    assert batch(1, (6, "B", None), (7, "A", "n.md"), (8, None, "m.md"))[0] == {2, 3, 5, 7, 8}
    waiting, notes = batch(2, (9, "A", "m.md"))
    assert waiting == {5, 8} and notes == {"n.md": "A7", "m.md": "A9", "missing.md": "A2"}
    assert sorted((r.seq, r.reason) for r in read_rejects(spark, store).collect()) == [(2, "not_found")] * 2 + [(5, "not_found")] * 3


def test_a_tag_search_opens_the_buckets_that_hold_it(spark, tmp_path):
    rows = [(path, text, ["Rare", "t"] if path.endswith("/n2.md") else tags, at) for path, text, tags, at in corpus(300)]
    store = made(spark, tmp_path, rows)
    found = read_tagged(spark, store, "rARE")
    assert [r.path for r in found.collect()] == ["a/b/n2.md"]
    assert len({f.split("bucket=")[1].split("/")[0] for f in found.inputFiles()}) == 1
    assert len(found.inputFiles()) < len(read_store(spark, store)[0].inputFiles())
    assert read_tagged(spark, store, "t").count() == 300 and read_tagged(spark, store, "none").count() == 0
    assert read_tagged(spark, str(tmp_path / "new"), "t").count() == 0
    log = [
        change(1, "update", "a/b/n2.md", content="plain", tags=[], folder=None),
        change(2, "update", "c/n3.md", content="now", tags=["rare"], folder=None),
    ]
    commit_changes(spark, store, changes(spark, log))
    assert [r.path for r in read_tagged(spark, store, "rare").collect()] == ["c/n3.md"]
    assert expire_snapshots(spark, store, keep=1) == 1
    assert [r.path for r in read_tagged(spark, store, "rare").collect()] == ["c/n3.md"]
    # Without its index a commit's buckets are all opened.
    commit = last_commit(spark, store)
    body = {k: v for k, v in commit.items() if k not in ("number", "tagged")}
    _mark(spark, store, commit["number"] + 1, body)
    assert [r.path for r in read_tagged(spark, store, "rare").collect()] == ["c/n3.md"]


def test_a_held_stream_comes_in_many_files(spark, tmp_path, monkeypatch, request):
    """Each batch lies in several files, so that no task reads or plans a third of the log."""
    events = spark.range(40).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) AS ts", "id % 7 AS user_id",
        "'view' AS event_type", "1.0D AS value", "concat('p', id) AS props",
    )
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    files, start = [], storing.stream_apply

    def counted(changes, store, *args, **options):
        folder = Path(store).parent / "in"
        files.append(len(list(folder.glob("*.parquet"))) - sum(files))
        return start(changes, store, *args, **options)

    monkeypatch.setattr(storing, "stream_apply", counted)
    small = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "4k"}
    before = {key: spark.conf.get(key) for key in small}
    for key, value in small.items():
        spark.conf.set(key, value)
    request.addfinalizer(lambda: [spark.conf.set(key, value) for key, value in before.items()])
    got = {r.path: r.content for r in storing.stream_replay_holds(spark, str(tmp_path)).collect()}
    assert got == {f"events/note_{u}.md": f"view p{max(i for i in range(40) if i % 7 == u)}" for u in range(7)}
    assert len(files) == 3 and min(files) > 1
