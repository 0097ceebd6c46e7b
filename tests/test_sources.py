"""Folder scans, the ingest gate and the snapshot store, on real files."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from marginalia.operators import apply_changes, snapshot_diff, to_parse
from marginalia.schema import FOLDERS, NOTES, notes_from_parts
from marginalia.sources import listing
from marginalia.sources import (
    as_creates,
    ingest_gate,
    read_rejects,
    read_store,
    refresh_notes,
    scan_changed,
    scan_files,
    scan_folders,
    scan_notes,
    write_notes,
    write_snapshot,
)
from marginalia.sources.store import CommitConflict, last_commit

FILES = {
    "root.md": "---\ntags: [a, b]\n---\nbody",
    "empty.md": "",
    "dir/x y.md": "spaced",
    "dir/UPPER.MD": "not scanned",
    "dir/note.txt": "not scanned",
    "dir/sub/deep.md": "déjà",
    ".dot.md": "hidden",
    "_under.md": "hidden too",
    ".hid/in.md": "below hidden",
    "_u/100%25.md": "percent",
}
MTIME_NS = 1_700_000_000_123_999_999


@pytest.fixture()
def root(tmp_path):
    base = tmp_path / "corpus"
    for path, text in FILES.items():
        target = base / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text, encoding="utf-8")
        os.utime(target, ns=(MTIME_NS, MTIME_NS))
    (base / "void" / "inner").mkdir(parents=True)
    return str(base)


def test_scan_finds_every_note(spark, root):
    rows = {r.path: r for r in scan_notes(spark, root).collect()}
    assert set(rows) == {p for p in FILES if p.endswith(".md")}
    assert rows["root.md"].tags == ["a", "b"] and rows["root.md"].content == "body"
    assert rows["empty.md"].content == "" and rows["empty.md"].size == 0
    assert rows["dir/sub/deep.md"].folder == "dir/sub" and rows["dir/sub/deep.md"].size == 6
    assert {r.mod_time for r in rows.values()} == {MTIME_NS // 1_000_000}


def test_scan_finds_every_folder(spark, root):
    folders = {r.path: (r.parent, r.depth) for r in scan_folders(spark, root).collect()}
    assert set(folders) == {"dir", "dir/sub", ".hid", "_u", "void", "void/inner"}
    assert folders["void/inner"] == ("void", 1)


def test_write_then_scan(spark, root, tmp_path):
    notes = scan_notes(spark, root)
    out = str(tmp_path / "out")
    os.makedirs(out)
    assert write_notes(notes, out) == notes.count()
    columns = ["path", "content", "tags"]
    again = scan_notes(spark, out)
    assert sorted(map(tuple, again.select(*columns).collect())) == sorted(
        map(tuple, notes.select(*columns).collect())
    )
    plain = str(tmp_path / "plain")
    os.makedirs(plain)
    write_notes(notes, plain, front_matter=False)
    with open(f"{plain}/root.md", encoding="utf-8") as f:
        assert f.read() == "body"


def test_incremental_scan(spark, root):
    before = spark.createDataFrame(scan_notes(spark, root).collect(), NOTES)
    assert scan_changed(spark, root, before).isEmpty()
    with open(f"{root}/root.md", "w", encoding="utf-8") as f:
        f.write("changed")
    with open(f"{root}/new.md", "w", encoding="utf-8") as f:
        f.write("new")
    os.remove(f"{root}/dir/x y.md")
    after = scan_notes(spark, root)
    status = {r.path: r.status for r in snapshot_diff(before, after).collect()}
    assert status["root.md"] == "changed" and status["new.md"] == "added"
    assert status["dir/x y.md"] == "removed" and status["empty.md"] == "unchanged"
    assert {r.path for r in to_parse(after, before).collect()} == {"root.md", "new.md"}
    assert {r.path: r.content for r in scan_changed(spark, root, before).collect()} == {
        "root.md": "changed",
        "new.md": "new",
    }
    refreshed = refresh_notes(spark, root, before)
    assert sorted(map(str, refreshed.collect())) == sorted(map(str, after.collect()))


def test_ingest_gate(spark, tmp_path):
    cases = {
        "field-log.md": b"---\ntags: [river, survey]\n---\nLevel at dawn: 2.4 m",
        "chart.svg": b"<svg/>",
        "README": b"no suffix",
        "long.md": b"z" * ((1 << 20) + 1),
        "limit.md": b"z" * (1 << 20),
        "zero.md": b"before\x00after",
        "latin.txt": "caf\u00e9".encode("latin-1"),
        "MEMO.MD": b"loud",
        "D:\\scans\\bill.txt": b"paid",
        "twice.md.txt": b"two suffixes",
    }
    files = spark.createDataFrame(
        [(name, 1000, len(data), bytearray(data)) for name, data in cases.items()],
        "path string, ms bigint, length bigint, content binary",
    ).select("path", F.timestamp_millis("ms").alias("modificationTime"), "length", "content")
    accepted, rejected = ingest_gate(files, "in")
    rows = {r.source_path: r for r in accepted.collect()}
    assert {r.path: r.reason for r in rejected.collect()} == {
        "chart.svg": "extension",
        "README": "extension",
        "long.md": "too_large",
        "zero.md": "nul_byte",
        "latin.txt": "not_utf8",
    }
    assert rows["field-log.md"].path == "in/field-log.md" and rows["field-log.md"].tags == ["river", "survey"]
    assert rows["field-log.md"].content == "Level at dawn: 2.4 m"
    assert rows["MEMO.MD"].path == "in/MEMO.md"
    assert rows["D:\\scans\\bill.txt"].path == "in/bill.md"
    assert rows["twice.md.txt"].path == "in/twice.md.md"
    none, all_rejected = ingest_gate(files, "../out")
    assert none.isEmpty() and all_rejected.filter("reason = 'illegal_path'").count() == 5

    taken = notes_from_parts(
        spark.createDataFrame([("in/bill.md", "old", [], 1)], "path string, content string, tags array<string>, mod_time bigint")
    )
    log = as_creates(accepted, F.xxhash64("source_path"))
    notes, _, rejects = apply_changes(taken, spark.createDataFrame([], FOLDERS), log)
    got = {r.path: r.content for r in notes.collect()}
    assert got["in/bill.md"] == "old" and got["in/1970-01-01_000001_bill.md"] == "paid"
    assert got["in/twice.md.md"] == "two suffixes" and len(got) == 6 and rejects.isEmpty()


def test_store_commits(spark, tmp_path):
    store = str(tmp_path / "store")
    notes, folders = read_store(spark, store)
    assert notes.isEmpty() and folders.isEmpty() and last_commit(spark, store) is None
    first = notes_from_parts(
        spark.createDataFrame([("a/n.md", "1", ["t"], 1)], "path string, content string, tags array<string>, mod_time bigint")
    )
    assert write_snapshot(first, folders, store, cluster=True) == 1
    old_notes, old_folders = read_store(spark, store)
    second = old_notes.withColumn("content", F.lit("2"))
    rejects = spark.createDataFrame([(7, "not_found")], "seq bigint, reason string")
    assert write_snapshot(second, old_folders, store, rejects, source="s", expected=1) == 2
    assert read_store(spark, store)[0].first().content == "2"
    assert old_notes.first().content == "1", "an open snapshot stays readable"
    assert last_commit(spark, store)["source"] == "s"
    assert [(r.seq, r.reason) for r in read_rejects(spark, store).collect()] == [(7, "not_found")]
    with pytest.raises(CommitConflict):
        write_snapshot(first, folders, store, expected=1)


def test_errors_lose_no_note(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "_WAIT_S", 0)
    calls = []

    def flaky(times, error):
        def read():
            calls.append(1)
            if len(calls) <= times:
                raise error
            return b"text"

        return read

    assert listing.unless_gone(flaky(2, OSError("slow down"))) == b"text"
    assert listing.unless_gone(flaky(10**6, FileNotFoundError())) is None
    with pytest.raises(PermissionError):
        listing.unless_gone(flaky(10**6, PermissionError("no")))


def test_roots_as_spark_writes_them(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert listing.open_root("notes")[1] == str(tmp_path / "notes")
    assert listing.open_root(f"file://{tmp_path}/x/")[1] == f"{tmp_path}/x"
    assert listing._uri("s3a://bucket/deep") == "s3://bucket/deep"
    assert listing._uri("hdfs://host/deep") == "hdfs://host/deep"


def test_a_scan_makes_no_list_of_files(spark, tmp_path):
    files = {f"f{i % 3}/n{i}.md": b"\xff" * (i % 2) + b"body %d" % i for i in range(200)} | {"f0/empty.md": b"", "f0/.h.md": b"\xff"}
    for path, content in files.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_bytes(content)
    notes = scan_notes(spark, str(tmp_path))
    assert not [path for path in notes.inputFiles() if path.endswith(".md")]
    assert notes.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    read = {r.path: bytes(r.content) for r in notes.select("path", F.col("content").cast("binary").alias("content")).collect()}
    assert read == files | {"f0/.h.md": "�".encode()}
    found = {r.path.removeprefix(f"file:{tmp_path}/"): bytes(r.content) for r in scan_files(spark, str(tmp_path)).collect()}
    assert found == {path: content for path, content in files.items() if content and "/." not in path}
