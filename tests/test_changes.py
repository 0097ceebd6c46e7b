"""The change-log engine against a one-at-a-time model, and the stated cases."""

from __future__ import annotations

import random

import pytest
from log_model import Model
from pyspark.sql import functions as F

from marginalia.operators import changes as changes_module
from marginalia.operators.allocate import BLOCK, _block_of, free_numbers, order_blocks, ordinal_within
from marginalia.operators.changes import apply_changes
from marginalia.schema import CHANGES, notes_from_parts

PARTS = "path string, content string, tags array<string>, mod_time bigint"


def change(seq, kind, path=None, name=None, folder=None, content=None, tags=None, ts=None):
    return {
        "seq": seq,
        "key": path or f"new::{seq}",
        "client_id": None,
        "kind": kind,
        "path": path,
        "name": name,
        "folder": folder,
        "content": content,
        "tags": tags,
        "ts": 1000 * seq if ts is None else ts,
    }


def run(spark, notes, folders, log):
    columns = CHANGES.fieldNames()
    result = apply_changes(
        notes_from_parts(spark.createDataFrame(notes, PARTS)),
        spark.createDataFrame([(f,) for f in folders], "path string"),
        spark.createDataFrame([tuple(c[k] for k in columns) for c in log], CHANGES),
    )
    return result


def check(spark, notes, folders, log):
    model = Model(notes, folders)
    model.apply(log)
    got_notes, got_folders, got_rejects = run(spark, notes, folders, log)
    rows = got_notes.collect()
    paths = [r.path for r in rows]
    assert len(paths) == len(set(paths)), "a path came out twice"
    assert {r.path: (r.content, list(r.tags), r.mod_time) for r in rows} == model.notes
    assert {r.path for r in got_folders.collect()} == model.folders
    assert {r.seq: r.reason for r in got_rejects.collect()} == model.rejects
    for r in rows:
        assert r.preview == r.content.strip()
        assert r.folder == r.path.rpartition("/")[0]
        assert r.name == r.path.rpartition("/")[2].removesuffix(".md")
        header = "---\ntags: [" + ", ".join(f'"{t}"' for t in r.tags) + "]\n---\n" if r.tags else ""
        assert r.size == len((header + r.content).encode())
    return model


def test_note_crud(spark):
    notes = [("pump.md", "rev 1", [], 4), ("valve.md", "shut", ["parts"], 4), ("draft.md", "hull", ["keep"], 4), ("scrap.md", "-", [], 4)]
    log = [
        change(1, "create", name="keel", content="> oak\n> 9 m", tags=["wood", "long"]),
        change(2, "create", content="unnamed"),
        change(3, "create", name="pump", content="rev 2"),
        change(4, "create", name="pump", content="rev 3", ts=3000),
        change(5, "update", "valve.md", content="open", tags=["parts", "checked"]),
        change(6, "update", "draft.md", content="hull", tags=["keep"], name="final"),
        change(7, "delete", "scrap.md"),
        change(8, "delete", "ghost.md"),
        change(9, "update", "ghost.md", content="boo"),
        change(10, "create", name="../../up/there", folder="bay/two"),
        change(11, "create", name="raft", folder="../sea"),
        change(12, "update", "final.md", content="deck", name="valve"),
    ]
    model = check(spark, notes, [], log)
    assert "1970-01-01_000003_pump.md" in model.notes and "1970-01-01_000003-2_pump.md" in model.notes
    assert model.rejects == {8: "not_found", 9: "not_found", 11: "illegal_path", 12: "exists"}


def test_move_duplicate_and_save(spark):
    notes = [("m.md", "x", ["k"], 5), ("c.md", "1", [], 1), ("box/c.md", "2", [], 1), ("note (copy 2).md", "q", [], 1), ("note.md", "n", ["a"], 1)]
    log = [
        change(1, "move", "m.md", folder="box"),
        change(2, "move", "c.md", folder="box"),
        change(3, "move", "c.md", folder=""),
        change(4, "duplicate", "note.md"),
        change(5, "duplicate", "note.md"),
        change(6, "duplicate", "nope.md"),
        change(7, "duplicate", "note (copy).md"),
        change(8, "save", "c.md", name="d", folder="deep/er", content="s", tags=["z"]),
        change(9, "save", None, name="brand", folder="deep", content="b"),
        change(10, "save", "gone.md", content="kept in rejects"),
        change(11, "duplicate", "note.md", ts=7),
    ]
    model = check(spark, notes, [], log)
    assert {"note (copy).md", "note (copy 3).md", "note (copy 4).md", "note (copy) (copy).md"} <= set(model.notes)


def test_folder_changes(spark):
    notes = [("a/n.md", "x", [], 1), ("a/sub/m.md", "y", [], 2), ("b_/k.md", "z", [], 3), ("bx/k.md", "w", [], 4), ("r.md", "r", [], 1)]
    log = [
        change(1, "rename_folder", "a", name="z"),
        change(2, "create_folder", "x/y/z"),
        change(3, "create_folder", ""),
        change(4, "update", "z/n.md", content="after", tags=["t"]),
        change(5, "move_folder", "z", folder="z/sub"),
        change(6, "move_folder", "z", folder="x/y"),
        change(7, "delete_folder", "b_"),
        change(8, "delete_folder", ""),
        change(9, "create", name="late", folder="a", content="new a"),
        change(10, "rename_folder", "a", name="x"),
        change(11, "move_folder", "x/y/z", folder=""),
        change(12, "duplicate", "z/sub/m.md"),
        change(13, "rename_folder", "nowhere", name="q"),
        change(14, "rename_folder", "z", name="../q"),
        change(15, "delete", "z/n.md"),
        change(16, "create", name="n", folder="z"),
        change(17, "rename_folder", "x/y", name="yy"),
    ]
    check(spark, notes, ["empty"], log)


def test_fetching_folder_changes_in_parts(spark, monkeypatch):
    monkeypatch.setattr(changes_module, "FOLDER_OPS_PER_FETCH", 2)
    log = [
        change(1, "rename_folder", "a", name="b"),
        change(2, "rename_folder", "b", name="c"),
        change(3, "rename_folder", "c", name="a"),
        change(4, "update", "a/n.md", content="2", tags=[]),
        change(5, "rename_folder", "a", name="z"),
    ]
    check(spark, [("a/n.md", "1", [], 1)], [], log)


NAMES = ["x", "x (copy)", "x (copy 2)", "1970-01-01_000001_x", "y", None]


def random_log(rng, worlds, steps, start=0):
    log, seq = [], start
    for _ in range(steps):
        for world in worlds:
            seq += 1
            path = f"{world}/{rng.choice(NAMES[:-1])}.md"
            kind = rng.choice(["create", "create", "update", "update", "delete", "move", "duplicate", "duplicate", "save"])
            log.append(
                change(
                    seq,
                    kind,
                    None if kind == "create" else path,
                    name=rng.choice(NAMES) if kind in ("create", "save") or (kind == "update" and rng.random() < 0.4) else None,
                    folder=rng.choice([world, world, f"{world}/s"]) if kind in ("create", "move", "save") else None,
                    content=rng.choice([None, f"c{seq}"]),
                    tags=rng.choice([["t"], [], ["u", "v"]]),
                    ts=rng.choice([1000, 2000]),
                )
            )
    return log


@pytest.mark.parametrize("seed", [1, 2])
def test_random_note_changes(spark, seed):
    rng = random.Random(seed)
    worlds = [f"w{i}" for i in range(60)]
    notes = [(f"{w}/{n}.md", f"{w}{n}", ["a"], 1) for w in worlds for n in NAMES[:-1] if rng.random() < 0.5]
    check(spark, notes, [], random_log(rng, worlds, 6))


def test_random_folder_changes(spark):
    rng = random.Random(11)
    places = ["a", "b", "a/c", "b/d", "a/c/e", "f"]
    notes = [(f"{p}/x.md", p, [], 1) for p in places[:5]]
    log, seq = [], 0
    for _ in range(60):
        seq += 1
        kind = rng.choice(["create_folder", "rename_folder", "move_folder", "delete_folder", "rename_folder", "move_folder"])
        if kind == "delete_folder" and rng.random() < 0.7:
            kind = "create_folder"
        log.append(
            change(seq, kind, rng.choice(places), name=rng.choice(["a", "b", "c", "g"]), folder=rng.choice(places + [""]))
        )
        if rng.random() < 0.05:
            seq += 1
            log.append(change(seq, "create", name="x", folder=rng.choice(places), content=f"n{seq}"))
    check(spark, notes, ["a/empty"], log)


def test_ordinals_in_a_hot_group(spark):
    rows = spark.range(0, 3000).select(
        F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("k"),
        (F.col("id") * 7 % 3001).alias("seq"),
    )
    got = ordinal_within(rows, ["k"], "seq", "n", block=64).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.k, []).append((r.seq, r.n))
    for members in groups.values():
        assert [n for _, n in sorted(members)] == list(range(1, len(members) + 1))


def test_free_numbers(spark):
    rng = random.Random(9)
    used = {k: set(rng.sample(range(1, 400), rng.randint(0, 200))) for k in "abcdef"}
    asked = {"a": 250, "b": 1, "c": 30, "d": 5, "f": 100, "new": 3}
    requests = spark.createDataFrame([(k, i + 1) for k, n in asked.items() for i in range(n)], "k string, ordinal bigint")
    taken = spark.createDataFrame([(k, n) for k, ns in used.items() for n in ns] + [("a", 10**12)], "k string, n bigint")
    got = {(r.k, r.ordinal): r.n for r in free_numbers(requests, taken, ["k"], block=16).collect()}
    for k, n in asked.items():
        free = [i for i in range(1, 1000) if i not in used.get(k, ())]
        assert [got[k, i + 1] for i in range(n)] == free[:n]


def test_folder_changes_alone_shuffle_no_notes(spark):
    log = [change(1, "rename_folder", "a", name="b"), change(2, "delete_folder", "c")]
    notes, _, _ = run(spark, [("a/n.md", "1", [], 1)], [], log)
    plan = notes._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_hot_note_and_hot_name(spark):
    """A third of a log on one note or one name stays few rounds, and comes out exact."""
    log = []
    for seq in range(1, 241):
        if seq % 3 == 0:
            log.append(change(seq, "duplicate", "hot.md", ts=1000))
        elif seq % 3 == 1:
            log.append(change(seq, "create", name="same", content=str(seq), ts=1000))
        else:
            log.append(change(seq, "update", "warm.md", content=str(seq), tags=["t"]))
    notes = [("hot.md", "h", ["x"], 1), ("warm.md", "w", [], 1), ("hot (copy 7).md", "c", [], 1)]
    model = check(spark, notes, [], log)
    assert "hot (copy 81).md" in model.notes and "1970-01-01_000001-79_same.md" in model.notes


def test_a_repeated_seq_is_refused(spark):
    log = [change(1, "create", name="a"), change(1, "create", name="b")]
    with pytest.raises(ValueError, match="different values of seq"):
        check(spark, [], [], log)


def test_an_outlier_makes_no_block_wide(spark):
    rows = spark.range(0, 30_000).select(F.lit("hot").alias("k"), F.col("id").alias("seq"))
    rows = rows.unionByName(spark.createDataFrame([("hot", 10**15)], "k string, seq bigint"))
    blocks = order_blocks(rows, "seq")
    sizes = rows.groupBy(_block_of(F.col("seq"), blocks)).count()
    assert sizes.agg(F.max("count")).first()[0] <= BLOCK
    got = ordinal_within(rows, ["k"], "seq", "n", blocks)
    assert got.filter("n <> least(seq, 30000) + 1").isEmpty()


def chain(note, steps, start=0):
    """A note that is renamed, written and moved along, over paths of its own."""
    log, path = [], f"{note}.md"
    for i in range(steps):
        seq = start + 2 * i
        if i % 3 == 2:
            log.append(change(seq, "move", path, folder=f"{note}/{i}"))
            path = f"{note}/{i}/" + path.rpartition("/")[2]
        else:
            log.append(change(seq, "update", path, name=f"{note}_{i}", content=f"c{seq}" if i % 2 else None, tags=[f"t{i}"]))
            path = (path.rpartition("/")[0] + "/" if "/" in path else "") + f"{note}_{i}.md"
        log.append(change(seq + 1, "update", path, content=None if i % 4 else f"w{seq}", tags=[f"u{i}"]))
    return log


def jobs(spark, name, work):
    """How many Spark jobs some work takes."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_long_chains_take_few_rounds(spark):
    notes = [("n.md", "body", ["a"], 1)]
    counts, rows = [], []
    for steps in (4, 64):
        model = Model(notes)
        model.apply(chain("n", steps))
        counts.append(jobs(spark, f"chain{steps}", lambda steps=steps: rows.extend(run(spark, notes, [], chain("n", steps))[0].collect())))
        row = rows.pop()
        assert not rows and model.notes == {row.path: (row.content, list(row.tags), row.mod_time)}
    # 16 times as long: four more doublings, each a write, a check and their stages.
    assert counts[1] <= counts[0] + 4 * 6


def test_chains_end_where_they_are_not_clear(spark):
    """Chains of many kinds side by side: deleted at the end, blocked, missing, met by others, turning back."""
    notes = [(f"{n}.md", n, [], 1) for n in "abcdfg"] + [("b/2/taken.md", "t", [], 1), ("e_1.md", "e", [], 1)]
    log = chain("a", 7) + [change(90, "delete", chain("a", 7)[-1]["path"])]
    log += chain("b", 5, 100) + [change(190, "update", chain("b", 5)[-1]["path"], name="taken", tags=[])]
    log += [change(191, "update", "b/2/b_4.md", name="free", content="after", tags=["z"])]
    log += chain("missing", 4, 200)
    log += chain("c", 4, 300) + [change(400, "move", "d.md", folder="c/2"), change(401, "update", "c/2/d.md", name="c_3", tags=["clash"])]
    log += chain("f", 4, 500) + [change(520, "create", name="f_1"), change(521, "duplicate", "f_0.md")]
    log += [change(600 + i, "update", f"g{'_x' if i % 2 else ''}.md", name="g" if i % 2 else "g_x", content=f"v{i}", tags=[]) for i in range(6)]
    log += [change(700, "update", "e.md", name="e_1", tags=[]), change(701, "update", "e_1.md", name="e", tags=[]), change(702, "update", "e.md", name="e_2", tags=[])]
    model = check(spark, notes, [], log)
    assert "b/2/free.md" in model.notes and model.rejects[190] == "exists"


@pytest.mark.parametrize("seed", [5])
def test_random_chains(spark, seed):
    rng = random.Random(seed)
    log, seq, notes = [], 0, []
    for w in range(80):
        notes += [(f"w{w}/{n}.md", n, [], 1) for n in "pq" if rng.random() < 0.6]
        for _ in range(rng.randint(1, 9)):
            seq += 1
            path = f"w{w}/{rng.choice('pqrstu')}.md"
            kind = rng.choice(["update", "update", "update", "move", "delete", "save"])
            log.append(change(seq, kind, path, name=rng.choice([*"pqrstuvw", None]) if kind in ("update", "save") else None,
                              folder=rng.choice([f"w{w}", f"w{w}/s"]) if kind in ("move", "save") else None,
                              content=rng.choice([None, f"c{seq}"]), tags=[f"t{seq}"]))
    check(spark, notes, [], log)
