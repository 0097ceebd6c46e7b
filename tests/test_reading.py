"""Listing, search and tree cases, and search against brute force."""

from __future__ import annotations

import random

from marginalia.operators import (
    all_folders,
    batch_search,
    enrich,
    folder_children,
    folder_nodes,
    folder_preorder,
    folder_tree,
    get_note,
    list_notes,
    named_notes,
    note_meta,
    search_notes,
    subtree,
)
from marginalia.operators import search
from marginalia.schema import QUERIES, notes_from_parts

PARTS = "path string, content string, tags array<string>, mod_time bigint"


def notes(spark, *rows):
    return notes_from_parts(spark.createDataFrame(list(rows), PARTS))


def paths(df):
    return [r.path for r in df.collect()]


def test_listing_is_scoped_and_sorted(spark):
    table = notes(
        spark,
        ("root.md", "r", [], 5),
        ("docs/b.md", "1", [], 1000),
        ("docs/a.md", "2", None, 2000),
        ("docs/c.md", "", [], 1000),
        ("docs/in/d.md", None, [], 3000),
        ("docs2/e.md", "x", [], 1),
    )
    assert paths(list_notes(table, "")) == ["root.md"]
    assert paths(list_notes(table, "docs")) == ["docs/a.md", "docs/b.md", "docs/c.md"]
    assert paths(list_notes(table, "/docs/./")) == ["docs/a.md", "docs/b.md", "docs/c.md"]
    assert paths(list_notes(table, "docs", "modified-asc")) == ["docs/b.md", "docs/c.md", "docs/a.md"]
    assert paths(list_notes(table, "../docs")) == []
    assert paths(list_notes(table, "none")) == []
    assert paths(subtree(table, "docs")) == ["docs/in/d.md", "docs/a.md", "docs/b.md", "docs/c.md"]
    meta = {r.path: r for r in note_meta(table).collect()}
    assert meta["docs/c.md"].preview == "" and meta["docs/a.md"].tags == []
    assert "content" not in note_meta(table).columns
    assert get_note(table, "docs/a.md").first().content == "2"
    assert get_note(table, "nope.md").isEmpty()


def test_enrich_and_named(spark):
    table = notes(spark, ("2025-01-15_123456.md", "# T\n*x*", [], 1), ("real.md", "[a](b)", [], 2))
    rows = {r.name: (r.has_custom_name, r.plain_preview) for r in enrich(note_meta(table)).collect()}
    assert rows == {"2025-01-15_123456": (False, "T\nx"), "real": (True, "a")}
    assert paths(named_notes(table)) == ["real.md"]


def test_search(spark):
    table = notes(
        spark,
        ("ledger.md", "Paid 40% of invoice_7", ["Accounts"], 10),
        ("route.md", "bridge, then harbour", ["Trips", "draft"], 20),
        ("label.md", "", ["paid"], 30),
    )
    assert paths(search_notes(table, "pAID")) == ["ledger.md"]
    assert paths(search_notes(table, "", "trips")) == ["route.md"]
    assert paths(search_notes(table, "harbour", "accounts")) == []
    assert paths(search_notes(table, "harbour", "DRAFT")) == ["route.md"]
    assert paths(search_notes(table)) == ["label.md", "route.md", "ledger.md"]
    assert paths(search_notes(table, limit=2)) == ["label.md", "route.md"]
    assert paths(search_notes(table, "0%")) == ["ledger.md"]
    assert paths(search_notes(table, "_")) == ["ledger.md"]
    assert paths(search_notes(table, " paid")) == []


def test_batch_search_is_brute_force(spark):
    rng = random.Random(4)
    words = ["red", "blue", "Green", "a", "of", "sun", "é", "x%y"]
    rows = [
        (f"n{i}.md", " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.sample(["T", "u", "v"], rng.randint(0, 3)), i)
        for i in range(120)
    ]
    queries = [
        (q, " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))[rng.randint(0, 2) :], rng.choice(["", "t", "U", "none"]))
        for q in range(60)
    ] + [(60, None, None), (61, " ", ""), (62, "  red", ""), (63, "re", ""), (64, "un a", ""), (65, "e", ""), (66, "d b", "T"), (67, "e ", ""), (68, " g", ""), (69, "nowhere", "")]
    want = sorted(
        (q, path)
        for q, text, tag in queries
        for path, content, tags, _ in rows
        if (text or "").lower() in content.lower()
        and (not tag or tag.lower() in [t.lower() for t in tags])
    )
    table = notes(spark, *rows)
    asked = spark.createDataFrame(queries, QUERIES)
    got = batch_search(table, asked).collect()
    assert sorted((r.query_id, r.path) for r in got) == want
    assert [r.query_id for r in got] == sorted(r.query_id for r in got)
    assert batch_search(table, asked.filter("false")).isEmpty()


def test_few_queries_are_scanned_without_words(spark, monkeypatch):
    """Few queries part no body into words; more than a scan takes find the same by their words."""
    rng = random.Random(6)
    words = ["red", "blue", "Green", "a", "of", "sun", "É", "x%y"]
    rows = [(f"n{i}.md", " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))), ["T"] * (i % 2), i) for i in range(60)]
    rows.append((None, "red", ["T"], 1))
    asked = [(1, "RED", ""), (2, "ed b", ""), (3, "é", ""), (4, None, None), (5, " ", ""), (6, "sun", "t"), (7, "", "T"), (8, "x%y a", "")]
    want = sorted(
        (q, path, time)
        for q, text, tag in asked
        for path, content, tags, time in rows
        if path and (text or "").lower() in content.lower() and (not tag or tag.lower() in [t.lower() for t in tags])
    )
    table, queries = notes(spark, *rows), spark.createDataFrame(asked, QUERIES)
    parted = []
    words_of = search._words
    monkeypatch.setattr(search, "_words", lambda notes: parted.append(1) or words_of(notes))

    def found():
        return sorted((r.query_id, r.path, r.mod_time) for r in batch_search(table, queries).collect())

    assert found() == want and not parted
    again = queries.unionByName(queries.filter("query_id = 8"))
    assert sorted({(r.query_id, r.path) for r in batch_search(table, again).collect()}) == sorted({row[:2] for row in want}) and parted
    monkeypatch.setattr(search, "SCANNED", 2)
    assert {row[:2] for row in found()} == {row[:2] for row in want}


def test_few_queries_cut_no_text_without_spaces(spark, monkeypatch):
    """A long text without spaces is tested as a whole and not cut into grams."""
    monkeypatch.delattr(search, "_holding")
    table = notes(spark, ("long.md", "abcdé" * 20_000 + "文Z", [], 1), ("short.md", "dÉa", [], 2))
    asked = spark.createDataFrame([(1, "éa", ""), (2, "文z", ""), (3, "aa", "")], QUERIES)
    assert [(r.query_id, r.path) for r in batch_search(table, asked).collect()] == [(1, "short.md"), (1, "long.md"), (2, "long.md")]


def test_queries_with_a_tag_write_no_candidates(spark, monkeypatch):
    """Neither the tables nor the exchanges hold a row for each note and query of its tag."""
    table = notes(spark, *[(f"n{i}.md", f"body {i}", ["T", "u"], i) for i in range(200)])
    asked = [(q, f"Y {q + 7}", "t") for q in range(60)] + [(60, "", "none"), (61, " ", ""), (62, "y 19", "U"), (63, "Y 19", "")]
    want = sorted((q, f"n{i}.md") for q, text, tag in asked for i in range(200) if text.lower() in f"body {i}" and tag != "none")
    rows = []
    save = search.Scratch.save

    def counted(scratch, df):
        saved = save(scratch, df)
        rows.append(saved.count())
        return saved

    def exchanged(plan):
        """The rows written by the exchanges of a plan that has run."""
        while (kind := plan.getClass().getSimpleName()).endswith(("AdaptiveSparkPlanExec", "QueryStageExec")):
            plan = plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan()
        written = plan.metrics().get("shuffleRecordsWritten")
        below = [exchanged(plan.children().apply(i)) for i in range(plan.children().size())]
        return max([written.get().value() if written.isDefined() else 0, *below])

    monkeypatch.setattr(search.Scratch, "save", counted)
    found = batch_search(table, spark.createDataFrame(asked, QUERIES))
    got = found.collect()
    assert sorted((r.query_id, r.path) for r in got) == want
    assert max(rows) <= search.LANES * len(asked) and 200 <= exchanged(found._jdf.queryExecution().executedPlan()) <= 5 * 200


def test_notes_of_one_path_are_found_for_each_of_them(spark):
    """A tag is one of the path, whichever of its notes has it; a query of words finds each note for itself."""
    table = notes(spark, ("a.md", "red", ["t"], 1), ("a.md", "red sun", ["T", "u"], 2), ("a.md", "blue", [], 3), ("b.md", "red", ["u"], 4))
    asked = spark.createDataFrame([(1, "red", "t"), (2, "red", "U"), (3, "red", ""), (4, "", "t"), (5, " ", "")], QUERIES)
    found = sorted((r.query_id, r.path, r.mod_time) for r in batch_search(table, asked).collect())
    a, b = [("a.md", 1), ("a.md", 2)], ("b.md", 4)
    want = [(1, *at) for at in a * 2] + [(2, *at) for at in [*a, b]] + [(3, *at) for at in [*a, b]]
    want += [(4, *at) for at in [*a, ("a.md", 3)] * 2] + [(5, "a.md", 2)] * 3
    assert found == sorted(want)


def test_batch_search_by_words_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "SCANNED", 0)
    test_batch_search_is_brute_force(spark)
    test_batch_search_in_text_without_spaces(spark)


def test_batch_search_in_text_without_spaces(spark):
    """One long word costs its length: its grams are cut in stretches, and a piece across two of them is found."""
    rng = random.Random(8)
    body = "".join(rng.choice("abcdefgh é文".replace(" ", "")) for _ in range(200_000))
    across = body[(1 << 14) - 3 : (1 << 14) + 4]
    table = notes(spark, ("long.md", body, [], 1), ("short.md", "a " + body[70_000:70_012], [], 2), ("none.md", "", [], 3))
    asked = [(1, across, ""), (2, body[70_002:70_011], ""), (3, body[-4:], ""), (4, "zz", ""), (5, body[-1], ""), (6, "文é", "")]
    bodies = {"long.md": body, "short.md": "a " + body[70_000:70_012], "none.md": ""}
    want = sorted((q, path) for q, text, _ in asked for path, content in bodies.items() if text in content)
    got = batch_search(table, spark.createDataFrame(asked, QUERIES)).collect()
    assert sorted((r.query_id, r.path) for r in got) == want


def test_folder_tree(spark):
    table = notes(
        spark,
        ("rootnote.md", "r", [], 1),
        ("a/b/deep.md", "d", [], 2),
        ("a/b/newer.md", "d", [], 3),
        ("a b/other.md", "o", [], 2),
        ("z/2025-01-15_123456.md", "t", [], 2),
    )
    explicit = spark.createDataFrame([("empty",), ("x/y/z",), ("a",)], "path string")
    folders = all_folders(table, explicit)
    order = [(r.path, r.depth) for r in folder_preorder(folders).collect()]
    assert order == [("a", 0), ("a/b", 1), ("a b", 0), ("empty", 0), ("x", 0), ("x/y", 1), ("x/y/z", 2), ("z", 0)]
    rows = [(r.folder, r.note_path) for r in folder_tree(table, explicit).collect()]
    assert rows == [
        ("a", None),
        ("a/b", "a/b/newer.md"),
        ("a/b", "a/b/deep.md"),
        ("a b", "a b/other.md"),
        ("empty", None),
        ("x", None),
        ("x/y", None),
        ("x/y/z", None),
        ("z", "z/2025-01-15_123456.md"),
    ]
    named = [(r.folder, r.note_path) for r in folder_tree(table, explicit, named_only=True).collect()]
    assert ("z", None) in named and len(named) == len(rows)
    nodes = {r.path: (r.n_children, r.n_notes) for r in folder_nodes(table, explicit).collect()}
    assert nodes["a"] == (1, 0) and nodes["a/b"] == (0, 2) and nodes["x"] == (1, 0)
    children = [(r.parent, r.name) for r in folder_children(table).collect()]
    assert children == [("", "a"), ("", "a b"), ("", "z"), ("a", "b")]


def test_plans_keep_scans_narrow(spark, tmp_path):
    """Filters reach the files, bodies are not read without need, and nothing is joined."""
    store = str(tmp_path / "notes")
    notes(spark, ("a/b.md", "body", ["t"], 1), ("c.md", "x", [], 2)).write.parquet(store)
    table = spark.read.parquet(store)

    def plan(df):
        return df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        )

    listing = plan(list_notes(table, "/a/./"))
    assert "EqualTo(folder,a)" in listing and "content" not in listing
    tagged = plan(search_notes(table, tag="t"))
    assert "content" not in tagged and "Join" not in tagged
    assert "content" not in plan(folder_tree(table)) 
    queries = spark.createDataFrame([(1, "b", ""), (2, "x y z", "t")], QUERIES)
    batch = plan(batch_search(table, queries))
    assert "Cartesian" not in batch and "NestedLoop" not in batch and "Python" not in batch
    assert "TakeOrderedAndProject" in plan(search_notes(table, "b", limit=1))
