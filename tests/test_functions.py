"""Expressions against hand-made cases and small Python models."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from marginalia.functions import (
    add_tag,
    ancestors,
    basename,
    build_front_matter,
    dirname,
    is_timestamp_name,
    is_under,
    normalize_path,
    note_name,
    parse_front_matter,
    preview,
    rewrite_prefix,
    sanitize_name,
    strip_markdown,
    timestamp_name,
    truncate,
)
from marginalia.functions.names import copy_parts, family, stamped_name, stamped_parts
from marginalia.functions.paths import normal_constant


def apply(spark, values, fn, dtype="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_front_matter_cases(spark):
    cases = {
        "---\ntags: [north, east]\n---\nWind 4": (["north", "east"], "Wind 4"),
        "No header here.\n---\n": ([], "No header here.\n---\n"),
        "---\n---\nempty": ([], "empty"),
        "---\r\ntags: [\"a\", 'b']\r\n---\r\nbody": (["a", "b"], "body"),
        "---\ntags: a, b\ntags: c\n---": (["a", "b"], ""),
        "---\ntags: [a]\nno fence": ([], "---\ntags: [a]\nno fence"),
        "---\nx\n----\nbody\n---\nrest": ([], "rest"),
        "---\ntitle: q\n---\n---\nrule": ([], "---\nrule"),
        "": ([], ""),
        "---": ([], "---"),
    }
    got = apply(spark, list(cases), parse_front_matter)
    assert [(g.tags, g.body) for g in got] == list(cases.values())


def test_front_matter_put_together(spark):
    """Headers built from known parts give those parts back."""
    rng = random.Random(7)
    bodies = ["", "text", "---\nrule", "a\n\nb\n", "tags: [no]\n---\n", "\r\n"]
    others = ["title: x", "", "tagsx: [q]", " ---", "----", "- - -", "date: 1\t"]
    cases = []
    for _ in range(600):
        end = rng.choice(["\n", "\r\n"])
        tags = ["".join(rng.choice("ab\u00e9 -#") for _ in range(4)).strip(" ") or "t" for _ in range(rng.randint(0, 4))]
        quote = rng.choice(["", '"', "'"])
        listed = rng.choice([",", ", ", " , "]).join(f"{quote}{t}{quote}" for t in tags)
        line = f"tags:{rng.choice(['', ' ', '  '])}" + rng.choice([f"[{listed}]", listed])
        before, after = ([rng.choice(others) for _ in range(rng.randint(0, 3))] for _ in range(2))
        header = [*before, line, *after, *rng.choice([[], ["tags: [late]"]])]
        body = rng.choice(bodies)
        cases.append((end.join(["---", *header, "---"]) + end + body, (tags, body)))
        unclosed = end.join(["---", *(x for x in header if x != "---")]) + end
        cases.append((unclosed, ([], unclosed)))
        cases.append(("x" + unclosed, ([], "x" + unclosed)))
    got = apply(spark, [raw for raw, _ in cases], parse_front_matter)
    for (raw, want), g in zip(cases, got):
        assert (g.tags, g.body) == want, repr(raw)


def test_front_matter_build(spark):
    tags = [["a", "b"], [], ['q"t', "back\\slash"], ["tab\there", "nb sp", "\x01", "é😀"]]
    got = apply(spark, tags, build_front_matter, "array<string>")
    assert got == [
        '---\ntags: ["a", "b"]\n---\n',
        "",
        '---\ntags: ["q\\"t", "back\\\\slash"]\n---\n',
        '---\ntags: ["tab\\there", "nb\\u00a0sp", "\\x01", "é😀"]\n---\n',
    ]


def test_front_matter_round_trip(spark):
    rng = random.Random(3)
    tags = [
        ["".join(rng.choice("abc é-#/") for _ in range(5)).strip() or "t" for _ in range(rng.randint(1, 4))]
        for _ in range(200)
    ]
    got = apply(
        spark,
        tags,
        lambda t: parse_front_matter(F.concat(build_front_matter(t), F.lit("body"))),
        "array<string>",
    )
    assert [(g.tags, g.body) for g in got] == [(t, "body") for t in tags]


def test_strip_markdown(spark):
    cases = {
        "# Title\ntext": "Title\ntext",
        "see <https://a.b/c_d_e>": "see https://a.b/c_d_e",
        "<b>bold</b> x": "bold x",
        "a\n```py\ncode\n```\nb": "a\nb",
        "![alt](u.png)[text](http://x)": "text",
        "- [ ] todo\n- [x] done": "todo\ndone",
        "__strong__ and _em_ but foo_bar_baz": "strong and em but foo_bar_baz",
        "_a_ _b_ _c_": "a b c",
        "**b** ~~s~~ `c`": "b s c",
        "> quote\n- item\n1. one": "quote\nitem\none",
        "a\n-----\nb": "a\nb",
        "a\n\n\nb  \t c": "a\nb c",
        "#no heading": "#no heading",
        " - item": "item",
        "": "",
    }
    assert apply(spark, list(cases), strip_markdown) == list(cases.values())
    assert apply(spark, [None], strip_markdown) == [""]


def test_names(spark):
    cases = {
        "hello": "hello",
        "../../evil": "evil",
        "a\\b\\c": "c",
        'x:*?"<>|y': "x_______y",
        " .trim. ": "trim",
        "con": "_con",
        "LPT1.txt": "_LPT1.txt",
        "a/b/": "b",
        "": "",
        "///": "_",
        ".": "",
        "..": "",
        "tab\there": "tab_here",
        "é" * 250: "é" * 200,
        "com10": "com10",
    }
    assert apply(spark, list(cases), sanitize_name) == list(cases.values())
    stamps = ["2025-01-15_123456", "2025-01-15_123456x", "2025-1-15_123456", "note"]
    assert apply(spark, stamps, is_timestamp_name) == [True, True, False, False]
    assert apply(spark, [0, 1736944496789], timestamp_name, "bigint") == [
        "1970-01-01_000000",
        "2025-01-15_123456",
    ]


def test_timestamp_name_ignores_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # 2024-03-10 02:30 does not exist on New York clocks.
        assert apply(spark, [1710037800000], timestamp_name, "bigint") == ["2024-03-10_023000"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_families(spark):
    same = [
        "f/x.md",
        "f/x (copy).md",
        "f/x (copy 12).md",
        "f/2024-01-01_000000_x.md",
        "f/2024-01-01_000000-3_x (copy) (copy 2).md",
        "f/2024-01-01_000000_2024-01-01_000000_x.md",
    ]
    assert set(apply(spark, same, family)) == {"f/x"}
    parts = apply(spark, ["x (copy)", "x (copy 3)", "x (copy 1)", "x (copy 03)", "x"], copy_parts)
    assert [(p.base, p.n) for p in parts][:2] == [("x", 1), ("x", 3)]
    assert [p.n for p in parts][2:] == [None, None, None]
    stamped = apply(
        spark,
        ["x"],
        lambda v: stamped_parts(stamped_name(v, F.lit("2024-01-01_000000"), F.lit(4))),
    )[0]
    assert (stamped.stamp, stamped.base, stamped.n) == ("2024-01-01_000000", "x", 4)


def test_paths(spark):
    paths = ["a/b/c.md", "c.md", "a/x.MD", ".md", "a/.md.md"]
    assert apply(spark, paths, dirname) == ["a/b", "", "a", "", "a"]
    assert apply(spark, paths, basename) == ["c.md", "c.md", "x.MD", ".md", ".md.md"]
    assert apply(spark, paths, note_name) == ["c", "c", "x.MD", "", ".md"]
    assert apply(spark, ["", "a", "a/b/c"], ancestors) == [[], ["a"], ["a", "a/b", "a/b/c"]]
    under = apply(spark, ["a_b", "a_b/c", "axb/c", "a_bc"], lambda p: is_under(p, F.lit("a_b")))
    assert under == [True, True, False, False]


def test_normalize_path(spark):
    def model(path):
        parts = []
        for part in path.split("/"):
            if part in ("", "."):
                continue
            if part == "..":
                if not parts:
                    return None
                parts.pop()
            else:
                parts.append(part)
        return "/".join(parts)

    rng = random.Random(5)
    paths = ["/".join(rng.choice(["", ".", "..", "a", "..foo", "b c"]) for _ in range(rng.randint(1, 6))) for _ in range(400)]
    assert apply(spark, paths, normalize_path) == [model(p) for p in paths]
    assert [normal_constant(p) for p in paths] == [model(p) for p in paths]


def test_rewrite_prefix(spark):
    ops = [("a", "z"), ("z/sub", "q"), ("gone", None)]
    paths = ["a/n.md", "a/sub/m.md", "ab/n.md", "gone/x.md", "a"]
    assert apply(spark, paths, lambda p: rewrite_prefix(p, ops)) == ["z/n.md", "q/m.md", "ab/n.md", None, "z"]
    assert apply(spark, paths, lambda p: rewrite_prefix(p, [])) == paths
    back = apply(spark, paths[:3], lambda p: rewrite_prefix(p, [("a", "b"), ("b", "a")]))
    assert back == paths[:3]


def test_text(spark):
    long = "é" * 1001
    assert apply(spark, ["  x 　", long, "", "y" * 1000], preview) == ["x", "é" * 1000 + "...", "", "y" * 1000]
    assert [tuple(r) for r in apply(spark, ["abc", "ab"], lambda s: truncate(s, 2))] == [("ab", True), ("ab", False)]
    assert [tuple(r) for r in apply(spark, ["abc"], lambda s: truncate(s, 0))] == [("", False)]
    tagged = apply(spark, [["a"], ["b"], []], lambda t: add_tag(t, F.lit(" a ")), "array<string>")
    assert tagged == [["a"], ["b", "a"], ["a"]]
    assert apply(spark, [["a"]], lambda t: add_tag(t, F.lit("  ")), "array<string>") == [["a"]]
