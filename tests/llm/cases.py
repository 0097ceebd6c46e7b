"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["size", "shard", "slot", "score", "key", "n", "at", "rows", "hash", "copies", "target", "component", "piece"]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]
    return "".join(w + ("\n" if i % 9 == 8 else " ") for i, w in enumerate(words)).strip()


def odd_rows() -> list[tuple]:
    same = prose(1, 60)
    rows = [
        (1, same, "en", "a"),
        (2, same, "en", "a"),
        (2, same, "en", "a"),  # the row again
        (3, None, None, None),
        (4, "", "fr", "b"),
        (5, " \n\t ", "fr", "b"),
        (6, "one two", "en", "a"),
        (7, "ONE two", "en", "a"),
        (8, prose(2, 20_000), "de", "a"),
        (9, "ümläut ñandú É 中文 \U0001f600 x", "es", None),
        (10, same.upper(), "en", "a"),
        (11, same + " more", "en", "c"),
        (12, "line\nline\nline\nline\nline\nline", "en", "c"),
        (None, "nobody's text is here now and again", None, "a"),
        (None, "nobody's text is here now and again", None, "a"),
        (None, None, "en", "a"),
        (14, prose(3, 40), "en", ""),
        (14, prose(4, 40), "en", ""),  # another text under the same id
    ]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


def odd_docs(spark, clashing: bool = True):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    if clashing:
        for name in CLASHING:
            docs = docs.withColumn(name, docs.lang)
    return docs


def none(spark):
    return spark.createDataFrame([], SCHEMA)
