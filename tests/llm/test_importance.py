import hashlib
import math
import re
import zlib

import pytest
from cases import SCHEMA, none, odd_docs, prose
from pyspark.sql import functions as F

from marginalia.llm import byte_words
from marginalia.llm.importance import draw, features, find_head, fit_importance, resample, weigh_documents

BUCKETS = 50


def brute_runs(text, width):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return [" ".join(words[i : i + n]) for n in range(1, width + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, width, percent=10, least=20):
    """(doc_id, text) to n_features, weight, score; and the drawn (doc_id, text) in order."""
    bucket = lambda run: zlib.crc32(run.encode()) % BUCKETS
    totals = []
    for texts in ([t for _, t in docs], target):
        counts = [0] * BUCKETS
        for text in texts:
            for run in brute_runs(text, width):
                counts[bucket(run)] += 1
        totals.append(counts)
    own, theirs = totals
    gain = [
        math.floor(1000 * math.log((t + 1.0) * (sum(own) + BUCKETS) / ((s + 1.0) * (sum(theirs) + BUCKETS))))
        for s, t in zip(own, theirs, strict=True)
    ]
    out = []
    for doc_id, text in docs:
        runs = brute_runs(text, width)
        weight = sum(gain[bucket(r)] for r in runs)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc_id, text, len(runs), weight, score))
    enough = [r for r in out if len(brute_runs(r[1], 1)) >= least]
    enough.sort(key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    return out, enough[: len(enough) * percent // 100]


def figures(rows):
    return sorted(((r.doc_id, r.text, r.n_features, r.weight, r.score) for r in rows), key=repr)


@pytest.mark.parametrize("width", [1, 3])
@pytest.mark.parametrize("head", [2, 1000])
def test_matches_the_model(spark, width, head):
    docs = [(i, prose(i % 70, 5 + i % 60) + (" NUL\0x É中9 " if i % 7 == 0 else "")) for i in range(120)]
    target = [prose(i, 30) for i in range(5)] + [None, ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    weigher = fit_importance(df, spark.createDataFrame([(t,) for t in target], "text string"), width, BUCKETS, head)
    rows = draw(weigh_documents(df, weigher), 25, 20, width).collect()
    want, drawn = brute(docs, target, width, 25)
    assert figures(rows) == sorted(want, key=repr)
    ranked = sorted((r for r in rows if r.rank is not None), key=lambda r: r.rank)
    assert [r.rank for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r.doc_id, r.score) for r in ranked] == [(r[0], r[4]) for r in drawn]


def test_runs_across_pieces(monkeypatch):
    text = (prose(1, 300) + " " + "y" * 500 + " " + prose(2, 50)).encode()
    words, pairs = {}, {}
    from marginalia.llm.importance import Pairs, Words

    whole = sorted(int(x) for part in features(text, 3, Words(words), Pairs(pairs)) for x in part)
    monkeypatch.setattr(byte_words, "PIECE", 40)
    assert sorted(int(x) for part in features(text, 3, Words(words), Pairs(pairs)) for x in part) == whole
    assert whole == sorted(zlib.crc32(run.encode()) for run in brute_runs(text.decode(), 3))


def test_head_holds_what_is_frequent(spark):
    rows = [("the and " * 50 + " ".join(f"rare{i}x{j}" for j in range(40)) + " " + "z" * 100,) for i in range(60)]
    words, pairs = find_head(spark.createDataFrame(rows, "text string").repartition(4), 2, head=16)
    assert b"the" in words and b"and" in words and (b"the", b"and") in pairs
    assert len(words) <= 16 and len(pairs) <= 16 and max(map(len, words)) <= 64
    assert words[b"the"] == zlib.crc32(b"the") and pairs[(b"the", b"and")] == zlib.crc32(b"the and")


def test_odd_rows(spark):
    docs = odd_docs(spark).withColumn("Weight", F.col("lang"))
    target = spark.createDataFrame([("one two line",), (None,)], "text string")
    rows = weigh_documents(docs, fit_importance(docs, target, 1, BUCKETS)).collect()
    assert len(rows) == 18
    assert figures(rows) == sorted(brute([(r.doc_id, r.text) for r in docs.collect()], ["one two line", None], 1)[0], key=repr)
    drawn = resample(docs, target, percent=100).collect()
    assert sorted(r.rank for r in drawn) == list(range(1, len(drawn) + 1))
    assert all(len(brute_runs(r.text, 1)) >= 20 for r in drawn) and {r.doc_id for r in drawn} >= {1, 2, 8}
    assert resample(none(spark), target).collect() == []
    empty = spark.createDataFrame([], SCHEMA).select("text")
    assert len(resample(docs, empty, percent=100).collect()) == len(drawn)
