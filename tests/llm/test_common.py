import re

import numpy as np
import pyarrow as pa
from cases import odd_rows

from marginalia.llm import common
from marginalia.llm.common import scratch, shingle_hashes, strings, text_words
from marginalia.llm.graph import components


def test_words_by_hash(monkeypatch):
    texts = [r[1] for r in odd_rows()] + ["x" * 70 + " y", "x" * 70, "ab", "a b"]
    for chunk in (1 << 20, 16):
        monkeypatch.setattr(common, "CHUNK", chunk)
        with np.errstate(over="ignore"):
            found = list(text_words(*strings(pa.array(texts))))
            seen = {}
            for text, hashes in zip(texts, found, strict=True):
                words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
                assert len(words) == len(hashes)
                for w, h in zip(words, hashes, strict=True):
                    assert seen.setdefault(w, h) == h
            assert len(set(map(int, seen.values()))) == len(seen)
            assert [len(shingle_hashes(np.arange(n, dtype=np.uint64))) for n in (0, 1, 4, 5, 7)] == [0, 1, 1, 1, 3]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 200)]
    found = components(spark.createDataFrame(edges, "a long, b long"), scratch(spark, "graph"))
    got = {r.node: r.root for r in found.collect()}
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 95: 90, 100: 90, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long"), scratch(spark, "graph")).collect() == []
