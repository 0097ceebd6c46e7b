import math
import re
from collections import defaultdict

import pytest
from cases import none, odd_docs, prose

from marginalia.llm import mixing
from marginalia.llm.mixing import mix_sources, repeated


def shares(sizes, weights=(3, 1, 2), total=1.5, most=2.0):
    """Targets by resharing what is above, again and again."""
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target = dict.fromkeys(sources, 0.0)
    left, free = total * sum(sizes.values()), set(sources)
    while left > 1e-9 and free:
        each = left / sum(weight[s] for s in free)
        left = 0.0
        for s in sorted(free, key=repr):
            target[s] += each * weight[s]
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                free = free - {s}
    return target


def check(rows):
    sizes, taken = defaultdict(int), defaultdict(int)
    largest = defaultdict(int)
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 2
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    want = shares(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6)
    return {s: abs(taken[s] - want[s]) / max(1, largest[s]) for s in sizes}


@pytest.mark.parametrize("few", [4096, 1])
def test_targets_are_met(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW", few)
    sources = ["a", "b", "c", "d", None]
    rows = [(i, prose(i, 3 + i % 40), "a" if i % 3 else sources[i % 5]) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mix_sources(docs).collect()
    assert len(found) == 500
    assert max(check(found).values()) <= 0.5 + 1e-9
    assert sorted(map(tuple, mix_sources(docs.repartition(7)).collect())) == sorted(map(tuple, found))


def test_nested(spark):
    rows = [(i, prose(i, 3 + i % 40), "a" if i % 2 else "b") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    less, more = ({r.doc_id: r.copies for r in mix_sources(docs, total=t).collect()} for t in (0.6, 0.9))
    assert all(less[i] <= more[i] for i in less) and sum(less.values()) < sum(more.values())


def test_odd_rows(spark):
    found = mix_sources(odd_docs(spark)).collect()
    assert len(found) == 18
    check(found)
    assert repeated(mix_sources(odd_docs(spark))).count() == sum(r.copies for r in found)
    assert mix_sources(none(spark)).collect() == []
    silent = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in mix_sources(silent).collect()] == [(0, 0.0)] * 2
