import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import none, odd_docs, prose
from tokenizers import Tokenizer

from marginalia.llm.packing import best_fit, bin_completion, fillings, lower_bound, pack_documents
from marginalia.llm.queries import word_tokenizer


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in sorted({b for b in bins if b >= items[i]}):
            rest = list(bins)
            rest.remove(room)
            go(i + 1, [*rest, room - items[i]])
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0]


def test_as_few_as_can_be():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.choice([10, 30, 100])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 10))]
        counts = dict(Counter(items))
        packing = bin_completion(counts, capacity)
        assert sum((Counter({x: n * f.count(x) for x in set(f)}) for f, n in packing.items()), Counter()) == Counter(items)
        assert all(sum(f) <= capacity for f in packing)
        assert lower_bound(counts, capacity) <= fewest(items, capacity) == packing.total()


def test_search_betters_best_fit():
    counts = {44: 1, 24: 2, 23: 1, 22: 2, 21: 2, 17: 3, 8: 1, 6: 2}  # best fit takes one sequence more
    improved = [c for c in (counts, {6: 2, 5: 2, 4: 2, 3: 2, 2: 2}) if bin_completion(c, 61).total() <= best_fit(c, 61)[0].total()]
    assert len(improved) == 2


def pieces_of(texts, capacity):
    tokenizer = Tokenizer.from_file(word_tokenizer())
    tokenizer.encode_special_tokens = True
    out = Counter()
    for doc, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            out[(doc, piece, start, len(part), zlib.crc32(part.tobytes()))] += 1
    return out


def check(rows, capacity):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(sequences) == list(range(len(sequences)))
    assert len(sequences) == bin_completion(dict(Counter(r.length for r in rows)), capacity).total()


@pytest.mark.parametrize("capacity", [64, 4096])
def test_pieces_and_places(spark, capacity):
    texts = [(i, prose(i % 70, 1 + 7 * (i % 40)) + ", Don't stop. \x01 <|endoftext|> x,y.") for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = pack_documents(docs.repartition(3), word_tokenizer(), capacity).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == pieces_of(texts, capacity)
    check(rows, capacity)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = pack_documents(docs, word_tokenizer(), 4096, keep_ids=True).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == pieces_of([(r.doc_id, r.text) for r in docs.collect()], 4096)
    assert all(zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 for r in rows)
    check(rows, 4096)
    assert pack_documents(none(spark), word_tokenizer()).collect() == []


def test_every_undominated_filling_comes():
    """Whatever can be filled in is no better than some filling that comes, piece by piece or in parts."""
    rng = random.Random(8)
    for _ in range(60):
        room = rng.randint(5, 40)
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        found = [f for f in fillings(dict(Counter(items)), room) if f is not None]
        assert len(set(found)) == len(found) and all(sum(f) <= room and not Counter(f) - Counter(items) for f in found)

        def fits(part, into):
            return not part or any(x >= part[0] and fits(part[1:], into[:i] + (x - part[0],) + into[i + 1 :]) for i, x in enumerate(into))

        for mask in range(1 << len(items)):
            part = tuple(sorted((x for i, x in enumerate(items) if mask >> i & 1), reverse=True))
            if sum(part) <= room:
                assert any(fits(part, f) for f in found)


def test_search_over_many_lengths():
    """Ever so often only fillings beyond the first few, or fewer repeats, meet the optimum."""
    rng = random.Random(3)
    for _ in range(150):
        items = [rng.randint(11, 50) for _ in range(rng.randint(6, 10))] * rng.randint(1, 2)
        items = items[:11]
        assert bin_completion(dict(Counter(items)), 100).total() == fewest(items, 100)
