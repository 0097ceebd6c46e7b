import hashlib
import re
import statistics

from cases import none, odd_docs, prose

from pyspark.sql import functions as F

from marginalia.llm.fingerprints import _hot_ids, _range, fingerprint_documents


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_estimates_and_edits(spark):
    texts = [prose(i // 3, 40 + 37 * (i % 5)) for i in range(150)] + [prose(5, 900)]
    docs = spark.createDataFrame([(3 * i - 90, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = sorted(fingerprint_documents(docs.repartition(3)).collect(), key=lambda r: r.doc_id)
    errors = []
    for i, r in enumerate(rows):
        following, n = texts[(i + 1) % len(texts)], len(texts[i])
        edited = texts[i][: n - n // 2] + following[: n // 2]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [r.near_edited - jaccard(texts[i], edited), r.near_next - jaccard(texts[i], following)]
    assert abs(statistics.mean(errors)) < 0.01 and statistics.pstdev(errors) < 0.06
    assert all(len(r.fingerprint) == 128 for r in rows)


def test_odd_rows(spark):
    rows = fingerprint_documents(odd_docs(spark)).collect()
    assert len(rows) == 18
    prints = {}
    for r in rows:
        assert prints.setdefault(r.text or "", r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert prints[""] == ""
    assert {r.fingerprint for r in rows if r.doc_id in (1, 10)} == {prints[[r.text for r in rows if r.doc_id == 1][0]]}
    assert fingerprint_documents(none(spark)).collect() == []
    (alone,) = fingerprint_documents(spark.createDataFrame([(7, "just one")], "doc_id long, text string")).collect()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"justjust").hexdigest()


def test_hot_ids_are_cut(spark):
    top = (1 << 63) - 1
    ids = [None] * 90 + [7] * 120 + [top] * 60 + list(range(-20, 20))
    docs = spark.createDataFrame([(d, f"text {i} " + prose(i, 6)) for i, d in enumerate(ids)], "doc_id long, text string")
    hot = _hot_ids(docs, [0], 10.0)
    assert set(hot) == {None, 7, top} and hot[7] == 13
    hashed = docs.withColumn("h", F.xxhash64("text"))
    hashed = hashed.withColumn("range", _range(F.col("doc_id"), F.col("h"), [0], hot))
    rows = sorted(hashed.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    assert [r.range for r in rows] == sorted(r.range for r in rows)
    sizes = [sum(r.range == x for r in rows) for x in {r.range for r in rows}]
    assert max(sizes) < 40 and len(sizes) > 20
    got = {(r.doc_id, r.text): r.edited_sha256 for r in fingerprint_documents(docs).collect()}
    for r, after in zip(rows, [*rows[1:], rows[0]]):
        n = len(r.text)
        edited = r.text[: n - n // 2] + after.text[: n // 2]
        assert got[r.doc_id, r.text] == hashlib.sha256(edited.encode()).hexdigest()
