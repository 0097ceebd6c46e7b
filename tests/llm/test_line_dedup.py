from cases import none, odd_docs

from marginalia.llm.line_dedup import dedup_lines


def brute(rows):
    """Sequential model: documents in order, later windows cover their lines."""
    docs = sorted({(r.doc_id, r.text) for r in rows if r.text is not None}, key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    first, out = {}, {}
    for doc in docs:
        lines = doc[1].split("\n")
        covered = set()
        for at in range(len(lines) - 2):
            window = tuple(lines[at : at + 3])
            where = first.setdefault(window, (doc, at))
            if where[0] != doc or at >= where[1] + 3:
                covered |= {at, at + 1, at + 2}
        out[doc] = ("\n".join(x for i, x in enumerate(lines) if i not in covered), covered)
    return out


def test_matches_the_model(spark):
    texts = ["a\nb\nc\nd", "x\na\nb\nc\ny\nb\nc\nd\nz", "a\nb\nc", "q\nq\nq\nq\nq\nq\nq", "1\n2\n3\n4\n5\n1\n2\n3\n2\n3\n4", "only\ntwo", "", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(docs.collect())
    for r, text in ((r, t) for r in dedup_lines(docs).collect() for t in [texts[r.doc_id]]):
        cleaned, covered = want[(r.doc_id, text)]
        assert r.text == cleaned
        assert {i for s in r.removed_spans for i in range(s.start, s.end)} == covered
        assert r.n_removed == len(covered) and r.n_lines == len(text.split("\n"))
        spans = [(s.start, s.end) for s in r.removed_spans]
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = dedup_lines(docs).collect()
    assert len(rows) == 18
    by_id = {r.doc_id: r for r in rows}
    assert by_id[3].text is None and by_id[3].n_lines == 0
    assert by_id[4].text == "" and by_id[4].n_lines == 1
    assert by_id[12].text == "line\nline\nline" and by_id[12].n_chars == 14
    assert [r.text for r in rows if r.doc_id == 1][0].count("\n") > 3
    assert [r.n_removed for r in rows if r.doc_id == 2] == [7, 7]
    assert dedup_lines(none(spark)).collect() == []
