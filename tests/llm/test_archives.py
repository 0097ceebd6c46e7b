import hashlib

import pytest
from cases import prose

from marginalia.llm import archives
from marginalia.llm.archives import _arc_records, _when, archive_pages, pages_to_arc

SCHEMA = "page_id long, url string, html string"


def brute(rows):
    best = {}
    for i, (page, _, html) in enumerate(rows):
        body = (html or "").encode()
        if len(body) >= 1000:
            best[body] = max(best.get(body, ((False, 0), -1)), ((page is not None, page or 0), i))
    out = []
    for i, (page, _, html) in enumerate(rows):
        body = (html or "").encode()
        again = body in best and best[body][1] != i
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", rows[best[body][1]][0] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("archive_bytes", [1 << 20, 3000])
def test_round_trip(spark, monkeypatch, archive_bytes):
    monkeypatch.setattr(archives, "ARCHIVE_BYTES", archive_bytes)
    big = "<p>" + prose(1, 300) + "</p>"
    rows = [(i, f"http://x.example/{i}?a b", prose(i, 5 + 40 * (i % 9)) + "\r\n\r\nWARC/1.0\n\n") for i in range(60)]
    rows += [(100 + i, None, big) for i in range(20)] + [(200, "u", None), (201, "u", ""), (202, "u", "é\n\x00" * 400), (203, "", "small"), (204, "x", "small")]
    rows += [(None, "n", "nobody"), (None, "n", big)]
    pages = spark.createDataFrame(rows, SCHEMA).withColumn("path", archives.F.lit("clash")).repartition(4)
    found = archive_pages(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows)


def test_repeated_rows_and_no_rows(spark):
    big = prose(2, 400)
    found = archive_pages(spark.createDataFrame([(5, "u", big)] * 3 + [(4, "u", big)], SCHEMA)).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in found if r.record_type == "revisit") == [(4, "revisit", 5)] + [(5, "revisit", 5)] * 2
    assert archive_pages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_versions_by_header(spark, monkeypatch):
    monkeypatch.setattr(archives, "ARCHIVE_BYTES", 1)
    contents = [bytes(r.content) for r in pages_to_arc(spark.createDataFrame([(i, "http://a/", "body") for i in range(4)], SCHEMA).coalesce(1)).collect()]
    fields = [next(_arc_records(c))[1] for c in contents]
    assert ["Checksum" in f for f in fields] == [False, True, False, True]
    with pytest.raises(ValueError, match="declares"):
        list(_arc_records(contents[0][:-1]))
    with pytest.raises(ValueError, match="filedesc"):
        list(_arc_records(b"http://a/ 0.0.0.0 20240101000000 text/html 3\nabc"))


def test_dates():
    assert _when("20240315123045") == "2024-03-15T12:30:45Z"
    assert _when("2024") == "2024-01-01T00:00:00Z"


def test_least_and_greatest_page_ids(spark):
    """Also next to null ids, where a float would round them."""
    big = prose(3, 400)
    ids = [-(1 << 63), (1 << 63) - 1, (1 << 63) - 2, 10**18, 1 - 10**18, (1 << 53) + 1, 7, None]
    rows = [(i, "u", prose(n, 20)) for n, i in enumerate(ids)] + [(i, "u", big) for i in ids]
    pages = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    found = archive_pages(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows)
    assert {r.refers_to for r in found if r.record_type == "revisit"} == {(1 << 63) - 1}


def test_a_page_id_that_is_no_long():
    head = b"HTTP/1.1 200 OK\r\nX-Page-Id: %s\r\n\r\n"
    assert archives._page_id(head % b"-9223372036854775808") == -(1 << 63)
    assert archives._page_id(b"HTTP/1.1 200 OK\r\n\r\n") is None
    for wrong in (b"9223372036854775808", b"-9223372036854775809", b"1e5", b"", b"12345678901234567890"):
        with pytest.raises(ValueError, match="X-Page-Id"):
            archives._page_id(head % wrong)
