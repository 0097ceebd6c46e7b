"""ARC archives, their conversion to WARC, and reading of either.

An archive is one row of bytes, or one gzip file in any store Spark can write to: Spark's text
writer puts each row into a file of its own and commits it only with its task, so a lost
executor leaves no half archive. Files are read back whole by Spark's binary reader; writers
here start a new archive at ``ARCHIVE_BYTES``, so a file holds that much or one record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import scratch

ARCHIVE_BYTES = 8 << 20
#: Payloads of at least this many bytes are revisited when they come again.
REVISIT_BYTES = 1000
CAPTURED = "20240101000000"
ID_HEADER = "X-Page-Id"
# Fixed values of the two formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
NO_URL = "urn:none"


def _url(url: str | None) -> str:
    return quote(url, safe="%:/?#[]@!$&'()*+,;=~") if url else NO_URL


def _http(page_id: str | None, length: int) -> bytes:
    own = "" if page_id is None else f"{ID_HEADER}: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {length}\r\n\r\n".encode()


# ---------------------------------------------------------------- ARC


def _arc_head(version: int, name: str) -> bytes:
    about = f"{version} 0 marginalia\n{ARC_FIELDS[version]}\n"
    fields = [f"filedesc://{name}", "0.0.0.0", CAPTURED, "text/plain"]
    if version == 2:
        fields += ["200", "-", "-", "0", name]
    return f"{' '.join([*fields, str(len(about))])}\n{about}".encode()


def _arc_record(version: int, name: str, offset: int, url: str, block: bytes) -> bytes:
    fields = [url, "0.0.0.0", CAPTURED, "text/html"]
    if version == 2:
        checksum = base64.b32encode(hashlib.sha1(block).digest()).decode()
        fields += ["200", checksum, "-", str(offset), name]
    return b"\n" + f"{' '.join([*fields, str(len(block))])}\n".encode() + block


def pages_to_arc(pages: DataFrame) -> DataFrame:
    """(content binary): the rows of ``pages`` (page_id, url, html) as ARC archives, versions 1 and 2 in turn.

    A null url is written as urn:none, null html as an empty page, a null page_id as a page without id.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, count, parts, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for page_id, url, html in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                version, name = 1 + (task + count) % 2, f"pages-{task:06d}-{count:06d}.arc"
                if not parts:
                    parts = [_arc_head(version, name)]
                    size = len(parts[0])
                body = (html or "").encode()
                parts.append(_arc_record(version, name, size + 1, _url(url), _http(page_id, len(body)) + body))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield pd.DataFrame({"content": [b"".join(parts)]})
                    parts, count = [], count + 1
        if parts:
            yield pd.DataFrame({"content": [b"".join(parts)]})

    # As text, since pandas makes floats of numbers with nulls among them and rounds the large ones.
    plain = pages.select(F.col("page_id").cast("long").cast("string").alias("page_id"), "url", "html")
    return plain.mapInPandas(write, "content binary")


def _arc_records(data: bytes) -> Iterator[tuple[int, dict[str, str], int, int]]:
    """(offset, header fields, start, end) of each document of an archive, by its version's header and the declared lengths."""
    at, names = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        stop = data.find(b"\n", at)
        if stop < 0:
            raise ValueError(f"ARC header at {at} has no end")
        line = data[at:stop].decode("utf-8", "replace").rstrip("\r")
        if names is None:
            if not line.startswith("filedesc://"):
                raise ValueError("an ARC archive begins with filedesc://")
            length = int(line.rsplit(" ", 1)[1])
            about = data[stop + 1 : stop + 1 + length].decode("utf-8", "replace").split("\n")
            version = int(about[0].split(" ")[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is not known")
            names = about[1].strip().split(" ") if len(about) > 1 and about[1].strip() else ARC_FIELDS[version].split(" ")
        else:
            fields = dict(zip(names, line.rsplit(" ", len(names) - 1), strict=True))
            length = int(fields["Archive-length"])
            if stop + 1 + length > len(data):
                raise ValueError(f"ARC record at {at} declares {length} bytes, more than there are")
            yield at, fields, stop + 1, stop + 1 + length
        at = stop + 1 + length


# ---------------------------------------------------------------- files


def write_archives(archives: DataFrame, path: str) -> None:
    """Write each row's ``content`` as one gzip file below ``path``."""
    # The writer ends each row with a line end, which is the last byte of every archive here.
    value = F.col("content")
    body = F.when(F.expr("right(hex(content), 2)") == "0A", F.substring(value, F.lit(1), F.length(value) - 1)).otherwise(value)
    (
        archives.select(body.cast("string").alias("value"))
        .write.option("maxRecordsPerFile", 1)
        .option("compression", "gzip")
        .option("zlib.compress.level", "BEST_SPEED")
        .option("lineSep", "\n")
        .text(path)
    )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): archive files as stored, still compressed; none for an empty folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def _plain(data: bytes) -> bytes:
    """Content without its gzip members, if it has some."""
    if data[:2] != b"\x1f\x8b":
        return bytes(data)
    parts = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        parts.append(member.decompress(data) + member.flush())
        data = member.unused_data
    return b"".join(parts)


def _payload_at(block: bytes) -> int:
    """Where the payload of an HTTP response begins; 0 for anything else."""
    end = block.find(b"\r\n\r\n") if block[:5] == b"HTTP/" else -1
    return end + 4 if end >= 0 else 0


def _header(block: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)\r?$", block[: _payload_at(block)])
    return found[1].decode("utf-8", "replace") if found else None


def _page_id(block: bytes) -> int | None:
    """The page id in a record's HTTP header, a signed 64-bit number; null without one."""
    text = _header(block, ID_HEADER)
    if text is None:
        return None
    if not re.fullmatch(r"-?[0-9]{1,19}", text) or not -(1 << 63) <= int(text) < 1 << 63:
        raise ValueError(f"{ID_HEADER} {text!r} is no signed 64-bit number")
    return int(text)


def _when(date: str) -> str:
    """A 14-digit ARC date as a WARC one; short or wrong dates are filled from the earliest possible."""
    digits = (re.sub(r"\D", "", date) + "00000101000000"[len(re.sub(r"\D", "", date)) :])[:14]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:]}Z"


def _record_id(archive: str, offset: int) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}"


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


# ---------------------------------------------------------------- conversion

def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    """``rows`` whose last number may be null; it never is a float, which would round large ones."""
    names = [c.split(" ")[0] for c in schema.split(", ")]
    out = pd.DataFrame([r[:-1] for r in rows], columns=names[:-1])
    return out.assign(**{names[-1]: pd.array([r[-1] for r in rows], dtype="Int64")})


NARROW = "path string, offset long, record_id string, url string, date string, digest string, payload_bytes long, ordinal long"


def arc_index(archives: DataFrame) -> DataFrame:
    """One row for each record of ARC ``archives`` (path, content): where it is, its WARC id, its payload's digest."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                data, rows = _plain(content), []
                for offset, fields, start, end in _arc_records(data):
                    block = data[start:end]
                    payload = block[_payload_at(block) :]
                    rows.append(
                        (path, offset, _record_id(_name(path), offset), fields["URL"], _when(fields["Archive-date"]),
                         hashlib.sha1(payload).hexdigest(), len(payload), _page_id(block))
                    )
                yield _frame(rows, NARROW)

    return archives.mapInPandas(scan, NARROW)


def _warc(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def arc_to_warc(archives: DataFrame) -> DataFrame:
    """(content): each ARC archive (path, content) as a WARC one.

    Every document becomes one record with an id made from its place, its date, address and
    digests. Of documents with equal payloads of at least ``REVISIT_BYTES``, the one with the greatest
    page id (then the greatest place) is the response; the others become revisits of it,
    which keep the HTTP header but not the payload. All smaller ones are responses.
    A header line or length that can't be read is an error, not a lost record.
    """
    tables = scratch(archives.sparkSession, "convert")
    index = tables.save(arc_index(archives))
    large = index.where(F.col("payload_bytes") >= REVISIT_BYTES)
    best = F.max(F.struct("ordinal", "path", "offset", "record_id", "url", "date")).alias("best")
    winners = large.groupBy("digest").agg(best, F.count("*").alias("n")).where("n > 1").select("digest", "best")
    revisits = large.join(winners, "digest").where(F.col("record_id") != F.col("best.record_id"))
    # At most one entry for each record of the archive.
    listed = revisits.groupBy("path").agg(
        F.collect_list(F.struct("offset", "best.record_id", "best.url", "best.date")).alias("revisits")
    )

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content, listed_ in zip(batch["path"], batch["content"], batch["revisits"], strict=True):
                name = _name(path)
                known = {} if listed_ is None else {r["offset"]: r for r in listed_}
                info = f"software: marginalia\r\nformat: WARC File Format 1.0\r\nisPartOf: {name}\r\n".encode()
                first = [
                    ("WARC-Type", "warcinfo"),
                    ("WARC-Record-ID", f"<{_record_id(name, -1)}>"),
                    ("WARC-Date", _when(CAPTURED)),
                    ("Content-Type", "application/warc-fields"),
                ]
                data, parts = _plain(content), [_warc(first, info)]
                for offset, fields, start, end in _arc_records(data):
                    block = data[start:end]
                    payload_at = _payload_at(block)
                    digest = base64.b32encode(hashlib.sha1(block[payload_at:]).digest()).decode()
                    again = known.get(offset)
                    head = [
                        ("WARC-Type", "response" if again is None else "revisit"),
                        ("WARC-Record-ID", f"<{_record_id(name, offset)}>"),
                        ("WARC-Date", _when(fields["Archive-date"])),
                        ("WARC-Target-URI", fields["URL"]),
                        ("WARC-IP-Address", fields["IP-address"]),
                        ("WARC-Payload-Digest", f"sha1:{digest}"),
                    ]
                    if again is not None:
                        block = block[:payload_at]
                        head += [
                            ("WARC-Profile", WARC_PROFILE),
                            ("WARC-Refers-To", f"<{again['record_id']}>"),
                            ("WARC-Refers-To-Target-URI", again["url"]),
                            ("WARC-Refers-To-Date", again["date"]),
                        ]
                    head.append(("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"))
                    kind = "application/http; msgtype=response" if payload_at else fields["Content-type"]
                    parts.append(_warc([*head, ("Content-Type", kind)], block))
                yield pd.DataFrame({"content": [b"".join(parts)]})

    return archives.join(listed, "path", "left").mapInPandas(convert, "content binary")


# ---------------------------------------------------------------- WARC

READ = (
    "path string, offset long, record_id string, record_type string, url string, date string, "
    "payload_digest string, payload_bytes long, refers_to_id string, page_id long"
)


def warc_records(archives: DataFrame) -> DataFrame:
    """One row for each response and revisit of WARC ``archives`` (path, content), digests checked.

    ``payload_digest`` is lower-case hex; ``payload_bytes`` is that of the full payload, for revisits too.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                data, at, rows = _plain(content), 0, []
                while data.startswith(b"WARC/", at):
                    stop = data.index(b"\r\n\r\n", at)
                    lines = data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]
                    head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
                    block = data[stop + 4 : stop + 4 + int(head["content-length"])]
                    if len(block) < int(head["content-length"]):
                        raise ValueError(f"{path}: the record at {at} is cut short")
                    kind = head["warc-type"]
                    if kind in ("response", "revisit"):
                        payload_at = _payload_at(block)
                        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:"))
                        full = len(block) - payload_at
                        if kind == "revisit":
                            full = int(_header(block, "Content-Length") or 0)
                        elif hashlib.sha1(block[payload_at:]).digest() != digest:
                            raise ValueError(f"{path}: the payload at {at} doesn't match its digest")
                        rows.append(
                            (path, at, head["warc-record-id"].strip("<>"), kind, head["warc-target-uri"], head["warc-date"],
                             digest.hex(), full, head.get("warc-refers-to", "").strip("<>") or None,
                             _page_id(block))
                        )
                    at = stop + 4 + len(block) + 4
                if at < len(data):
                    raise ValueError(f"{path}: no WARC record at {at}")
                yield _frame(rows, READ)

    return archives.mapInPandas(scan, READ)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as ARC, convert the archives to WARC, and read those back.

    One row a page: page_id, payload_bytes, payload_digest, record_type, refers_to (the page_id of
    the response a revisit refers to, else null), url, record_id, path. Null html is an empty
    payload; a null page_id comes back null and ranks below all others; rows that agree in
    page_id and payload are told apart by their place. Other columns are not archived. An empty
    table gives an empty result.
    """
    spark = pages.sparkSession
    tables = scratch(spark, "archives")
    write_archives(pages_to_arc(pages), f"{tables.root}/arc")
    write_archives(arc_to_warc(read_archives(spark, f"{tables.root}/arc")), f"{tables.root}/warc")
    records = tables.save(warc_records(read_archives(spark, f"{tables.root}/warc")))
    responses = records.where("record_type = 'response'")
    targets = responses.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    return records.join(targets, "refers_to_id", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id", "path"
    )
