"""Words of UTF-8 bytes, and the places of rows in a sorted table."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20


def word_table(gaps: str) -> bytes:
    """For ``bytes.translate``: the characters of ``gaps`` become spaces and A-Z become a-z."""
    return bytes(32 if chr(i) in gaps else i + 32 if 65 <= i <= 90 else i for i in range(256))


def word_lists(text: bytes | None, table: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists of about ``PIECE`` bytes, so that a very long text is never held as words at once."""
    text = text or b""
    if len(text) <= PIECE:
        yield text.translate(table).split()
        return
    begun: list[bytes] = []
    for at in range(0, len(text), PIECE):
        piece = text[at : at + PIECE].translate(table)
        cut = piece.rfind(b" ") + 1
        if cut:
            yield b"".join([*begun, piece[:cut]]).split()
            begun = []
        begun.append(piece[cut:])
    yield b"".join(begun).split()


def bytes_of(column) -> Iterator[bytes | None]:
    """The values of an Arrow string column as UTF-8."""
    import pyarrow as pa

    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for value in column:
        yield value.as_py()


def numbered(df: DataFrame, order: list[Column], name: str, tables, keep: list[Column | str] | None = None) -> DataFrame:
    """``df``, or the columns ``keep`` of it, with a long ``name``: each row's place in ``order``, from 0.

    The rows are sorted by ranges and written. A place is then the rows in the files before plus the
    row's place in its file, so no task numbers more than its own range, and equal keys are numbered too.
    """
    placed = tables.save(df.sort(*order).select(*(keep or ["*"]))).withColumn("__mg_file", F.col("_metadata.file_name"))
    placed = placed.withColumn("__mg_row", F.col("_metadata.row_index"))
    files = placed.groupBy("__mg_file").agg((F.max("__mg_row") + 1).alias("__mg_rows"))
    # One row for each file; file names ascend with their ranges.
    before = F.sum("__mg_rows").over(W.orderBy("__mg_file").rowsBetween(W.unboundedPreceding, -1))
    files = files.select("__mg_file", F.coalesce(before, F.lit(0)).alias("__mg_before"))
    placed = placed.join(files, "__mg_file").withColumn(name, F.col("__mg_before") + F.col("__mg_row"))
    return placed.drop("__mg_file", "__mg_row", "__mg_rows", "__mg_before")
