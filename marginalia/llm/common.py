"""What several operators share: freed names, saved tables, word hashes, a radix search for splitters."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.scratch import Scratch

SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: Code points of the white space above, for ``translate``.
BLANKS = "\t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def freed(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that the caller is about to add (names compare as Spark's do)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def scratch(spark: SparkSession, label: str) -> Scratch:
    return Scratch(spark, label)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


# ---------------------------------------------------------------- splitters


def splitters(
    keyed: DataFrame, targets: list[float], tolerance: float, bits: int = 8
) -> list[int]:
    """Boundaries b_1 <= b_2 .. such that the weight of keys below b_i is within ``tolerance`` of target i.

    ``keyed`` has a long ``key`` and a long ``weight`` and should be a saved table, as every
    round scans it. A round counts the exact weights below 2**bits candidate boundaries in each
    bracket that is still too wide, so it returns at most len(targets) * 2**bits rows, and
    there are at most 64 / bits rounds. A key is never cut: if one key is heavier than the
    tolerance, the nearer of its two sides is taken.
    """
    ends = keyed.agg(F.min("key").alias("lo"), F.max("key").alias("hi")).first()
    if ends.lo is None:
        return [0] * len(targets)
    if (ends.lo < 0) == (ends.hi < 0):
        shift = (ends.lo ^ ends.hi).bit_length()
    else:
        shift = 1 + max(ends.lo.bit_length(), ends.hi.bit_length())
    prefixes: dict[int, int] = {}
    # Of each prefix under refinement: the weight of all keys before it.
    found: list[int | None] = [None] * len(targets)
    closest = [(float("inf"), 0)] * len(targets)
    first = True
    while True:
        old, shift = shift, max(0, shift - bits)
        rows = keyed
        if not first:
            rows = rows.where(F.shiftright("key", old).isin(list(prefixes)))
        counted = (
            rows.groupBy(F.shiftright("key", shift).alias("prefix"))
            .agg(F.sum("weight").alias("weight"))
            .collect()  # at most 2**bits rows for each target
        )
        parts: dict[int, list[tuple[int, int]]] = {}
        for prefix, weight in sorted((r.prefix, r.weight) for r in counted):
            parts.setdefault(0 if first else prefix >> (old - shift), []).append((prefix, weight))
        starts = {0: 0} if first else prefixes
        edges: list[tuple[int, int, int]] = []  # weight before, prefix, weight
        for parent in sorted(parts):
            before = starts[parent]
            for prefix, weight in parts[parent]:
                edges.append((before, prefix, weight))
                before += weight
        prefixes, first = {}, False
        ends_at = [before + weight for before, _, weight in edges]
        for i, target in enumerate(targets):
            if found[i] is not None:
                continue
            at = min(bisect_left(ends_at, target), len(edges) - 1)
            before, prefix, weight = edges[at]
            for gap, boundary in ((abs(target - before), prefix), (abs(before + weight - target), prefix + 1)):
                closest[i] = min(closest[i], (gap, boundary << shift))
            if closest[i][0] <= tolerance or not shift:
                found[i] = closest[i][1]
            else:
                prefixes[prefix] = before
        if not prefixes:
            top = (1 << 63) - 1
            return [min(b, top) for b in found]  # type: ignore[misc, type-var]


# ---------------------------------------------------------------- words in numpy

#: Bytes of text that are hashed at once; the arrays for it take some 40 times as much.
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
GAP = np.zeros(256, dtype=bool)
GAP[[32, *range(9, 14)]] = True
#: Bytes that are neither letters nor digits; those of other alphabets count as letters.
MARKS = np.array([not (i >= 128 or chr(i).isalnum()) for i in range(256)])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(_BASE, CHUNK + 1)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64), CHUNK + 1)


def word_spans(data: np.ndarray, gap: np.ndarray = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes; ``gap`` says which bytes are between words."""
    inside = np.concatenate(([False], ~gap[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes; A-Z count as a-z. Spans don't overlap and ascend."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        first = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, first + CHUNK, side="right")))
        if ends[to - 1] - first > CHUNK:  # one word longer than a chunk
            value, word = np.uint64(0), data[first : ends[at]]
            for cut in range(0, len(word), CHUNK):
                piece = _BYTES[_LOWER[word[cut : cut + CHUNK]]]
                with np.errstate(over="ignore"):
                    value = mixed(np.array([value]))[0] + (piece * _POWERS[: len(piece)]).sum(dtype=np.uint64)
            out[at] = value
        else:
            piece = _BYTES[_LOWER[data[first : ends[to - 1]]]]
            sums = np.concatenate(([np.uint64(0)], np.cumsum(piece * _POWERS[: len(piece)], dtype=np.uint64)))
            a, b = starts[at:to] - first, ends[at:to] - first
            out[at:to] = (sums[b] - sums[a]) * _INVERSE[a]
        at = to
    lengths = (ends - starts).astype(np.uint64)
    return mixed(out + lengths * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all runs of ``width`` words; of the whole sequence if it is shorter; none without words."""
    if not len(words):
        return words
    n = min(width, len(words))
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for j in range(n):
        out = out * np.uint64(_BASE) + words[j : len(words) - n + 1 + j]
    return mixed(out + np.uint64(n))


def tidy() -> None:
    """Give memory that is free back to the system, as Spark keeps Python workers for later tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def strings(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of an Arrow string column; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer else np.zeros(0, dtype=np.uint8)
    return data, offsets.astype(np.int64)


def text_words(data: np.ndarray, offsets: np.ndarray, letters: bool = False):
    """For each text: the hashes of its words, or of its runs of letters and digits.

    Works on runs of whole texts of about a chunk.
    """
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        part = data[offsets[i] : offsets[j]]
        bounds = offsets[i : j + 1] - offsets[i]
        # A word must not run over the end of a text, so each text is given its own gap.
        if j - i > 1:
            keep = np.ones(len(part) + j - i - 1, dtype=bool)
            keep[bounds[1:-1] + np.arange(j - i - 1)] = False
            spread = np.full(len(keep), 32, dtype=np.uint8)
            spread[keep] = part
            part, bounds = spread, bounds + np.arange(j - i + 1)
        starts, ends = word_spans(part, MARKS if letters else GAP)
        hashes = span_hashes(part, starts, ends)
        cuts = np.searchsorted(starts, bounds)
        for k in range(j - i):
            yield hashes[cuts[k] : cuts[k + 1]]
        i = j
