"""How a store lays out its notes: buckets by folder, the folders that hold most cut by path."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of notes that a bucket of a new store is meant to hold, and the fewest buckets.
BUCKET_BYTES = 64 << 20
FEWEST = 16
#: Notes that a folder may hold in one bucket whatever its share.
HOT_NOTES = 10_000


@dataclass(frozen=True)
class Layout:
    """``buckets`` in all; ``hot`` has the folders that lie in more than one, with how many."""

    buckets: int
    hot: dict[str, int] = field(default_factory=dict)

    def bucket(self, folder: Column, path: Column) -> Column:
        return F.pmod(F.xxhash64(folder) + F.pmod(F.xxhash64(path), self.width(folder)), F.lit(self.buckets)).cast("int")

    def width(self, folder: Column) -> Column:
        """How many buckets a folder lies in."""
        if not self.hot:
            return F.lit(1)
        widths = F.create_map(*[F.lit(x) for entry in sorted(self.hot.items()) for x in entry])
        return F.coalesce(F.try_element_at(widths, folder), F.lit(1))

    def of_folder(self, folder: Column) -> Column:
        """All buckets of a folder."""
        steps = F.sequence(F.lit(0), self.width(folder) - 1)
        return F.transform(steps, lambda i: F.pmod(F.xxhash64(folder) + i, F.lit(self.buckets)).cast("int"))


def plan_layout(notes: DataFrame, buckets: int | None = None, hot_notes: int = HOT_NOTES) -> Layout:
    """A layout for ``notes``. A folder with more than a bucket's share of them is cut by path.

    Fewer than half as many folders as there are buckets can hold two shares, so ``hot`` is no
    longer than that.
    """
    rows, size = notes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = buckets or max(FEWEST, -(-size // BUCKET_BYTES))
    share = max(-(-rows // buckets), hot_notes)
    counted = notes.groupBy("folder").agg(F.count("*").alias("n")).filter(F.col("n") >= 2 * share)
    return Layout(buckets, {row.folder: min(buckets, -(-row.n // share)) for row in counted.collect()})
