"""Numbering inside groups of any size, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 10_000
# Quantiles of an order that are looked at, however many rows it has.
QUANTILES = 200
# Where blocks begin, and how wide they are from there on.
Blocks = Sequence[tuple[int, int]]


def ordinal_within(
    df: DataFrame, keys: Sequence[str], order: str, out: str, block: int | Blocks = BLOCK
) -> DataFrame:
    """Number rows 1, 2, ... within ``keys`` by ``order``, a unique integer column.

    Values of ``order`` are cut into blocks, so no window holds more rows of a group
    than a block has numbers; the count of each block's predecessors is added on.
    For an order with gaps, ``order_blocks`` gives wider blocks.
    """
    keys = list(keys)
    blocked = df.withColumn("_block", _block_of(F.col(order), block))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        blocked.groupBy(*keys, "_block")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    return (
        blocked.withColumn("_place", F.row_number().over(inside))
        .join(offsets, [*keys, "_block"])
        .withColumn(out, F.col("_place") + F.col("_offset"))
        .drop("_block", "_place", "_offset")
    )


def _block_of(order: Column, block: int | Blocks) -> Column:
    """A name for the block of a number; blocks sort like their numbers."""
    if isinstance(block, int):
        return F.call_function("div", order, F.lit(block))
    starts = F.array(*[F.lit(start) for start, _ in block])
    widths = F.array(*[F.lit(width) for _, width in block])
    at = F.greatest(F.size(F.filter(starts, lambda s: s <= order)), F.lit(1))
    return F.struct(at.alias("run"), F.call_function("div", order, F.element_at(widths, at)).alias("part"))


def order_blocks(df: DataFrame, order: str) -> Blocks:
    """Blocks of about ``BLOCK`` rows of ``df`` for ``ordinal_within``.

    Widths follow the quantiles of ``order``, so a number far from all others makes no
    block wider but its own. Up to ``QUANTILES`` blocks hold ``BLOCK`` rows; of more
    rows than that, each quantile is cut into blocks by its own average gap.
    """
    rows = df.agg(F.count(order)).first()[0]
    pieces = max(1, min(QUANTILES, -(-2 * rows // BLOCK)))
    marks = [i / pieces for i in range(pieces + 1)]
    found = df.agg(F.percentile_approx(order, marks, 100 * QUANTILES)).first()[0]
    if not found:
        return [(0, BLOCK)]
    starts = sorted(set(found))
    each = max(1, rows // pieces)
    ends = [*starts[1:], starts[-1] + 1]
    blocks = -(-each // BLOCK)
    return [(start, min(1 << 62, max(1, -(-(end - start) // blocks)))) for start, end in zip(starts, ends)]


def free_numbers(
    requests: DataFrame,
    used: DataFrame,
    keys: Sequence[str],
    ordinal: str = "ordinal",
    out: str = "n",
    block: int = BLOCK,
) -> DataFrame:
    """Give request number ``ordinal`` of each group the ordinal-th smallest free number.

    ``used`` has ``keys`` and ``n``. With u numbers used and k asked for, none
    beyond u + k is needed, so the numbers up to there are looked at in blocks:
    a block's free numbers are those missing from its used ones, and the blocks
    before it say at which ordinal they start.
    """
    keys = list(keys)
    asked = requests.groupBy(*keys).agg(F.max(ordinal).alias("_asked"))
    taken = (
        used.filter(F.col("n") >= 1)
        .select(*keys, "n")
        .distinct()
        .withColumn("_block", F.floor((F.col("n") - 1) / block))
    )
    limits = (
        asked.join(taken.groupBy(*keys).agg(F.count("*").alias("_used")), keys, "left")
        .withColumn("_limit", F.col("_asked") + F.coalesce("_used", F.lit(0)))
        .drop("_used")
    )
    last_block = F.floor((F.col("_limit") - 1) / block)
    blocks = limits.withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("bigint"), last_block))
    )
    first = F.col("_block") * block + 1
    last = F.least((F.col("_block") + 1) * block, F.col("_limit"))
    bounded = taken.join(limits.select(*keys, "_limit"), keys).filter("n <= _limit")
    counts = bounded.groupBy(*keys, "_block").agg(F.count("*").alias("_in_block"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    free = last - first + 1 - F.coalesce("_in_block", F.lit(0))
    placed = (
        blocks.join(counts, [*keys, "_block"], "left")
        .withColumn("_before", F.coalesce(F.sum(free).over(before), F.lit(0)))
        .filter("_before < _asked")
    )
    members = bounded.groupBy(*keys, "_block").agg(F.collect_set("n").alias("_members"))
    missing = F.array_except(
        F.sequence(first, last), F.coalesce("_members", F.array().cast("array<bigint>"))
    )
    offered = (
        placed.join(members, [*keys, "_block"], "left")
        .select(*keys, "_before", F.posexplode(missing).alias("_pos", out))
        .select(*keys, (F.col("_before") + F.col("_pos") + 1).alias(ordinal), out)
    )
    return requests.join(offered, [*keys, ordinal])
