"""Whitespace, truncation and preview expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Preview length in code points and the marker of a cut preview.
PREVIEW_CHARS = 1000
ELLIPSIS = "..."

# The characters that count as blank in note text, and the set
# that counts as blank in rendered (plain) text.
UNICODE_BLANKS = (
    "\t\n\x0b\x0c\r \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
RENDERED_BLANKS = UNICODE_BLANKS.replace("\u0085", "") + "\ufeff"


def trim_blanks(text: Column) -> Column:
    """Strip Unicode whitespace from both ends (``trim()`` strips only spaces)."""
    return F.btrim(text, F.lit(UNICODE_BLANKS))


def truncate(text: Column, n: int) -> Column:
    """``struct(text, truncated)``: at most ``n`` code points of ``text``."""
    if n <= 0:
        return F.struct(F.lit("").alias("text"), F.lit(False).alias("truncated"))
    return F.struct(
        F.left(text, F.lit(n)).alias("text"), (F.length(text) > n).alias("truncated")
    )


def preview(body: Column) -> Column:
    """The first 1000 code points of the trimmed body, marked when cut."""
    cut = truncate(trim_blanks(body), PREVIEW_CHARS)
    return F.concat(cut["text"], F.when(cut["truncated"], ELLIPSIS).otherwise(""))


def add_tag(tags: Column, tag: Column) -> Column:
    """Append a trimmed, non-empty tag unless it is already present."""
    clean = trim_blanks(tag)
    keep = clean.isNull() | (clean == "") | F.array_contains(tags, clean)
    return F.when(keep, tags).otherwise(F.array_append(tags, clean))
