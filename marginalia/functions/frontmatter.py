"""The tag header at the top of a note file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import trim_blanks

# The header format.
HEADER = r"(?s)\A---\r?\n(|.*?\n)---\r*(?:\n|\z)"
TAG_LINE = r"(?:\A|\n)tags:([^\n]*)"
QUOTES = "\"'"
FENCE = "---"
# Short escapes inside a quoted tag.
SHORT_ESCAPES = {
    "\\": "\\\\", '"': '\\"', "\x07": "\\a", "\b": "\\b", "\x0c": "\\f",
    "\n": "\\n", "\r": "\\r", "\t": "\\t", "\x0b": "\\v",
}
UNPRINTABLE = r"[^\p{L}\p{M}\p{N}\p{P}\p{S} ]"


def parse_front_matter(raw: Column) -> Column:
    """``struct(tags, body)`` of a note file.

    The pattern is anchored and lazy, so its cost follows the header, not the
    body. Without a closed header the whole text is the body.
    """
    fenced = F.startswith(raw, F.lit(FENCE))
    header = F.when(fenced, F.regexp_extract(raw, HEADER, 0)).otherwise("")
    inner = F.when(fenced, F.regexp_extract(raw, HEADER, 1)).otherwise("")
    body = F.when(fenced, F.substring(raw, F.length(header) + 1, F.length(raw))).otherwise(raw)
    return F.struct(_tags(inner).alias("tags"), body.alias("body"))


def _tags(inner: Column) -> Column:
    value = trim_blanks(F.regexp_extract(inner, TAG_LINE, 1))
    value = F.regexp_replace(value, r"\A\[", "")
    value = F.regexp_replace(value, r"\]\z", "")
    cleaned = F.transform(F.split(value, ","), lambda t: F.btrim(trim_blanks(t), F.lit(QUOTES)))
    return F.filter(cleaned, lambda t: t != "")


def quote_tag(tag: Column) -> Column:
    """A double-quoted tag with escapes for quotes, backslashes and unprintable characters."""
    plain = F.replace(F.replace(tag, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escaped = F.array_join(F.transform(F.split(tag, ""), _escape_char), "")
    text = F.when(F.rlike(tag, F.lit(UNPRINTABLE)), escaped).otherwise(plain)
    return F.concat(F.lit('"'), text, F.lit('"'))


def _escape_char(char: Column) -> Column:
    out = None
    for raw, short in SHORT_ESCAPES.items():
        out = F.when(char == raw, short) if out is None else out.when(char == raw, short)
    code = F.ascii(char)
    digits = F.lower(F.hex(code))
    return (
        out.when(~F.rlike(char, F.lit(UNPRINTABLE)), char)
        .when(code < 0x80, F.concat(F.lit("\\x"), F.lpad(digits, 2, "0")))
        .when(code < 0x10000, F.concat(F.lit("\\u"), F.lpad(digits, 4, "0")))
        .otherwise(F.concat(F.lit("\\U"), F.lpad(digits, 8, "0")))
    )


def build_front_matter(tags: Column) -> Column:
    """The header text for ``tags``; empty when there are none."""
    listed = F.array_join(F.transform(tags, quote_tag), ", ")
    block = F.concat(F.lit("---\ntags: ["), listed, F.lit("]\n---\n"))
    return F.when(F.size(tags) > 0, block).otherwise("")
