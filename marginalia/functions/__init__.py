"""Column expressions. All of them are built from Spark's own functions."""

from marginalia.functions.frontmatter import build_front_matter, parse_front_matter
from marginalia.functions.markdown import strip_markdown
from marginalia.functions.names import is_timestamp_name, sanitize_name, timestamp_name
from marginalia.functions.paths import (
    ancestors,
    basename,
    dirname,
    is_under,
    normalize_path,
    note_name,
    rewrite_prefix,
)
from marginalia.functions.text import add_tag, preview, truncate

__all__ = [
    "add_tag",
    "ancestors",
    "basename",
    "build_front_matter",
    "dirname",
    "is_timestamp_name",
    "is_under",
    "normalize_path",
    "note_name",
    "parse_front_matter",
    "preview",
    "rewrite_prefix",
    "sanitize_name",
    "strip_markdown",
    "timestamp_name",
    "truncate",
]
